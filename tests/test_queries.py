"""Every query with a SQL text gives that text's rows in DuckDB."""

import math

import duckdb
import pytest

from corpuscraft import plans
from corpuscraft.plans.sequences import free_keys

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if str(type(v)).find("bool") >= 0:
        return bool(v)
    return None if math.isnan(float(v)) else float(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(plans.oracle_sql()[name])
    got = plans.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())


def test_greedy_near_duplicates(spark):
    rows = {r["id"]: r["kept"] for r in plans.queries()["near_dup_greedy"](spark, SF).collect()}
    assert len(rows) == 54 and all(v is not None for v in rows.values())
    assert all(rows[i] for i in range(40)) and not any(v for i, v in rows.items() if i >= 10_000)


def test_free_keys_beyond_many_blocked_ones(spark):
    ids = spark.range(10_000).selectExpr("id as key")
    rows = free_keys(ids, 100).collect()
    assert len({r["key"] for r in rows}) == 100 and all(r["key"] >= 10_000 for r in rows)
    assert [r["draw"] for r in rows] == sorted(r["draw"] for r in rows)
    assert free_keys(ids, 6000).count() == 6000  # more than one round
    with pytest.raises(ValueError, match="free keys"):
        free_keys(ids, 10_001)
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id")
    got = plans.queries()["rejection_sampling"](spark, "/root/testdata/sf0.1")
    assert got.count() == 100 and got.join(documents, got["key"] == documents["doc_id"]).count() == 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
