"""Queries on copies of their tables: rows over tasks, work shared by equal rows, results of SQL where small tables do not differ."""

import hashlib
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from corpuscraft import plans
from corpuscraft.functions import algebra, draws, exact, questions
from corpuscraft.operators.shared import Scratch
from corpuscraft.plans import curriculum

from .conftest import SF
from .test_queries import rows_of


def same_as_sql(spark, folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    want = con.sql(plans.oracle_sql()[name])
    got = plans.queries()[name](spark, folder)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["identity_evidence", "identity_proof", "folded_forms", "grade_outcomes", "graded_responses", "gate_classes", "arm_judgements", "question_validity", "perturbation_grid", "story_bundles"])
def test_python_work_of_one_file_is_spread(spark, name):
    assert spark.read.parquet(f"{SF}/part.parquet").rdd.getNumPartitions() == 1
    assert plans.queries()[name](spark, SF).rdd.getNumPartitions() >= 4


def counted(x):
    CALLS.append(x)
    return {"v": x}


CALLS: list = []


def test_equal_rows_share_a_result():
    again = [exact.kept(counted)(x) for x in ("a", "b", "a", "a")]
    assert [r["v"] for r in again] == ["a", "b", "a", "a"] and CALLS == ["a", "b"]
    made = [(lambda k: lambda x: {"v": x + k})(k) for k in "xy"]  # functions with values of their own are not taken for each other
    assert [exact.kept(f)("a")["v"] for f in made] == ["ax", "ay"]


def test_questions_are_folded_once(spark, tmp_path):
    spark.range(0, 360).selectExpr("id as p_partkey", "int(id % 50 + 1) as p_size").write.parquet(f"{tmp_path}/part.parquet")
    same_as_sql(spark, str(tmp_path), "reference_bank", "part")
    spark.range(0, 360).selectExpr("id as p_partkey", "int(id % 50 + 1) as p_size").union(spark.read.parquet(f"{tmp_path}/part.parquet")).write.parquet(f"{tmp_path}/twice/part.parquet")
    same_as_sql(spark, f"{tmp_path}/twice", "reference_bank", "part")  # a key that comes twice is two rows


def test_misconceptions_told_apart_as_in_sql(spark, tmp_path):
    """Values that differ by less than 1e-9: (22/23) (1/23)**8 and nine times that."""
    spark.range(0, 4000).selectExpr("id as p_partkey", "22 as p_size").write.parquet(f"{tmp_path}/part.parquet")
    same_as_sql(spark, str(tmp_path), "misconception_audit", "part")
    assert curriculum.Q.traps("binomial", {"n": "9", "r": "8", "p": "1/23"})[0]["collides"] is False  # exact elsewhere


def test_regrade_names_its_ids(spark):
    rows = plans.queries()["regrade_audit"](spark, SF).collect()
    assert rows and all(len([x for x in r["ids"].split(",") if x]) == r["newly_credited"] for r in rows)
    assert all((r["ids_sha"] is None) == (r["ids"] == "") for r in rows)


def test_bootstrap_draws_in_arrays_are_those_in_sql(spark):
    rows = spark.range(400).selectExpr("id", "int(pow(1.04, id)) - 1 as n", "(id * 37 % 101) / 100.0D as p")
    u = draws.uniform(F.lit("t"), F.col("id"))
    for r in rows.select("n", "p", u.alias("u"), draws.binomial(F.col("n").cast("long"), F.col("p"), u).alias("k")).collect():
        assert draws.count_of(r["n"], r["p"], r["u"]) == r["k"], r


class State:
    """State that counts its messages."""

    def __init__(self):
        self.messages, self.values, self.timers, self.total = 0, {}, [], None

    getValueState = getMapState = lambda self, name, *schema: Held(self, name)

    def registerTimer(self, at):
        self.messages += 1
        self.timers.append(at)


class Held:
    def __init__(self, state, name):
        self.state, self.name, self.of = state, name, state.values.setdefault(name, {})

    def said(self, value=None):
        self.state.messages += 1
        return value

    exists = lambda self: self.said(None in self.of)
    get = lambda self: self.said(self.of[None])
    update = lambda self, v: self.said(self.of.__setitem__(None, v))
    containsKey = lambda self, k: self.said(k in self.of)
    getValue = lambda self, k: self.said(self.of[k])
    updateValue = lambda self, k, v: self.said(self.of.__setitem__(k, v))
    iterator = lambda self: self.said(iter(list(self.of.items())))


class At:
    def __init__(self, at):
        self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: at


def test_a_ledger_reads_and_writes_its_state_once():
    from pyspark.sql import Row

    from corpuscraft.streaming.ledger import Ledger

    row = Row("account", "seq", "event_time", "at", "kind", "tag", "cost")
    machine, state = Ledger(50, 1e9, 1, 100), State()
    machine.init(state)
    rows = [row(1, k, None, 10 * k, "request" if k < 4 else "failure", k % 4, 1.0) for k in range(60)]
    said = list(machine.handleInputRows((1,), iter(rows), At(0)))
    assert [r["outcome"] for r in said][:8] == ["started"] * 4 + ["failure"] * 4 and len(said) == 60
    assert state.messages <= 3 + 4 + 1
    late = [row(1, 100 + k, None, 1000 + 50 * k, "request", 10 + k, 1.0) for k in range(3)]
    assert [r["outcome"] for r in machine.handleInputRows((1,), iter(late), At(0))] == ["started"] * 3 and state.timers[-1] == 1100
    assert [r["tag"] for r in machine.handleExpiredTimer((1,), At(1150), At(1150))] == [10, 11] and state.timers[-1] == 1200  # all that are due, then the next
    assert [r["tag"] for r in machine.handleExpiredTimer((1,), At(1200), At(1200))] == [12]


def test_responses_to_every_category_are_graded(spark):
    asked = {r["p_partkey"]: r["category"] for r in plans.queries()["question_texts"](spark, SF).select("p_partkey", "category").collect()}
    rows = plans.queries()["graded_responses"](spark, SF).collect()
    assert len(rows) == len(asked) and {asked[r["p_partkey"]] for r in rows} == set(questions.CATEGORIES)
    assert all(r["outcome"] == "accepted" and r["bindings_match"] for r in rows if r["p_partkey"] % 8 == 2)
    # a bare answer, and a misconception that happens to be right, are correct where a reviewed structure is no more than that (keys
    # of one parity have categories of that parity)
    assert {asked[r["p_partkey"]] for r in rows if r["p_partkey"] % 8 == 6 and r["primary_correct"]} == {"poisson_variance"}
    assert {asked[r["p_partkey"]] for r in rows if r["p_partkey"] % 8 == 3 and r["primary_correct"]} == {"process_variance"}
    grade = lambda raw, c, **s: algebra.grade("Expression: " + raw, c, json.dumps(s), "minutes")["outcome"]
    assert grade("3/4", "process_variance", rate="1", duration="3/4") == grade("2/3", "interval", lower="-2", upper="2", divisor="3") == grade("(1/23)**(0)*(1-(1/23))**((3)-(0))", "binomial", n="3", r="0", p="1/23") == "accepted"
    assert grade("(1)*(5)", "moment_variance", mean="1/23", variance="5", scale="1") == grade("(1)*((2)*(1/4))", "process_scaled", rate="2", duration="1/4", scale="1") == "equivalence_pending"


def test_an_audit_shuffles_no_whole_records(spark):
    """No shuffle of the audit holds a record's raw text, digests as text or receipts; values that many records repeat are told."""
    from corpuscraft.operators import evidence

    plan = spark.createDataFrame([(p, 0, f"q{p}", "1") for p in range(40)], "packet long, place int, id string, expected string")
    raw = [json.dumps({"items": [{"id": f"q{p}", "answer": "1"}]}) for p in range(40)]
    rows = spark.createDataFrame(
        [(p + 1, p, 0, f"packet_{p:03d}_attempt_0", [f"q{p}"], raw[p], hashlib.sha256(raw[p].encode()).hexdigest(), f"r{p // 2 if p > 35 else p}", [1.0], 1.0, [(f"q{p}", True)]) for p in range(40)],
        "seq long, packet long, attempt long, tag string, requested array<string>, raw string, response_sha string, response_id string, receipts array<double>, cost double, decisions array<struct<id:string,accepted:boolean>>",
    ).withColumn("digest", evidence.body_digest())
    back = rows.select((F.col("seq") + 1).alias("seq"), F.col("digest").alias("previous"))
    ledger = Scratch(spark, "test").put(rows.drop("digest").join(back, "seq", "left"), "ledger")
    found = evidence.audit(ledger, plan)
    assert sorted(map(tuple, found.collect())) == [(s, "response_id") for s in (19, 20, 37, 38, 39, 40)]
    shuffled, todo = [], [evidence.audit(ledger, plan)._jdf.queryExecution().executedPlan().initialPlan()]
    while todo:
        x = todo.pop()
        todo += [x.children().apply(i) for i in range(x.children().size())]
        shuffled += [x.output().mkString(" ")] if x.nodeName() == "Exchange" else []
    assert shuffled and not any(c in x for x in shuffled for c in ("raw#", "response_sha#", "receipts#"))
