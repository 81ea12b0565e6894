"""Expressions, envelopes, grading, sources and contracts on small literals."""

import base64
import gzip
import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscraft.functions import domain, exact, text
from corpuscraft.operators import core
from corpuscraft.sources import archives, documents


@pytest.mark.parametrize(
    ("expression", "value"),
    [("1/3+1/6", "1/2"), ("2**-2", "1/4"), ("comb(5,2)*(1/2)**5", "5/16"), ("gcd(12,18)", "6"), ("-(3-5)", "2"), ("1/0", None), ("__import__('os')", None), ("2**99", None), ("1.5+1", None), ("comb(2,3)", None), ("", None), ("a+1", None), ("9" * 2000, None), ("True+1", None)],
)
def test_evaluate(expression, value):
    found = exact.evaluate(expression)
    assert found["value"] == value and (found["error"] is None) == (value is not None)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=2, max_size=5), st.randoms())
def test_form_ignores_order(numbers, random):
    shuffled = numbers[:]
    random.shuffle(shuffled)
    a, b = (exact.evaluate("+".join(f"({x})" for x in xs)) for xs in (numbers, shuffled))
    assert a["form"] == b["form"] and a["value"] == str(sum(numbers))


def test_envelope():
    good = '{"answers":[{"question_id":"a","expression":"1"}]}'
    assert exact.read_envelope(good, ["a"])["ok"]
    assert exact.read_envelope(good + "}", ["a"])["repairs"] == ["closing brace"]
    assert exact.read_envelope('{"required_response":' + good + "}", ["a"])["repairs"] == ["unwrapped"]
    for bad in ('{"answers":[],"answers":[]}', good + " trailing", '{"answers":[{"question_id":"a"}]}', good.replace("1", "<x>"), good.replace('"a"', '"b"'), "", None):
        assert not exact.read_envelope(bad, ["a"])["ok"]


def test_judge_is_three_valued():
    assert exact.judge("2+1", "1+2")["correct"] is True
    assert exact.judge("4-1", "1+2")["correct"] is None
    assert exact.judge("5", "1+2")["correct"] is False
    assert exact.judge(None, "1")["outcome"] == "non_executable_or_format"


def test_text_columns(spark):
    df = spark.createDataFrame([("Ünï -- Code_1",), ("One. Two. Three.",), (None,)], "x string")
    assert [r[0] for r in df.select(text.normalize_unicode(F.col("x"))).collect()] == ["ünï code_1", "one two three", None]
    assert df.select(text.substring_after_last_sentence(F.col("x"))).collect()[1][0] == "Three. One. Two."
    assert df.select(text.comb_notation(F.lit("C (3,1)+C(2,1)"))).first()[0] == "comb(3,1)+comb(2,1)"


def test_mcnemar_and_holm(spark):
    p = spark.createDataFrame([(12, 15), (0, 0), (10, 0)], "gains int, losses int").select(domain.mcnemar(F.col("gains"), F.col("losses")).alias("p")).collect()
    assert [round(r[0], 12) for r in p] == [round(0.7011080384254456, 12), 1.0, round(2 / 1024, 12)]
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")
    assert {r["k"]: round(r["p_holm"], 9) for r in core.with_holm(df, tie="k").collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}


def test_gate_needs_answers(spark):
    df = spark.createDataFrame([("a", True), ("b", None)], "check string, ok boolean")
    assert core.gate(df).first()["passed"] is False


def test_sources(spark, tmp_path):
    doc = {"a": [{"b": 1}, {"c": {"d": 2}}]}
    (tmp_path / "plain.json").write_text(json.dumps(doc))
    (tmp_path / "packed.json").write_bytes(base64.b64encode(gzip.compress(json.dumps(doc).encode())))
    packed = documents.read_packed(spark, f"{tmp_path}/*.json")
    assert packed.select("sha256").distinct().count() == 1
    assert documents.nested_objects(packed).filter("path like '%plain%'").count() == 4
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("in/a.txt", "hello")
    assert archives.zip_members(spark, f"{tmp_path}/x.zip").first()["content"] == b"hello"
    (tmp_path / "l.jsonl").write_text('{"a":1}\n\n{"a":2}\n')
    assert documents.read_lines(spark, f"{tmp_path}/l.jsonl", "a int").count() == 2
    assert documents.read_lines(spark, f"{tmp_path}/none.jsonl", "a int", missing_ok=True).count() == 0
    assert documents.manifest(spark, f"{tmp_path}/plain.json").first()["bytes"] == len(json.dumps(doc))


def test_write_once_and_splits(spark, tmp_path):
    a = spark.createDataFrame([(1, "train"), (2, "blind")], "id int, split string")
    assert documents.write_once(a, f"{tmp_path}/t") and not documents.write_once(a, f"{tmp_path}/t")
    with pytest.raises(ValueError, match="other rows"):
        documents.write_once(a.limit(1), f"{tmp_path}/t")
    documents.write_splits(a, f"{tmp_path}/s")
    assert [r["id"] for r in spark.read.parquet(f"{tmp_path}/s/public").collect()] == [1]
    bad = documents.contract(spark.createDataFrame([(1, ""), (1, "train")], "id int, split string"), ["split"], ["id"], {"train": 2})
    assert {r["check"] for r in bad.collect()} == {"unique", "required", "count"}
