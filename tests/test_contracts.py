"""Sources, sinks, digests, streams and algebra on small literals."""

import base64
import gzip
import hashlib
import json
import os
import unicodedata
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscraft.functions import algebra, canonical, exact, questions, text
from corpuscraft.operators import alike, contracts, core, generate, neardup
from corpuscraft.sources import archives, documents
from corpuscraft.streaming import resume


@pytest.mark.parametrize(
    ("expression", "out"),
    [("2*0+x", "2 * 0 + x"), ("x**2-0*y", "x ** 2 - 0 * y"), ("1-(1-a)*b", "1 - (1 - a) * b"), ("3-1-(1-x)", "3 - 1 - (1 - x)"), ("2*(a**1+b)", "2 * (a + b)"), ("1-(1-(3/4))", "3 / 4"), ("1*(0+x)-0", "x"), ("comb(7,6)*x**0", "7"), ("comb(1,1)", "1"), ("x+", None), (None, None)],
)
def test_fold(expression, out):
    assert algebra.folded(expression)["text"] == out


@settings(max_examples=80, deadline=None)
@given(st.recursive(st.integers(0, 4).map(str), lambda x: st.tuples(x, st.sampled_from("+-*"), x).map(lambda t: f"({t[0]}{t[1]}{t[2]})"), max_leaves=8))
def test_folding_keeps_the_value(expression):
    out = algebra.folded(expression)["text"]
    assert exact.evaluate(out)["value"] == exact.evaluate(expression)["value"]


@settings(max_examples=60, deadline=None)
@given(st.integers(-9, 9), st.integers(1, 9), st.integers(-9, 9))
def test_proof_of_identities(a, b, c):
    assert exact.proved(f"(x+{abs(a)})*(x-{b})", f"x**2+({abs(a) - b})*x-{abs(a) * b}")["same"] is True
    assert exact.proved(f"x/({b}*y)+({c})", f"(x+({c})*{b}*y)/({b}*y)")["same"] is True
    assert exact.proved(f"x+{b}", "x")["same"] is False


def test_envelopes_refuse_empty_answers_and_blanks():
    good = '{"answers":[{"question_id":"a","expression":"1"}]}'
    for bad in ('{"answers":[]}', good.replace('"1"', '"  "'), '{"answers":[1]}', good[:-1], '{"required_response":{"answers":[]},"answers":[]}'):
        assert not exact.read_envelope(bad, ["a"])["ok"]
    assert exact.read_envelope(good + " }", ["a"])["repairs"] == ["closing brace"]
    assert exact.read_envelope('{"question_id":1,"required_response":' + good + "}", ["a"])["repairs"] == ["unwrapped"]
    assert not exact.read_strict_envelope(good, ["a", "b"])["ok"] and not exact.read_strict_envelope(good + "}", ["a"])["ok"]
    assert exact.read_transport("1/2", "stop", ["a"])["items"] == [{"question_id": "a", "expression": "1/2"}]
    assert not exact.read_transport("1/2", "stop", ["a", "b"])["ok"] and not exact.read_transport(good, None, ["a"])["ok"]


def test_grades():
    s = json.dumps({"p": "1/5", "p_b": "3/7"})
    grade = lambda raw, c="exactly_one": algebra.grade(raw, c, s, "minutes")
    own = questions.expression("exactly_one", json.loads(s))
    assert grade("Expression: " + own)["outcome"] == "accepted"
    assert grade("Expression: (1/5)+(3/7)-2*(1/5)*(3/7)")["primary_correct"]
    assert grade(questions.show(questions.answer("exactly_one", json.loads(s))))["outcome"] == "equivalence_pending"
    assert grade("Expression: (1/5)*(3/7)")["outcome"] == "mathematical_error"
    assert grade(own + "\nso it is about a half")["outcome"] == "non_executable_or_format"
    bound = grade("Bindings: p=1/5; p_b=3/7\nExpression: p*(1-p_b)+(1-p)*p_b")
    assert bound["outcome"] == "accepted" and bound["bindings_match"] and not bound["whole_raw_executable"]
    assert bound["two_lines"] and not grade(own)["two_lines"]
    assert grade("Bindings: p=1/5; p_b=3/7\n```\np*p_b\nresult = p*(1-p_b)+(1-p)*p_b")["outcome"] == "accepted"
    assert grade("p=1/5; p_b=3/7")["outcome"] == "non_executable_or_format"  # bindings alone are no result
    assert grade(own + "; x = y =")["outcome"] == "non_executable_or_format"
    ends = json.dumps({"lower": "0", "upper": "10", "divisor": "2"})
    computed = algebra.grade("upper = (0+10)/2+(10-0)/(2*2)", "interval", ends, None)
    assert computed["computed"] == "15/2" and computed["outcome"] == "accepted" and not computed["bindings_match"]
    assert algebra.gated(own, "length", "exactly_one", s, None)["reason"] == "finish_reason_not_stop"
    assert algebra.gated(own, "stop", "exactly_one", s, None)["accepted"]
    assert not algebra.gated("Expression: " + own, "stop", "exactly_one", s, None)["accepted"]


@pytest.mark.parametrize("category", questions.CATEGORIES)
def test_questions_are_read_as_they_are_written(category):
    numbers = {"p": "2/9", "p_b": "7/9", "mean": "-3/4", "variance": "5/2", "scale": "-2", "offset": "1/3", "rate": "3/2", "duration": "7/4", "lower": "-1/2", "upper": "9", "cutoff": "3/4", "n": "6", "r": "2", "divisor": "3/2"}
    names = {m for t in questions.FORMATS[category] for m in __import__("re").findall(r"\{(\w+)", t.replace("{given}", "{p}{p_b}").replace("{ask}", ""))}
    s = {k: ("3/4" if k == "mean" and category.startswith("poisson") else numbers[k]) for k in names}
    for surface in questions.SURFACES:
        for order in questions.GIVEN:
            for unit in ("minutes", "seconds"):
                asked = questions.render(category, surface, s, order, unit)
                got, _, _ = questions.read(asked, category, surface)
                assert got == s
                with pytest.raises(exact.Refused):
                    questions.read(asked + " ", category, surface)
    right = questions.answer(category, s)
    assert all(Fraction(exact.evaluate(r)["value"]) == right for r in [questions.expression(category, s), *questions.references(category, s)])
    assert any(not t["collides"] for t in questions.traps(category, s))


def test_digests_of_all_dialects():
    doc = {"b": [1, {"z": None}], "a": "é"}
    raw = json.dumps(doc, indent=3)
    for name, kwargs in (("compact", {"separators": (",", ":"), "ensure_ascii": False}), ("compact_ascii", {"separators": (",", ":")}), ("spaced", {"ensure_ascii": False}), ("spaced_ascii", {}), ("lines", {"indent": 1})):
        assert canonical.digest(raw, name) == hashlib.sha256(json.dumps(doc, sort_keys=True, **kwargs).encode()).hexdigest()
    assert canonical.digest('{"a":1,"a":2}') is None and canonical.digest("{") is None and canonical.digest(None) is None


def test_fingerprint_of_the_grader():
    one = canonical.fingerprint(algebra, exact, questions)
    assert one == canonical.fingerprint(questions, algebra, exact) != canonical.fingerprint(algebra, exact)


def test_self_hashes(spark):
    body = {"x": 1, "y": "é"}
    good = json.dumps(body | {"sha": canonical.digest(json.dumps(body))})
    rows = spark.createDataFrame([(good,), (good.replace("1", "2", 1),), (json.dumps(body),), ("no json",), (None,)], "r string")
    assert [r["state"] for r in contracts.self_hashes(rows, "r", "sha").collect()] == ["valid", "drifted", "missing", "missing", "missing"]


def test_packed_sources_are_pinned(spark, tmp_path):
    raw = json.dumps({"a": 1}).encode()
    packed = base64.encodebytes(gzip.compress(raw, mtime=0))
    (tmp_path / "a.b64").write_bytes(packed)
    (tmp_path / "b.b64").write_bytes(packed[:10] + b"*" + packed[10:])
    (tmp_path / "c.json").write_bytes(raw[:-1])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    pins = {"a.b64": {"file_sha256": sha(packed), "gzip_sha256": sha(gzip.compress(raw, mtime=0)), "sha256": sha(raw)}}
    read = lambda p: {r["path"].rsplit("/", 1)[-1]: r for r in documents.read_packed(spark, f"{tmp_path}/*", p).collect()}
    rows = read(pins)
    assert rows["a.b64"]["document"] == '{"a": 1}' and rows["a.b64"]["error"] is None
    assert rows["b.b64"]["document"] is None and rows["b.b64"]["error"] and rows["c.json"]["document"] is None
    assert read({"a.b64": {"sha256": "0"}})["a.b64"]["error"] == "sha256 drift"


def test_registry_records_logs_and_artifacts(spark, tmp_path):
    docs = spark.createDataFrame([("f", json.dumps({"id": 1, "task": "t", "in": [{"id": 2, "task": "x"}, {"id": 3}]}))], "path string, document string")
    kept, counts = documents.registry_of(documents.nested_objects(docs), ["id", "task"], F.get_json_object("object", "$.task") == "t")
    assert kept.count() == 1 and tuple(counts.first())[1:] == (3, 2, 1, 1)
    body = {"n": 1}
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "1.json").write_text(json.dumps(body | {"sha": canonical.digest(json.dumps(body))}))
    (tmp_path / "r" / "2.json").write_text(json.dumps(body | {"sha": "x"}))
    assert sorted(r["state"] for r in documents.read_records(spark, f"{tmp_path}/r", "sha").collect()) == ["drifted", "valid"]
    digest = hashlib.sha256((tmp_path / "r" / "2.json").read_bytes()).hexdigest()
    assert documents.locate(spark, f"{tmp_path}/r", digest).endswith("2.json")
    with pytest.raises(ValueError, match="no files"):
        documents.locate(spark, f"{tmp_path}/r", "0", first=[f"{tmp_path}/none"])
    (tmp_path / "log.txt").write_text("start\n{'train_runtime': 2.5, 'train_loss': 0.25}\n{'train_runtime': 9}\n")
    assert tuple(documents.scrape_log(spark, f"{tmp_path}/log.txt", "{'train_runtime':", "train_runtime double, train_loss double").first()["x"]) == (2.5, 0.25)
    one, before = documents.tree_digest(spark, f"{tmp_path}/r"), documents.tree_digest(spark, f"{tmp_path}/r")
    (tmp_path / "r" / "2.json").write_text("{}")
    assert one == before != documents.tree_digest(spark, f"{tmp_path}/r")


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "x|y"), (2, None)], "id int, s string")
    documents.replace_table(a, f"{tmp_path}/t")
    documents.replace_table(a.filter("id = 1"), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1
    assert {(r["id"], r["side"]) for r in documents.check_table(a, f"{tmp_path}/t").collect()} == {(2, "regenerated")}
    documents.append_lines(a, f"{tmp_path}/l")
    documents.append_lines(a, f"{tmp_path}/l")
    assert documents.read_lines(spark, f"{tmp_path}/l", "id int, s string").count() == 4
    (tmp_path / "tree" / "in").mkdir(parents=True)
    (tmp_path / "tree" / "in" / "a.txt").write_text("hello")
    packed = archives.package(spark, f"{tmp_path}/tree", f"{tmp_path}/packed").collect()
    assert [tuple(r) for r in packed] == [("in/a.txt", 5, hashlib.sha256(b"hello").hexdigest())]
    documents.export_packed(a.coalesce(1), f"{tmp_path}/e")
    rows = [json.loads(r["document"]) for r in documents.read_packed(spark, f"{tmp_path}/e/part-*").collect()]
    assert rows == [[{"id": 1, "s": "x|y"}, {"id": 2, "s": None}]]
    assert documents.report(a.orderBy("id"), "T").splitlines()[2:5] == ["| id | s |", "|-|-|", "| 1 | x\\|y |"]
    with pytest.raises(ValueError, match="no report"):
        documents.report(a, "T", most=1)
    (tmp_path / "d.json").write_text('[{"a": 1}, {"a": 2}]')
    assert documents.read_document(spark, f"{tmp_path}/d.json", "a int").count() == 2 and documents.read_document(spark, f"{tmp_path}/no.json", "a int", True).count() == 0


def test_a_stream_resumes_where_it_stood(spark, tmp_path):
    schema = "user_id long, value double"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = lambda: spark.read.schema(schema).parquet(f"{tmp_path}/in")
    write([(1, 1.0), (2, 5.0)])
    write([(1, 3.0)])
    name = f"test-{tmp_path.name}"
    assert {tuple(r) for r in resume.final_state(read(), name).collect()} == {(1, 2, 3.0), (2, 1, 5.0)}
    write([(1, 9.0)])
    assert {tuple(r) for r in resume.final_state(read(), name).collect()} == {(1, 3, 9.0), (2, 1, 5.0)}
    batches = spark.read.schema("user_id long, n bigint, best double, batch int").parquet(f"{core.shared_folder(spark)}/stream-{name}/state").groupBy("batch").agg(F.sum("n").alias("n")).orderBy("batch").collect()
    assert [r["n"] for r in batches] == [3, 1]  # the second run read the new file alone


def test_numbers_of_a_whole_table(spark):
    rows = spark.range(1000).repartition(7)
    got = core.numbered(rows, [F.desc("id")], "k").collect()
    assert sorted((r["id"], r["k"]) for r in got) == [(i, 1000 - i) for i in range(1000)]
    within = core.numbered_within(rows.withColumn("g", F.col("id") % 3), ["g"], ["id"], "k").collect()
    assert all(r["k"] == r["id"] // 3 + 1 for r in within)


@pytest.mark.parametrize("fan", [64, 3])
def test_merkle_trees(spark, monkeypatch, fan):
    """Roots are those of a plain tree in any partitions; proofs hold, and fail for another leaf, another group's root or a cut proof."""
    from corpuscraft.operators import merkle

    monkeypatch.setattr(merkle, "FAN", fan)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def root(texts):
        level, depth = [sha("0:" + x) for x in texts], 0
        while depth == 0 or len(level) > 1:
            level, depth = [sha("1:" + ",".join(level[i : i + fan])) for i in range(0, len(level), fan)], depth + 1
        return level[0], depth

    sizes = {"a": 1, "b": 3, "c": 100, "d": 28}
    df = spark.createDataFrame([(g, i, f"{g}{i % 40}", "x") for g, n in sizes.items() for i in range(n)], "g string, i int, v string, place string")
    tree = merkle.Tree(df.repartition(6), ["g"], ["i"], F.col("v"))
    assert {r["g"]: (r["tree"], r["depth"]) for r in tree.roots.collect()} == {g: root([f"{g}{i % 40}" for i in range(n)]) for g, n in sizes.items()}
    rows = tree.proofs().join(tree.roots, "g").select("g", "i", merkle.holds(F.col("digest"), F.col("proof"), F.col("tree")).alias("ok"), merkle.holds(merkle.leaf(F.lit("no")), F.col("proof"), F.col("tree")).alias("leaf"), merkle.holds(F.col("digest"), F.slice("proof", 1, F.size("proof") - 1), F.col("tree")).alias("cut"), merkle.holds(F.col("digest"), F.col("proof"), F.lit("x")).alias("root")).collect()
    assert len(rows) == 132 and all(r["ok"] and not (r["leaf"] or r["cut"] or r["root"]) for r in rows)
    whole = merkle.Tree(df, [], ["g", "i"], F.col("v")).roots.collect()
    assert len(whole) == 1 and whole[0]["tree"] == root([f"{g}{i % 40}" for g, n in sizes.items() for i in range(n)])[0]
    assert merkle.Tree(df.limit(0), ["g"], ["i"], F.col("v")).roots.count() == 0


def test_bootstrap_draws_by_the_counts(spark):
    """Binomial counts have their exact frequencies; the interval is that of resampling row by row, within sampling error."""
    import math

    import numpy as np

    from corpuscraft.functions import draws

    lit = lambda v: F.lit(v).cast("long")
    u = draws.uniform(F.lit("t"), F.col("id"))
    got = {r["k"]: r["count"] for r in spark.range(20_000).select(draws.binomial(lit(12), F.lit(0.3), u).alias("k")).groupBy("k").count().collect()}
    for k in range(13):
        p = math.comb(12, k) * 0.3**k * 0.7 ** (12 - k)
        assert abs(got.get(k, 0) / 20_000 - p) < 5 * math.sqrt(p * (1 - p) / 20_000) + 1e-4
    r = spark.range(40).select(draws.binomial(lit(10**9), F.lit(0.25), u).alias("a"), draws.binomial(lit(0), F.lit(0.5), u).alias("b"), draws.binomial(lit(9), F.lit(1.0), u).alias("c"), draws.binomial(lit(9), F.lit(0.0), u).alias("d")).collect()
    assert all(abs(x["a"] - 25 * 10**7) < 10**5 and (x["b"], x["c"], x["d"]) == (0, 9, 0) for x in r)
    groups = {"g": [-1] * 30 + [0] * 50 + [1] * 45, "h": [2] * 7 + [-3] * 9}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs] + [("g", None)], "g string, x int")
    b = core.bootstrap_interval(df, "x", "g", 4000, "s").first()
    rng = np.random.default_rng(1)
    nets = sum(rng.choice(xs, (200_000, len(xs))).sum(1) for xs in groups.values())
    assert b["reps"] == 4000 and abs(b["low"] - np.quantile(nets, 0.025)) <= 2 and abs(b["high"] - np.quantile(nets, 0.975)) <= 2


def test_near_duplicates_by_brute_force(spark):
    from difflib import SequenceMatcher

    rows = [(i, t) for i, t in enumerate(["what is the mean of ten numbers", "what is the mean of two numbers", "completely other words here", "what is the mean of ten numbers", "word", "word", "", "what is a mean of two numbers now"])]
    kept = []
    want = {}
    for i, t in rows:
        want[i] = not any(SequenceMatcher(None, t, u).ratio() >= 0.84 for _, u in kept) if t else True
        if want[i]:
            kept.append((i, t))
    got = {r["id"]: r["kept"] for r in alike.greedy(spark.createDataFrame(rows, "id long, text string"), 0.84).collect()}
    assert got == want
    chain = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i, i + 30))) for i in range(20)], "id long, text string")
    assert all(r["kept"] is not None for r in alike.greedy(chain, 0.84).collect())


@pytest.mark.parametrize("most", [1_000_000, 20])
def test_containment_of_short_and_long_needles(spark, monkeypatch, most):
    """One automaton, and beyond its bound runs of words beside parts of the short needles."""
    monkeypatch.setattr(neardup, "PATTERN_CHARACTERS", most)
    texts = ["the cat sat on the mat today", "a dog", "catalogue", "", None, "wörter, groß 🤦 und klein", "aaaa", "the cat sat on the mat today"]
    parts = ["cat", "cat sat on", "he cat sat on the ma", "a dog", "x y z w v u", "", None, "🤦", "aa", "a", "ß 🤦 und k", "cat", " ", "on the mat today!"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pattern string")
    needles = spark.createDataFrame([(i, p, "x") for i, p in enumerate(parts)], "item_id long, needle string, any string")
    want = sorted((d, n) for d, t in enumerate(texts) for n, p in enumerate(parts) if t is not None and p is not None and p in t)
    assert sorted(map(tuple, neardup.containing(docs, needles).collect())) == want
    assert neardup.containing(docs, needles.limit(0)).count() == neardup.containing(docs.limit(0), needles).count() == 0


def test_text_forms(spark):
    xs = ["Straße ẞ", "ΣΑΣ", "ﬁ Ⅷ", "plain", None]
    df = spark.createDataFrame([(x,) for x in xs], "x string")
    got = df.select(text.casefold(F.col("x")).alias("f"), text.nfkc(F.col("x")).alias("k")).collect()
    assert [r["f"] for r in got][:2] == ["strasse ss", "σασ"]
    assert [r["k"] for r in got] == [None if x is None else unicodedata.normalize("NFKC", x) for x in xs]
    lists = spark.createDataFrame([(["1/2", "0.5", "3"],), (["1/2", "1/3"],), (["a", "a "],)], "c array<string>")
    assert [r[0] for r in lists.select(text.numerically_distinct(F.col("c"))).collect()] == [False, True, False]


def test_requests_hold_public_columns_only(spark):
    rows = spark.createDataFrame([(1, "q", "secret")], "p_partkey int, question string, answer string")
    assert generate.forbidden_columns(generate.sanitized(rows, "p_partkey")) == [] and "answer" in generate.forbidden_columns(rows)
    payload = generate.requests(rows, "p_partkey", 12, 1, 1, 1).first()["payload"]
    assert json.loads(payload) == [{"id": 1, "question": "q"}]


def test_rules_must_be_the_approved_ones(spark):
    rows = spark.createDataFrame([("a",)], "rule string")
    approved = hashlib.sha256(b"a=text").hexdigest()
    assert core.with_rules(rows, "rule", {"a": "text"}, approved).first()["rule_text"] == "text"
    with pytest.raises(ValueError, match="approved"):
        core.with_rules(rows, "rule", {"a": "other"}, approved)


def test_shared_folder_without_the_setting(tmp_path):
    """A session that never set spark.checkpoint.dir: one folder an application, scratch that goes with the process."""
    import subprocess
    import sys

    code = """
import os, tempfile
tempfile.tempdir = {tmp!r}
from pyspark.sql import SparkSession
from corpuscraft.operators import core, shared
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
assert spark.conf.get("spark.checkpoint.dir", None) is None
folder = shared.shared_folder(spark)
assert folder == shared.shared_folder(spark) and folder.startswith({tmp!r})
rows = core.numbered(spark.range(100), ["id"], "n").collect()
assert [(r["id"], r["n"]) for r in sorted(rows)] == [(i, i + 1) for i in range(100)]
assert os.listdir(folder)
"""
    conf = tmp_path / "conf"
    conf.mkdir()
    (tmp_path / "t").mkdir()
    import os

    env = {**os.environ, "SPARK_CONF_DIR": str(conf), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    done = subprocess.run([sys.executable, "-c", code.format(tmp=str(tmp_path / "t"))], env=env, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
    assert not any(os.listdir(d) for d in (tmp_path / "t").glob("corpuscraft-*"))


# streams
def thirds(spark, folder, columns, repeat=False):
    """Writes the events in three arrivals and yields after each; with ``repeat`` the second comes once more with the third."""
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").selectExpr(*columns)
    for k in range(3):
        some = events.filter(f"seq * 3 div 10000 = {k}")
        some = some.unionByName(events.filter("seq * 3 div 10000 = 1")) if repeat and k == 2 else some
        some.repartition(2).write.mode("append").parquet(folder)
        yield k


def test_caps_of_a_stream_in_three_runs(spark, tmp_path):
    """A stream stopped and started again three times, some rows twice, gives the rows of the windows over the whole table."""
    from corpuscraft import plans
    from corpuscraft.streaming import ledger
    from corpuscraft.streaming.resume import Stream

    schema, name = "account long, seq long, cost double", f"caps-{tmp_path.name}"
    columns = ["user_id account", "event_id seq", "case when event_type = 'purchase' then value else 0 end cost"]
    for _ in thirds(spark, str(tmp_path / "in"), columns, repeat=True):
        stream = Stream(spark, str(tmp_path / "in"), schema, name)  # a new object each time: nothing but the checkpoint goes on
        stream.run(lambda rows: ledger.capped(rows, 40, 400.0, 5.0))
    want = plans.queries()["ledger_caps"](spark, "/root/testdata/sf0.01")
    assert sorted(map(repr, map(tuple, stream.rows.collect()))) == sorted(map(repr, map(tuple, want.select("user_id", "event_id", "allowed", "blocked_by").collect())))


def test_ledger_of_a_stream_in_three_runs(spark, tmp_path):
    """The outcomes are those of one run over the whole table, timers that fire between runs included."""
    from corpuscraft import plans
    from corpuscraft.plans import streams
    from corpuscraft.streaming import ledger
    from corpuscraft.streaming.resume import Stream

    kept = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    told = []
    for k in range(3):
        kept.filter(f"event_id * 3 div 10000 = {k}").repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = Stream(spark, str(tmp_path / "in"), kept.schema, f"ledger-{tmp_path.name}")
        stream.run(lambda rows: ledger.outcomes(streams.call_rows(rows), streams.CALLS, streams.COST, streams.RESERVE, streams.PATIENCE, f"{streams.LATENESS} milliseconds"))
        told.append(stream.rows.filter("outcome = 'timeout'").count())
    assert 0 < told[0] < told[1] < told[2]
    want = plans.queries()["ledger_stream"](spark, "/root/testdata/sf0.01")
    assert sorted(map(repr, map(tuple, stream.rows.withColumn("cost", F.round("cost", 6)).collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_ledger_answers_once(spark, tmp_path):
    """A call in flight is not made again, an answered one is cached, repeated rows change nothing, an answer without a cost stops the account."""
    from corpuscraft.streaming import ledger
    from corpuscraft.streaming.resume import Stream

    schema = "account long, seq long, at timestamp, kind string, tag long, cost double"
    rows = [(1, 0, "request", 1, None), (1, 1, "request", 1, None), (1, 2, "response", 1, 3.0), (1, 3, "request", 1, None), (1, 3, "request", 1, None), (1, 4, "request", 2, None), (1, 5, "failure", 2, None), (1, 6, "request", 2, None), (1, 7, "response", 9, 1.0), (1, 8, "request", 3, None), (1, 9, "response", 3, None), (1, 10, "request", 4, None), (1, 11, "note", 4, None)]
    spark.createDataFrame([(a, s, k, g, c) for a, s, k, g, c in rows], "account long, seq long, kind string, tag long, cost double").withColumn("at", F.timestamp_seconds(F.col("seq") + 1000)).select("account", "seq", "at", "kind", "tag", "cost").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = Stream(spark, str(tmp_path / "in"), schema)
    stream.run(lambda r: ledger.outcomes(r, 10, 100.0, 5.0, 60_000, "1 second"))
    got = [(r["seq"], r["outcome"]) for r in stream.rows.orderBy("seq", "outcome").collect()]
    assert got == [(0, "started"), (1, "unresolved"), (2, "response"), (3, "cached"), (3, "repeated"), (4, "started"), (5, "failure"), (6, "unresolved"), (7, "orphan"), (8, "started"), (9, "response"), (10, "unpriced")]


def brute_greedy(rows, least):
    from difflib import SequenceMatcher

    kept, out = [], {}
    for i, t in sorted(rows):
        hit = False
        for e in kept:
            m = SequenceMatcher(None, t or "", e)
            if m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least:
                hit = True
                break
        out[i] = not hit
        if not hit:
            kept.append(t or "")
    return out


def hostile_texts(n=2000, seed=4):
    """Texts without a shared word, of few letters, permuted, shifted, cut, chained by small changes, copied, long, empty and null."""
    import random

    r = random.Random(seed)
    draw = lambda k, letters="abcdefghij ": "".join(r.choice(letters) for _ in range(k))
    texts = ["", None, " ", "a", "a", "ab" * 150, "ab" * 150, "wort " * 60, "wort " * 60 + "x", "ß🤦" * 10, "ß🤦" * 10 + "é"]
    base = [draw(r.randint(5, 60)) for _ in range(120)]
    while len(texts) < n - 260:
        t = r.choice(base)
        kind = r.randrange(6)
        if kind == 0:
            t = t[::-1]
        elif kind == 1:
            k = r.randrange(len(t) + 1)
            t = t[k:] + t[:k]
        elif kind == 2:
            t = "".join(c for c in t if r.random() > 0.12)
        elif kind == 3:
            t = "".join(c + (draw(1) if r.random() < 0.15 else "") for c in t)
        elif kind == 4:
            t = t.replace(" ", "")
        else:
            t = "".join(r.sample(t, len(t)))
        texts.append(t)
    chain = list(draw(40))
    for _ in range(200):  # each is alike to those near it only
        chain[r.randrange(40)] = draw(1)
        texts.append("".join(chain))
    long = draw(260, "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    texts += [long, long, long[:250], long + "zz"] + ["copied text of some length"] * (n - len(texts) - 4)
    order = list(range(len(texts)))
    r.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize(("told", "block"), [(32, 512), (2, 150)])
def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch, told, block):
    from corpuscraft.operators import alike

    monkeypatch.setattr(alike, "TOLD", told)
    monkeypatch.setattr(alike, "TEXTS", block)
    rows = hostile_texts()
    got = {r["id"]: r["kept"] for r in alike.greedy(spark.createDataFrame(rows, "id long, text string").repartition(5), 0.84).collect()}
    assert got == brute_greedy(rows, 0.84)
    assert alike.greedy(spark.createDataFrame([], "id long, text string"), 0.84).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=30), st.text("abc ", max_size=30), st.sampled_from([0.3, 0.6, 0.84, 0.95]))
def test_bounds_lose_no_pair(a, b, least):
    from corpuscraft.operators import alike

    assert bool(alike.alike_pairs([(2, False, a)], [(1, False, b)], least, False)) == (alike.ratio(a, b) >= least)


def walked(x, at="$"):
    out = [(at, x)] if isinstance(x, dict) else []
    for k, v in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
        out += walked(v, f"{at}.{k}" if isinstance(x, dict) else f"{at}[{k}]")
    return out


def test_nested_objects_of_any_depth(spark):
    deep = {"a": 1}
    for _ in range(9):
        deep = {"n": [deep, 7, None, "x"]}
    docs = [{"id": 1, "in": [{"id": 2, "e": {}}, [[{"z": "ü"}]], 3, None]}, [], [{}, {"k.k": {"q": [1.5, True]}}], "text", 7, deep]
    df = spark.createDataFrame([(f"p{i}", json.dumps(d), "x") for i, d in enumerate(docs)] + [("none", None, "x")], "path string, document string, v string").repartition(3)
    got = sorted((r["path"], r["json_path"], json.dumps(json.loads(r["object"]), sort_keys=True)) for r in documents.nested_objects(df).collect())
    assert got == sorted((f"p{i}", at, json.dumps(x, sort_keys=True)) for i, d in enumerate(docs) for at, x in walked(d))
    assert documents.nested_objects(df.limit(0)).count() == 0


def test_archives_by_member(spark, tmp_path):
    import zipfile

    body = {f"in/{i}/x.bin": os.urandom(i * 7) for i in range(30)}
    for name, some in (("a.zip", list(body)[:20]), ("b.zip", list(body)[20:]), ("none.zip", [])):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.mkdir("empty")
            for m in some:
                z.writestr(m, body[m])
    df = archives.zip_members(spark, f"{tmp_path}/*.zip", partition=200)
    rows = df.collect()
    assert {r["member"]: bytes(r["content"]) for r in rows} == body and len(rows) == 30
    assert all(r["archive"].endswith("a.zip" if r["member"] in list(body)[:20] else "b.zip") for r in rows)
    assert df.rdd.getNumPartitions() > 10  # members of one archive are read by several tasks
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../x", b"1")
    with pytest.raises(Exception, match="outside the archive"):
        archives.zip_members(spark, f"{tmp_path}/bad.zip").collect()
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    at = raw.index(body["in/19/x.bin"])
    raw[at] ^= 255
    (tmp_path / "hurt.zip").write_bytes(raw)
    with pytest.raises(Exception, match="CRC"):
        archives.zip_members(spark, f"{tmp_path}/hurt.zip").collect()


def test_package_in_parts(spark, tmp_path):
    import zipfile

    for i in range(12):
        (tmp_path / "tree" / f"d{i % 3}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / f"d{i % 3}" / f"{i}.txt").write_bytes(b"x" * (i + 1))
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))  # several tasks for these small files
    try:
        rows = archives.package(spark, f"{tmp_path}/tree", f"{tmp_path}/out").collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(map(tuple, rows)) == sorted((f"d{i % 3}/{i}.txt", i + 1, hashlib.sha256(b"x" * (i + 1)).hexdigest()) for i in range(12))
    parts = os.listdir(tmp_path / "out")
    assert len(parts) > 1 and all(p.startswith("part-") for p in parts)
    listed = [x["path"] for p in parts for x in json.loads(zipfile.ZipFile(tmp_path / "out" / p).read(archives.MANIFEST))]
    assert sorted(listed) == sorted(r["path"] for r in rows)


def test_slots_run_out(spark):
    """One key for all: the first slot takes it, the others report that they found none; a registered key fills nothing."""
    from corpuscraft.operators import slots

    grid = spark.createDataFrame([(3, "x"), (1, "y"), (2, "z")], "slot int, key string")
    one = lambda rows, r: rows.select("*", F.struct(F.lit(r).alias("r")).alias("candidate"), F.array(F.struct(F.lit("k").alias("kind"), F.lit("same").alias("key"))).alias("keys"), (F.lit(r) > 0).alias("valid"))
    none = spark.createDataFrame([], "kind string, key string")
    got = {r["slot"]: (r["attempt"], r["candidate"] and r["candidate"]["r"]) for r in slots.fill(grid, one, none, 4).collect()}
    assert got == {1: (1, 1), 2: (None, None), 3: (None, None)}
    assert all(r["attempt"] is None for r in slots.fill(grid, one, spark.createDataFrame([("k", "same")], none.schema), 3).collect())
    assert slots.fill(grid.limit(0), one, none, 3).count() == 0


def test_evidence_chain(spark):
    """A clean ledger has no fault; each planted one is found, and only that."""
    from corpuscraft.operators import evidence

    plan = spark.createDataFrame([(p, k, f"q{p}{k}", str(k * 2)) for p in range(3) for k in range(3)], "packet long, place int, id string, expected string")
    schema = "seq long, packet long, attempt long, tag string, requested array<string>, raw string, response_sha string, response_id string, receipts array<double>, cost double, decisions array<struct<id:string,accepted:boolean>>"

    def record(seq, p, a, wrong=(), ids=None, **changed):
        ids = [f"q{p}{k}" for k in range(3)] if ids is None else ids
        raw = changed.pop("raw", json.dumps({"items": [{"id": i, "answer": "no" if i in wrong else str(int(i[2]) * 2)} for i in ids]}))
        row = {"seq": seq, "packet": p, "attempt": a, "tag": f"packet_{p:03d}_attempt_{a}", "requested": ids, "raw": raw, "response_sha": hashlib.sha256(raw.encode()).hexdigest(), "response_id": f"r{seq}", "receipts": [0.5, 0.25, None], "cost": 0.5, "decisions": [(i, i not in wrong) for i in ids]}
        return {**row, **changed}

    clean = [record(1, 0, 0, ["q02", "q00"]), record(2, 0, 1, ["q02"], ["q00", "q02"]), record(3, 1, 0), record(4, 2, 0, ["q21"]), record(5, 2, 1, [], ["q21"])]

    def faults(rows, previous=None):
        names = [c.split()[0] for c in schema.split(", ")]
        df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema).withColumn("digest", evidence.body_digest())
        digests = {r["seq"]: r["digest"] for r in df.collect()}
        back = spark.createDataFrame([(s, (previous or {}).get(s, digests.get(s - 1))) for s in digests], "seq long, previous string")
        return sorted(map(tuple, evidence.audit(df.drop("digest").join(back, "seq"), plan).collect()))

    def with_(k, **changed):
        return [{**r, **changed} if r["seq"] == k else r for r in clean]

    assert faults(clean) == []
    assert faults(with_(2, cost=0.25)) == [(2, "cost")] and faults(with_(2, receipts=[None, -1.0, float("nan")])) == [(2, "cost")]
    assert faults(with_(3, response_id="r1")) == [(1, "response_id"), (3, "response_id")] and faults(with_(3, response_id=None)) == [(3, "response_id")]
    assert faults(with_(4, response_sha=None)) == [(4, "response_sha")]
    assert faults(with_(3, tag="packet_000_attempt_0")) == [(1, "tag"), (3, "tag")]
    assert faults(with_(5, decisions=[("q21", False)])) == [(5, "decisions")]
    assert faults([*clean[:1], record(2, 0, 1, ["q02"], ["q02", "q00"]), *clean[2:]]) == [(2, "requested")]  # not in packet order
    assert faults([*clean[:1], record(2, 0, 1, [], ["q00"]), *clean[2:]]) == [(2, "requested")]  # a failure left out
    assert faults([*clean[:2], record(3, 1, 0, raw="no json", decisions=[(f"q1{k}", False) for k in range(3)]), *clean[3:]]) == []
    assert faults(clean, {3: "0" * 64}) == [(3, "chain")] and faults(clean, {4: None}) == [(4, "chain")]
    assert faults([r for r in clean if r["seq"] != 3]) == [(4, "chain"), (4, "order")]  # a gap
    assert faults([*clean[:2], {**clean[3], "seq": 3}, {**clean[4], "seq": 4}, {**clean[2], "seq": 5}]) == [(5, "order")]
    assert (3, "plan") in faults([*clean[:2], record(3, 9, 0, ids=["q90"]), *clean[3:]])
