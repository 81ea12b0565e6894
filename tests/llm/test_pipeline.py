"""The pipeline's stages in order: on the small table, and each against brute force on documents of its own."""

import collections
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from corpuscraft.llm import toxicity

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy string, __cut int"


def words(t):
    return (t or "").encode().lower().split()


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, shared passages, a repeated row, a repeated id, null ids and texts, a very long text, clashing columns."""
    rng = np.random.default_rng(11)
    draw = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 500, n))
    passage, base = draw(80), draw(120)
    texts = [(i, draw(int(rng.integers(1, 150)))) for i in range(60)]
    texts += [(60, base), (61, base), (62, base + " end"), (63, draw(20) + " " + passage + " " + draw(20)), (64, draw(30) + " " + passage), (65, passage + " " + draw(60))]
    texts += [(60, draw(90)), (66, draw(6000)), (67, None), (68, ""), (None, draw(70)), (None, base), (3, texts[3][1])]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "c", 1) for i, t in texts], SCHEMA).cache()


def rows_of(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_near_duplicates_equal_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if None not in (rows[a][0], rows[b][0]) and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = collections.defaultdict(lambda: 10**9)
    for (i, _), k in zip(rows, label, strict=True):
        least[k] = min(least[k], 10**9 if i is None else i)
    want = collections.Counter(r for r, k, s in zip(rows, label, sets, strict=True) if r[0] is None or not s or r[0] == least[k])
    out = pipeline.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns and rows_of(out) == want
    assert {i for i, _ in want} >= {60, None, 67, 68} and not {61, 62} & {i for i, _ in want}


def test_cut_repeats_equals_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    first: dict = {}
    key = lambda i, t, j: (i, j, t)
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - 49 if i is not None else 0):
            g = tuple(w[j : j + 50])
            first[g] = min(first.get(g, key(10**9, "", 0)), key(i, t, j))
    out = pipeline.cut_repeats(spark, docs, SF)
    got = {(r["doc_id"], len(words(r["text"]))): r for r in out.collect()}
    assert out.columns == docs.columns and out.count() == docs.count()
    assert all(r["n_chars"] == len(r["text"] or "") for r in out.collect())
    for i, t in rows:
        w = words(t)
        gone = np.zeros(len(w), dtype=bool)
        for j in range(len(w) - 49 if i is not None else 0):
            o, at, other = first[tuple(w[j : j + 50])]
            if (o, other) != (i, t):
                gone[j : j + 50] = True
        assert words(got[i, int((~gone).sum())]["text"]) == [x for x, g in zip(w, gone, strict=True) if not g]


def test_toxicity_keeps_what_is_scored_clean(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "'x' as score", "1 as label")
    out = pipeline.drop_toxic(spark, docs, sf)
    scored = toxicity.score_documents(docs, toxicity.training_labels(spark.read.parquet(f"{sf}/labels.parquet")))
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in scored.filter("predicted = 0").select("doc_id").collect()}


def test_packing_holds_every_id_once(spark, docs):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    one = docs.dropDuplicates(["doc_id"])
    packed = pipeline.pack(spark, one, SF).collect()
    ids = {r["doc_id"]: [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in one.collect()}
    by_doc, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packed:
        by_doc[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, own in ids.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(own)) and r["ids_crc32"] == zlib.crc32(np.array(own[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(own)
    for pieces in sequences.values():
        spans = sorted((r["offset"], r["offset"] + r["length"]) for r in pieces)
        assert spans[0][0] == 0 and spans[-1][1] <= 2048 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_empty_tables(spark, docs):
    kept = docs.limit(0)
    for name, stage in pipeline.STAGES:
        out = stage(spark, kept, SF)
        assert out.count() == 0, name
        assert name == pipeline.STAGES[-1][0] or out.columns == docs.columns


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    sizes = [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        kept.write.mode("overwrite").parquet(path)
        kept = spark.read.parquet(path)
        assert kept.columns == docs.columns
        sizes.append(kept.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3]
    packed = pipeline.STAGES[-1][1](spark, kept, SF)
    assert packed.select("doc_id").distinct().count() == sizes[3]
    assert [tuple(r) for r in pipeline.run(spark, SF).orderBy("doc_id", "start").limit(50).collect()] == [tuple(r) for r in packed.orderBy("doc_id", "start").limit(50).collect()]
