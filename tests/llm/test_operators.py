"""The operators against brute force, round trips and held-out rows, with nulls, ties, empty tables and clashing columns."""

import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuscraft.llm import additive, bitpack, bm25, bpe_trie, brown, licenses, mixing, packing, prefix_trie, setsketch, suffix_dedup, toxicity, whitening
from corpuscraft.llm.tokenize import encoder

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, block string, label string, n int, cut int, keep int"


def make_docs(spark, n=120, seed=5):
    """Random texts, exact and near copies, a shared passage, null, empty, short and very long texts, a repeated row, a null id."""
    rng = np.random.default_rng(seed)
    draw = lambda k: " ".join(rng.choice(WORDS, k))
    passage = draw(70)
    texts = [draw(int(rng.integers(1, 200))) for _ in range(n)]
    texts[10] = texts[11] = texts[3] + " and some more words here to be long " + draw(90)
    near = texts[10].split()
    near[30] = "changed"
    texts[12] = " ".join(near)
    for i in (20, 21, 22):
        texts[i] = draw(40) + " " + passage + " " + draw(30)
    texts[30], texts[31], texts[32], texts[33] = None, "", " \n\t ", "Two words"
    texts[34] = texts[33].upper()
    texts[35] = draw(4000)
    texts[36] = "same " * 130
    rows = [(i, t, "en", "b", "l", 1, 0, 0) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, draw(80), "en", "b", "l", 1, 0, 0)], SCHEMA)


def tokens(t):
    return (t or "").encode().lower().split()


@pytest.fixture(scope="module")
def docs(spark):
    return make_docs(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_duplicates(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = {i: frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if (w := tokens(t)) else frozenset() for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = setsketch.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]))
    assert setsketch.near_duplicates(empty).count() == 0


def test_sketch_merges_and_estimates():
    a, b = np.arange(1, 2000, dtype=np.uint64) * np.uint64(7919), np.arange(1000, 3000, dtype=np.uint64) * np.uint64(7919)
    assert (np.maximum(setsketch.sketch(a), setsketch.sketch(b)) == setsketch.sketch(np.union1d(a, b))).all()
    same = (setsketch.sketch(a) == setsketch.sketch(b)).mean()
    assert abs(same - 1000 / 2999) < 0.12


def test_block_pairs_lose_no_link(spark, docs, monkeypatch):
    want = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in setsketch.near_duplicates(docs).collect())
    monkeypatch.setattr(setsketch, "BLOCK_SETS", 1)
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in setsketch.near_duplicates(docs).collect()) == want


def brute_spans(rows, words):
    count, first = collections.Counter(), {}
    for i, t in sorted((i, t) for i, t in rows if i is not None):
        w = tokens(t)
        for j in range(len(w) - words + 1):
            k = tuple(w[j : j + words])
            count[k] += 1
            first.setdefault(k, (i, j))
    out = set()
    for i, t in rows:
        w = tokens(t)
        for kind in (True, False):
            spans = []
            for j in range(len(w) - words + 1):
                k = tuple(w[j : j + words])
                if i is not None and count[k] > 1 and (first[k] == (i, j)) == kind:
                    if spans and j <= spans[-1][1]:
                        spans[-1][1] = j + words
                    else:
                        spans.append([j, j + words])
            out |= {(i, a, b, kind) for a, b in spans}
    return out


@pytest.mark.parametrize("together", [20_000, 1])
def test_repeated_passages(docs, empty, monkeypatch, together):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = suffix_dedup.repeated_passages(docs).collect()
    got = {(r["doc_id"], r["start_word"], r["end_word"], r["is_first"]) for r in found}
    assert got == brute_spans(rows, 50) and len(got) == len(found)
    assert {20, 21, 22} <= {r[0] for r in got}
    assert suffix_dedup.repeated_passages(empty).count() == 0


def test_remove_repeats(docs):
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert text[20] == before[20] and len(tokens(text[21])) == len(tokens(before[21])) - 70
    assert tokens(text[36]) == [b"same"] * 129 or len(tokens(text[36])) < 130
    assert text[30] is None and text[31] == ""


@pytest.mark.parametrize("together", [20_000, 0])
def test_remove_repeats_with_shared_neighbours(spark, monkeypatch, together):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    own = lambda i: " ".join(f"d{i}x{k}" for k in range(40))
    passage = " ".join(f"p{k}" for k in range(70))
    period = " ".join(f"q{k % 3}" for k in range(200))
    # the words beside the passage in 1 are beside it in 2 and 3 too; 4 holds periodic text twice
    texts = [f"{own(0)} {passage} {own(10)}", f"{own(1)} left {passage} right {own(11)}", f"{own(2)} left {passage} {own(12)}", f"{own(3)} {passage} right {own(13)}", f"{own(4)} {period} {own(14)} {period}"]
    rows = [(i, t, "", "", "", 0, 0, 0) for i, t in enumerate(texts)]
    out = {r["doc_id"]: r["text"].split() for r in suffix_dedup.remove_repeats(spark.createDataFrame([*rows, rows[0]], SCHEMA)).collect()}
    assert out[0] == texts[0].split()
    assert out[1] == f"{own(1)} left right {own(11)}".split()
    assert out[2] == f"{own(2)} {own(12)}".split()
    assert out[3] == f"{own(3)} {own(13)}".split()
    assert out[4] == [*own(4).split(), *period.split()[:50], *own(14).split()]


@pytest.mark.parametrize("together", [20_000, 0])
def test_rows_of_one_id_are_told_apart(spark, monkeypatch, together):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    draw = lambda p, n: " ".join(f"{p}{k}" for k in range(n))
    shared, other = draw("s", 80), draw("o", 100)
    rows = spark.createDataFrame([(1, shared), (2, shared + " a b c d e"), (2, other), (3, draw("t", 80)), (3, draw("t", 80))], "doc_id long, text string")
    out = sorted((r["doc_id"], r["text"]) for r in suffix_dedup.remove_repeats(rows).collect())
    assert out == sorted([(1, shared), (2, "a b c d e"), (2, other), (3, draw("t", 80)), (3, draw("t", 80))])
    spans = {tuple(r) for r in suffix_dedup.repeated_passages(rows.filter("doc_id = 3")).collect()}
    assert spans == {(3, 0, 80, True)}


def test_near_duplicates_of_one_id_keep_their_links(spark):
    draw = lambda p, n: " ".join(f"{p}{k}" for k in range(n))
    a, b = draw("a", 60), draw("b", 60)
    rows = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " x"), (4, draw("c", 60)), (4, draw("c", 60)), (None, a)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in setsketch.near_duplicates(rows).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True)]


def test_trie_equals_library(spark, docs, empty):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    extra = spark.createDataFrame([(900 + i, t, "", "", "", 0, 0, 0) for i, t in enumerate(["It's <|endoftext|> x", "İstanbul ΣΣ é é", "日本 12½ \x1c y", "a" * 400 + "!" * 300, " 　"])], SCHEMA)
    rows = docs.unionByName(extra)
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    for r in bpe_trie.encode_documents(rows, P.path("word_bpe_49k.json")).collect():
        ids = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert list(np.frombuffer(r["ids"], "<u4")) == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == tok.decode(ids, skip_special_tokens=False)
    assert bpe_trie.encode_documents(empty, P.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize(("name", "style"), [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")])
def test_chunk_cache_equals_library(name, style):
    tok, enc = Tokenizer.from_file(P.path(name)), encoder(P.path(name), style)
    rng = np.random.default_rng(2)
    texts = ["", " ", "a  b\n\n c", " <|endoftext|> x<|endoftext|>y", "x\x1cy é é", "İİ ǅ ß   z"] + ["".join(rng.choice(list("ab'.,0  \n\té’sTL"), 80)) for _ in range(300)]
    assert [list(np.frombuffer(x, "<u4")) for x in enc.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 999, dtype=np.uint64)
    packed = bitpack.pack(ids, bits)
    assert len(packed) == math.ceil(999 * bits / 8)
    assert (bitpack.unpack(packed, bits, 100, 50) == ids[100:150]).all()


def test_token_file(spark, docs, empty, monkeypatch, tmp_path):
    monkeypatch.setattr(bitpack, "BLOCK_IDS", 100)
    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    bitpack.write_token_file(docs, f"{tmp_path}/ids", path)
    rows = bitpack.read_token_file(spark, f"{tmp_path}/ids").orderBy("start").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    start = 0
    for r in rows:
        ids = [*tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], list(np.frombuffer(r["ids"], "<u4"))) == (start, len(ids), ids)
        start += len(ids)
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert keys == sorted(keys) and len(rows) == docs.count()
    assert bitpack.read_document(spark, f"{tmp_path}/ids", 35) == [[*tok.encode(texts[35], add_special_tokens=False).ids, 0]]
    assert sorted(bitpack.read_document(spark, f"{tmp_path}/ids", 5)) == [[*tok.encode(texts[5], add_special_tokens=False).ids, 0]] * 2  # a repeated id
    assert bitpack.read_document(spark, f"{tmp_path}/ids", 10**6) == []
    plan = bitpack.blocks_of(spark, f"{tmp_path}/ids", 35)._jdf.queryExecution().toString()
    assert "LessThanOrEqual(min_id,35)" in plan and "GreaterThanOrEqual(max_id,35)" in plan  # reaches the scan
    assert bitpack.blocks_of(spark, f"{tmp_path}/ids", 35).count() <= 2
    bitpack.write_token_file(empty, f"{tmp_path}/none", path)
    assert bitpack.read_token_file(spark, f"{tmp_path}/none").count() == 0


def test_packing(docs, empty):
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    one = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack_documents(one, path).collect()
    ids = {r["doc_id"]: [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in one.collect()}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, own in ids.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(own)
            assert r["ids_crc32"] == zlib.crc32(np.array(own[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(own)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    total = sum(map(len, ids.values()))
    assert len(by_sequence) <= total / 2048 * 1.03 + 1
    assert packing.pack_documents(empty, path).count() == 0


def test_cutting_stock_is_near_the_bound():
    rng = np.random.default_rng(0)
    counts = np.bincount(np.clip(rng.lognormal(4, 1.1, 5000).astype(int), 1, 256), minlength=257)[1:]
    plan = packing.solve(counts)
    assert (sum(p * n for p, n in plan) == counts).all()
    assert all((p * np.arange(1, 257)).sum() <= 256 for p, _ in plan)
    assert sum(n for _, n in plan) <= (counts * np.arange(1, 257)).sum() / 256 * 1.01 + 1


def vectors(n, d, seed=1):
    return np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)


def true_nearest(x, q, k=10):
    dist = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
    return [i for i in np.lexsort((np.arange(len(x)), dist)) if i != q][:k], dist


def test_nearest_vectors(spark):
    x = vectors(1500, 16)
    x[700:900] = x[0]
    rows = [(i, [float(v) for v in x[i]], 1, "a", 0) for i in range(1500)] + [(i, v, 1, "a", 0) for i, v in ((5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [None] * 16), (5400, [1.0]), (None, [1.0] * 16))]
    df = spark.createDataFrame([*rows, rows[705], rows[705]], "vec_id long, embedding array<float>, label int, codes string, row int")
    got = collections.defaultdict(list)
    for r in additive.nearest(df, every=100, k=10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 1500, 100))
    hits = 0
    for q, found in got.items():
        want, dist = true_nearest(x, q)
        hits += len(set(want) & {v for v, _ in found})
        assert all(abs(dist[v] - s) < 1e-12 for v, s in found)
    assert hits >= 0.9 * 10 * len(got)
    assert [v for v, _ in got[0]] == list(range(700, 710))
    assert additive.nearest(df.limit(0)).count() == 0


def test_neighbours_come_by_their_codes_alike_in_all_partitions(spark):
    x = vectors(6000, 48, 3)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(6000)], "vec_id long, embedding array<float>")
    assert additive.rerank_of(6000) == 39 and additive.rerank_of(100) == 20 and additive.rerank_of(10**9) == 15_812
    seen = [sorted(map(tuple, additive.nearest(df.repartition(n), every=200).collect())) for n in (1, 4, 32)]
    assert seen[0] == seen[1] == seen[2]
    hits = sum(v in true_nearest(x, q)[0] for q, _, v, _ in seen[0])
    assert hits >= 0.9 * len(seen[0]) and len(seen[0]) == 300


def test_beam_search_keeps_the_sum_near():
    books = additive.train(vectors(3000, 12, 5).astype(np.float64))[:6]
    x = vectors(800, 12, 6).astype(np.float64)
    wide, norm = additive.encode(x, books)
    narrow, _ = additive.encode(x, books, beam=1)
    error = lambda codes: ((x - additive.decode(codes, books)) ** 2).sum()
    assert error(wide) <= error(narrow) < (x**2).sum() * 0.5
    assert norm == pytest.approx((additive.decode(wide, books) ** 2).sum(1))


@pytest.mark.parametrize(("shard", "packet", "sparse"), [(8_192, 1_000_000, 8), (7, 150, 10**6), (1, 400, 10**6), (3, 100_000, 0)])
def test_bm25_is_exact(docs, empty, monkeypatch, shard, packet, sparse):
    monkeypatch.setattr(bm25, "SPARSE", sparse)
    monkeypatch.setattr(bm25, "PIVOT", 0.0 if sparse > 8 else 0.2)
    monkeypatch.setattr(bm25, "SEED", 4)
    monkeypatch.setattr(bm25, "LEAD", 1 if shard == 3 else 4)
    monkeypatch.setattr(bm25, "BLOCK", 16 if sparse == 0 else 64)
    monkeypatch.setattr(bm25, "SHARD_DOCS", shard)
    monkeypatch.setattr(bm25, "PACKET_TERMS", packet)
    rows = [(r["doc_id"], tokens(r["text"])) for r in docs.collect() if r["doc_id"] is not None]
    n, mean = len(rows), sum(len(w) for _, w in rows) / len(rows)
    df = collections.Counter(w for _, ws in rows for w in set(ws))
    want = []
    for q in range(0, 120, 20):
        query = set(next(w for i, w in rows if i == q))
        scores = []
        for i, ws in rows:
            c = collections.Counter(ws)
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in query if w in c)
            if i != q and s > 0:
                scores.append((-round(s, 6), i))
        want += [(q, i, -s) for s, i in sorted(scores)[:10]]
    got = [(r["query_id"], r["doc_id"], round(r["score"], 6)) for r in bm25.similar_documents(docs).orderBy("query_id", "rank").collect()]
    assert [g[0] for g in got] == [w[0] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-6)
    assert bm25.similar_documents(empty).count() == 0


def test_bm25_skips_most_blocks(spark):
    """All queries of a table in batches as registered: pivots apart, most blocks of a query are never scored."""
    from corpuscraft.llm.words import word_hashes

    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    shards = [r.asDict() for r in bm25.index_of(table).collect()]
    n = sum(r["n"] for r in shards)
    mean = sum(np.frombuffer(r["lengths"], "<i8").sum() for r in shards) / n
    known, code = np.unique(np.concatenate([np.frombuffer(r["terms"], "<u8") for r in shards]), return_inverse=True)
    df = np.bincount(code, weights=np.concatenate([np.diff(np.frombuffer(r["starts"], "<i4")) for r in shards]))
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    queries = [(np.searchsorted(known, np.unique(word_hashes([r["text"] or ""])[0])).astype(np.int32), r["doc_id"]) for r in table.filter("doc_id % 20 = 0").collect()]
    scored = asked = 0
    for row in shards:
        shard = bm25.Shard(row, known, idf, mean)
        shard.search(queries[: bm25.BATCH], 10, np.zeros(len(queries))[: bm25.BATCH])
        scored, asked = scored + shard.scored, asked + shard.asked_for
    assert asked == len(queries) * sum(-(-r["n"] // bm25.BLOCK) for r in shards) and scored < 0.5 * asked


def test_bm25_blocks_hold_their_own_frequent_terms(spark):
    """Of two languages' documents a block keeps products for its own words only, and results stay those of all scores."""
    from corpuscraft.llm.words import word_hashes

    rng = np.random.default_rng(3)
    texts = [" ".join([f"x{i % 2}"] * 9 + [f"w{i % 2}_{j}" for j in rng.integers(0, 150, rng.integers(20, 60))]) for i in range(1_500)]
    row = bm25.index_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).first().asDict()
    known = np.frombuffer(row["terms"], "<u8")
    df = np.diff(np.frombuffer(row["starts"], "<i4"))
    shard = bm25.Shard(row, known, np.log(1 + (1_500 - df + 0.5) / (df + 0.5)), np.frombuffer(row["lengths"], "<i8").mean())
    cells, frequent = sum(len(x) for x in shard.dense), int((shard.row >= 0).sum())
    assert 0 < cells < 0.7 * frequent * shard.blocks
    queries = [(np.searchsorted(known, np.unique(word_hashes([texts[i]])[0])).astype(np.int32), i) for i in range(0, 1_500, 20)]
    for floor in (0.0, 0.95):
        want = [shard.best(terms, own, np.arange(1_500), 10, 0.0) for terms, own in queries]
        got = shard.search(queries, 10, np.array([floor * s[-1] for _, s in want]))
        assert all(np.array_equal(g[0], w[0]) and np.array_equal(g[1], w[1]) for g, w in zip(got, want, strict=True))


def test_bm25_with_a_repeated_query_id(spark):
    query = "a b c d e f"
    rows = [(0, query)] * 30 + [(i, " ".join(["a b c d e", *[f"x{i}y{j}" for j in range(i)]])) for i in range(1, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [(r["rank"], r["doc_id"]) for r in bm25.search(docs, spark.createDataFrame([(0, query)], "doc_id long, text string"), 5).orderBy("rank").collect()]
    assert got == [(i, i) for i in range(1, 6)]


def test_language_model(docs, empty):
    rows = {r["doc_id"]: tokens(r["text"]) for r in docs.collect() if r["doc_id"] != 5}
    got = {r["doc_id"]: r for r in brown.score_texts(docs.filter("doc_id is null or doc_id <> 5")).collect()}
    key = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7
    c = collections.Counter(w for i, ws in rows.items() if key(i) != 2 for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    for i, ws in rows.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (key(i) == 2, len(ws) + 1, sum(c[w] > 0 for w in [*ws, None]), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*ws, None]))
        assert r["score"] < 0
    assert brown.score_texts(empty).count() == 0


def test_classes_recover_structure_and_sum_to_one():
    rng = np.random.default_rng(3)
    groups = np.arange(12) % 2
    bigrams = np.where(groups[:, None] != groups[None, :], 50, 0) + rng.integers(0, 2, (12, 12))
    cls = brown.exchange(bigrams, 12, 2)
    assert len({tuple(sorted(np.flatnonzero(cls == k) % 2)) for k in range(2)}) == 2
    classes = np.concatenate([cls, 2 + np.arange(1 + brown.BANDS)])
    n = np.zeros((3 + brown.BANDS, 3 + brown.BANDS))
    np.add.at(n, (cls[:, None], cls[None, :]), bigrams)
    types, mass = np.zeros(brown.BANDS), np.zeros(brown.BANDS)
    types[1], mass[1], types[9], mass[9] = 5, 5, 2, 40
    transition, emission = brown.log_tables(n, classes, np.array([10] * 12), types, mass)
    assert (10**transition).sum(1) == pytest.approx(np.ones(len(n)))
    assert 10 ** emission[12 + 1 + 1] * 5 == pytest.approx(1)
    assert [10 ** emission[:12][cls == k].sum() for k in range(2)] == pytest.approx([(1 / 6) ** 6] * 2)
    # a word whose neighbours are those of one group is pulled into it
    left, right = np.zeros((1, len(n))), np.zeros((1, len(n)))
    left[0, cls[1]], right[0, cls[1]] = 30, 30
    assert brown.pulls(left, right, n, 2).argmax() == cls[0]


def test_language_model_equals_a_dictionary_model(spark, monkeypatch):
    monkeypatch.setattr(brown, "HEAD", 8)
    monkeypatch.setattr(brown, "CLASSES", 3)
    monkeypatch.setattr(brown, "FLOOR", 6)
    rng = np.random.default_rng(8)
    pools = [[f"a{i}" for i in range(12)], [f"b{i}" for i in range(12)], [f"c{i}" for i in range(12)]]
    texts = [" ".join(str(rng.choice(pools[j % 3])) for j in range(int(rng.integers(0, 60)))) + (f" rare{i} odd{i // 2}" if i % 3 else "") for i in range(90)] + ["Never seen WORDS", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from corpuscraft.llm._common import Scratch

    coded, stats = brown.prepare(docs, Scratch(spark, "test"), 7, 2, "doc_id", "text")
    model = brown.fit(coded, stats)
    import xxhash

    signed = lambda w: int(np.array([xxhash.xxh3_64_intdigest(w)], dtype=np.uint64).view(np.int64)[0])
    place = dict(zip(model.top.tolist(), model.order.tolist(), strict=True))
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = collections.Counter(w for i, t in enumerate(texts) if not held(i) for w in tokens(t))
    k = len(model.counts)
    assert k == sum(c >= 6 for c in count.values()) > 30 and set(model.cls[:k]) == {0, 1, 2}

    def symbol(w, scored):
        if w is None:
            return k
        if (at := place.get(signed(w))) is not None:
            return at
        c = count[w]
        b = c if c < 8 else 4 + c.bit_length()
        return k + 1 + (8 if scored and b == 7 else b)

    pairs = collections.Counter()
    for i, t in enumerate(texts):
        if not held(i):
            row = [symbol(w, False) for w in [*tokens(t), None]]
            row = [s - 1 if k + 1 < s < k + 9 else s for s in row]
            pairs.update((model.cls[a], model.cls[b]) for a, b in zip([k, *row], row, strict=False))
    n = np.zeros_like(model.transition)
    for (a, b), c in pairs.items():
        n[a, b] = c
    transition, emission = brown.log_tables(n, model.cls, model.counts, stats["types"], stats["mass"])
    assert transition == pytest.approx(model.transition) and emission == pytest.approx(model.emission)
    got = {r["doc_id"]: r["score"] for r in brown.score_texts(docs).collect()}
    for i, t in enumerate(texts):
        want, before = 0.0, model.cls[k]
        for w in [*tokens(t), None]:
            s = symbol(w, True)
            want += transition[before, model.cls[s]] + emission[s] + (math.log10(count[w]) if w is not None and s >= k + 1 and count[w] >= 7 else 0)
            before = model.cls[s]
        assert got[i] == pytest.approx(want)


def test_language_model_beats_base_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = brown.score_texts(docs).filter("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert r["s"] > r["b"]


def test_toxicity(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = toxicity.score_documents(docs, toxicity.training_labels(labels))
    held = scored.join(labels.filter("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0").selectExpr("doc_id", "toxic"), "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in held)
    assert toxicity.score_documents(empty, labels).count() == 0
    nothing = toxicity.score_documents(docs.limit(5), labels.limit(0)).collect()
    assert all(r["score"] == 0 for r in nothing)


def test_toxicity_neighbours_are_exact():
    rng = np.random.default_rng(4)
    rows = [dict(collections.Counter(rng.integers(0, 30, rng.integers(0, 8)).tolist())) for _ in range(700)]
    index = toxicity.Index([f"t{i}" for i in range(30)], rng.uniform(1, 5, 30), rows, list(range(700)), rng.integers(0, 2, 700).tolist(), {0: 1.0, 1: 1.0})
    place = {int(i): k for k, i in enumerate(index.ids)}
    vectors = np.zeros((700, 30))
    for i, r in enumerate(rows):
        at, w = index.unit(r)
        vectors[place[i], at] = w
    for i in range(0, 700, 7):
        if rows[i]:
            docs, cos = index.nearest(rows[i], without=i)
            want = vectors @ vectors[place[i]]
            want[place[i]] = -1
            assert cos == pytest.approx(np.sort(want)[::-1][: len(cos)])
            assert len(docs) == min(toxicity.NEIGHBOURS, int((want > 0).sum()))


def test_licenses(spark, docs, empty):
    rows = [(1, "x\nLicensed under the Apache License, Version 2.0.\ny"), (2, "Released under the MIT License."), (3, "Mit der Zeit.\nfree use"), (4, None), (5, ""), (6, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."), (7, "Licensed under the terms agreed with the author.")]
    got = {r["doc_id"]: r for r in licenses.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["families"] for i in (1, 2, 3, 4, 5, 6, 7)] == [["apache-2.0"], ["mit"], [], [], [], ["cc-by-nc", "gpl-3.0"], []]
    assert got[7]["n_unknown"] == 1
    m = licenses.model()  # of names that no phrase of the training had
    assert m["accuracy"] > 0.65 and m["unknown"] > 0.9 and m["loss"] < math.log(len(m["classes"])) / 2
    plan = licenses.scan_documents(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert licenses.scan_documents(empty).count() == 0


def test_wrapped_licenses(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version."
    mit = "Permission is hereby granted, free of\ncharge, to any person obtaining a copy\nof this software and associated\ndocumentation files, to deal in it"
    mark = lambda t: "\n".join("# " + x for x in t.split("\n"))
    texts = [gpl.format(2), gpl.format(3), mark(gpl.format(2)), mark(gpl.format(3)), "Some text\n#\n" + mark(mit), "MIT License\nApache License 2.0", "a licence\n\n" + gpl.format(3) + "\n\nLicensed under CC BY-NC 4.0"]
    got = {r["doc_id"]: r["families"] for r in licenses.scan_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(7)] == [["gpl-2.0"], ["gpl-3.0"], ["gpl-2.0"], ["gpl-3.0"], ["mit"], ["apache-2.0", "mit"], ["cc-by-nc", "gpl-3.0"]]


def test_licences_of_unknown_families_and_rows(spark):
    texts = [
        (1, "Licensed under the Eclipse Public License 2.0."),
        (2, "Licensed under the Fair Public License 2.0."),
        (3, "See the file for the terms of the work."),
        (4, "Released under the Boost Software License, Version 1.0."),
        (5, "Distributed under the EUPL."),
        (6, "Released under the MIT License."),
        (6, "Released under the MIT License."),
        (6, "Nothing here."),
        (None, "Released under the MIT License."),
        (None, "Licensed under the Apache License, Version 2.0."),
        (8, "word " * 60_000 + "\n\nReleased under the MIT License.\n\n" + "word " * 60_000),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "doc_id copy", "text family", "1 as paragraph")
    got = collections.Counter((r["doc_id"], tuple(r["families"]), r["n_paragraphs"], r["n_unknown"]) for r in licenses.scan_documents(df).collect())
    assert got == collections.Counter({(1, ("epl",), 1, 0): 1, (2, (), 0, 1): 1, (3, (), 0, 0): 1, (4, ("bsl-1.0",), 1, 0): 1, (5, ("eupl",), 1, 0): 1, (6, ("mit",), 1, 0): 2, (6, (), 0, 0): 1, (None, ("mit",), 1, 0): 1, (None, ("apache-2.0",), 1, 0): 1, (8, ("mit",), 1, 0): 1})
    probability = {r["doc_id"]: r["probability"] for r in licenses.scan_documents(df.limit(1).union(df.limit(1))).collect()}
    assert probability[1] == next(r["probability"] for r in licenses.scan_documents(df.limit(1)).collect())


def test_licences_equal_brute_force(spark):
    import regex

    m, split = licenses.model(), regex.compile(licenses.PARAGRAPH)
    at = {f: i for i, f in enumerate(m["features"])}

    def read(unit):
        grams = [g for g in sorted(licenses.ngrams(unit)) if g in at]
        if not any(" " not in g for g in grams):
            return None
        z = m["bias"] + np.sum([np.round(m["weights"][at[g]], 6) for g in grams], axis=0)
        family = m["classes"][int(z.argmax())]
        alike = max([sum(w for g, w in n if g in grams) for f, n in m["templates"] if f == family], default=0.0)
        return family, alike, 1 / np.exp(z - z.max()).sum(), family != licenses.UNKNOWN and alike >= licenses.CONFIRM, bool(regex.search(licenses.CUE, unit))

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = {}
    for r in docs.collect():
        families, unknown, n = set(), 0, 0
        for block in split.split(r["text"] or ""):
            lines = [read(x) for x in block.split("\n")] if "\n" in block else []
            whole, sure = read(block), [x for x in lines if x and x[3]]
            if whole is None:
                continue
            kept = [whole, *[x for x in sure if x[0] != whole[0] and x[1] >= 0.999 and not (x[0] == "gpl" and whole[0] in licenses.SPECIAL)]] if whole[3] else sure or [whole]
            families |= {x[0] for x in kept if x[3]}
            n += sum(x[3] for x in kept)
            unknown += any(not x[3] and x[4] for x in kept)
        want[r["doc_id"]] = (sorted(families), n, unknown)
    got = {r["doc_id"]: (r["families"], r["n_paragraphs"], r["n_unknown"]) for r in licenses.scan_documents(docs).collect()}
    assert got == want and sum(bool(f) for f, _, _ in want.values()) > 5


def test_toxicity_of_odd_rows(spark):
    rng = np.random.default_rng(12)
    draw = lambda n: " ".join(rng.choice(WORDS, n))
    rows = [(i, draw(20) + (" nasty vile nasty" if i % 4 == 0 else "")) for i in range(400)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "nasty " * 40_000), (None, "nasty vile"), (None, None), (904, "nasty vile"), (904, "nasty vile"), (904, draw(30)), (905, "w1 w2 NASTY! vile.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as label", "1 as score", "text as evidence", "0 as toxic")
    marks = [(i, int(i % 4 == 0)) for i in range(400)] + [(3, 0), (4, 1), (None, 1), (900, 0), (77_777, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int").selectExpr("*", "toxic as label", "'t' as text")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        by[r["doc_id"]].append(r["predicted"])
    assert [by[i] for i in (900, 901, 902, 903, 905)] == [[0], [0], [0], [1], [1]]
    assert sorted(by[904]) == [0, 1, 1] and sorted(by[None]) == [0, 1]
    assert sum(by[i] == [int(i % 4 == 0)] for i in range(400)) >= 396
    assert all(e["label"] in (0, 1) and 0 < e["cosine"] <= 1 + 1e-9 for r in got for e in r["evidence"])
    kept = toxicity.clean_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got)


def test_language_model_of_odd_rows(spark):
    rows = [(i, "a b c d") for i in range(30)] + [(5, "a b c d"), (5, "x y"), (None, "a b"), (None, None), (40, "z " * 50_000), (41, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as held", "'b' as block", "text as words", "2 as n", "3 as codes")
    got = collections.Counter((r["doc_id"], r["n_tokens"]) for r in brown.score_texts(docs).collect())
    assert got == collections.Counter((i, len(tokens(t)) + 1) for i, t in rows)


def test_token_file_and_packing_of_odd_rows(spark, tmp_path):
    path = P.path("word_bpe_49k.json")
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "d e f"), (None, None), (2, ""), (3, "word " * 5_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as size", "3 as bucket", "4 as length", "5 as start")
    tok = Tokenizer.from_file(path)
    ids = lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 1]
    pieces = packing.pack_documents(docs, path).collect()
    assert sum(r["length"] for r in pieces) == sum(len(ids(t)) for _, t in rows)
    places = collections.defaultdict(list)
    for r in pieces:
        places[r["sequence_id"]].append((r["offset"], r["offset"] + r["length"]))
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 2048 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    bitpack.write_token_file(docs, f"{tmp_path}/odd", path, "words", 1)
    read = bitpack.read_token_file(spark, f"{tmp_path}/odd").collect()
    want = collections.Counter((i, np.array(ids(t), "<u4").tobytes()) for i, t in rows)
    assert collections.Counter((r["doc_id"], bytes(r["ids"])) for r in read) == want
    starts = sorted((r["start"], r["n_tokens"]) for r in read)
    assert starts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(starts, starts[1:], strict=False))


# operator 11
def vectors_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string, n string, x string, v string")


def test_whitening_against_a_covariance(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 64)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 24)) @ np.diag(np.linspace(3, 0.4, 24))
    rows = [(i, [float(c) for c in v], "c", "n", "x", "v") for i, v in enumerate(base)]
    odd = [(900, None), (901, [None] + [0.0] * 23), (902, [math.nan] + [0.0] * 23), (903, [math.inf] + [0.0] * 23), (904, [1.0, 2.0]), (905, []), (906, [3e38] + [0.0] * 23)]
    rows += [(i, v, "c", "n", "x", "v") for i, v in odd] + [rows[7], rows[7], (None, rows[8][1], "c", "n", "x", "v")]
    df = vectors_table(spark, rows).repartition(40)  # more tasks than children of a node
    got = whitening.whiten(df).orderBy("vec_id", "component").collect()
    kept = [(r[0], r[1]) for r in rows if r[1] is not None and len(r[1]) == 24 and all(c is not None and math.isfinite(c) and abs(c) < 1e30 for c in r[1])]
    assert len(got) == 16 * len(kept) == 16 * 303 and got[0]["vec_id"] is None
    x = {i: np.floor(64 * np.array(v, dtype=np.float32).astype(float)).astype(np.int64) + 1_000_000 for i, v in kept}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(0)
    centred = lambda a: (a - s // n) - (s % n) / n
    cov = centred(fit).T @ centred(fit) / n
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1][:16], w[:, ::-1][:, :16]
    signs = np.zeros(16)
    for r in got:
        j = r["component"] - 1
        want = float(centred(x[r["vec_id"]]) @ w[:, j] / np.sqrt(e[j]))
        signs[j] = signs[j] or np.sign(want * r["whitened"])
        assert abs(r["whitened"] * signs[j] - want) < 1e-9
        assert (r["n"], r["deviation"]) == (n, int(((n * x[r["vec_id"]] - s) ** 2).sum()))
        assert abs(r["explained"] / (e[j] / np.trace(cov)) - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening_without_variance(spark):
    assert whitening.whiten(vectors_table(spark, [])).count() == 0
    assert whitening.whiten(vectors_table(spark, [(1, None, "", "", "", ""), (2, [], "", "", "", "")])).count() == 0
    alike = whitening.whiten(vectors_table(spark, [(i, [1.0, 2.0, 3.0], "", "", "", "") for i in range(5)])).collect()
    assert len(alike) == 15 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in alike)
    line = whitening.whiten(vectors_table(spark, [(i, [float(i), 2.0 * i, 0.0], "", "", "", "") for i in range(4)])).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in line) and all(abs(r["explained"] - (r["component"] == 1)) < 1e-12 for r in line)


def test_deviation_of_any_size():
    model = whitening.Whitening(10**7, [5 * 10**7 + 3, 0], np.eye(2), np.ones(2), 2.0, 2)
    x = np.array([[6, 1], [5 + 10**3, 2], [5 + 10**9, 0]], dtype=np.int64)
    want = [sum((10**7 * int(v) - s) ** 2 for v, s in zip(r, model.sums, strict=True)) for r in x]
    assert model.deviations(x) == [v if v < 1 << 63 else None for v in want] and want[2] >= 1 << 63
    assert model.deviations(x[:1]) == want[:1]


# operator 12
def brute_trie(rows, block=100, heads=6):
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            by[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in by.items()}
    new = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        new[c] = (*own.get(c - int(math.fmod(c, block)), [])[:h], *v[h:])
    members = collections.defaultdict(list)
    for c in sorted(new):
        for d in range(len(new[c]) + 1):
            members[new[c][:d]].append(c)
    kids, leaves, saved = collections.Counter(k[:-1] for k in members if k), collections.Counter(), collections.Counter()
    for k in sorted(members, key=len, reverse=True):
        leaves[k] += not kids[k]
        saved[k] += (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        if k:
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    sha = lambda k: hashlib.sha256(",".join(str(c) for c in members[k] if len(new[c]) == len(k)).encode()).hexdigest()
    return sorted((m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], sha(k)) for k, m in members.items())


TURNS = "conv_id long, turn long, role string, text string, bucket string, pos string, total string, round string"


@pytest.mark.parametrize("local", [prefix_trie.LOCAL, 60, 1])
def test_prefix_trie(spark, monkeypatch, local):
    monkeypatch.setattr(prefix_trie, "PIECE", 50)
    rng = np.random.default_rng(8)
    texts = ["", "hello", "a", "bb", "wörter 🤦 drei", "long " * 300]
    rows = []
    for c in [*range(0, 330), *range(400, 420), 777, -7, -100, 10**15]:
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t, ["user", "assistant", None][int(rng.integers(0, 3))], texts[int(rng.integers(0, 6))]))
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1090) for t in range(7)]  # copies
    rows += [(1095, t, "user", f"deep {t}") for t in range(300)] + [(1096, t, "user", f"deep {t}") for t in range(280)]
    rows += [(1200, None, "user", None), (1200, 0, "user", "then"), (1200, None, "assistant", ""), (None, 0, "user", "nobody's"), (1203, 0, "user", "x"), (1203, 0, "user", "x")]
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([(*rows[i], "b", "p", "t", "r") for i in order], TURNS).repartition(7)
    got = prefix_trie.prefix_trie(df, local=local)
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[0], r[1])) == brute_trie(rows)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS), local=local).count() == 0


def test_prefix_trie_without_turns(spark):
    """A conversation whose turns are all replaced by those of an absent one still is a member of the root."""
    c = next(i for i in range(101, 200) if zlib.crc32(str(i).encode()) % 6 >= 2)
    rows = [(c, 0, "user", "one"), (c, 1, "user", "two")]
    got = prefix_trie.prefix_trie(spark.createDataFrame([(*r, "b", "p", "t", "r") for r in rows], TURNS)).collect()
    assert [tuple(r) for r in got] == brute_trie(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


# operator 13
def level_targets(sizes, weights=(5, 2, 1)):
    """Shares, then the excess over twice the size dealt again by weight until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not over:
            out |= share
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL", 16)
    monkeypatch.setattr(mixing, "BLOCK", 50)
    df = make_docs(spark, 240).drop("lang")
    names = ["zeta", "Alpha", "ähnlich", "beta", None, "wordless"]
    source = F.element_at(F.array(*[F.lit(x) for x in names]), F.when(F.length("text") < 1, 6).when(F.col("doc_id") < 80, 1).otherwise(F.pmod(F.coalesce("doc_id", F.lit(3)), F.lit(5)) + 1).cast("int"))
    df = df.withColumn("source", source).withColumn("size", F.lit("clash")).withColumn("row", F.lit("clash")).cache()
    rows = mixing.mix_documents(df, shard=40).collect()
    full = mixing.Mix(df, shard=40)
    want = collections.Counter()
    for r in df.collect():
        want[r["source"]] += len(tokens(r["text"]))
    target, taken = level_targets(want), collections.Counter()
    assert len(rows) == df.count()
    by_id = {r["doc_id"]: r["source"] for r in df.collect()}
    for r in rows:
        s = by_id[r["doc_id"]]
        assert r["source_size"] == want[s] and abs(r["target"] - target[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5001 for s in target) and len(target) == 6
    assert sorted(map(repr, mixing.mix_documents(df.repartition(9), shard=40).collect())) == sorted(map(repr, rows))  # reruns agree
    blocks = full.blocks.collect()
    shards = collections.Counter(b["shard"] for b in blocks)
    assert len(shards) == -(-len(blocks) // 40) and max(shards.values()) - min(shards.values()) <= 1
    assert all(sorted(b["place"] for b in blocks if b["shard"] == s) == list(range(1, n + 1)) for s, n in shards.items())
    words = collections.Counter(w for r in full.texts.collect() for w in tokens(r["text"]))
    assert sum(words.values()) == sum(r["taken"] for r in rows)
    assert mixing.mix_documents(df.limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix_documents(df.filter("length(text) < 1")).collect()] == [0]


def test_hypergeometric_draws(spark):
    """Frequencies against exact probabilities, and the ends of the range."""
    n, m, k, reps = 30, 12, 9, 20_000
    lit = lambda v: F.lit(v).cast("long")
    draw = lambda *a: mixing.hypergeometric(*map(lit, a), mixing.uniform(F.lit(5), F.col("id")))
    got = {r["x"]: r["count"] for r in spark.range(reps).select(draw(n, m, k).alias("x")).groupBy("x").count().collect()}
    for x in range(0, 10):
        p = math.comb(m, x) * math.comb(n - m, k - x) / math.comb(n, k)
        assert abs(got.get(x, 0) / reps - p) < 5 * math.sqrt(p * (1 - p) / reps) + 1e-4
    ends = spark.range(50).select(draw(10, 10, 4).alias("a"), draw(10, 0, 4).alias("b"), draw(10, 4, 10).alias("c"), draw(10, 7, 5).alias("d"), draw(10**9, 5 * 10**8, 5 * 10**8).alias("e")).collect()
    assert all(r["a"] == 4 and r["b"] == 0 and r["c"] == 4 and 2 <= r["d"] <= 5 and abs(r["e"] - 25 * 10**7) < 80_000 for r in ends)


def test_exact_scores_are_the_same_from_slices_and_positions(monkeypatch):
    import numpy as np

    from corpuscraft.llm import bm25

    rng = np.random.default_rng(5)
    known = np.arange(50, dtype=np.uint64)
    sets = [np.sort(rng.choice(50, 1 + i % 20, replace=False)) for i in range(90)]
    cells = bm25.build(list(range(90)), [len(x) for x in sets], np.repeat(np.arange(90), [len(x) for x in sets]).astype(np.int32), np.concatenate(sets).astype(np.uint64), np.ones(sum(map(len, sets)), dtype=np.int32))
    row = dict(zip([c.split()[0] for c in bm25.SHARD.split(", ")], [0, True, 90, *cells], strict=True))
    shard = bm25.Shard(row, known, rng.random(50), 10.0)
    terms = np.sort(rng.choice(50, 20, replace=False)).astype(np.int32)
    for docs in (np.arange(90), np.array([3, 70, 8]), np.zeros(0, dtype=np.int64)):
        got = []
        for most in (0, 1_000):
            monkeypatch.setattr(bm25, "SLICES", most)
            got.append(shard.exact(terms, docs).tobytes())
        assert got[0] == got[1] and len(got[0]) == 8 * len(docs)
