"""Toxicity scores by the nearest labelled examples under exact TF-IDF cosine.

Examples are a bounded sample of labelled rows: at most ``EXAMPLES`` of each label, the first by a hash of their id. Terms are
words, and beginnings of words, that lean towards one label (odds ratio of ``LEANING`` or more either way) beyond chance (a
likelihood-ratio statistic of ``TELLING`` or more), at most ``VOCABULARY`` of them. Examples lie in an inverted index cut into
blocks of ``BLOCK`` examples with each term's greatest weight in each block; a query visits blocks by falling bound and stops
when no block can hold one of its ``NEIGHBOURS`` nearest: the result is exact. Neighbours vote by distance, each weighed by how
many labelled rows it stands for; an isotonic map, fitted on the examples' own votes without themselves, makes the vote a
probability. The nearest examples are returned as evidence.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, bound_batches, crc_mod, steps, task, texts_of
from .tokenize import Cache

EXAMPLES, VOCABULARY, TELLING, LEANING, BLOCK, NEIGHBOURS = 10_000, 16_000, 24.0, 4.0, 64, 15
PREFIXES = (4, 5)
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def terms_of(word: str) -> list[str]:
    """A word and its beginnings of four and five letters, so that inflected and compound forms count together."""
    return [word, *[word[:n] + "~" for n in PREFIXES if len(word) > n]]


class WordTerms(Cache):
    """The known terms of a word."""

    def __init__(self, term: dict[str, int]):
        super().__init__(self.find, 100_000)
        self.term = term

    def find(self, word: str) -> tuple[int, ...]:
        return tuple(self.term[t] for t in terms_of(word) if t in self.term)

    def __reduce__(self):
        return WordTerms, (self.term,)


class Index:
    """Unit TF-IDF vectors of the examples, with block maxima."""

    def __init__(self, terms: list[str], idf: np.ndarray, rows: list[dict[int, int]], ids: list[int], labels: list[int], weights: dict[int, float]):
        self.term = {w: i for i, w in enumerate(terms)}
        self.of_word = WordTerms(self.term)
        self.idf = idf
        vectors = [self.unit(r) for r in rows]
        order = sorted(range(len(rows)), key=lambda i: (-1 if not len(vectors[i][0]) else int(vectors[i][0][vectors[i][1].argmax()]), ids[i]))  # like by like: tighter bounds
        vectors = [vectors[i] for i in order]
        self.ids = np.array([ids[i] for i in order], dtype=np.int64)
        self.labels = np.array([labels[i] for i in order], dtype=np.int64)
        self.weights = np.array([weights[labels[i]] for i in order])
        n_terms, self.n = len(terms), len(rows)
        self.blocks = max(1, -(-self.n // BLOCK))
        flat = np.concatenate([v[0] for v in vectors]) if vectors else np.zeros(0, dtype=np.int64)
        value = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
        doc = np.repeat(np.arange(self.n), [len(v[0]) for v in vectors])
        by_term = np.lexsort((doc, flat))
        flat, self.post_doc, self.post_value = flat[by_term], doc[by_term], value[by_term]
        cell = flat * self.blocks + self.post_doc // BLOCK
        self.cell_start = np.searchsorted(cell, np.arange(n_terms * self.blocks + 1))
        self.block_max = np.zeros(n_terms * self.blocks)
        np.maximum.at(self.block_max, cell, self.post_value)
        self.block_max = self.block_max.reshape(n_terms, self.blocks)
        none = np.array([not len(v[0]) for v in vectors], dtype=bool)
        self.empty = (float((self.weights * self.labels)[none].sum()), float(self.weights[none].sum()), none)
        self.map_x, self.map_y = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        self.known: dict = {}

    def unit(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.array(sorted(counts), dtype=np.int64)
        w = np.array([1 + np.log(counts[i]) for i in at.tolist()]) * self.idf[at] if len(at) else np.zeros(0)
        return at, w / np.sqrt((w * w).sum()) if len(at) else w

    def counts(self, text: str) -> dict[int, int]:
        return Counter([i for found in map(self.of_word.__getitem__, words_of(text)) for i in found])

    def nearest(self, counts: dict[int, int], without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the nearest examples that share a term, nearest first, ties by place."""
        at, w = self.unit(counts)
        bound = w @ self.block_max[at] if len(at) == 1 else (w[:, None] * self.block_max[at]).sum(0)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        docs, cos, edge = np.zeros(0, dtype=np.int64), np.zeros(0), -1.0
        for k in range(0, len(order), 16):
            part = order[k : k + 16]
            part = part[bound[part] >= edge - 1e-12]
            if not len(part):
                break
            cells = (at[:, None] * self.blocks + part).ravel()
            start = self.cell_start[cells]
            size = self.cell_start[cells + 1] - start
            posts = np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            scores = np.bincount(self.post_doc[posts], weights=self.post_value[posts] * np.repeat(np.repeat(w, len(part)), size))
            new = np.flatnonzero(scores)
            if without is not None:
                new = new[self.ids[new] != without]
            docs, cos = np.concatenate([docs, new]), np.concatenate([cos, scores[new]])
            top = np.lexsort((docs, -cos))[:NEIGHBOURS]
            docs, cos = docs[top], cos[top]
            edge = cos[-1] if len(cos) == NEIGHBOURS else -1.0
        return docs, cos

    def vote(self, counts: dict[int, int], without: int | None = None) -> tuple[float, list]:
        """The share of the weight that votes toxic, and the nearest three examples."""
        key = tuple(sorted(counts.items())) if without is None and len(counts) < 12 else None
        if key is not None and key in self.known:
            return self.known[key]
        docs, cos = self.nearest(counts, without) if counts else (np.zeros(0, dtype=np.int64), np.zeros(0))
        if len(docs):
            w = self.weights[docs] / (1.02 - np.minimum(cos, 1))
            out = float((w * self.labels[docs]).sum() / w.sum())
        else:
            toxic, total, none = self.empty
            own = none & (self.ids == without) if without is not None and not counts else np.zeros(self.n, dtype=bool)
            toxic, total = toxic - float((self.weights * self.labels)[own].sum()), total - float(self.weights[own].sum())
            out = toxic / total if total > 0 else 0.0
        found = (out, [(int(self.ids[d]), float(c), int(self.labels[d])) for d, c in zip(docs[:3], cos[:3], strict=True)])
        if key is not None and len(self.known) < 10_000:
            self.known[key] = found
        return found

    def calibrate(self, votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        """Isotonic regression: pools neighbours until the share of toxic weight rises with the vote."""
        pools: list[list[float]] = []
        for x, y, w in sorted(zip(votes.tolist(), labels.tolist(), weights.tolist(), strict=True)):
            if pools and pools[-1][3] == x:
                pools[-1][0] += y * w
                pools[-1][1] += w
            else:
                pools.append([y * w, w, x, x])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                y2, w2, _, x2 = pools.pop()
                pools[-1][0] += y2
                pools[-1][1] += w2
                pools[-1][3] = x2
        if pools:
            self.map_x = np.array([p[i] for p in pools for i in (2, 3)])
            self.map_y = np.array([p[0] / p[1] for p in pools for _ in (2, 3)])

    def score(self, vote: float) -> float:
        return float(np.clip(np.interp(vote, self.map_x, self.map_y), 0, 1))


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str, text_col: str, label_col: str) -> Index | None:
    """An index of examples among ``labels`` (id, label; of repeated ids the greatest label; others than 0 and 1 don't count)."""
    spark = docs.sparkSession
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    marks = scratch.put(marks.groupBy("doc_id").agg(F.max("label").alias("label")), "marks")
    totals = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    picks = [r for y in totals for r in marks.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES).collect()]
    if not picks:
        return None
    chosen = F.broadcast(spark.createDataFrame(picks, marks.schema))  # at most EXAMPLES rows of each label
    texts = texts_of(docs, id_col, text_col).selectExpr("cast(doc_id as long) doc_id", "text").join(chosen, "doc_id").select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"))
    texts = scratch.put(texts, "examples")

    def presence(batches):
        import pyarrow as pa

        for _, marks, found in steps(batches):
            seen = Counter(), Counter()
            for y, t in zip(marks, found, strict=True):
                seen[y].update(set(words_of(t)))
            terms = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *[pa.array([s[w] for w in terms], pa.int64()) for s in seen]], names=["term", "clean", "toxic"])

    got = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = got.get(0, 0), got.get(1, 0)
    if not n0 + n1:
        return None
    part = lambda o, e: F.when(o > 0, 2 * o * F.log(o / e)).otherwise(0.0)
    whole = texts.mapInArrow(task(presence), "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # a beginning counts by its words but the commonest, so that it says more than that word does
    begun = whole.select(F.explode(F.array(*[F.when(F.length("term") > k, F.concat(F.substring("term", 1, k), F.lit("~"))) for k in PREFIXES])).alias("start"), "clean", "toxic").filter("start is not null")
    rest = lambda c: F.least(F.sum(c) - F.max_by(c, F.struct(F.col("clean") + F.col("toxic"), "toxic")), F.lit(got.get(int(c == "toxic"), 0))).alias(c)
    seen = whole.unionByName(begun.groupBy(F.col("start").alias("term")).agg(rest("clean"), rest("toxic")))
    n, df = n0 + n1, F.col("clean") + F.col("toxic")
    g2 = part(F.col("toxic"), df * n1 / n) + part(F.col("clean"), df * n0 / n) + part(n1 - F.col("toxic"), (n - df) * n1 / n) + part(n0 - F.col("clean"), (n - df) * n0 / n)
    odds = (F.col("toxic") + 0.5) * (n0 - F.col("clean") + 0.5) / ((F.col("clean") + 0.5) * (n1 - F.col("toxic") + 0.5))
    terms = seen.filter((df >= 3) & ((odds >= LEANING) | (odds <= 1 / LEANING))).withColumn("g2", g2).filter(F.col("g2") >= TELLING).orderBy(F.desc("g2"), "term").limit(VOCABULARY).collect()
    idf = np.array([np.log((n + 1) / (r["clean"] + r["toxic"] + 1)) + 1 for r in terms])
    names = [r["term"] for r in terms]
    lookup = WordTerms({w: i for i, w in enumerate(names)})

    def vectors(batches):
        import pyarrow as pa

        for ids, marks, found in steps(batches):
            rows = [Counter([i for some in map(lookup.__getitem__, words_of(t)) for i in some]) for t in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int32()), pa.array([list(r) for r in rows], pa.list_(pa.int32())), pa.array([list(r.values()) for r in rows], pa.list_(pa.int32()))], names=["doc_id", "label", "at", "tf"])

    rows = texts.mapInArrow(task(vectors), "doc_id long, label int, at array<int>, tf array<int>").orderBy("doc_id", F.size("at")).collect()
    weights = {y: totals[y] / got[y] for y in got}
    index = Index(names, idf, [dict(zip(r["at"], r["tf"], strict=True)) for r in rows], [r["doc_id"] for r in rows], [r["label"] for r in rows], weights)
    shared = spark.sparkContext.broadcast(index)

    def own_votes(batches):
        import pyarrow as pa

        for b in batches:
            c = b.to_pydict()
            votes = [shared.value.vote(dict(zip(a, t, strict=True)), without=i)[0] for i, a, t in zip(c["doc_id"], c["at"], c["tf"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), b.column("label")], names=["vote", "label"])

    votes = texts.mapInArrow(task(vectors), "doc_id long, label int, at array<int>, tf array<int>").repartition(max(8, spark.sparkContext.defaultParallelism)).mapInArrow(task(own_votes), "vote double, label int").collect()
    scratch.drop("marks", "examples")
    index.calibrate(np.array([v["vote"] for v in votes]), np.array([v["label"] for v in votes]), np.array([weights[v["label"]] for v in votes]))
    return index


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, score, predicted, evidence (doc_id, cosine, label of the nearest examples), a row for each row.

    Learns from the given labels only; null texts count as empty; a text without any term has the share of toxic rows among
    such examples. Without any labelled text every score is 0.
    """
    spark = docs.sparkSession
    index = fit(docs, labels, Scratch(spark, "toxicity"), id_col, text_col, label_col)
    shared = spark.sparkContext.broadcast(index)

    def run(batches):
        import pyarrow as pa

        index = shared.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
        for ids, texts in steps(batches):
            found = [index.vote(index.counts(t)) if index else (0.0, []) for t in texts]
            scores = [index.score(v) if index else 0.0 for v, _ in found]
            evidence = [[{"doc_id": d, "cosine": c, "label": y} for d, c, y in e] for _, e in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidence, kind)], names=["doc_id", "score", "predicted", "evidence"])

    rows = texts_of(docs, id_col, text_col).selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(task(run), "doc_id long, score double, predicted int, evidence array<struct<doc_id:bigint,cosine:double,label:int>>")


def clean_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of docs scored below 0.5, with all their columns; a map over the rows, without any join."""
    spark = docs.sparkSession
    index = fit(docs, labels, Scratch(spark, "toxicity"), id_col, text_col, label_col)
    if index is None:
        return docs
    bound_batches(spark)
    shared, at = spark.sparkContext.broadcast(index), docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        index = shared.value
        for b in batches:
            texts = b.column(at).cast(pa.string()).to_pylist()
            yield b.filter(pa.array([index.score(index.vote(index.counts(t or ""))[0]) < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(task(run), docs.schema)


def training_labels(labels: DataFrame, folds: int = 5, id_col: str = "doc_id") -> DataFrame:
    """The rows that may be learnt from: crc32(id as text) mod folds is not 0."""
    return labels.filter(crc_mod(id_col, folds) != 0)
