"""Approximate nearest neighbours by additive quantisation.

A vector is stored as the sum of ``BOOKS`` full-dimensional codewords, one from each codebook. Codebooks are trained one after
another on residuals of a bounded sample (``SAMPLE`` rows, chosen by hash); a beam search over partial sums encodes every row,
and the squared norm of the sum is stored. A query's inner products with all codewords form a table, so a stored row's
approximate distance is its norm minus twice a sum of ``BOOKS`` table entries. Of the whole table, the ``rerank_of(rows)`` rows
of least approximate distance are fetched for each query, by a join, and ranked by the exact distance on original vectors: a
number fixed by the table's size alone, whatever the partitions.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, task

BOOKS, WORDS, BEAM = 32, 256, 4
SAMPLE = 16_384
#: One row in so many gives each query a first bound of its candidates' distances.
SEED = 4
#: Queries sent to the tasks at once: the bound of that broadcast. More queries make more passes over the codes.
QUERIES = 4_096
#: Places in all lists of a task at once: longer lists make fewer queries a pass.
LISTED = 1 << 20
#: Rows scored at once, and queries at once: the bound of the score table in memory.
ROWS, ASKED = 2_048, 512


def rerank_of(rows: int, k: int = 10) -> int:
    """Half the square root of the rows, at least ``2 * k``: the list grows with the table, without an end."""
    return max(2 * k, (math.isqrt(max(rows - 1, 0)) + 2) // 2)


def train(x: np.ndarray, seed: int = 7, rounds: int = 5) -> np.ndarray:
    """Codebooks (BOOKS, WORDS, d) by k-means on the residuals of the greedy sum."""
    rng = np.random.default_rng(seed)
    left, books = x.astype(np.float64).copy(), []
    near_to = lambda c: (np.einsum("kd,kd->k", c, c)[None] - 2 * left @ c.T).argmin(1)
    for _ in range(BOOKS):
        centres = left[rng.choice(len(left), WORDS, replace=len(left) < WORDS)].copy()
        for _ in range(rounds):
            near = near_to(centres)
            n = np.bincount(near, minlength=WORDS)
            order, some = np.argsort(near, kind="stable"), np.flatnonzero(n)
            centres[some] = np.add.reduceat(left[order], (np.cumsum(n) - n)[some]) / n[some, None]
            centres[n == 0] = left[rng.integers(0, len(left), int((n == 0).sum()))]
        left -= centres[near_to(centres)]
        books.append(centres)
    return np.stack(books)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, BOOKS) and squared norms of the sums, by beam search on the distance of partial sums."""
    n, (m, k, d) = len(x), books.shape
    left, cost = x[:, None, :].copy(), np.einsum("nd,nd->n", x, x)[:, None]
    codes = np.zeros((n, 1, 0), dtype=np.uint8)
    rows = np.arange(n)[:, None]
    for b, words in enumerate(books):
        total = (cost[:, :, None] - 2 * (left.reshape(-1, d) @ words.T).reshape(n, -1, k) + np.einsum("kd,kd->k", words, words)).reshape(n, -1)
        width = min(beam if b < m - 1 else 1, total.shape[1])
        best = np.sort(np.argpartition(total, width - 1, axis=1)[:, :width], axis=1)
        state, word = best // k, best % k
        cost, left = total[rows, best], left[rows, state] - words[word]
        codes = np.concatenate([codes[rows, state], word[:, :, None].astype(np.uint8)], axis=2)
    codes = codes[:, 0]
    return codes, (decode(codes, books) ** 2).sum(1)


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), books.shape[2]))
    for b, words in enumerate(books):
        out += words[codes[:, b]]
    return out


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows with an id and a finite, non-zero vector without nulls, as doubles."""
    v = F.col("vec")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).filter("vec_id is not null and size(vec) > 0")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return rows.filter(fine).filter(F.exists(v, lambda c: c != 0))


def build_index(df: DataFrame, scratch: Scratch, id_col: str, vec_col: str) -> tuple[DataFrame, np.ndarray | None, int]:
    """Every usable row of the commonest dimension: vec_id, codes, norm, vec; the codebooks; the dimension."""
    rows = usable(df, id_col, vec_col)
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return rows, None, 0
    d = common["d"]
    rows = rows.filter(F.size("vec") == d)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec")

    def fit(batches):
        import pyarrow as pa

        parts = [b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, d) for b in batches if b.num_rows]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(np.concatenate(parts)))], pa.binary())], names=["books"])

    books = pickle.loads(sample.coalesce(1).mapInArrow(task(fit), "books binary").first()["books"])

    def code(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                full = np.concatenate([x, np.zeros((1024 - len(x), d))])  # of one shape, so that a row's sums never depend on its batch
                codes, norm = encode(full, books)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("row"), pa.array([c.tobytes() for c in codes[: len(x)]], pa.binary()), pa.array(norm[: len(x)]), part.column("vec")], names=["vec_id", "row", "codes", "norm", "vec"])

    keyed = rows.select("vec_id", F.xxhash64("vec").alias("row"), "vec")
    return scratch.put(keyed.mapInArrow(task(code), "vec_id long, row long, codes binary, norm double, vec array<double>"), "index"), books, d


def search(index: DataFrame, books: np.ndarray, d: int, queries: DataFrame, k: int = 10, rerank: int | None = None) -> DataFrame:
    """The k nearest index rows of each query (vec_id, vec) but its own: query_id, rank, vec_id, score."""
    spark = index.sparkSession
    rerank = rerank or rerank_of(index.count(), k)
    total = queries.count()
    passes = max(1, -(-total // (min(QUERIES, max(1, LISTED // rerank)) * 3 // 4 or 1)))
    m, words, _ = books.shape
    flat = books.reshape(-1, d)
    rough = None
    for p in range(passes):
        block = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).orderBy("vec_id").toArrow()  # at most QUERIES rows
        q_ids = block.column("vec_id").to_numpy()
        q = block.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, d)
        shared = spark.sparkContext.broadcast((q_ids, q, flat))

        def near(batches, shared=shared, floor=None):
            import pyarrow as pa

            q_ids, q, flat = shared.value
            tables = (2 * q @ flat.T).astype(np.float32).reshape(len(q), m, words)
            score = np.full((len(q), rerank), np.inf)
            least = np.full(len(q), np.inf) if floor is None else floor.value
            ids, rows = np.full((len(q), rerank), np.iinfo(np.int64).max), np.zeros((len(q), rerank), dtype=np.int64)
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    part = b.slice(at, ROWS)
                    own, row, norm = (part.column(c).to_numpy() for c in ("vec_id", "row", "norm"))
                    once = np.unique(np.stack([own, row]), axis=1, return_index=True)[1]  # rows equal in id and vector count once
                    own, row, norm = own[once], row[once], norm[once]
                    codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(-1, m)[once].astype(np.intp)
                    for low in range(0, len(q), ASKED):
                        some = slice(low, low + ASKED)
                        got = np.zeros((len(q_ids[some]), len(own)), dtype=np.float32)
                        for book in range(m):
                            got += tables[some, book][:, codes[:, book]]
                        got = np.round(norm[None] - got, 5)
                        got[own[None] == q_ids[some, None]] = np.inf
                        edge = np.minimum(score[some, -1], least[some])
                        for i in np.flatnonzero((got <= edge[:, None]).any(1)) + low:
                            mine = got[i - low]
                            use = np.flatnonzero((mine <= edge[i - low]) & (mine < np.inf))
                            s, v, r = np.concatenate([score[i], mine[use]]), np.concatenate([ids[i], own[use]]), np.concatenate([rows[i], row[use]])
                            order = np.lexsort((r, v, s))
                            fresh = np.concatenate([[True], (np.diff(v[order]) != 0) | (np.diff(r[order]) != 0) | ~np.isfinite(s[order][1:])])
                            top = order[fresh][:rerank]
                            score[i], ids[i], rows[i] = s[top], v[top], r[top]
            at = np.flatnonzero(np.isfinite(score).ravel())
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, rerank)[at]), pa.array(ids.ravel()[at]), pa.array(rows.ravel()[at]), pa.array(score.ravel()[at])], names=["query_id", "vec_id", "row", "rough"])

        schema, stored = "query_id long, vec_id long, row long, rough double", index.select("vec_id", "row", "codes", "norm")
        # the candidates of a part of the rows bound those of all: no task tells many that cannot be among the best
        seeds = distinct_best(stored.filter(F.pmod(F.xxhash64("vec_id", "row"), F.lit(SEED)) == 0).mapInArrow(task(near), schema), rerank)
        bounds = seeds.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("rough").alias("bound")).filter(F.col("n") == rerank).toArrow()  # a row for each query
        least = np.full(len(q_ids), np.inf)
        least[np.searchsorted(q_ids, bounds.column("query_id").to_numpy())] = bounds.column("bound").to_numpy()
        floor = spark.sparkContext.broadcast(least)
        part = stored.mapInArrow(task(lambda batches, near=near, floor=floor: near(batches, floor=floor)), schema)
        rough = part if rough is None else rough.unionByName(part)
    kept = distinct_best(rough, rerank).select("query_id", "vec_id", "row")
    vectors = index.select("vec_id", "row", "vec").join(kept.select("vec_id", "row").distinct(), ["vec_id", "row"], "left_semi").dropDuplicates(["vec_id", "row"])
    both = kept.join(vectors, ["vec_id", "row"]).join(queries.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("q")), "query_id")
    exact = F.sqrt(F.aggregate(F.zip_with("vec", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    ranked = both.select("query_id", "vec_id", "row", exact.alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id", "row")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def distinct_best(rough: DataFrame, rerank: int) -> DataFrame:
    """The rows of least approximate distance of each query; a row that several tasks tell counts once."""
    merged = rough.groupBy("query_id", "vec_id", "row").agg(F.min("rough").alias("rough"))
    return merged.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("rough", "vec_id", "row"))).filter(F.col("at") <= rerank).drop("at")


def nearest(df: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Searches with every row whose id is divisible by ``every``. Rows that repeat an id with another vector are rows of their own
    (of a query's, the least vector asks); rows equal in both count once. Vectors that are null, zero, of another dimension than
    the commonest or not finite take no part; without usable rows the result is empty."""
    scratch = Scratch(df.sparkSession, "additive")
    index, books, d = build_index(df, scratch, id_col, vec_col)
    if books is None:
        return index.selectExpr("vec_id query_id", "cast(0 as int) rank", "vec_id", "cast(0 as double) score").limit(0)
    queries = index.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    return search(index, books, d, queries, k)
