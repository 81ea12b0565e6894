"""Packing documents into fixed-length sequences as a cutting-stock problem solved by column generation.

A document's ids are cut into full pieces of ``capacity`` ids and one rest. Piece lengths, in steps of ``capacity / UNITS``
rounded up, form a histogram of at most ``UNITS`` classes, all that the driver needs. A linear program over patterns (how many
pieces of each class share a sequence) is solved by the revised simplex method; a knapsack dynamic program prices new columns.
Whole parts of the solution are kept, what is left is packed best-fit decreasing, and the pieces, ranked within their class,
take the pattern's places in order.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, steps, task, texts_of
from .tokenize import encoder

#: Length classes a sequence is divided into: the bound of the histogram, the linear program and the tables sent to the tasks.
UNITS = 256


def knapsack(values: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes 1..units of greatest value that fits ``units``; values[j] is that of size j + 1."""
    best, took = np.zeros(units + 1), np.zeros(units + 1, dtype=np.int64)
    for c in range(1, units + 1):
        reach = values[:c] + best[c - 1 :: -1][:c]
        j = int(reach.argmax())
        if reach[j] > best[c - 1] + 1e-12:
            best[c], took[c] = reach[j], j + 1
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(units, dtype=np.int64), units
    while c > 0:
        if took[c]:
            pattern[took[c] - 1] += 1
            c -= took[c]
        else:
            c -= 1
    return float(best[units]), pattern


def invert(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots, in plain array operations: a threaded BLAS beside a JVM can stall the driver."""
    m = len(matrix)
    both = np.hstack([matrix.astype(float), np.eye(m)])
    for k in range(m):
        top = k + int(np.abs(both[k:, k]).argmax())
        both[[k, top]] = both[[top, k]]
        both[k] /= both[k, k]
        factors = both[:, k].copy()
        factors[k] = 0
        both -= factors[:, None] * both[k]
    return both[:, m:]


def solve(counts: np.ndarray, units: int = UNITS) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used; together they hold exactly ``counts[j]`` pieces of size j + 1."""
    sizes = np.flatnonzero(counts)
    m = len(sizes)
    if not m:
        return []
    need = counts[sizes].astype(float)
    columns = np.zeros((units, m), dtype=np.int64)
    columns[sizes, np.arange(m)] = units // (sizes + 1)
    inverse = np.diag(1.0 / columns[sizes, np.arange(m)])
    x = (inverse * need).sum(1)
    for step in range(20 * m):
        duals = np.zeros(units)
        duals[sizes] = inverse.sum(0)
        value, pattern = knapsack(np.where(counts > 0, duals, -1.0), units)
        if value <= 1 + 1e-7:
            break
        direction = (inverse * pattern[sizes]).sum(1)
        ratios = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        columns[:, out] = pattern
        inverse[out] /= direction[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(direction[others], inverse[out])
        if step % 100 == 99:
            inverse = invert(columns[sizes])
        x = np.maximum((inverse * need).sum(1), 0)
    whole = np.floor(x + 1e-6).astype(np.int64)
    rest = counts - (columns * whole).sum(1)
    for j in range(m):  # rounding may have gone over by a piece
        while (rest < 0).any() and whole[j] and (columns[:, j] * (rest < 0)).any():
            whole[j] -= 1
            rest += columns[:, j]
    plan = [(columns[:, j], int(whole[j])) for j in range(m) if whole[j]]
    return plan + best_fit(rest, units)


def best_fit(rest: np.ndarray, units: int) -> list[tuple[np.ndarray, int]]:
    """Best-fit decreasing of the pieces left by rounding: fewer than one pattern for each class."""
    bins: list[np.ndarray] = []
    free: list[int] = []
    at: dict[int, list[int]] = {}
    for size in range(units, 0, -1):
        for _ in range(int(rest[size - 1])):
            room = next((f for f in range(size, units) if at.get(f)), None)
            if room is None:
                bins.append(np.zeros(units, dtype=np.int64))
                free.append(units)
                k = len(bins) - 1
            else:
                k = at[room].pop()
            bins[k][size - 1] += 1
            free[k] -= size
            if free[k]:
                at.setdefault(free[k], []).append(k)
    same = Counter(tuple(b) for b in bins)
    return [(np.array(k), n) for k, n in same.items()]


def cut_documents(df: DataFrame, tokenizer: str, style: str = "words", end_id: int = 1, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each whole text (null: empty; ``end_id`` appended): doc_id, start, length, ids_crc32, doc_tokens."""

    def cut(batches):
        import zlib

        import pyarrow as pa

        enc, end = encoder(tokenizer, style), np.array([end_id], dtype="<u4").tobytes()
        for ids, texts in steps(batches):
            rows = ([], [], [], [], [])
            for doc, raw in zip(ids, enc.encode(texts), strict=True):
                raw += end
                n = len(raw) // 4
                for start in range(0, n, capacity):
                    piece = raw[4 * start : 4 * (start + capacity)]
                    for col, v in zip(rows, (doc, start, len(piece) // 4, zlib.crc32(piece), n), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return texts_of(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(task(cut, "tokenize"), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_pieces(pieces: DataFrame, capacity: int = 2048, units: int = UNITS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (doc_id, start, length from 1 to ``capacity``).

    A class may hold a third of all pieces, so ranks are counted in hash buckets of each class and shifted by the counts of the
    buckets before. Each sequence holds at most ``capacity`` pieces. Equal rows are told apart by their place in the order only.
    """
    spark, step = pieces.sparkSession, capacity // units
    buckets = max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = pieces.withColumn("size", F.ceil(F.col("length") / step).cast("int")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    counted = keyed.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counted.select("size", "bucket", (F.sum("n").over(Window.partitionBy("size").orderBy("bucket")) - F.col("n")).alias("before"))
    counts = np.zeros(units, dtype=np.int64)
    for r in counted.groupBy("size").agg(F.sum("n").alias("n")).collect():  # at most ``units`` rows
        counts[r["size"] - 1] = r["n"]
    plan = solve(counts, units)
    first_sequence = np.concatenate([[0], np.cumsum([n for _, n in plan])]).astype(np.int64)
    places = {}  # size -> first rank, sequence and pieces a sequence of each pattern that holds it
    for j in np.flatnonzero(counts):
        holds = [(int(p[j]), n, int(first_sequence[k])) for k, (p, n) in enumerate(plan) if p[j]]
        per, times, base = (np.array(x, dtype=np.int64) for x in zip(*holds, strict=True))
        places[int(j) + 1] = (np.concatenate([[0], np.cumsum(per * times)[:-1]]), base, per)

    def place(batches):
        import pyarrow as pa

        for b in batches:
            size, rank = b.column("size").to_numpy(), b.column("rank").to_numpy()
            seq = np.zeros(len(size), dtype=np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                first, base, per = places[int(s)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                seq[at] = base[k] + (rank[at] - first[k]) // per[k]
            keep = [i for i, f in enumerate(b.schema.names) if f not in ("size", "rank")]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(seq)], names=[*[b.schema.names[i] for i in keep], "sequence_id"])

    ranked = (
        keyed.withColumn("within", F.row_number().over(Window.partitionBy("size", "bucket").orderBy("doc_id", "start", "length")))
        .join(before, ["size", "bucket"])
        .select(*pieces.columns, "size", (F.col("before") + F.col("within") - 1).alias("rank"))
    )
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    placed = ranked.mapInArrow(place, f"{fields}, sequence_id long")
    along = Window.partitionBy("sequence_id").orderBy("doc_id", "start", "length").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(along), F.lit(0)).cast("long"))


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts and packs whole documents. The pieces (numbers only) are kept in the shared folder, so no text is encoded twice."""
    scratch = Scratch(df.sparkSession, "packing")
    return pack_pieces(scratch.put(cut_documents(df, tokenizer, end_id=end_id, capacity=capacity, id_col=id_col, text_col=text_col), "pieces"), capacity)
