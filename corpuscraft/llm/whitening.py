"""Whitening of vectors by a tall-skinny QR factorisation (TSQR); no covariance matrix is formed for the fit.

Entries become integers, ``floor(scale * c) + shift``, and each distinct integer vector counts once (the fit list). Its exact sums
centre every row; each task folds its rows, block by block, into one triangular factor; the factors are stacked and factored again
up a tree of ``FAN`` children a node. The singular values of the last factor give the eigenvalues of the covariance, its right
vectors the components, so the squares that would halve the precision are never taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from decimal import Decimal

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, bound_batches, task

#: Children of a node of the merge tree.
FAN = 16
#: Rows folded into a factor at once.
BLOCK = 4_096
#: Greatest entry times ``scale`` whose floor is exact: beyond it a double has no fraction left.
EXACT = float(1 << 52)


@dataclass(frozen=True)
class Whitening:
    """A fitted model: what it holds grows with the dimension alone."""

    n: int
    sums: list[int]
    components: np.ndarray  # (components, d): unit rows by falling eigenvalue
    eigenvalues: np.ndarray
    trace: float
    rank: int  # components that have variance
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n; the whole part is subtracted as integers."""
        whole, part = np.array([s // self.n for s in self.sums], dtype=np.int64), np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - part

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values (rows, components) of the components that have variance."""
        return self.centred(x) @ self.components[: self.rank].T / np.sqrt(self.eigenvalues[: self.rank])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n * x - S) squared of each row; null where a long cannot hold it."""
        near, rest = x - np.array([s // self.n for s in self.sums], dtype=np.int64), [s % self.n for s in self.sums]
        if len(x) and (float(np.abs(near).max()) + 1) ** 2 * float(self.n) ** 2 * x.shape[1] < 2.0**62:
            return ((near * self.n - np.array(rest, dtype=np.int64)) ** 2).sum(1).tolist()
        exact = (sum((v * self.n - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in near.tolist())
        return [v if v < 1 << 63 else None for v in exact]


def integer_rows(df: DataFrame, scale: int, shift: int, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """vec_id and x (array of long) of the rows that take part, and their dimension (0 if there are none)."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.filter((F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(F.abs(c * scale) <= EXACT, F.lit(False))))  # null, NaN and infinity are not
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()  # one row
    d = common[0]["d"] if common else 0
    x = F.transform("v", lambda c: F.floor(c * scale) + F.lit(shift).cast("long"))
    return rows.filter(F.size("v") == d).select("vec_id", x.alias("x")), d


def matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def blocks(batches, d: int) -> Iterator[np.ndarray]:
    """The rows of Arrow batches in blocks of ``BLOCK`` rows."""
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            held.append(matrix(b.column(0).slice(at, BLOCK), d))
            n += len(held[-1])
            if n >= BLOCK:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of rows and the sums of each dimension, as whole numbers of any size."""
    import pyarrow as pa

    def add(batches):
        n, total = 0, [0] * d
        for x in blocks(batches, d):
            high, low = (x >> 26).sum(0).tolist(), (x & ((1 << 26) - 1)).sum(0).tolist()  # neither sum of a block can overflow
            n, total = n + len(x), [t + (h << 26) + k for t, h, k in zip(total, high, low, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["dim", "n", "s"])

    parts = fit.mapInArrow(task(add), "dim int, n long, s decimal(38,0)")
    rows = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dim").collect()  # a row for each dimension
    return rows[0]["n"], [int(r["s"]) for r in rows]


def merged(parts: DataFrame, join: Callable[[list[bytes]], bytes], scratch: Scratch, name: str) -> DataFrame:
    """One row from (node, part) by a tree: up to ``FAN`` neighbouring nodes meet in one task, level by level.

    The parts, one for each task that made them, are written first, so that a lost executor costs a level and not the pass.
    """
    import pandas as pd

    parts = scratch.put(parts, name)
    width = (parts.agg(F.max("node")).first()[0] or 0) + 1

    def meet(group):
        group = group.sort_values("child")
        return pd.DataFrame({"node": [int(group["node"].iloc[0])], "part": [join(list(group["part"]))]})

    while width > 1:
        parts = parts.select(F.expr(f"node div {FAN}").alias("node"), F.col("node").alias("child"), "part").groupBy("node").applyInPandas(meet, "node long, part binary")
        width = -(-width // FAN)
    return parts


def one_part(batches, fold: Callable[[np.ndarray], None], done: Callable[[], bytes], d: int):
    """Folds the blocks of a task into one part, named by the task's place."""
    import pyarrow as pa

    some = False
    for x in blocks(batches, d):
        fold(x)
        some = True
    if some:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([done()], pa.binary())], names=["node", "part"])


def fit_whitening(fit: DataFrame, d: int, components: int, scratch: Scratch) -> Whitening:
    """The model of the distinct integer vectors in ``fit`` (one column, x)."""
    import pyarrow as pa

    n, sums = exact_sums(fit, d)
    plain = Whitening(n, sums, np.zeros((0, d)), np.zeros(0), 0.0, 0)

    def factor(batches):
        r = [np.zeros((0, d))]

        def fold(x):
            r[0] = np.linalg.qr(np.vstack([r[0], plain.centred(x)]), mode="r")

        yield from one_part(batches, fold, lambda: r[0].tobytes(), d)

    def stack(parts):
        return np.linalg.qr(np.vstack([np.frombuffer(p).reshape(-1, d) for p in parts]), mode="r").tobytes()

    def decompose(batches):
        for b in batches:
            for part in b.column("part").to_pylist():
                r = np.frombuffer(part).reshape(-1, d)
                s, right = np.linalg.svd(np.vstack([r, np.zeros((max(0, d - len(r)), d))]), full_matrices=True)[1:]
                yield pa.RecordBatch.from_arrays([pa.array([right[:components].tobytes()]), pa.array([s.tobytes()])], names=["right", "s"])

    last = merged(fit.mapInArrow(task(factor), "node long, part binary"), stack, scratch, "factors")
    found = last.mapInArrow(task(decompose), "right binary, s binary").first()  # one row, of the dimension's size
    s, right = np.frombuffer(found["s"]), np.frombuffer(found["right"]).reshape(-1, d)
    rank = int((s[: len(right)] > s[0] * max(n, d) * np.finfo(float).eps).sum()) if s[0] > 0 else 0
    model = replace(plain, components=right, eigenvalues=s[: len(right)] ** 2 / n, trace=float((s**2).sum() / n), rank=rank)
    return replace(model, identity_error=identity_error(fit, d, model, scratch)) if rank else model


def identity_error(fit: DataFrame, d: int, model: Whitening, scratch: Scratch) -> float:
    """The largest absolute entry of the whitened fit list's covariance less the identity, measured in a pass of its own: each task
    centres its rows by their mean before it multiplies, and means and products are joined up the tree."""
    k = model.rank

    def pair(a: tuple, b: tuple) -> tuple:
        n = a[0] + b[0]
        step = b[1] - a[1]
        return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)

    def pack(m: tuple) -> bytes:
        return np.concatenate([[m[0]], m[1], m[2].ravel()]).tobytes()

    def unpack(part: bytes) -> tuple:
        v = np.frombuffer(part)
        return v[0], v[1 : k + 1], v[k + 1 :].reshape(k, k)

    def moments(batches):
        m = [None]

        def fold(x):
            w = model.project(x)
            mean = w.mean(0)
            own = (float(len(w)), mean, (w - mean).T @ (w - mean))
            m[0] = own if m[0] is None else pair(m[0], own)

        yield from one_part(batches, fold, lambda: pack(m[0]), d)

    def join(parts):
        out = unpack(parts[0])
        for p in parts[1:]:
            out = pair(out, unpack(p))
        return pack(out)

    n, _, product = unpack(merged(fit.mapInArrow(task(moments), "node long, part binary"), join, scratch, "moments").first()["part"])
    return float(np.abs(product / n - np.eye(k)).max())


def whiten(df: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each row that takes part and component.

    Rows whose vector is null or empty, holds a null or non-finite entry, one beyond 2^52 / ``scale``, or has another dimension than
    the commonest (the smaller of two as common) take no part. Ids may repeat or be null: each row is whitened by itself. A component
    without variance (all rows alike, or fewer distinct rows than components) has a null ``whitened`` and explains 0, or null where
    nothing varies; ``identity_error`` is over the others, null if there are none. A deviation beyond a long is null. No usable row: an empty result.
    """
    import pyarrow as pa

    bound_batches(df.sparkSession)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, d = integer_rows(df, scale, shift, id_col, vec_col)
    if not d:
        return df.sparkSession.createDataFrame([], schema)
    scratch = Scratch(df.sparkSession, "whitening")
    fit = scratch.put(rows.select("x").distinct(), "fit")
    model = fit_whitening(fit, d, components, scratch)
    scratch.drop("fit", "factors", "moments")
    k = len(model.components)
    share = [float(e) / model.trace if i < model.rank else 0.0 for i, e in enumerate(model.eigenvalues)] if model.trace else [None] * k

    def apply(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x, m = matrix(part.column(1), d), part.num_rows
                white = np.full((m, k), np.nan)
                white[:, : model.rank] = model.project(x)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                    pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(white.ravel(), from_pandas=True), pa.array(share * m, pa.float64()), pa.array([model.identity_error] * (m * k), pa.float64()),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(task(apply), schema)
