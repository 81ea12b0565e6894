"""Helpers that the operators of this subpackage share: scratch tables, id handling, bounded batches."""

from __future__ import annotations

import contextlib
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import Scratch  # noqa: F401

#: Bytes of text that one step in a Python worker holds at once (a single longer text makes a step of its own).
STEP_CHARS = 1_500_000
#: Bytes of a batch of rows between Spark and Python.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"__{name}_{uuid.uuid4().hex}"


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def steps(batches, limit: int | None = None, text: int = -1) -> Iterator[tuple[list, ...]]:
    """Columns of Arrow batches as lists, in pieces of about ``limit`` bytes of text; the column at ``text`` has nulls made empty.

    A batch is cut before it becomes Python objects, so that only one piece of it is held.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    limit = limit or STEP_CHARS
    for batch in batches:
        if not batch.num_rows:
            continue
        reach = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text % batch.num_columns)), 0).cast(pa.int64()).to_numpy())
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(reach, (reach[at - 1] if at else 0) + limit)) + 1
            cols = [c.to_pylist() for c in batch.slice(at, end - at).columns]
            cols[text] = [x or "" for x in cols[text]]
            yield tuple(cols)
            at = end


_frees: dict[str, Callable[[], None]] = {}
_last: list[str] = []


def frees(owner: str) -> Callable[[Callable[[], None]], Callable[[], None]]:
    """Registers what empties an owner's caches in a Python worker."""

    def add(f: Callable[[], None]) -> Callable[[], None]:
        _frees[owner] = f
        return f

    return add


def give_back() -> None:
    """Returns freed memory to the system: Arrow's pool and, where there is one, the C library's heap."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def task(run: Callable, *owners: str) -> Callable:
    """``run`` (Arrow batches to Arrow batches) as a task that uses the caches of ``owners``.

    A Python worker outlives its tasks and may next serve another operator: caches that the task at hand doesn't use are
    emptied first, and what the task has freed goes back to the system when it ends.
    """

    def served(batches):
        if _last != list(owners):
            for owner, f in _frees.items():
                if owner not in owners:
                    f()
            _last[:] = owners
            gc.collect()
            give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return served


def bound_batches(spark: SparkSession) -> None:
    """Keeps the batches between Spark and Python small (``BATCH_BYTES``), where the session has not set their size itself: Spark's
    own bound of 64 MB is held several times over by each task, outside the heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") in ("67108864b", "67108864", "64m"):
        spark.conf.set(key, f"{BATCH_BYTES}b")


def texts_of(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns in use, the text last, whatever else the table holds."""
    bound_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("doc_id"), *[F.col(c) for c in more], F.col(text_col).cast("string").alias("text"))
