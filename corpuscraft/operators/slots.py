"""Coverage slots filled by drawn candidates, in rounds of joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def fill(slots: DataFrame, propose: Callable[[DataFrame, int], DataFrame], registered: DataFrame, most: int, slot: str = "slot") -> DataFrame:
    """The slots with ``attempt`` (from 0; null: none of ``most`` attempts was free) and ``candidate``.

    In round r every open slot makes its r-th attempt: ``propose`` adds ``candidate`` (a struct), ``keys`` (an array of kind and key,
    under each of which a candidate must be the only one) and ``valid``. A valid candidate none of whose keys is registered, and none
    of which an earlier slot proposes in the same round, fills its slot and registers its keys. Every slot is filled once at most,
    whatever the partitions; a round is anti-joins and minima by key, and no table reaches the driver.
    """
    scratch = Scratch(slots.sparkSession, "slots")
    taken = scratch.put(registered.select("kind", "key").distinct(), "taken-0")
    open_, filled = scratch.put(slots, "open-0"), None
    for r in range(most):
        made = scratch.put(propose(open_, r).filter("valid"), f"made-{r}")
        keys = made.select(slot, F.explode("keys").alias("k")).select(slot, "k.kind", "k.key")
        free = keys.join(keys.join(taken, ["kind", "key"], "left_semi").select(slot).distinct(), slot, "left_anti")
        first = free.groupBy("kind", "key").agg(F.min(slot).alias("first"))
        late = free.join(first, ["kind", "key"]).filter(F.col(slot) != F.col("first")).select(slot).distinct()
        won = free.select(slot).distinct().join(late, slot, "left_anti")
        got = scratch.put(made.join(won, slot).withColumn("attempt", F.lit(r)).select(*slots.columns, "attempt", "candidate", "keys"), f"filled-{r}")
        filled = got if filled is None else filled.unionByName(got)
        taken = taken.unionByName(scratch.put(got.select(F.explode("keys").alias("k")).select("k.kind", "k.key"), f"taken-{r + 1}"))
        open_ = scratch.put(open_.join(got.select(slot), slot, "left_anti").select(*slots.columns), f"open-{r + 1}")
        scratch.drop(f"made-{r}", f"open-{r}")
        if open_.isEmpty():
            break
    exhausted = open_.withColumn("attempt", F.lit(None).cast("int")).withColumn("candidate", F.lit(None).cast(filled.schema["candidate"].dataType))
    return filled.drop("keys").unionByName(exhausted)
