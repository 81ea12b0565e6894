"""Merkle trees over the rows of a group: one root that commits to all of them in order, and short proofs that a row is among them.

Leaves are numbered in the order of a whole table, so a level is a grouping by place: ``FAN`` digests at most meet in a task, whatever
the size of the group. A node is the sha256 of "1:" and its children's digests joined by commas; a leaf that of "0:" and its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import numbered_within
from .shared import Scratch

#: Children of a node.
FAN = 64


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(F.lit("0:"), text), 256)


def node(children: Column) -> Column:
    return F.sha2(F.concat(F.lit("1:"), F.array_join(children, ",")), 256)


class Tree:
    """The tree of each group of ``df`` over ``text`` in the order of ``order``. ``leaves``: the group's columns, the row's ``order``
    columns, place (from 0) and digest; ``roots``: the group's columns, depth and tree (the root's digest)."""

    def __init__(self, df: DataFrame, group: list[str], order: list[str], text: Column):
        self.keys = group
        scratch = Scratch(df.sparkSession, "merkle")
        rows = df.select(*[F.col(g) for g in group], *[F.col(c) for c in order], leaf(text).alias("digest"))
        rows = numbered_within(rows.withColumn("__all", F.lit(0)), ["__all", *group], order, "__n").drop("__all")
        self.leaves = scratch.put(rows.withColumn("place", F.col("__n") - 1).drop("__n"), "leaves")
        self.levels, below, self.roots = [], self.leaves.select(*group, "place", "digest"), None
        while True:
            depth = len(self.levels) + 1
            grouped = below.groupBy(*group, F.expr(f"place div {FAN}").alias("place")).agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("x"))  # FAN rows at most
            level = scratch.put(grouped.withColumn("children", F.transform("x", lambda c: c["digest"])).drop("x").withColumn("digest", node(F.col("children"))), f"level-{depth}")
            self.levels.append(level)
            single = level.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.first("digest").alias("tree"))
            done = scratch.put(single.filter("n = 1").select(*group, F.lit(depth).alias("depth"), "tree"), f"roots-{depth}")
            self.roots = done if self.roots is None else self.roots.unionByName(done)
            wide = single.filter("n > 1")
            if wide.isEmpty():
                break
            below = level.join(wide.select(*group), group, "left_semi").select(*group, "place", "digest") if group else level.select("place", "digest")

    def proofs(self, leaves: DataFrame | None = None) -> DataFrame:
        """The leaves with ``proof``: for each level the digests that stand together and the place among them."""
        out = (self.leaves if leaves is None else leaves).withColumn("proof", F.array().cast("array<struct<children:array<string>,at:int>>")).withColumn("__up", F.col("place"))
        for level in self.levels:
            up = level.select(*[F.col(k) for k in self.keys], F.col("place").alias("__next"), "children")
            out = out.withColumn("__next", F.expr(f"__up div {FAN}")).join(up, [*self.keys, "__next"], "left")
            step = F.struct(F.col("children"), F.expr(f"cast(__up % {FAN} as int)").alias("at"))
            out = out.withColumn("proof", F.when(F.col("children").isNull(), F.col("proof")).otherwise(F.array_append("proof", step))).withColumn("__up", F.col("__next")).drop("children", "__next")
        return out.drop("__up")


def holds(digest: Column, proof: Column, root: Column) -> Column:
    """Whether a proof leads from a leaf's digest to the root: at every level the digest stands at its place, and that level's node
    is the next digest."""
    step = lambda acc, p: F.struct(node(p["children"]).alias("digest"), (acc["ok"] & F.get(p["children"], p["at"]).eqNullSafe(acc["digest"])).alias("ok"))
    end = F.aggregate(proof, F.struct(digest.alias("digest"), F.lit(True).alias("ok")), step)
    return F.coalesce((F.size(proof) > 0) & end["ok"] & (end["digest"] == root), F.lit(False))


def roots_sql(rows: str) -> str:
    """g, n, depth, tree of a query of (g, o, x): groups' texts x in the order of o."""
    return f"""
    SELECT g, n, depth, l[1] AS tree FROM (
      WITH RECURSIVE r AS (
        SELECT g, count(*) AS n, 0 AS depth, list(sha256(concat('0:', x)) ORDER BY o) AS l FROM ({rows}) GROUP BY g
        UNION ALL SELECT g, n, depth + 1, list_transform(range(0, (len(l) + {FAN - 1}) // {FAN}), lambda i: sha256(concat('1:', array_to_string(l[i * {FAN} + 1 : (i + 1) * {FAN}], ',')))) FROM r WHERE depth = 0 OR len(l) > 1
      ) SELECT * FROM r WHERE depth > 0 AND len(l) = 1)"""
