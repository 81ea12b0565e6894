"""A trie of the prefixes that conversations share, by distributed MSD radix partitioning over dictionary-encoded turns.

Each distinct turn (role, text) gets an id. All conversations start in one bucket. A bucket of more than ``LOCAL`` turns is
partitioned by a round of joins and counts: what all its members share from its first depth on is one chain of nodes, found by a
minimum, a maximum and a count at each depth, however many members or turns there are; the turn after it is the radix digit that
deals the members to buckets of the next round. A bucket of at most ``LOCAL`` turns goes to one task, where multikey quicksort
(three-way partitions by the turn at a depth) finishes it. Both emit nodes as they go; sums over subtrees are rolled up from the
last round to the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, bound_batches, task

#: Turns of a bucket that one task finishes.
LOCAL = 16_384
#: Characters of a piece of a list of ids that is hashed in turn.
PIECE = 65_536
#: Nodes in a batch of results.
BATCH = 20_000
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


# turns
def encoded_turns(df: DataFrame, scratch: Scratch, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, pos (from 1), tid, length (code points of the text): conversations in order, each distinct turn under one id.

    A turn is told by the sha256 of role and text, so no text is shuffled. Turns of a conversation with one number stand by role, then
    by that digest.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    print_ = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = df.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), print_.alias("print"), F.length(text).cast("long").alias("length")).filter("conv is not null")
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "print")).cast("long")
    rows = scratch.put(rows.select("conv", place.alias("pos"), "print", "length"), "rows")
    words = scratch.put(rows.select("print").distinct().withColumn("tid", F.monotonically_increasing_id()), "dictionary")
    turns = scratch.put(rows.join(words, "print").select("conv", "pos", "tid", "length"), "turns")
    scratch.drop("rows", "dictionary")
    return turns


def rebuilt(turns: DataFrame, block: int, heads: int) -> DataFrame:
    """conv, pos, tid, length, total: each conversation c with its first h turns replaced by the first h of conversation c - c % block
    (all if there are fewer, none if it is absent); h = crc32(decimal c) % heads. ``total`` is its number of turns now; a row of
    position 0 and no text stands before all turns, so a conversation without turns has a row too."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    first = turns.filter((F.col("conv") % block == 0) & (F.col("pos") < heads)).groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "tid", "length"))).alias("head"))  # under ``heads`` turns each
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own")).select("conv", "own", h.alias("h"), (F.col("conv") - F.col("conv") % block).alias("base"))
    given = F.coalesce(F.slice("head", 1, F.col("h").cast("int")), F.array().cast("array<struct<pos:bigint,tid:bigint,length:bigint>>"))
    convs = convs.join(first, "base", "left").select("conv", "h", given.alias("head"), (F.size(given) + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("total"))
    anchor = F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit(-1).cast("long").alias("tid"), F.lit(0).cast("long").alias("length")))
    start = convs.select("conv", F.explode(F.concat(anchor, "head")).alias("x"), "total").select("conv", "x.*", "total")
    rest = turns.withColumn("h", h).filter("pos > h").drop("h").join(convs.select("conv", (F.size("head") - F.col("h")).alias("shift"), "total"), "conv")
    return start.unionByName(rest.select("conv", (F.col("pos") + F.col("shift")).alias("pos"), "tid", "length", "total"))


# large buckets
def split_round(rows: DataFrame, scratch: Scratch, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """One round over buckets that are too large for a task: (buckets, chains, children, ends, rows of the next round)."""
    counts = scratch.put(rows.groupBy("bucket", "pos").agg(F.count(F.lit(1)).alias("n"), F.min("tid").alias("low"), F.max("tid").alias("high"), F.max("length").alias("length"), F.min("conv").alias("conv_id"), F.max("above").alias("above")), f"counts-{k}")
    heads = counts.groupBy("bucket").agg(F.min("pos").alias("first"), F.max("pos").alias("deepest"), F.max("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("above").alias("above"))
    parts = counts.join(heads.select("bucket", "n_convs"), "bucket").filter("n < n_convs or low < high").groupBy("bucket").agg(F.min("pos").alias("parts"))
    buckets = scratch.put(heads.join(parts, "bucket", "left").select("bucket", "first", F.coalesce(F.col("parts") - 1, "deepest").alias("last"), "n_convs", "conv_id", "above"), f"buckets-{k}")
    chains = counts.join(buckets.select("bucket", "last"), "bucket").filter("pos <= last").select("bucket", "pos", "length")
    there = rows.join(buckets.select("bucket", "last", F.col("conv_id").alias("from")), "bucket").filter("pos >= last")
    ends = scratch.put(there.filter("pos = last and total = last").select(F.lit(k).alias("round"), "bucket", "conv"), f"ends-{k}")
    on = scratch.put(there.filter("pos = last + 1").select("bucket", "conv", "tid", "from"), f"on-{k}")
    children = scratch.put(on.select("bucket", "tid").distinct().withColumn("child", F.monotonically_increasing_id()), f"children-{k}")
    moved = on.join(children, ["bucket", "tid"]).select("conv", "child", F.col("from").alias("above"))
    later = there.filter("pos > last").select("conv", "pos", "tid", "length", "total").join(moved, "conv")
    return buckets, chains, children, ends, scratch.put(later.select(F.col("child").alias("bucket"), "conv", "pos", "tid", "length", "total", "above"), f"rows-{k + 1}")


# small buckets
def finish(start: int, above: int | None, convs: list[int], at: list[int], size: list[int], tid: list[int], length: list[int]) -> Iterator[tuple]:
    """The nodes of one bucket, parents first, by multikey quicksort. ``at`` and ``size``: where each conversation's turns lie in ``tid``
    and ``length``; conversations come by ascending id, and partitions keep that order."""
    nodes: list[list] = []  # conv_id, depth, parent, n_convs, children, leaves, saved, ends
    todo = [(list(range(len(convs))), 0, -1)]
    while todo:
        members, j, parent = todo.pop()
        if len(members) > 1:
            digits = [tid[at[i] + j] for i in members]
            pivot = sorted((digits[0], digits[len(digits) // 2], digits[-1]))[1]
            less, more = [i for i, x in zip(members, digits, strict=True) if x < pivot], [i for i, x in zip(members, digits, strict=True) if x > pivot]
            todo += [(part, j, parent) for part in (less, more) if part]
            if less or more:
                members = [i for i, x in zip(members, digits, strict=True) if x == pivot]
        here = len(nodes)
        over = [i for i in members if size[i] == j + 1]
        nodes.append([convs[members[0]], start + j, parent, len(members), 0, 0, (len(members) - 1) * length[at[members[0]] + j], ",".join(str(convs[i]) for i in over)])
        if len(over) < len(members):
            todo.append(([i for i in members if size[i] > j + 1] if over else members, j + 1, here))
    for x in reversed(nodes):
        x[5] = x[5] or 1
        if x[2] >= 0:
            up = nodes[x[2]]
            up[4], up[5], up[6] = up[4] + 1, up[5] + x[5], up[6] + x[6]
    for c, depth, parent, n, children, leaves, saved, ends in nodes:
        yield c, depth, nodes[parent][0] if parent >= 0 else above, n, children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest() if ends else EMPTY


def local_nodes(rows: DataFrame) -> DataFrame:
    """The nodes of all small buckets, with their round and bucket: rows of a bucket reach one task, in order."""
    import pyarrow as pa

    schema = "round int, bucket long, top boolean, " + NODE
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.bool_(), *[pa.int64()] * 7, pa.string()]

    def run(batches):
        held, out = None, []

        def flush():
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        def one(cols, a, b):
            rnd, bucket = int(cols[0][a]), int(cols[1][a])
            conv, pos, tid, length = (cols[c][a:b] for c in (2, 3, 4, 5))
            first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            top, above = int(pos[0]), None if cols[7][a] else int(cols[6][a])
            size = np.diff(np.append(first, b - a))
            for node in finish(top, above, conv[first].tolist(), first.tolist(), size.tolist(), tid.tolist(), length.tolist()):
                out.append((rnd, bucket, node[1] == top, *node))

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(6)] + [batch.column(6).fill_null(0).to_numpy(zero_copy_only=False), batch.column(6).is_null().to_numpy(zero_copy_only=False)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            edges = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
            for a, b in zip(np.append(0, edges[:-1]), edges, strict=True) if len(edges) else ():
                one(held, a, b)
                if len(out) >= BATCH:
                    yield flush()
            if len(edges):
                held = [x[edges[-1] :] for x in held]
        if held is not None:
            one(held, 0, len(held[0]))
        if out:
            yield flush()

    ordered = rows.select("round", "bucket", "conv", "pos", "tid", "length", "above").repartition("round", "bucket").sortWithinPartitions("round", "bucket", "conv", "pos")
    return ordered.mapInArrow(task(run), schema)


# lists of ids
def id_digests(ids: DataFrame) -> DataFrame:
    """round, bucket, ends_sha256 of (round, bucket, conv): the sha256 of a bucket's ids, ascending, joined by commas.

    Ranges of the whole order are written out as pieces of text first, wherever a bucket's rows lie; only the pieces of a bucket meet,
    in order, and pass through one hash that holds none of them.
    """
    import pyarrow as pa

    def pieces(batches):
        key, first, held, size = None, 0, [], 0

        def cut():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([first], pa.int64()), pa.array([",".join(held)])], names=["round", "bucket", "first", "piece"])

        for b in batches:
            for rnd, bucket, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (rnd, bucket) or size >= PIECE:
                    if held:
                        yield cut()
                    key, first, held, size = (rnd, bucket), conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield cut()

    def digests(batches):
        key, h, out = None, None, []
        for b in batches:
            for rnd, bucket, piece in zip(*(b.column(c).to_pylist() for c in ("round", "bucket", "piece")), strict=True):
                if key == (rnd, bucket):
                    h.update(b"," + piece.encode())
                else:
                    if h:
                        out.append((*key, h.hexdigest()))
                    key, h = (rnd, bucket), hashlib.sha256(piece.encode())
        if h:
            out.append((*key, h.hexdigest()))
        for at in range(0, len(out), BATCH):
            cols = list(zip(*out[at : at + BATCH], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2])], names=["round", "bucket", "ends_sha256"])

    written = ids.repartitionByRange("round", "bucket", "conv").sortWithinPartitions("round", "bucket", "conv").mapInArrow(task(pieces), "round int, bucket long, first long, piece string")
    met = written.repartition("round", "bucket").sortWithinPartitions("round", "bucket", "first")
    return met.mapInArrow(task(digests), "round int, bucket long, ends_sha256 string")


def trie_nodes(rows: DataFrame, scratch: Scratch, local: int = LOCAL) -> DataFrame:
    """The nodes of all sequences (conv, pos from 0, tid, length, total); every conversation's first row must be the same turn."""
    rows = scratch.put(rows.select(F.lit(0).cast("long").alias("bucket"), "conv", "pos", "tid", "length", "total", F.lit(None).cast("long").alias("above")), "rows-0")
    rounds, small, k = [], [], 0
    while True:
        sizes = scratch.put(rows.groupBy("bucket").agg((F.count(F.lit(1)) > local).alias("large")), f"sizes-{k}")
        large = sizes.filter("large")
        if large.isEmpty():
            small.append(rows.withColumn("round", F.lit(k)))
            break
        small.append(rows.join(sizes.filter("not large").select("bucket"), "bucket").withColumn("round", F.lit(k)))
        rounds.append(split_round(rows.join(large.select("bucket"), "bucket"), scratch, k))
        rows, k = rounds[-1][4], k + 1
    together = small[0]
    for x in small[1:]:
        together = together.unionByName(x)
    nodes = scratch.put(local_nodes(together), "nodes")
    result, columns = nodes.select(*[x.split()[0] for x in NODE.split(", ")]), [x.split()[0] for x in NODE.split(", ")]
    if not rounds:
        scratch.drop("rows-0", "sizes-0", "turns")
        return result
    ends = rounds[0][3]
    for r in rounds[1:]:
        ends = ends.unionByName(r[3])
    digests = scratch.put(id_digests(ends), "digests")
    above = None
    for k in reversed(range(len(rounds))):
        buckets, chains, children, _, _ = rounds[k]
        tops = nodes.filter(F.col("top") & (F.col("round") == k + 1)).select("bucket", "n_leaves", "saved_tokens")
        tops = tops if above is None else tops.unionByName(above)
        below = children.join(tops.withColumnRenamed("bucket", "child"), "child").groupBy("bucket").agg(F.count(F.lit(1)).alias("branches"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        on = chains.join(buckets, "bucket").join(below, "bucket", "left").join(digests.filter(F.col("round") == k).drop("round"), "bucket", "left")
        deeper = F.sum((F.col("n_convs") - 1) * F.col("length")).over(Window.partitionBy("bucket").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0))
        last = F.col("pos") == F.col("last")
        trunk = on.select(
            "bucket", (F.col("pos") == F.col("first")).alias("top"), "conv_id", F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("first"), F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
            F.when(last, F.coalesce("branches", F.lit(0))).otherwise(1).cast("long").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), (F.coalesce("saved", F.lit(0)) + deeper).cast("long").alias("saved_tokens"), F.when(last, F.coalesce("ends_sha256", F.lit(EMPTY))).otherwise(EMPTY).alias("ends_sha256"),
        )
        trunk = scratch.put(trunk, f"trunk-{k}")
        above = trunk.filter("top").select("bucket", "n_leaves", "saved_tokens")
        result = result.unionByName(trunk.select(*columns))
    scratch.drop(*[f"{x}-{k}" for k in range(len(rounds) + 1) for x in ("rows", "sizes", "counts", "buckets", "ends", "on", "children")], "digests", "turns")
    return result


def prefix_trie(df: DataFrame, block: int = 100, heads: int = 6, local: int = LOCAL, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each node of the trie of rebuilt conversations (see ``rebuilt``): conv_id (the smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty ones; null turns come first; turns of one number stand by role, then by digest, and repeated rows are
    turns of their own. Rows without conv_id belong to no conversation. The remainder of a negative id is that of SQL (towards zero).
    An empty table gives no nodes, not even a root.
    """
    bound_batches(df.sparkSession)
    scratch = Scratch(df.sparkSession, "trie")
    return trie_nodes(rebuilt(encoded_turns(df, scratch, id_col, turn_col, role_col, text_col), block, heads), scratch, local)
