"""Near duplicates by the ratio of matching blocks, kept or removed greedily in order, without losing a pair.

The ratio of two texts is 2 * M / S: M characters in matching blocks (difflib's, one text against an earlier one), S in both texts.
For a ratio of at least t three bounds hold, each cheaper than the ratio and none of them ever wrong:

- lengths: the longer text has at most (2 - t) / t times the shorter one's characters;
- characters: M is at most the size of the common multiset of characters;
- pairs: blocks are separated by characters that match nothing, so there are at most S - 2 * M + 1 of them and the texts have at least
  3 * M - S - 1 pairs of neighbouring characters in common.

Texts of like length are dealt to blocks of a bounded size; each pair of blocks that the lengths allow is one row, whose bounds
are products of 0/1 matrices over (character, occurrence) and (pair, occurrence).
"""

from __future__ import annotations

import json
import math
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: Texts and characters of a block.
TEXTS, CHARACTERS = 512, 1_000_000
#: Length classes grow by this factor.
STEP = 1.1
#: Earlier texts that are told at once for a text; one that has more is looked at again when these are all gone.
TOLD = 32
#: Columns of a matrix of occurrences at once.
COLUMNS = 4_096


def ratio(text: str, earlier: str) -> float:
    return SequenceMatcher(None, text, earlier).ratio()


def occurrences(texts: list[str], width: int) -> list[set[tuple[str, int]]]:
    """Each text's runs of ``width`` characters, the k-th of its kind told from the others."""
    out = []
    for t in texts:
        counts = Counter(t[i : i + width] for i in range(len(t) - width + 1))
        out.append({(c, k) for c, n in counts.items() for k in range(n)})
    return out


def shared_counts(a: list[set], b: list[set]) -> np.ndarray:
    """The sizes of all intersections of two lists of sets."""
    known = {x for s in a for x in s} & {x for s in b for x in s}
    place = {x: i for i, x in enumerate(known)}
    total = np.zeros((len(a), len(b)), dtype=np.float32)

    def entries(sets):
        at = [(i, place[x]) for i, s in enumerate(sets) for x in s if x in place]
        at = np.array(at, dtype=np.int64).reshape(-1, 2)
        return at[np.argsort(at[:, 1], kind="stable")]

    left, right = entries(a), entries(b)
    for low in range(0, len(place), COLUMNS):
        parts = []
        for at, n in ((left, len(a)), (right, len(b))):
            some = at[np.searchsorted(at[:, 1], low) : np.searchsorted(at[:, 1], low + COLUMNS)]
            dense = np.zeros((n, COLUMNS), dtype=np.float32)
            dense[some[:, 0], some[:, 1] - low] = 1
            parts.append(dense)
        total += parts[0] @ parts[1].T
    return total


def alike_pairs(a: list[tuple], b: list[tuple], least: float, same: bool) -> list[tuple[int, int]]:
    """(id, earlier) of the pairs of two blocks (id, settled, text) whose ratio, the later against the earlier, is ``least`` or more.
    A pair of two settled texts is of no use."""
    size = np.array([len(x[2]) for x in a])[:, None] + np.array([len(x[2]) for x in b])[None]
    need = np.ceil(least * size / 2 - 1e-9)
    texts = [x[2] for x in a], [x[2] for x in b]
    open_ = ~(np.array([x[1] for x in a])[:, None] & np.array([x[1] for x in b])[None])
    ids = np.array([x[0] for x in a])[:, None], np.array([x[0] for x in b])[None]
    maybe = open_ & (ids[0] < ids[1] if same else ids[0] != ids[1])
    for width, bound in ((1, need), (2, 3 * need - size - 1)):
        if maybe.any():
            maybe &= shared_counts(occurrences(texts[0], width), occurrences(texts[1], width)) >= bound
    out = []
    match = SequenceMatcher(None)
    for j in np.flatnonzero(maybe.any(0)):
        for i in np.flatnonzero(maybe[:, j]):
            late, early = (a[i], b[j]) if a[i][0] > b[j][0] else (b[j], a[i])
            if late[1]:  # a settled text needs no earlier ones
                continue
            match.set_seqs(late[2], early[2])
            if match.ratio() >= least:
                out.append((late[0], early[0]))
    return out


def edges(nodes: DataFrame, least: float, scratch: Scratch, name: str) -> DataFrame:
    """id, earlier, more: up to ``TOLD`` earliest texts that an unsettled text is alike to, and whether there may be others. ``nodes``:
    id, settled, text."""
    import pyarrow as pa

    log = math.log(STEP)
    rows = nodes.select("id", "settled", "text", F.floor(F.log(F.greatest(F.length("text"), F.lit(1)).cast("double")) / log).cast("int").alias("class"), F.length("text").alias("n"))
    sizes = rows.groupBy("class").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("chars"))  # a row for each class of lengths
    sizes = sizes.withColumn("parts", F.greatest(F.ceil(F.col("texts") / TEXTS), F.ceil(F.col("chars") / CHARACTERS)).cast("long"))
    dealt = rows.join(F.broadcast(sizes.select("class", "parts")), "class").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    blocks = scratch.put(dealt.groupBy("class", "part").agg(F.to_json(F.collect_list(F.struct("id", "settled", "text"))).alias("block"), F.every("settled").alias("settled")), f"{name}-blocks")
    reach = math.ceil(math.log((2 - least) / least) / log) + 1
    heads = blocks.select("class", "part", "settled")
    other = heads.select(F.col("class").alias("class_b"), F.col("part").alias("part_b"), F.col("settled").alias("settled_b"))
    near = heads.withColumn("class_b", F.explode(F.sequence(F.col("class"), F.col("class") + reach))).join(other, "class_b")
    near = near.filter("(class < class_b or part <= part_b) and not (settled and settled_b)").select("class", "part", "class_b", "part_b")
    both = near.join(blocks.select("class", "part", "block"), ["class", "part"]).join(blocks.select(F.col("class").alias("class_b"), F.col("part").alias("part_b"), F.col("block").alias("block_b")), ["class_b", "part_b"])
    both = both.repartition("class", "part", "class_b", "part_b").select(((F.col("class") == F.col("class_b")) & (F.col("part") == F.col("part_b"))).alias("same"), "block", "block_b")

    def compare(batches):
        block = lambda raw: [(x["id"], x["settled"], x["text"]) for x in json.loads(raw)]
        for batch in batches:
            for k in range(batch.num_rows):
                same, a, b = (c[k].as_py() for c in batch.columns)
                found = alike_pairs(block(a), block(b), least, same)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["id", "earlier"])

    told = both.mapInArrow(compare, "id long, earlier long")
    place = F.row_number().over(Window.partitionBy("id").orderBy("earlier"))  # each task drops what is beyond the limit first
    first = told.withColumn("place", place).filter(F.col("place") <= TOLD)
    return scratch.put(first.withColumn("more", F.max("place").over(Window.partitionBy("id")) == TOLD).drop("place"), name)


def greedy(items: DataFrame, least: float) -> DataFrame:
    """id, kept: an item goes when its ratio to one kept before it, in the order of id, is at least ``least`` (above 0; the bounds tell most apart
    from 2/3 on).

    Items of one text are one text, unless its ratio to itself is lower (long texts whose characters are all frequent). The rule is
    resolved by rounds over the pairs found: a text none of whose earlier ones is left is kept, one with a kept earlier one goes.
    Where more than ``TOLD`` earlier ones were found and all of them are gone, those left are compared once more. A null text is
    an empty one; ids are unique.
    """
    scratch = Scratch(items.sparkSession, "greedy")
    items = items.select("id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    @F.pandas_udf("boolean")
    def own(text):
        return text.map(lambda t: ratio(t, t) >= least)

    groups = scratch.put(items.groupBy("text").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("one", F.when(F.col("n") > 1, own("text")).otherwise(True)), "groups")
    named = scratch.put(items.join(groups.select("text", "first", "one"), "text").select("id", F.when(F.col("one"), F.col("first")).otherwise(F.col("id")).alias("node"), "text"), "named")
    state, turn = scratch.put(named.filter("id = node").select("id", "text", F.lit(None).cast("boolean").alias("kept")), "state-0"), 0

    def settle(rule: DataFrame, found) -> tuple[DataFrame, int]:
        """The next state, where ``found`` (from the columns of ``rule``) decides what is open, and how many texts stay open."""
        nonlocal turn
        after = scratch.put(state.join(rule, "id", "left").select("id", "text", F.coalesce("kept", found).alias("kept")), f"state-{turn + 1}")
        scratch.drop(f"state-{turn}")
        turn += 1
        return after, after.filter("kept is null").count()

    while True:
        nodes = state.filter("kept is null or kept").select("id", F.col("kept").isNotNull().alias("settled"), "text")
        pairs = edges(nodes, least, scratch, f"pairs-{turn}")
        state, left = settle(pairs.select("id").distinct().withColumn("later", F.lit(True)), F.when(F.col("later").isNull(), True))
        before = left + 1
        while 0 < left < before:
            known = pairs.join(state.select(F.col("id").alias("earlier"), F.col("kept").alias("k")), "earlier")
            rule = known.groupBy("id").agg(F.max(F.coalesce("k", F.lit(False))).alias("hit"), F.every(F.coalesce(~F.col("k"), F.lit(False))).alias("gone"), F.first("more").alias("more"))
            before = left
            state, left = settle(rule, F.when(F.col("hit"), False).when(F.col("gone") & ~F.col("more"), True))
        if not left:
            break
    return named.join(state.select(F.col("id").alias("node"), "kept"), "node").select("id", (F.col("kept") & (F.col("id") == F.col("node"))).alias("kept"))
