"""Near-duplicate documents by SetSketch registers, banded, estimated by likelihood and verified on full shingle sets.

A register keeps the least of exponential values over a set's elements, truncated to powers of ``BASE``. Registers of a union
are the larger of each pair, so sketches merge; two sets' registers agree about as often as their Jaccard similarity. Bands of
registers give candidate groups: the rows of a band are chosen so that a pair at the threshold misses all bands with a chance
below ``MISS``. Sets of one candidate group are compared in blocks of bounded size, each with the group's first set; a likelihood over
the counts of greater, equal and smaller registers, given both sizes, drops pairs that cannot reach the threshold; the rest are
verified on the sets. Each block returns the links of a spanning forest only. Where that leaves a group in several components,
the sets outside its largest one are compared with all sets of other components, block by block: a group of copies of one
text is compared once for each set, and no group ever makes all its pairs.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, fresh, steps, task, texts_of
from .components import components
from .words import mix, shingle_set, word_hashes

REGISTERS = 192
BASE = 1.001
MISS = 1e-6
#: Bounds of a block of a candidate group, in the first comparison and in that between components.
BLOCK_SETS, BLOCK_SHINGLES, WIDE = 64, 100_000, 4
#: Natural logarithm of the likelihood ratio below which a pair is dropped unverified.
MARGIN = 25.0


def band_rows(percent: int, registers: int = REGISTERS, miss: float = MISS) -> int:
    """The most registers a band can have."""
    j = percent / 100
    return max([r for r in range(1, 13) if (1 - j**r) ** (registers // r) <= miss], default=1)


def sketch(elements: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Registers of a non-empty set of 64-bit hashes.

    Each element sends points at rate m to random registers; those up to a time that fills all registers are drawn at once.
    """
    n, gold = len(elements), np.uint64(0x9E3779B97F4A7C15)
    reach = (math.log(m) + 4) / n
    while True:
        mean = m * reach
        depth = int(mean + 6 * math.sqrt(mean) + 8)
        h = mix(elements[:, None] + np.arange(1, depth + 1, dtype=np.uint64)[None, :] * gold)
        t = np.cumsum(-np.log(((h >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52), axis=1) / m
        if t[:, -1].min() > reach:
            use = t <= reach
            least = np.full(m, np.inf)
            np.minimum.at(least, ((h[use] & np.uint64(0xFFF)) * np.uint64(m)) >> np.uint64(12), t[use])
            if np.isfinite(least).all():
                return np.clip(np.floor(1 - np.log(least) / math.log(BASE)) + 20_000, 0, 65_535).astype(np.uint16)
        reach *= 1.5


def bands_of(registers: np.ndarray, rows: int) -> np.ndarray:
    n = len(registers) // rows
    grid = registers[: n * rows].reshape(n, rows).astype(np.uint64)
    key = np.arange(1, n + 1, dtype=np.uint64)
    for j in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, j])
    return key.view(np.int64)


def likely(regs: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of the other sets may reach the threshold: the joint log-likelihood of a similarity at or above it is within
    ``MARGIN`` of the best one."""
    m = len(regs)
    more, same = (regs > others).sum(1), (regs == others).sum(1)
    less = m - more - same
    u = size / (size + sizes)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    grid = np.concatenate([np.linspace(0, percent / 100, 12, endpoint=False), np.linspace(percent / 100, 1, 9)])
    p_of = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)
    best, above = np.full(len(sizes), -np.inf), np.full(len(sizes), -np.inf)
    for j in grid:
        jj = np.minimum(j, top)
        a, b = p_of(u - v * jj), p_of(v - u * jj)
        ll = more * np.log(a) + less * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))
        best = np.maximum(best, ll)
        if j >= percent / 100 - 1e-12:
            above = np.maximum(above, ll)
    return above >= best - MARGIN


def forest(ids: list, sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets (side: only between the two sides; label: only between components)."""
    k = len(ids)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    regs = np.stack([sketch(s) for s in sets])
    label, links = np.arange(k) if label is None else label.copy(), []
    order = np.argsort(sizes, kind="stable")
    for i in order:
        mask = (label != label[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        if side is not None:
            mask &= side != side[i]
        js = np.flatnonzero(mask)
        if not len(js):
            continue
        js = js[likely(regs[i], int(sizes[i]), regs[js], sizes[js], percent)]
        if not len(js):
            continue
        flat = np.concatenate([sets[j] for j in js])
        at = np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)
        shared = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[js])[:-1]]))
        for j, c in zip(js, shared, strict=True):
            if 100 * c >= percent * (sizes[i] + sizes[j] - c) and label[i] != label[j]:
                links.append((ids[i], ids[j]))
                label[label == label[j]] = label[i]
    return links


def signatures(df: DataFrame, shingle: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, copy (a hash of the text), n_shingles, set_id (a 64-bit hash of the whole set), bands (of the first of equal sets
    of a step only)."""
    rows = band_rows(percent)

    def run(batches):
        import pyarrow as pa

        for ids, copies, texts in steps(batches):
            hashes, counts = word_hashes(texts)
            ends = np.cumsum(counts)
            sizes, keys, bands, seen = [], [], [], set()
            for end, n in zip(ends, counts, strict=True):
                s = shingle_set(hashes[end - n : end], shingle)
                key = int(mix(mix(s).sum(keepdims=True) + np.uint64(len(s))).view(np.int64)[0]) if len(s) else None
                sizes.append(len(s))
                keys.append(key)
                bands.append(bands_of(sketch(s), rows) if len(s) and key not in seen else None)
                seen.add(key)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(copies, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "copy", "n_shingles", "set_id", "bands"])

    return with_copies(df, id_col, text_col).mapInArrow(task(run, "words"), "doc_id long, copy long, n_shingles long, set_id long, bands array<bigint>")


def with_copies(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, copy, text: id and copy tell rows apart but for those equal in both, which are copies."""
    return texts_of(df, id_col, text_col).selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) copy", "text")


def full_sets(df: DataFrame, placed: DataFrame, shingle: int) -> DataFrame:
    """The shingle sets of placed rows: set_id, label, block, blocks, shingles; a set once for each task that meets it."""

    def run(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for *cols, texts in steps(batches):
            new = [i for i, s in enumerate(cols[0]) if not (s in seen or seen.add(s))]
            hashes, counts = word_hashes([texts[i] for i in new])
            ends = np.cumsum(counts)
            found = [shingle_set(hashes[e - n : e], shingle).tobytes() for e, n in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([*[pa.array([c[i] for i in new], pa.int64()) for c in cols], pa.array(found, pa.binary())], names=["set_id", "label", "block", "blocks", "shingles"])

    chosen = df.join(placed.hint("shuffle_merge"), ["doc_id", "copy"]).select("set_id", "label", "block", "blocks", "text")
    return chosen.mapInArrow(task(run, "words"), "set_id long, label long, block long, blocks long, shingles binary")


def linker(percent: int):
    """Links of one block as a spanning forest; ``side`` and ``component``, where not null, leave out pairs on one side or of one component."""

    def link(group):
        import pyarrow as pa

        rows = {(i, s): (np.frombuffer(x, np.uint64), c) for i, s, c, x in zip(*(group.column(n).to_pylist() for n in ("set_id", "side", "component", "shingles")), strict=True)}
        ids, sides = [i for i, _ in rows], [s for _, s in rows]
        links = []
        if len(set(ids)) > 1:
            between = None if sides[0] is None else (np.array(sides), np.array([c for _, c in rows.values()]))
            links = forest(ids, [x for x, _ in rows.values()], percent, *(between or ()))
        return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})

    return link


def drop_near_duplicates(df: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with all columns, but those that are not the kept ones of their component. Rows are told apart by id and
    text: of a repeated id only the texts that give way go. Rows without id stay."""
    doc, copy = fresh("doc"), fresh("copy")
    bad = components_of_rows(df, shingle, percent, id_col, text_col).filter("not kept").select(F.col("doc_id").alias(doc), F.col("copy").alias(copy)).distinct()
    bad = Scratch(df.sparkSession, "rejected").put(bad, "rows")
    same = (df[id_col].cast("long") == F.col(doc)) & (F.xxhash64(df[text_col].cast("string")) == F.col(copy))
    return df.join(bad.hint("shuffle_merge"), same, "left_anti")


def near_duplicates(df: DataFrame, shingle: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, a row for each row.

    Null and empty texts have no shingles and are linked with nothing. A row whose id is null links nothing, names no component
    and is kept. Rows that repeat an id are linked by their own texts; the smallest id reachable from any text names the
    component. Exact copies share a set_id and meet as one set, so a group of copies, however large, is counted and never paired.
    """
    return components_of_rows(df, shingle, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def components_of_rows(df: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``near_duplicates`` with copy, a hash of the row's text."""
    spark = df.sparkSession
    scratch = Scratch(spark, "setsketch")
    signed = scratch.put(signatures(df, shingle, percent, id_col, text_col), "signed")
    real = signed.filter("n_shingles > 0 and doc_id is not null")
    banded = real.select("set_id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("set_id").alias("first"), F.max("set_id").alias("last")).filter("first <> last").select("band", "first")
    stars = banded.join(scratch.put(shared, "bands"), "band").filter("set_id <> first").select(F.col("set_id").alias("u"), F.col("first").alias("v"))
    groups = components(stars, scratch, "groups").withColumnRenamed("v", "set_id")
    sets = real.groupBy("set_id").agg(F.min(F.struct("doc_id", "copy")).alias("at"), F.max("n_shingles").alias("n")).select("set_id", "at.doc_id", "at.copy", "n")
    members = scratch.put(sets.join(groups, "set_id"), "members")
    blocks = members.groupBy("label").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    # a group may hold a third of all sets: a merge join is one that Spark splits there
    placed = members.join(blocks.hint("shuffle_merge"), "label").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")))
    full = scratch.put(full_sets(with_copies(df, id_col, text_col), scratch.put(placed, "placed"), shingle), "full")
    # the set that names a group (its first) meets every block of the group
    own = F.when(F.col("set_id") == F.col("label"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    none = F.lit(None).cast("long")
    links = full.select("set_id", "label", F.explode(own).alias("block"), none.alias("side"), none.alias("component"), "shingles").groupBy("label", "block").applyInArrow(linker(percent), "u long, v long")
    links = scratch.put(links, "links")
    joined = components(links, scratch, "near").withColumnRenamed("label", "component").withColumnRenamed("v", "set_id")
    # what the blocks of a group leave in several components
    divided = scratch.get("placed", placed).filter("blocks > 1").select("set_id", "label", F.greatest(F.lit(1), F.floor(F.col("blocks") / WIDE)).alias("wide")).join(joined, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    parts = divided.groupBy("label", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("label").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts"), (F.sum("n") - F.max("n")).alias("strays")).filter("parts > 1")
    divided = scratch.put(divided.join(largest, "label").withColumn("groups", F.ceil(F.col("strays") / (BLOCK_SETS * WIDE))), "divided")
    if not divided.isEmpty():
        rows = scratch.get("full", full).select("set_id", "shingles").dropDuplicates(["set_id"]).join(divided, "set_id")
        every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)
        at = lambda n, seed: F.pmod(F.xxhash64("set_id", F.lit(seed)), F.col(n).cast("long"))
        shown = rows.withColumn("a", at("wide", 1)).withColumn("b", F.explode(every("groups"))).withColumn("side", F.lit(0).cast("long"))
        strays = rows.filter("component <> main").withColumn("b", at("groups", 2)).withColumn("a", F.explode(every("wide"))).withColumn("side", F.lit(1).cast("long"))
        both = shown.select("set_id", "label", "a", "b", "side", "component", "shingles").unionByName(strays.select("set_id", "label", "a", "b", "side", "component", "shingles"))
        more = scratch.put(both.groupBy("label", "a", "b").applyInArrow(linker(percent), "u long, v long"), "more")
        if not more.isEmpty():
            joined = components(links.unionByName(more), scratch, "far").withColumnRenamed("label", "component").withColumnRenamed("v", "set_id")
    named = sets.join(joined, "set_id", "left").select("set_id", "doc_id", F.coalesce("component", "set_id").alias("label"))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component"))
    component = scratch.put(named.join(smallest, "label").select("set_id", F.col("component").alias("component_id")), "component")
    scratch.drop("bands", "members", "placed", "full", "links", "divided", "more")
    linked = real.select("doc_id", "copy", "n_shingles", "set_id").join(component, "set_id").select("doc_id", "copy", "n_shingles", "component_id")
    alone = signed.filter("n_shingles = 0 or doc_id is null").select("doc_id", "copy", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
