"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

Each source's target is its weight's share of the mix, at most ``repeats`` times its size. Its blocks (runs of ``BLOCK`` words of a
document) stand in a permuted order of their own, once for each repeat; the mix takes the first so many words of that order, so the
last block is cut where the target is met. The numbers of blocks taken, source by source, are the quotas at the root of a tree
over output shards: a node deals its quotas to its two halves as if the blocks were shuffled and cut (a hypergeometric draw for
each source, given those before), until every shard has an exact quota of every source and the range of the permuted order that
fills it. Shards then draw their ranges, which are disjoint, and shuffle them by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.core import numbered
from ._common import Scratch

#: Words of a block, and blocks of an output shard.
BLOCK, SHARD = 1_024, 1_024
#: Blocks that are put in order together: a source's permuted order is cut into so many cells, whatever the source's size.
CELL = 4_096
#: Levels of the tree between two exchanges of its nodes.
LEVELS = 3
#: Fixed value: what is a word.
WORD = r"[^\x20\x09-\x0D]+"


def uniform(*keys: Column) -> Column:
    """A number from 0 to below 1, by hash."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` items out of ``total`` are among the ``marked`` ones, by inversion of ``u``: weights relative to the mode,
    whose ratios need no factorials, over ten standard deviations and ten to each side (what lies beyond weighs under 1e-20)."""
    d = lambda c: c.cast("double")
    n, m, k = d(total), d(marked), d(drawn)
    low, high = F.greatest(F.lit(0).cast("long"), drawn - (total - marked)), F.least(marked, drawn)
    mode = F.least(high, F.greatest(low, F.floor((k + 1) * (m + 1) / (n + 2))))
    reach = F.ceil(F.sqrt(k * (m / n) * ((n - m) / n) * ((n - k) / F.greatest(n - 1, F.lit(1.0)))) * 10) + 10
    none = F.array().cast("array<bigint>")
    up = lambda i: (m - i) * (k - i) / ((i + 1) * (n - m - k + i + 1))
    down = lambda i: i * (n - m - k + i) / ((m - i + 1) * (k - i + 1))

    def mass(places: Column, ratio) -> Column:
        step = lambda acc, i: bound(acc["w"] * ratio(i), lambda w: F.struct(w.alias("w"), (acc["s"] + w).alias("s")))
        return F.aggregate(places, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s")), step, lambda acc: acc["s"])

    def seek(places: Column, ratio, left: Column, mode: Column, by: int) -> Column:
        """The place where ``left`` is used up, and what is left of it."""

        def step(acc, i):
            moved = bound(acc["w"] * ratio(i), lambda w: F.struct(w.alias("w"), (acc["left"] - w).alias("left"), (i + by).alias("at")))
            return F.when(acc["left"] >= 0, moved).otherwise(acc)

        return F.aggregate(places, F.struct(F.lit(1.0).alias("w"), left.alias("left"), mode.alias("at")), step)

    def draw(x: Column) -> Column:
        mode, above, below = x["mode"], F.when(x["last"] > x["mode"], F.sequence(x["mode"], x["last"] - 1)).otherwise(none), F.when(x["first"] < x["mode"], F.sequence(x["mode"], x["first"] + 1, F.lit(-1).cast("long"))).otherwise(none)
        fall = lambda risen: F.when(risen["left"] < 0, risen["at"]).otherwise(bound(seek(below, down, risen["left"], mode, -1), lambda f: F.when(f["left"] < 0, f["at"]).otherwise(mode)))
        rise = lambda over: F.when(over < 0, mode).otherwise(bound(seek(above, up, over, mode, 1), fall))
        return bound(u * (1 + mass(above, up) + mass(below, down)) - 1, rise)  # below 0: the mode itself

    start = F.struct(low.alias("low"), high.alias("high"), mode.alias("mode"), reach.alias("reach"))
    ends = lambda x: F.struct(x["mode"].alias("mode"), F.greatest(x["low"], x["mode"] - x["reach"]).alias("first"), F.least(x["high"], x["mode"] + x["reach"]).alias("last"))
    return bound(start, lambda x: F.when(x["low"] == x["high"], x["low"]).otherwise(bound(ends(x), draw)))


def measured(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """row, doc_id, source, print (of the text), size (words): all that the operator shuffles of a document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("print"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """source, s (its place by code point, null last), source_size, n_blocks, target, want (target in whole words).

    Targets are weights times a level, cut at ``repeats`` times the size: the level rises until what the cut sources leave is
    given out, a pass over the table of sources each time; only its sums reach the driver.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.ceil(F.col("size") / BLOCK)).alias("n_blocks"))
    own = numbered(own, [F.col("source").isNull(), "source"], "s")
    table = F.array(*[F.lit(float(w)) for w in weights])
    own = own.withColumn("weight", F.element_at(table, (F.pmod(F.col("s") - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("cap", F.col("source_size").cast("double") * repeats)
    first = own.agg(F.sum("source_size"), F.sum("weight")).first()
    goal, level, cut = share * float(first[0] or 0), 0.0, -1
    level = goal / first[1] if first[1] else 0.0
    while True:
        full = F.col("weight") * level >= F.col("cap")
        now = own.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if now[0] == cut or not now[2]:
            break
        cut, level = now[0], max(level, (goal - now[1]) / now[2])
    target = F.least("cap", F.col("weight") * level)
    return own.select("source", "s", "source_size", "n_blocks", target.alias("target"), F.least(F.round(target).cast("long"), F.col("source_size") * repeats).alias("want"))


def drawn_blocks(sizes: DataFrame, sources: DataFrame, seed: int, repeats: int) -> DataFrame:
    """s, position (from 1 in the source's permuted order), row, doc_id, print, epoch, start_word, n_words of all that the mix takes.

    A source's order is that of (epoch, cell, hash). Cells hold some ``CELL`` blocks of one source each, so that no task holds a
    source; a cell's place is the sum of those before it.
    """
    given = sizes.join(sources.filter("want > 0").select("source", "s", "source_size", "n_blocks", "want"), sizes["source"].eqNullSafe(sources["source"])).drop("source")
    epochs = F.sequence(F.lit(0), F.expr(f"cast(least({repeats} - 1, (want - 1) div source_size) as int)"))
    blocks = given.filter("size > 0").select("*", F.explode(F.expr(f"sequence(0L, (size - 1) div {BLOCK})")).alias("block")).select("*", F.explode(epochs).alias("epoch"))
    key = F.xxhash64(F.lit(seed), "epoch", "doc_id", "print", "s", "block")
    blocks = blocks.withColumn("key", key).withColumn("cell", F.floor(uniform(F.lit(seed + 1), F.col("key")) * F.ceil(F.col("n_blocks") / CELL)))
    blocks = blocks.select("s", "epoch", "cell", "key", "row", "doc_id", "print", (F.col("block") * BLOCK).alias("start_word"), F.least(F.lit(BLOCK).cast("long"), F.col("size") - F.col("block") * BLOCK).alias("words"), "want")
    cells = blocks.groupBy("s", "epoch", "cell").agg(F.sum("words").alias("in_cell"), F.count(F.lit(1)).alias("blocks_in_cell"), F.first("want").alias("limit"))
    ahead = Window.partitionBy("s").orderBy("epoch", "cell").rowsBetween(Window.unboundedPreceding, -1)
    places = cells.select("s", "epoch", "cell", "limit", F.coalesce(F.sum("in_cell").over(ahead), F.lit(0)).alias("words_before"), F.coalesce(F.sum("blocks_in_cell").over(ahead), F.lit(0)).alias("blocks_before")).filter("words_before < limit").drop("limit")
    within = Window.partitionBy("s", "epoch", "cell").orderBy("key", "doc_id", "print", "start_word", "row")
    before = F.col("words_before") + F.coalesce(F.sum("words").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.join(places, ["s", "epoch", "cell"]).select("s", (F.col("blocks_before") + F.row_number().over(within)).alias("position"), "row", "doc_id", "print", "epoch", "start_word", F.least(F.col("words"), F.col("want") - before).alias("n_words"))
    return placed.filter("n_words > 0")


def dealt(quotas: Column, total: Column, left: Column, *keys: Column) -> Column:
    """How many of each source's ``quotas``, ``total`` in all, fall among ``left`` that are drawn: a multivariate hypergeometric draw."""

    def deal(acc, x):
        take = lambda got: F.struct((acc["n"] - x["q"]).alias("n"), (acc["k"] - got).alias("k"), F.array_append(acc["got"], got).alias("got"))
        return bound(hypergeometric(acc["n"], x["q"], acc["k"], uniform(*keys, x["s"])), take)

    start = F.struct(total.alias("n"), left.alias("k"), F.array().cast("array<bigint>").alias("got"))
    return F.aggregate(quotas, start, deal, lambda acc: acc["got"])


def shard_quotas(quotas: DataFrame, shard: int, seed: int) -> DataFrame:
    """From s, q (blocks taken): shard, s, q, o (the shard takes positions o + 1 to o + q of the source).

    A node is a row: its first shard, its number of shards, its number of blocks and the quotas that are left of each source. What
    it holds grows with the sources, not with their rows.
    """
    root = quotas.agg(F.array_sort(F.collect_list(F.struct("s", F.col("q").cast("long").alias("q"), F.lit(0).cast("long").alias("o")))).alias("quotas"), F.coalesce(F.sum("q"), F.lit(0)).cast("long").alias("n"))
    root = root.select(F.lit(0).cast("long").alias("shard"), F.ceil(F.col("n") / shard).alias("shards"), "n", "quotas")
    nodes, most, level = root, root.first()["shards"], 0
    while most > 1:
        level += 1
        half = F.floor(F.col("shards") / 2)
        split = nodes.select("*", half.alias("half"), F.floor(F.col("n") * half.cast("decimal(20,0)") / F.col("shards")).cast("long").alias("left_n"))

        split = split.withColumn("got", F.when(F.col("shards") > 1, dealt(F.col("quotas"), F.col("n"), F.col("left_n"), F.lit(seed), F.lit(level), F.col("shard"))))
        kept = lambda part: F.filter(F.zip_with("quotas", "got", part), lambda x: x["q"] > 0)
        left = kept(lambda x, g: F.struct(x["s"].alias("s"), g.alias("q"), x["o"].alias("o")))
        right = kept(lambda x, g: F.struct(x["s"].alias("s"), (x["q"] - g).alias("q"), (x["o"] + g).alias("o")))
        node = lambda *v: F.struct(*[c.alias(k) for c, k in zip(v, ("shard", "shards", "n", "quotas"), strict=True)])
        halves = F.array(node(F.col("shard"), F.col("half"), F.col("left_n"), left), node(F.col("shard") + F.col("half"), F.col("shards") - F.col("half"), F.col("n") - F.col("left_n"), right))
        whole = F.array(node(F.col("shard"), F.col("shards"), F.col("n"), F.col("quotas")))
        nodes = split.select(F.explode(F.when(F.col("shards") > 1, halves).otherwise(whole)).alias("x")).select("x.*")
        if level % LEVELS == 0:
            nodes = nodes.repartition("shard")
        most = -(-most // 2)
    return nodes.select("shard", F.explode("quotas").alias("x")).select("shard", "x.*")


class Mix:
    """A mix of ``df``. ``documents``: a row for each row of the table; ``blocks``: the mix itself, block by block, in its shards."""

    def __init__(self, df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, shard: int = SHARD, seed: int = 13, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"):
        self.df, self.columns = df, (id_col, text_col)
        scratch = Scratch(df.sparkSession, "mix")
        self.sizes = scratch.put(measured(df, id_col, source_col, text_col), "sizes")
        self.sources = scratch.put(targets(self.sizes, weights, share, repeats), "sources")
        draws = scratch.put(drawn_blocks(self.sizes, self.sources, seed, repeats), "draws")
        quotas = scratch.put(shard_quotas(draws.groupBy("s").agg(F.count(F.lit(1)).alias("q")), shard, seed + 2), "quotas")
        ranges = quotas.select("shard", "s", F.explode(F.expr("sequence(o + 1, o + q)")).alias("position"))
        order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 3), "shard", "s", "position"), "s", "position")
        ranges = ranges.hint("merge")  # Spark takes the rows of a sequence for as small as its ends and would broadcast them
        self.blocks = ranges.join(draws, ["s", "position"]).withColumn("place", F.row_number().over(order))

    @property
    def documents(self) -> DataFrame:
        """doc_id, source, size, source_size, target, taken (words of all its blocks)."""
        taken = self.blocks.groupBy("row").agg(F.sum("n_words").alias("taken"))
        known = self.sizes.join(self.sources.select(F.col("source").alias("__source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("__source")))
        return known.join(taken, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    @property
    def texts(self) -> DataFrame:
        """shard, place, doc_id, text: the words of every block, joined by single spaces."""
        id_col, text_col = self.columns
        words = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"({WORD})"), F.lit(1))
        full = self.df.select(F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("print"), F.col(id_col).alias("__id"), words.alias("words")).dropDuplicates(["print", "__id"])
        joined = self.blocks.join(full, (self.blocks["print"] == full["print"]) & F.col("doc_id").eqNullSafe(F.col("__id")))
        return joined.select("shard", "place", "doc_id", F.array_join(F.slice("words", (F.col("start_word") + 1).cast("int"), F.col("n_words").cast("int")), " ").alias("text"))


def mix_documents(df: DataFrame, **parameters) -> DataFrame:
    """What the mix takes of each row: doc_id, size, source_size, target, taken.

    Null and empty texts have size 0 and are never taken; a null source is a source of its own, the last; a source without words has
    target 0. Rows that repeat an id are rows of their own, and equal rows may change places. The mix depends on ids, texts and sources
    alone, not on files or partitions, so reruns agree. An empty table gives an empty result.
    """
    return Mix(df, **parameters).documents.select("doc_id", "size", "source_size", "target", "taken")
