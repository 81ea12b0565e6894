"""Relational operators for curation: joins with contracts, deduplication, metrics, paired statistics, sampling and gates.

Contracts give tables of violations (check, key, detail) instead of raising, so that they stay lazy.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.domain import mcnemar
from .shared import Scratch, shared_folder  # noqa: F401


def hash_order(seed: str, *keys: str) -> Column:
    """A fixed order: sha256 of seed and keys joined by a pipe."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]), 256)


def hash_draw(seed: str, n: int, *keys: Column) -> Column:
    """A draw from 0 to n - 1: the first eight hex digits of a sha256, modulo n."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]), 256), 1, 8), 16, 10).cast("bigint") % n


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to as many tasks as a shuffle has. A table of short rows is a file or two, so without this one task or two
    do all that Python has to do for a million rows."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


# joins
def key_violations(df: DataFrame, *keys: str, check: str = "unique") -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1").select(F.lit(check).alias("check"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), F.col("count").cast("string").alias("detail"))


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "left_anti").select(F.lit("missing").alias("check"), F.col(key).cast("string").alias("key"), F.lit("").alias("detail"))


def with_credit(results: DataFrame, credits: DataFrame, keys: list[str], guard: str) -> DataFrame:
    """Left join of review credits whose guard digest agrees: correct or credited."""
    c = credits.select(*keys, F.col(guard).alias("__guard"), F.col("credit").alias("__credit"))
    joined = results.join(c, keys, "left")
    return joined.withColumn("credited", F.coalesce((F.col(guard) == F.col("__guard")) & F.col("__credit"), F.lit(False))).drop("__guard", "__credit").withColumn("correct", F.col("correct") | F.col("credited"))


def with_rules(rows: DataFrame, key: str, rules: dict[str, str], approved: str) -> DataFrame:
    """Rows with their rule's text from a dimension; an error if the rules are not those whose digest was approved."""
    digest = hashlib.sha256("\n".join(f"{k}={v}" for k, v in sorted(rules.items())).encode()).hexdigest()
    if digest != approved:
        raise ValueError("the rules are not the approved ones")
    dim = rows.sparkSession.createDataFrame(list(rules.items()), f"{key} string, rule_text string")
    return rows.join(F.broadcast(dim), key).withColumn("approved", F.lit(digest))  # a row for each rule


# deduplication
def keep_first(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__rn = 1").drop("__rn")


def duplicate_log(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """Which row each removed row gave way to: kept, removed. Counts and minima only, so a large group is no burden."""
    keyed = df.select(F.col(id_col), F.xxhash64(key).alias("__k"), F.sha2(key, 256).alias("__s"))
    first = keyed.groupBy("__k", "__s").agg(F.min(id_col).alias("kept"))
    return keyed.join(first, ["__k", "__s"]).filter(F.col(id_col) != F.col("kept")).select("kept", F.col(id_col).alias("removed"))


def owned_by_two(df: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys that more than one owner has."""
    return df.groupBy(key).agg(F.count_distinct(owner).alias("owners"), F.min(owner).alias("first_owner"), F.max(owner).alias("last_owner")).filter("owners > 1")


def over_concentrated(df: DataFrame, key: str, limit: int) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)


# metrics
def graded_metrics(df: DataFrame, sets: list[list[str]], correct: str = "correct", pending: str = "pending") -> DataFrame:
    """n, correct and pending by several groupings at once (grouping sets). A null ``correct`` is pending, not wrong."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(correct)).alias("n_correct"), F.count_if(F.col(pending)).alias("n_pending"))


def rate(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


# paired statistics
def paired_counts(df: DataFrame, group: list[str], base: str, candidate: str) -> DataFrame:
    b, c = F.col(base), F.col(candidate)
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(b).alias("base_correct"), F.count_if(c).alias("candidate_correct"), F.count_if(~b & c).alias("gains"), F.count_if(b & ~c).alias("losses"), F.count_if(b & c).alias("both"), F.count_if(~b & ~c).alias("neither")
    )


def with_mcnemar(df: DataFrame) -> DataFrame:
    return df.withColumn("net", F.col("gains") - F.col("losses")).withColumn("p", mcnemar(F.col("gains"), F.col("losses")))


def with_holm(df: DataFrame, p: str = "p", tie: str = "", out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p over all rows: these are a report's few groups, so one ordered window holds them."""
    order = Window.partitionBy(F.lit(0)).orderBy(p, tie)
    m = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    step = F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(order) + 1))
    return df.withColumn("__step", step).withColumn(out, F.max("__step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def bootstrap_interval(df: DataFrame, change: str, group: str, reps: int, seed: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """A percentile interval of the net change when each group is resampled with replacement.

    A resample is told by how often it draws each distinct change: multinomial counts, made by conditional binomials from hashes. So
    the work is replicates times distinct changes, whatever the number of rows, and a group is a few counts. Null changes are not drawn.
    """
    counted = df.filter(F.col(change).isNotNull()).groupBy(group, F.col(change).cast("long").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    kinds = counted.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("x", "n"))).alias("kinds"), F.sum("n").alias("m"))
    runs = spread(kinds.select("*", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")))
    drawn = F.transform("kinds", lambda kind: draws.uniform(F.lit(seed), F.col(group), F.col("rep"), kind["x"]))
    nets = runs.select("rep", draws.net_column(drawn, F.col("kinds.n"), F.col("kinds.x")).alias("net")).groupBy("rep").agg(F.sum("net").alias("net"))
    return nets.agg(F.percentile("net", F.lit(low)).alias("low"), F.percentile("net", F.lit(high)).alias("high"), F.count(F.lit(1)).alias("reps"))


# sampling and order
def stratified_sample(df: DataFrame, by: str, n: int, seed: str, id_col: str) -> DataFrame:
    """The first n of each stratum in hash order; the rank filter is pushed below the shuffle as a group limit."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(hash_order(seed, id_col), id_col))).filter(F.col("rn") <= n)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Rows numbered from 1 in a total order of the whole table, without a window over all of it.

    Rows are dealt by ranges of the order; each range is numbered by itself, and the counts of the ranges before (one number a
    range) are added. The dealt table is written once, so that both uses see the same ranges.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    return numbered_ranges(df.repartitionByRange(*order), order, name, Scratch(df.sparkSession, "numbered"))


def numbered_ranges(dealt: DataFrame, order: list, name: str, scratch: Scratch) -> DataFrame:
    """The same for rows whose tasks hold ranges of the order already; they are written to ``scratch`` as "rows"."""
    dealt = dealt.sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()).withColumn("__own", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1)  # the row's place in its task
    dealt = scratch.put(dealt, "rows")
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))  # a row for each range
    return dealt.join(F.broadcast(before), "__range").withColumn(name, (F.col("__before") + F.col("__own")).cast("long")).drop("__range", "__own", "__before")


def numbered_within(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Rows numbered from 1 within their group: their place in the whole order less that of the group's first row, so that no task
    holds a whole group."""
    placed = numbered(df, [*by, *order], "__at")
    first = placed.groupBy(*by).agg(F.min("__at").alias("__first"))
    return placed.join(first, by).withColumn(name, F.col("__at") - F.col("__first") + 1).drop("__at", "__first")


def round_robin(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Position of each row when groups take turns: places within groups, then places of (turn, group) in the whole table."""
    turns = numbered_within(df, [by], order, "turn")
    return numbered(turns, ["turn", by], "position")


# sets
def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, n: how many rows each of two tables has beyond the other, repeats counted, in one aggregate over both."""
    keys = a.columns
    both = a.withColumn("__d", F.lit(1)).unionByName(b.withColumn("__d", F.lit(-1))).groupBy(*keys).agg(F.sum("__d").alias("__d"))
    more = lambda d: F.coalesce(F.sum(F.greatest(d, F.lit(0))), F.lit(0))
    sums = both.agg(more(F.col("__d")).alias("left"), more(-F.col("__d")).alias("right"))
    return sums.select(F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("n")) for s in ("left", "right")])).alias("x")).select("x.*")


# audits
def critic_outcome(valid: Column, critic: Column, repaired: Column) -> Column:
    """stage and reason of a candidate: validated, criticised, and validated once more where a repair was asked for. A critic without
    a known verdict is an error."""
    ends = [
        (~F.coalesce(valid, F.lit(False)), "generator", F.lit("invalid_candidate")),
        (~F.coalesce(critic.isin("PASS", "REPAIR"), F.lit(False)), "critic", F.when(critic == "REJECT", "reject").otherwise("error")),
        ((critic == "REPAIR") & ~F.coalesce(repaired, F.lit(False)), "repair", F.lit("invalid_repair")),
        (critic == "REPAIR", "accepted", F.lit("repaired")),
    ]
    return F.coalesce(*[F.when(hit, F.struct(F.lit(stage).alias("stage"), reason.alias("reason"))) for hit, stage, reason in ends], F.struct(F.lit("accepted").alias("stage"), F.lit("passed").alias("reason")))


def reproduced(again: DataFrame, stored: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Recomputed values and whether the stored summary has the same; keys that only one side has are not reproduced."""
    old = stored.select(*keys, *[F.col(v).alias(f"__{v}") for v in values], F.lit(True).alias("__there"))
    same = F.coalesce(F.col("__there"), F.lit(False))
    for v in values:
        same &= F.col(v).eqNullSafe(F.col(f"__{v}"))
    return again.join(old, keys, "full").select(*keys, *values, same.alias("reproduced"))


# gates
def gate(checks: DataFrame) -> DataFrame:
    """passed only if every check holds; a check without an answer fails."""
    return checks.agg(F.count(F.lit(1)).alias("n_checks"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("n_failed"), F.every(F.coalesce("ok", F.lit(False))).alias("passed"))
