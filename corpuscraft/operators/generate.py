"""Rows made from rows: families, requirements on axes, training views, requests, adapters of older records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import questions as Q


def family_dimension(spark: SparkSession) -> DataFrame:
    """category, family: eighteen rows."""
    return spark.createDataFrame(list(Q.FAMILY_OF.items()), "category string, family string")


def family_of(category: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in Q.FAMILY_OF.items() for x in kv])[category]


def matches(required: Column, axes: Column) -> Column:
    """Whether every axis = value pair of a map holds in another."""
    return F.forall(F.map_entries(required), lambda e: axes[e["key"]].eqNullSafe(e["value"]))


def views(rows: DataFrame, targets: dict[str, tuple[str, str]], suffixes: dict[str, str], key: str = "p_partkey") -> DataFrame:
    """key, mode, prompt, target: a view of each record for each mode; ``targets`` are a label and the column behind it."""
    made = F.array(*[F.struct(F.lit(m).alias("mode"), F.concat("question", F.lit("\n" + suffixes[m])).alias("prompt"), F.concat(F.lit(label), F.col(c)).alias("target")) for m, (label, c) in targets.items()])
    return rows.select(key, F.explode(made).alias("x")).select(key, "x.mode", "x.prompt", "x.target")


#: What a request may hold: all else (answers, semantics, splits) stays behind.
PUBLIC = ("id", "question")


def sanitized(rows: DataFrame, key: str) -> DataFrame:
    """Exactly the public columns."""
    return rows.select(F.col(key).alias("id"), "question")


def forbidden_columns(rows: DataFrame) -> list[str]:
    """The columns that a request must not hold; none if it is sanitized."""
    return sorted(set(rows.columns) - set(PUBLIC))


def requests(rows: DataFrame, key: str, size: int, input_price: float, output_price: float, output_tokens: int) -> DataFrame:
    """packet, n, payload, cost_bound: packets of ``size`` keys in order; (bytes + 512) input tokens and ``output_tokens`` at most,
    priced for a million. A packet is bounded, so its rows may be gathered."""
    public = sanitized(rows, key)
    packets = public.groupBy(F.floor(F.col("id") / size).alias("packet")).agg(F.count(F.lit(1)).alias("n"), F.to_json(F.array_sort(F.collect_list(F.struct(*PUBLIC)))).alias("payload"))
    bound = (F.octet_length("payload") + 512) * input_price / 1e6 + F.lit(output_tokens) * output_price / 1e6
    return packets.select("packet", "n", "payload", bound.alias("cost_bound"))


def adapted(rows: DataFrame) -> DataFrame:
    """Older records (track, bindings) as category, semantics and answer: chances of a miss become chances of a hit, seconds
    become minutes. The arithmetic on rationals is left to the canonical form."""
    b = F.col("bindings")
    hit = lambda name: F.concat((F.split(b[name], "/")[1].cast("int") - F.split(b[name], "/")[0].cast("int")).cast("string"), F.lit("/"), F.split(b[name], "/")[1])
    minutes = lambda name: F.concat(b[name], F.lit("/60"))
    category = F.when(F.col("track") == "detectors", "exactly_one").when(F.col("track") == "poisson_time", "process_variance").when(F.col("track") == "uniform_time", "uniform_conditional")
    semantics = (
        F.when(F.col("track") == "detectors", F.to_json(F.struct(hit("miss_a").alias("p"), hit("miss_b").alias("p_b"))))
        .when(F.col("track") == "poisson_time", F.to_json(F.struct(b["rate"].alias("rate"), minutes("seconds").alias("duration"))))
        .when(F.col("track") == "uniform_time", F.to_json(F.struct(b["lower"].alias("lower"), b["upper"].alias("upper"), minutes("waited_seconds").alias("cutoff"))))
    )
    d = rows.withColumn("category", category).withColumn("semantics", Q.canonical_column(semantics).getField("text"))
    x = Q.question_column("category", F.lit("givens_first"), "semantics", F.lit("A_then_B"), F.lit("minutes"))
    return d.withColumn("answer", x.getField("answer"))


def first_accepted(attempts: DataFrame, key: str, order: str, accepted: str, *payload: str) -> DataFrame:
    """The first accepted attempt of each key; keys without one are left out."""
    return attempts.filter(F.col(accepted)).groupBy(key).agg(F.min_by(F.struct(*payload), order).alias("x")).select(key, "x.*")


def first_match(left: DataFrame, source: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each left row with the first source row of equal keys in the order, or null."""
    rest = [c for c in source.columns if c not in (*keys, order)]
    first = source.groupBy(*keys).agg(F.min_by(F.struct(order, *rest), order).alias("x")).select(*keys, "x.*")
    return left.join(first, keys, "left")


def replacements(chosen: DataFrame, blocked: DataFrame, reserve: DataFrame, key: str, category: str, order: str) -> DataFrame:
    """Chosen rows, those with a blocked key replaced by unused reserve rows of their category, taken in order: position by
    position within the category, so no row is used twice. ``replaced_by`` is null for rows that stay and for want of reserve."""
    hit = chosen.join(blocked.select(key).distinct().withColumn("hit", F.lit(True)), key, "left")
    used = chosen.select(key).unionByName(blocked.select(key)).distinct()
    spare = reserve.join(used, key, "left_anti")
    by = Window.partitionBy(category).orderBy(order)
    need = hit.filter("hit").withColumn("slot", F.row_number().over(by))
    give = spare.groupBy(category, key).agg(F.min(order).alias(order)).select(category, F.col(key).alias("replaced_by"), F.row_number().over(by).alias("slot"))
    out = need.join(give, [category, "slot"], "left").select(order, category, key, "replaced_by")
    return hit.filter("hit is null").select(order, category, key, F.lit(None).cast(reserve.schema[key].dataType).alias("replaced_by")).unionByName(out)
