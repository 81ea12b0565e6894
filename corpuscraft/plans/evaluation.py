"""Metrics, paired statistics, gates and domain formulas."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import domain, draws, exact
from ..operators import core
from ._registry import query

ARMS = "arms AS (SELECT d.lang, d.doc_id, l.quality = 1 AS base, l.toxic = 0 AS candidate FROM labels l JOIN documents d USING (doc_id))"
COUNTS = "counts AS (SELECT lang, count(*) AS n, count_if(base) AS base_correct, count_if(candidate) AS candidate_correct, count_if(NOT base AND candidate) AS gains, count_if(base AND NOT candidate) AS losses, count_if(base AND candidate) AS \"both\", count_if(NOT base AND NOT candidate) AS neither FROM arms GROUP BY lang)"
MCNEMAR = "CASE WHEN gains + losses = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, CAST(least(gains, losses) + 1 AS BIGINT)), lambda k: exp(lgamma(gains + losses + 1) - lgamma(k + 1) - lgamma(gains + losses - k + 1) - (gains + losses) * ln(2))))) END"


def arms(t):
    return t("labels").join(t("documents").select("doc_id", "lang"), "doc_id").select("lang", "doc_id", (F.col("quality") == 1).alias("base"), (F.col("toxic") == 0).alias("candidate"))


@query(f"WITH {ARMS}, {COUNTS}, p AS (SELECT *, gains - losses AS net, {MCNEMAR} AS p FROM counts), r AS (SELECT *, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, lang) + 1)) AS step FROM p) SELECT lang, n, base_correct, candidate_correct, gains, losses, \"both\", neither, net, round(p, 6) AS p, round(max(step) OVER (ORDER BY p, lang ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM r")
def paired_report(t):
    """Paired outcomes of two arms by language with exact McNemar and Holm-adjusted p."""
    out = core.with_holm(core.with_mcnemar(core.paired_counts(arms(t), ["lang"], "base", "candidate")), tie="lang")
    return out.withColumn("p", F.round("p", 6)).withColumn("p_holm", F.round("p_holm", 6))


@query(f"WITH {ARMS} SELECT concat(CAST(base AS INT), '->', CAST(candidate AS INT)) AS transition, count(*) AS n, min(doc_id) AS first_id FROM arms GROUP BY 1")
def paired_transitions(t):
    label = F.concat(F.col("base").cast("int").cast("string"), F.lit("->"), F.col("candidate").cast("int").cast("string"))
    return arms(t).groupBy(label.alias("transition")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("SELECT c_mktsegment AS segment, o_orderpriority AS priority, count(*) AS n, count_if(o_orderstatus = 'F') AS n_correct, count_if(o_orderstatus = 'P') AS n_pending FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((c_mktsegment), (o_orderpriority), (c_mktsegment, o_orderpriority), ())")
def grouping_metrics(t):
    """Counts of correct and pending rows by category, family, both and in all."""
    rows = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey").select("segment", F.col("o_orderpriority").alias("priority"), (F.col("o_orderstatus") == "F").alias("correct"), (F.col("o_orderstatus") == "P").alias("pending"))
    return core.graded_metrics(rows, [["segment"], ["priority"], ["segment", "priority"], []])


@query("SELECT r_name AS region, n_name AS nation, count(*) AS n, round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2)::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_metrics(t):
    dims = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t("orders").select("o_custkey", "o_totalprice").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(dims, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("SELECT l_returnflag AS category, count(*) AS n, count_if(l_discount > 0.05) AS n_correct, round(count_if(l_discount > 0.05) / count(*), 9) AS accuracy, count_if(l_linestatus = 'O') AS n_open FROM lineitem GROUP BY 1")
def category_rates(t):
    return t("lineitem").groupBy(F.col("l_returnflag").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("n_correct"), F.round(core.rate(F.count_if(F.col("l_discount") > 0.05), F.count(F.lit(1))), 9).alias("accuracy"), F.count_if(F.col("l_linestatus") == "O").alias("n_open"))


@query("WITH v AS (SELECT l_linenumber % 4 AS track, l_discount > 0.05 AS ok, CAST(l_quantity AS BIGINT) % 3 + 1 AS depth FROM lineitem) SELECT track, sum(CASE WHEN depth = 1 AND ok THEN 1 ELSE 0 END)::BIGINT AS d1, sum(CASE WHEN depth = 2 AND ok THEN 1 ELSE 0 END)::BIGINT AS d2, sum(CASE WHEN depth = 3 AND ok THEN 1 ELSE 0 END)::BIGINT AS d3 FROM v GROUP BY track")
def variant_pivot(t):
    """A count for each cell and variant, pivoted over the known variants."""
    v = t("lineitem").select((F.col("l_linenumber") % 4).alias("track"), (F.col("l_discount") > 0.05).cast("long").alias("ok"), (F.col("l_quantity").cast("long") % 3 + 1).alias("depth"))
    return v.groupBy("track").pivot("depth", [1, 2, 3]).agg(F.sum("ok")).select("track", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"d{k}") for k in (1, 2, 3)])


@query("WITH q AS (SELECT item_id AS id, s.shift, CAST((length(text) + s.shift * item_id) % 5 AS INT) AS pick FROM benchmark, (SELECT unnest([0, 1, 2, 3]) AS shift) s), g AS (SELECT id, shift, pick, CASE WHEN pick < 4 THEN (pick + shift) % 4 END AS original, pick = (id % 4 - shift + 8) % 4 AS correct FROM q), m AS (SELECT id, count_if(correct) AS n_correct, count(original) = 4 AND count(DISTINCT original) = 1 AS consistent, count(DISTINCT pick) = 1 AS constant_letter FROM g GROUP BY id) SELECT n_correct, count(*) AS questions, count_if(consistent) AS n_consistent, count_if(constant_letter) AS n_constant FROM m GROUP BY n_correct")
def rotation_metrics(t):
    """Four rotations of each question: correct rotations, the same original choice throughout, the same letter throughout."""
    q = t("benchmark").select(F.col("item_id").alias("id"), F.length("text").alias("len"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("shift"))
    pick = F.pmod(F.col("len") + F.col("shift") * F.col("id"), F.lit(5))
    g = q.select("id", pick.alias("pick"), F.when(pick < 4, F.pmod(pick + F.col("shift"), F.lit(4))).alias("original"), (pick == F.pmod(F.col("id") % 4 - F.col("shift"), F.lit(4))).alias("correct"))
    m = g.groupBy("id").agg(F.count_if("correct").alias("n_correct"), ((F.count("original") == 4) & (F.count_distinct("original") == 1)).alias("consistent"), (F.count_distinct("pick") == 1).alias("constant"))
    return m.groupBy("n_correct").agg(F.count(F.lit(1)).alias("questions"), F.count_if("consistent").alias("n_consistent"), F.count_if("constant").alias("n_constant"))


@query("WITH g AS (SELECT o_orderkey AS id, bool_and(l_quantity > 5) AS all_ok, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) SELECT count(*) AS groups, count_if(all_ok) AS all_correct, sum(n)::BIGINT AS members FROM g")
def group_all_correct(t):
    """Groups whose members all pass."""
    g = t("orders").select("o_orderkey").join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity"), "o_orderkey").groupBy("o_orderkey").agg(F.every(F.col("l_quantity") > 5).alias("all_ok"), F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("groups"), F.count_if("all_ok").alias("all_correct"), F.sum("n").alias("members"))


@query("WITH s AS (SELECT user_id % 5 AS seed, event_type, count_if(value > 50) / count(*) AS rate FROM events GROUP BY 1, 2) SELECT event_type, count(*) AS seeds, round(avg(rate), 9) AS mean, round(stddev_samp(rate), 9) AS sd, round(min(rate), 9) AS low, round(max(rate), 9) AS high FROM s GROUP BY 1")
def seed_summary(t):
    s = t("events").groupBy((F.col("user_id") % 5).alias("seed"), "event_type").agg((F.count_if(F.col("value") > 50) / F.count(F.lit(1))).alias("rate"))
    return s.groupBy("event_type").agg(F.count(F.lit(1)).alias("seeds"), *[F.round(f("rate"), 9).alias(n) for f, n in ((F.avg, "mean"), (F.stddev_samp, "sd"), (F.min, "low"), (F.max, "high"))])


@query("WITH c AS (SELECT event_type, count(*) AS n, count_if(value > 20) AS good FROM events GROUP BY 1), k AS (SELECT concat(event_type, ':share') AS \"check\", good >= 0.5 * n AS ok FROM c UNION ALL SELECT concat(event_type, ':enough'), n >= 100 FROM c) SELECT count(*) AS n_checks, count_if(NOT ok) AS n_failed, bool_and(ok) AS passed FROM k")
def gate_checks(t):
    """A table of named checks and whether all hold."""
    c = t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 20).alias("good"))
    checks = c.select(F.explode(F.array(F.struct(F.concat("event_type", F.lit(":share")).alias("check"), (F.col("good") >= 0.5 * F.col("n")).alias("ok")), F.struct(F.concat("event_type", F.lit(":enough")).alias("check"), (F.col("n") >= 100).alias("ok")))).alias("x")).select("x.*")
    return core.gate(checks)


@query("WITH m AS (SELECT o_orderpriority AS start, year(o_orderdate) % 2 AS seed, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS rate FROM orders GROUP BY 1, 2) SELECT start, count(*) = 2 AND bool_and(rate >= 0.3) AS passed, round(max(rate) - min(rate), 9) AS spread FROM m GROUP BY start")
def all_seeds_must_pass(t):
    m = t("orders").groupBy(F.col("o_orderpriority").alias("start"), (F.year("o_orderdate") % 2).alias("seed")).agg(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("rate"))
    return m.groupBy("start").agg(((F.count(F.lit(1)) == 2) & F.every(F.col("rate") >= 0.3)).alias("passed"), F.round(F.max("rate") - F.min("rate"), 9).alias("spread"))


@query("SELECT l_orderkey, l_linenumber, round(l_discount * l_tax, 9) AS \"both\", round((1 - l_discount) * (1 - l_tax), 9) AS neither, round(l_discount * (1 - l_tax) + (1 - l_discount) * l_tax, 9) AS exactly_one, round(2 * l_quantity + 3, 9) AS linear_mean, round(4 * l_tax, 9) AS linear_variance, round(l_quantity * l_tax + power(l_quantity * l_tax, 2), 9) AS poisson_second, round((l_quantity + 60) / 2, 9) AS uniform_mean, round((3600 - l_quantity * l_quantity) / (2 * (60 - l_quantity)), 9) AS tail_total, round(l_quantity + l_tax / 2, 9) AS upper_endpoint FROM lineitem")
def domain_formulas(t):
    p, q, x = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")
    named = {"both": domain.event("both", p, q), "neither": domain.event("neither", p, q), "exactly_one": domain.event("exactly_one", p, q), "linear_mean": domain.linear_moment("mean", F.lit(2), F.lit(3), x, q), "linear_variance": domain.linear_moment("variance", F.lit(2), F.lit(3), x, q), "poisson_second": domain.poisson_moment("second", x, q, F.lit(1)), "uniform_mean": domain.uniform_mean(x, F.lit(60.0)), "tail_total": domain.uniform_tail_total(x, F.lit(60.0)), "upper_endpoint": domain.upper_endpoint(x, q, F.lit(2))}
    return t("lineitem").select("l_orderkey", "l_linenumber", *[F.round(c, 9).alias(n) for n, c in named.items()])


@query("SELECT p_partkey, round(exp(lgamma(p_size + 1) - lgamma(p_size % 7 + 1) - lgamma(p_size - p_size % 7 + 1)) * power(0.25, p_size % 7) * power(0.75, p_size - p_size % 7), 8) AS pmf FROM part")
def binomial_pmf(t):
    n, r = F.col("p_size"), F.col("p_size") % 7
    return t("part").select("p_partkey", F.round(domain.binomial(n, r, F.lit(0.25)), 8).alias("pmf"))


@query("SELECT p_partkey, CASE WHEN (p_size * 2 + 6) % (p_size + 1) = 0 THEN CAST(CAST((p_size * 2 + 6) // (p_size + 1) AS BIGINT) AS VARCHAR) ELSE concat(CAST((p_size * 2 + 6) // gcd(p_size * 2 + 6, p_size + 1) AS BIGINT), '/', CAST((p_size + 1) // gcd(p_size * 2 + 6, p_size + 1) AS BIGINT)) END AS value, NULL::VARCHAR AS error FROM part")
def exact_rationals(t):
    """Canonical rationals of generated expressions."""
    text = F.format_string("(%d * 2 + 6) / (%d + 1)", "p_size", "p_size")
    return core.spread(t("part")).select("p_partkey", exact.evaluate_column(text).alias("x")).select("p_partkey", "x.value", "x.error")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'accepted' WHEN 2 THEN 'equivalence_pending' ELSE 'non_executable_or_format' END AS outcome, CASE WHEN p_partkey % 4 IN (0, 1) THEN TRUE WHEN p_partkey % 4 = 3 THEN FALSE END AS correct FROM part")
def grade_outcomes(t):
    """Accepted in any order of a sum, pending in another form, refused when it cannot be evaluated."""
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.format_string("%d + 3 * 2", F.col("p_size") + 1)).when(k == 1, F.format_string("Expression: 2 * 3 + %d", F.col("p_size") + 1)).when(k == 2, F.format_string("%d - (0 - 6)", F.col("p_size") + 1)).otherwise(F.lit("import os"))
    return core.spread(t("part")).select("p_partkey", exact.judge_column(raw, F.format_string("%d + 3 * 2", F.col("p_size") + 1)).alias("x")).select("p_partkey", "x.outcome", "x.correct")


@query(draws.bootstrap_sql("SELECT lang AS g, CASE WHEN toxic = 0 THEN 1 ELSE 0 END - quality AS x FROM labels JOIN documents USING (doc_id)", "boot", 20_000))
def bootstrap_ci(t):
    """A stratified paired bootstrap of the net change with hash draws."""
    b = arms(t).select("lang", (F.col("candidate").cast("long") - F.col("base").cast("long")).alias("change"))
    return core.bootstrap_interval(b, "change", "lang", 20_000, "boot")


@query("SELECT l_linestatus AS condition, l_returnflag AS category, count_if(l_discount > 0.05) AS automatic, count_if(l_discount > 0.05 OR l_tax > 0.06) AS reviewed, count_if(l_discount > 0.05) + count_if(l_discount <= 0.05 AND l_tax > 0.06) AS upper_bound FROM lineitem GROUP BY 1, 2")
def review_dispositions(t):
    auto, pending = F.col("l_discount") > 0.05, F.col("l_tax") > 0.06
    return t("lineitem").groupBy(F.col("l_linestatus").alias("condition"), F.col("l_returnflag").alias("category")).agg(F.count_if(auto).alias("automatic"), F.count_if(auto | pending).alias("reviewed"), (F.count_if(auto) + F.count_if(~auto & pending)).alias("upper_bound"))


@query("WITH r AS (SELECT doc_id, quality = 1 AS correct, sha256(CAST(doc_id AS VARCHAR)) AS raw_sha FROM labels), c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256('x') ELSE sha256(CAST(doc_id AS VARCHAR)) END AS guard, toxic = 0 AS credit FROM labels WHERE doc_id % 2 = 0) SELECT r.doc_id, coalesce(r.raw_sha = c.guard AND c.credit, FALSE) AS credited, r.correct OR coalesce(r.raw_sha = c.guard AND c.credit, FALSE) AS correct FROM r LEFT JOIN c USING (doc_id)")
def credit_merge(t):
    """Review credits count only where their digest of the reviewed text agrees."""
    key = F.sha2(F.col("doc_id").cast("string"), 256)
    r = t("labels").select("doc_id", (F.col("quality") == 1).alias("correct"), key.alias("raw_sha"))
    c = t("labels").filter("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.sha2(F.lit("x"), 256)).otherwise(key).alias("raw_sha"), (F.col("toxic") == 0).alias("credit"))
    return core.with_credit(r, c, ["doc_id"], "raw_sha").select("doc_id", "credited", "correct")


@query("WITH a AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, event_id, event_type = 'purchase' AS accepted FROM events) SELECT id, count(*) AS attempts, min(CASE WHEN accepted THEN attempt END) AS first_accepted, max_by(event_id, attempt) AS last_event FROM a GROUP BY id")
def attempt_history(t):
    """All attempts of an id, the first accepted one and the last one."""
    a = t("events").withColumn("attempt", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return a.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("attempts"), F.min(F.when(F.col("event_type") == "purchase", F.col("attempt"))).alias("first_accepted"), F.max_by("event_id", "attempt").alias("last_event"))


@query("WITH e AS (SELECT event_type AS suite, CAST(floor(user_id / 10) AS BIGINT) AS epoch, avg(value) AS score FROM events GROUP BY 1, 2), b AS (SELECT suite, epoch, round(score, 9) AS score, arg_max(epoch, round(score, 9)) OVER (PARTITION BY suite ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best_epoch FROM e) SELECT suite, epoch, best_epoch, epoch - best_epoch >= 2 AS plateau FROM b")
def plateau(t):
    """Epochs since the best score so far."""
    e = t("events").groupBy(F.col("event_type").alias("suite"), F.floor(F.col("user_id") / 10).alias("epoch")).agg(F.round(F.avg("value"), 9).alias("score"))
    order = Window.partitionBy("suite").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    best = e.withColumn("best_epoch", F.max_by("epoch", "score").over(order))
    return best.select("suite", "epoch", "best_epoch", (F.col("epoch") - F.col("best_epoch") >= 2).alias("plateau"))
