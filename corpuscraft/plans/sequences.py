"""Sampling, ordering, windows, generators, ledgers and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import core
from ._registry import query


@query("SELECT lang, doc_id, rn FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat('v1|', doc_id)), doc_id) AS rn FROM documents) WHERE rn <= 40")
def stratified_hash_sample(t):
    return core.stratified_sample(t("documents"), "lang", 40, "v1", "doc_id").select("lang", "doc_id", "rn")


@query("SELECT lang, doc_id, row_number() OVER (ORDER BY turn, lang) AS position FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents)")
def round_robin(t):
    return core.round_robin(t("documents").select("lang", "doc_id"), "lang", ["doc_id"]).select("lang", "doc_id", "position")


@query("WITH r AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'replay' END AS role FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY id) AS turn FROM r), m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM r GROUP BY role)) SELECT id, role, 2 * turn - CAST(role = 'new' AS INT) AS position FROM n, m WHERE turn <= m")
def interleave_one_to_one(t):
    """New and replayed rows by turns, as many of each; the place follows from the turn, so nothing is sorted as a whole."""
    rows = t("documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, "new").otherwise("replay").alias("role"))
    turns = core.numbered_within(rows, ["role"], ["id"], "turn")
    most = rows.groupBy("role").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("most"))
    return turns.join(F.broadcast(most)).filter("turn <= most").select("id", "role", (2 * F.col("turn") - (F.col("role") == "new").cast("int")).alias("position"))  # one row


@query("SELECT source, CAST(ceil(rn / 12.0) AS BIGINT) AS packet, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) GROUP BY 1, 2")
def packets(t):
    """Slices of twelve rows in order."""
    rn = core.numbered_within(t("documents").select("source", "doc_id"), ["source"], ["doc_id"], "rn")
    return rn.groupBy("source", F.ceil(F.col("rn") / 12.0).cast("long").alias("packet")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT conv_id, turn, dense_rank() OVER (ORDER BY sha256(concat('s|', conv_id)), conv_id) AS group_order FROM conversations")
def group_shuffle(t):
    """Whole groups in hash order: the rank is found among groups, then joined, so rows are not gathered."""
    keys = t("conversations").select("conv_id").distinct().withColumn("h", core.hash_order("s", "conv_id"))
    groups = core.numbered(keys, ["h", "conv_id"], "group_order").select("conv_id", "group_order")
    return t("conversations").select("conv_id", "turn").join(groups, "conv_id")


@query("SELECT user_id, max(flags) AS most FROM (SELECT user_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w AS flags, count(*) OVER w AS size FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE size = 8 GROUP BY user_id")
def sliding_rows(t):
    """The most flagged rows in any full window of eight rows."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(0, 7)
    rows = t("events").select("user_id", F.sum((F.col("event_type") == "click").cast("long")).over(w).alias("flags"), F.count(F.lit(1)).over(w).alias("size"))
    return rows.filter("size = 8").groupBy("user_id").agg(F.max("flags").alias("most"))


@query("SELECT item_id, shift, concat('ABCD'[(item_id % 4 - shift + 8) % 4 + 1]) AS gold, array_to_string(list_concat(c[shift + 1 :], c[1 : shift]), '|') AS choices FROM (SELECT item_id, [concat('w', item_id), concat('x', item_id), concat('y', item_id), concat('z', item_id)] AS c FROM benchmark), (SELECT unnest([0, 1, 2, 3]) AS shift)")
def rotation_expand(t):
    """Each question four times with its choices rotated."""
    c = F.array(*[F.concat(F.lit(x), F.col("item_id").cast("string")) for x in "wxyz"])
    q = t("benchmark").select("item_id", c.alias("c"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("shift"))
    return q.select("item_id", "shift", text.rotated_gold(F.col("item_id") % 4, F.col("shift")).alias("gold"), F.array_join(text.rotate(F.col("c"), F.col("shift")), "|").alias("choices"))


@query("SELECT p_partkey, unnest([1, 2, 3]) AS depth, p_size * unnest([1, 10, 100]) AS value FROM part")
def depth_ladder(t):
    """One row of parameters to three depths with growing magnitude."""
    levels = F.array(*[F.struct(F.lit(d).alias("depth"), (F.col("p_size") * m).alias("value")) for d, m in ((1, 1), (2, 10), (3, 100))])
    return t("part").select("p_partkey", F.explode(levels).alias("x")).select("p_partkey", "x.depth", "x.value")


@query("SELECT a.p_brand, b AS size_class, count(*) AS n FROM (SELECT DISTINCT p_brand FROM part) a, (SELECT unnest(range(0, 5)) AS b), (SELECT unnest([0, 1]) AS style) GROUP BY 1, 2")
def parameter_grid(t):
    """A product of small dimensions by exploding, without a cross join."""
    brands = t("part").select("p_brand").distinct()
    grid = brands.select("p_brand", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("size_class")).select("p_brand", "size_class", F.explode(F.array(F.lit(0), F.lit(1))).alias("style"))
    return grid.groupBy("p_brand", "size_class").agg(F.count(F.lit(1)).alias("n"))


@query("WITH w AS (SELECT greatest(5000, 2 * (max(doc_id) + 1)) AS space FROM documents), c AS (SELECT d AS draw, CAST(CAST(('0x' || substr(sha256(concat('gen|', d)), 1, 8)) AS UBIGINT) % space AS BIGINT) AS key FROM (SELECT unnest(range(0, 100000)) AS d), w) SELECT min(draw) AS draw, key FROM c WHERE key NOT IN (SELECT doc_id FROM documents) GROUP BY key ORDER BY draw LIMIT 100")
def rejection_sampling(t):
    """Draws in rounds until 100 keys outside the blocked ones are found, from a space at least twice as wide as the blocked ids."""
    return free_keys(t("documents").select(F.col("doc_id").alias("key")), 100)


def free_keys(blocked: DataFrame, wanted: int, most: int = 100_000) -> DataFrame:
    """draw, key: the first draws of ``wanted`` distinct keys that are not blocked; an error if ``most`` draws hold fewer."""
    space, draws = max(5000, 2 * ((blocked.agg(F.max("key")).first()[0] or 0) + 1)), 4000
    while True:
        drawn = blocked.sparkSession.range(draws).select(F.col("id").alias("draw"), core.hash_draw("gen", space, F.col("id")).alias("key"))
        free = drawn.join(blocked, "key", "left_anti").groupBy("key").agg(F.min("draw").alias("draw")).orderBy("draw").limit(wanted).select("draw", "key")
        if (found := free.count()) == wanted:
            return free
        if draws >= most:
            raise ValueError(f"{found} of {wanted} free keys in {draws} draws")
        draws = min(2 * draws, most)


LEDGER = "e AS (SELECT user_id AS tag, event_id, CASE event_type WHEN 'view' THEN 'started' WHEN 'purchase' THEN 'response' WHEN 'error' THEN 'http_error' ELSE 'note' END AS event, value FROM events)"


def ledger(t):
    kind = F.when(F.col("event_type") == "view", "started").when(F.col("event_type") == "purchase", "response").when(F.col("event_type") == "error", "http_error").otherwise("note")
    return t("events").select(F.col("user_id").alias("tag"), "event_id", kind.alias("event"), "value")


@query(f"WITH {LEDGER} SELECT tag, max_by(event, event_id) AS state, count_if(event = 'started') AS calls, max_by(event, event_id) = 'started' AS unresolved FROM e WHERE event <> 'note' GROUP BY tag")
def ledger_state(t):
    """The last event of each tag; a call without an answer is unresolved."""
    e = ledger(t).filter("event <> 'note'")
    return e.groupBy("tag").agg(F.max_by("event", "event_id").alias("state"), F.count_if(F.col("event") == "started").alias("calls"), (F.max_by("event", "event_id") == "started").alias("unresolved"))


@query("SELECT user_id, event_id, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) OVER w, 6) AS spent, sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) OVER w + 10 <= 200 AS allowed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def budget_running_sum(t):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)).over(w)
    return t("events").select("user_id", "event_id", F.round(spent, 6).alias("spent"), (spent + 10 <= 200).alias("allowed"))


@query("SELECT event_type, count(*) AS attempted, count(value) AS with_cost, round(sum(CAST(coalesce(value, 0) AS DECIMAL(18,4))), 4)::DOUBLE AS cost, count_if(value IS NULL OR isnan(value) OR value < 0) AS invalid FROM events GROUP BY 1")
def usage_totals(t):
    v = F.col("value")
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("attempted"), F.count("value").alias("with_cost"), F.sum(F.coalesce(v, F.lit(0.0)).cast("decimal(18,4)")).cast("double").alias("cost"), F.count_if(v.isNull() | F.isnan(v) | (v < 0)).alias("invalid"))


@query("SELECT coalesce(a.tag, b.tag, c.tag) AS tag, CASE WHEN b.tag IS NOT NULL THEN 'done' WHEN c.tag IS NOT NULL THEN 'pending' ELSE 'lost' END AS status FROM (SELECT DISTINCT user_id AS tag FROM events WHERE event_type = 'view') a FULL JOIN (SELECT DISTINCT user_id AS tag FROM events WHERE event_type = 'purchase' AND value > 90) b ON a.tag = b.tag FULL JOIN (SELECT DISTINCT user_id AS tag FROM events WHERE event_type = 'error' AND value > 80) c ON coalesce(a.tag, b.tag) = c.tag")
def reconciliation(t):
    """Three sources of tags reconciled in one aggregate instead of full outer joins."""
    kind = F.when(F.col("event_type") == "view", 1).when((F.col("event_type") == "purchase") & (F.col("value") > 90), 2).when((F.col("event_type") == "error") & (F.col("value") > 80), 3)
    g = t("events").select(F.col("user_id").alias("tag"), kind.alias("k")).filter("k is not null").groupBy("tag").agg(F.collect_set("k").alias("ks"))
    return g.select("tag", F.when(F.array_contains("ks", 2), "done").when(F.array_contains("ks", 3), "pending").otherwise("lost").alias("status"))


@query("WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS planned, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS seen FROM conversations) SELECT conv_id, count_if(planned <> seen) AS mismatches FROM p GROUP BY conv_id")
def order_verification(t):
    """A planned order against an observed one, position by position."""
    by = Window.partitionBy("conv_id")
    p = t("conversations").select("conv_id", F.row_number().over(by.orderBy("turn")).alias("planned"), F.row_number().over(by.orderBy(F.length("text"), "turn")).alias("seen"))
    return p.groupBy("conv_id").agg(F.count_if(F.col("planned") != F.col("seen")).alias("mismatches"))


@query("WITH l AS (SELECT conv_id, turn, len(string_split_regex(trim(text), '\\s+')) AS n, role FROM conversations) SELECT conv_id, sum(n)::BIGINT AS tokens, sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END)::BIGINT AS supervised, max(n) * count(*) - sum(n)::BIGINT AS padding FROM l GROUP BY conv_id")
def supervision_masking(t):
    """Labels of -100 outside the assistant's turns, and padding to the group's longest row."""
    n = F.size(F.split(F.trim("text"), r"\s+"))
    labels = F.when(F.col("role") == "assistant", F.sequence(F.lit(1), n)).otherwise(F.array_repeat(F.lit(-100), n))
    rows = t("conversations").select("conv_id", labels.alias("labels"), n.alias("n"))
    return rows.groupBy("conv_id").agg(F.sum("n").alias("tokens"), F.sum(F.size(F.filter("labels", lambda x: x != -100))).alias("supervised"), (F.max("n") * F.count(F.lit(1)) - F.sum("n")).alias("padding"))


@query("SELECT user_id, count(*) AS n, round(max(value), 6) AS best FROM events GROUP BY user_id")
def resume_incremental(t):
    """Events read as a stream into a final state with available-now triggers (see streaming.resume)."""
    from ..streaming.resume import final_state

    return final_state(t("events"))
