"""Parsing, formulation keys, selection, quotas, pivots and multi-arm comparisons."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import algebra, draws, exact, parsing, text
from ..operators import core
from ._registry import query


FOLDS = (
    ("1 * x + {n}", "x + {n}"),
    ("2*0 + x*{n}", "2 * 0 + x * {n}"),
    ("x**2 - 0*y + {n}", "x ** 2 - 0 * y + {n}"),
    ("1-(1-a)*b**{n}", "1 - (1 - a) * b ** {n}"),
    ("3-1-(1-x)+{n}", "3 - 1 - (1 - x) + {n}"),
    ("2*(a**1+b)*{n}", "2 * (a + b) * {n}"),
    ("1-(1-({n}/60))+y**0-0", "{n} / 60 + 1"),
    ("comb({n},1)*p+comb({n},0)", "{n} * p + 1"),
    ("(0+x)*(1-(1-(1-(1-{n}))))", "x * {n}"),
    ("x +", None),
)


@query("SELECT p_partkey, CASE p_partkey % 10 " + " ".join(f"WHEN {k} THEN " + ("NULL" if b is None else "replace('" + b + "', '{n}', CAST(p_size + 1 AS VARCHAR))") for k, (_, b) in enumerate(FOLDS)) + " END AS folded FROM part")
def folded_forms(t):
    """Identities folded on the tree: what only looks like one (a product with nought, a complement times b) stays."""
    raw = F.replace(F.element_at(F.array(*[F.lit(a) for a, _ in FOLDS]), (F.col("p_partkey") % 10 + 1).cast("int")), F.lit("{n}"), (F.col("p_size") + 1).cast("string"))
    return core.spread(t("part")).select("p_partkey", algebra.folded_column(raw).getField("text").alias("folded"))


@query("SELECT p_partkey, concat(p_size + 1, ' red, ', p_size, ' blue, 1.5 kg') AS swapped FROM part")
def simultaneous_numbers(t):
    """Numbers exchanged at once: no replacement is replaced again."""
    a, b = F.col("p_size").cast("string"), (F.col("p_size") + 1).cast("string")
    return core.spread(t("part")).select("p_partkey", parsing.replace_numbers_column(F.concat(a, F.lit(" red, "), b, F.lit(" blue, 1.5 kg")), F.array(a, b), F.array(b, a)).getField("text").alias("swapped"))


@query("SELECT concat_ws('|', kind, least(l_discount, l_tax), greatest(l_discount, l_tax)) AS task, count(*) AS n, count(DISTINCT l_returnflag) AS owners FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 'both' ELSE 'neither' END AS kind FROM lineitem) GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def semantic_tasks(t):
    """Tasks keyed without regard to the order of symmetric arguments; those that several splits own."""
    kind = F.when(F.col("l_linenumber") % 2 == 0, "both").otherwise("neither")
    key = F.concat_ws("|", kind, F.array_join(F.transform(F.array_sort(F.array("l_discount", "l_tax")), lambda x: x.cast("string")), "|"))
    return t("lineitem").groupBy(key.alias("task")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_returnflag").alias("owners")).filter("owners > 1")


@query("SELECT lang, doc_id, source FROM (SELECT lang, doc_id, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS cell, dense_rank() OVER (PARTITION BY lang ORDER BY source) AS story FROM documents) WHERE cell <= 2 AND story <= 4")
def first_per_cell(t):
    """Two rows of each of the first four groups in a category."""
    d = t("documents").select("lang", "doc_id", "source")
    stories = d.select("lang", "source").distinct().withColumn("story", F.row_number().over(Window.partitionBy("lang").orderBy("source"))).filter("story <= 4")
    cell = d.withColumn("cell", F.row_number().over(Window.partitionBy("lang", "source").orderBy("doc_id"))).filter("cell <= 2")
    return cell.join(stories, ["lang", "source"]).select("lang", "doc_id", "source")


@query("WITH u AS (SELECT doc_id, lang, source, 1 AS pool FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, lang, concat(source, '-new'), 2 FROM documents WHERE doc_id % 3 = 0), d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pool DESC) AS r FROM u), q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM d WHERE r = 1) SELECT lang, doc_id, source, rn FROM q WHERE rn <= 24")
def quota_later_wins(t):
    """A quota from pools of which the later one wins on the same id."""
    d = t("documents").select("doc_id", "lang", "source")
    u = d.filter("doc_id % 2 = 0").withColumn("pool", F.lit(1)).unionByName(d.filter("doc_id % 3 = 0").withColumn("source", F.concat("source", F.lit("-new"))).withColumn("pool", F.lit(2)))
    best = u.groupBy("doc_id").agg(F.max_by(F.struct("lang", "source"), "pool").alias("x")).select("doc_id", "x.*")
    return best.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).filter("rn <= 24").select("lang", "doc_id", "source", "rn")


@query("SELECT a.doc_id AS item, b.doc_id AS partner FROM documents a JOIN documents b ON b.source = concat('src', (CAST(substr(a.source, 4) AS INT) + 1) % 20) AND b.doc_id // 20 = a.doc_id // 20")
def sibling_pairs(t):
    """Each item with the one of the next family in its block."""
    d = t("documents").select("doc_id", F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("family"), F.floor(F.col("doc_id") / 20).alias("block"))
    return d.select(F.col("doc_id").alias("item"), "block", F.pmod(F.col("family") + 1, F.lit(20)).alias("family")).join(d.withColumnRenamed("doc_id", "partner"), ["block", "family"]).select("item", "partner")


@query("WITH p AS (SELECT item_id // 3 AS pair_id, CASE item_id % 3 WHEN 0 THEN 'original' WHEN 1 THEN 'paraphrase' ELSE 'magnitude' END AS variant, length(text) > 200 AS ok FROM benchmark) SELECT pair_id, bool_or(ok) FILTER (variant = 'original') AS original, bool_or(ok) FILTER (variant = 'paraphrase') AS paraphrase, bool_or(ok) FILTER (variant = 'magnitude') AS magnitude FROM p GROUP BY pair_id")
def variant_triples(t):
    """Three variants of each pair in one row."""
    p = t("benchmark").select(F.floor(F.col("item_id") / 3).alias("pair_id"), F.element_at(F.array(*map(F.lit, ("original", "paraphrase", "magnitude"))), (F.col("item_id") % 3 + 1).cast("int")).alias("variant"), (F.length("text") > 200).alias("ok"))
    return p.groupBy("pair_id").pivot("variant", ["original", "paraphrase", "magnitude"]).agg(F.bool_or("ok"))


@query("WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS slot FROM labels WHERE quality = 1), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS slot FROM labels WHERE quality = 1) SELECT slot, a.doc_id AS left_id, b.doc_id AS right_id FROM a JOIN b USING (slot)")
def positional_zip(t):
    """Two arms zipped by position."""
    d = t("labels").filter("quality = 1").select("doc_id")
    a = core.numbered(d, ["doc_id"], "slot").withColumnRenamed("doc_id", "left_id")
    b = core.numbered(d, [F.desc("doc_id")], "slot").withColumnRenamed("doc_id", "right_id")
    return a.join(b, "slot")


@query("SELECT o_orderpriority AS archetype, count(*) AS planned, count(l.ok) AS attempted, count_if(coalesce(l.ok, FALSE)) AS accepted, count_if(coalesce(l.ok, FALSE)) >= ceil(0.8 * count(*)) AS enough FROM orders LEFT JOIN (SELECT l_orderkey, bool_and(l_quantity > 2) AS ok FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey GROUP BY 1")
def acceptance_report(t):
    """Planned against accepted; an archetype needs four fifths."""
    l = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.every(F.col("l_quantity") > 2).alias("ok"))  # noqa: E741
    j = t("orders").select("o_orderkey", F.col("o_orderpriority").alias("archetype")).join(l, "o_orderkey", "left")
    good = F.count_if(F.coalesce("ok", F.lit(False)))
    return j.groupBy("archetype").agg(F.count(F.lit(1)).alias("planned"), F.count("ok").alias("attempted"), good.alias("accepted"), (good >= F.ceil(0.8 * F.count(F.lit(1)))).alias("enough"))


@query("SELECT source, CASE WHEN regexp_matches(text, '\\|') THEN 'table' WHEN regexp_matches(text, '[!]{2}') THEN 'shouting' WHEN regexp_matches(text, '[%$&#*]{3}') THEN 'junk' ELSE 'prose' END AS shape, count(*) AS n FROM documents GROUP BY 1, 2")
def shape_ledger(t):
    """A cascade of patterns: the first that fits names the row."""
    x = F.col("text")
    shape = F.when(x.rlike(r"\|"), "table").when(x.rlike("[!]{2}"), "shouting").when(x.rlike(r"[%$&#*]{3}"), "junk").otherwise("prose")
    return t("documents").groupBy("source", shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT letter, count(*) AS n, count(*) = (SELECT count(*) FROM part) / 4 AS balanced FROM (SELECT 'ABCD'[CAST(p_partkey % 4 + 1 AS BIGINT)] AS letter FROM part) GROUP BY letter")
def letter_balance(t):
    p = t("part")
    total = p.agg((F.count(F.lit(1)) / 4).alias("quota"))
    return p.groupBy(F.substring(F.lit("ABCD"), (F.col("p_partkey") % 4 + 1).cast("int"), F.lit(1)).alias("letter")).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).select("letter", "n", (F.col("n") == F.col("quota")).alias("balanced"))  # one row


@query("WITH a AS (SELECT event_type AS family, user_id, max(CASE WHEN event_id % 2 = 0 THEN CAST(value > 50 AS INT) END) AS a, max(CASE WHEN event_id % 2 = 1 THEN CAST(value > 50 AS INT) END) AS b FROM events GROUP BY 1, 2) SELECT family, concat('A', a, '_B', b) AS flip, count(*) AS n FROM a WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2")
def arm_flips(t):
    """Paired flips of two arms by family."""
    ok = (F.col("value") > 50).cast("int")
    arms = t("events").groupBy(F.col("event_type").alias("family"), "user_id").agg(F.max(F.when(F.col("event_id") % 2 == 0, ok)).alias("a"), F.max(F.when(F.col("event_id") % 2 == 1, ok)).alias("b")).dropna()
    return arms.groupBy("family", F.concat(F.lit("A"), F.col("a").cast("string"), F.lit("_B"), F.col("b").cast("string")).alias("flip")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH m AS (SELECT l_returnflag AS category, l_quantity > 10 AS base, l_quantity > 20 AS mid, l_quantity > 5 AS big FROM lineitem) SELECT category, round(avg(base::INT), 9) AS base, round(avg(mid::INT), 9) AS mid, round(avg(big::INT), 9) AS big, count_if(NOT base AND big) AS wrong_right, count_if(base AND NOT mid) AS right_wrong, count_if(base = mid) AS same FROM m GROUP BY category")
def three_models(t):
    q = F.col("l_quantity")
    base, mid, big = q > 10, q > 20, q > 5
    return t("lineitem").groupBy(F.col("l_returnflag").alias("category")).agg(*[F.round(F.avg(c.cast("int")), 9).alias(n) for c, n in ((base, "base"), (mid, "mid"), (big, "big"))], F.count_if(~base & big).alias("wrong_right"), F.count_if(base & ~mid).alias("right_wrong"), F.count_if(base == mid).alias("same"))


@query("WITH e AS (SELECT user_id % 3 AS run, CAST(event_id // 1000 AS BIGINT) AS epoch, count_if(value > 50) AS n, round(avg(value), 6) AS score FROM events GROUP BY 1, 2) SELECT run, arg_max(epoch, (n, score, -epoch)) AS best_epoch, coalesce(min(CASE WHEN n >= 200 THEN epoch END), max(epoch)) AS first_passing FROM e GROUP BY run")
def select_epoch(t):
    """The best epoch with tie-breaks, and the first that passes or else the last."""
    e = t("events").groupBy((F.col("user_id") % 3).alias("run"), F.floor(F.col("event_id") / 1000).alias("epoch")).agg(F.count_if(F.col("value") > 50).alias("n"), F.round(F.avg("value"), 6).alias("score"))
    return e.groupBy("run").agg(F.max_by("epoch", F.struct("n", "score", -F.col("epoch"))).alias("best_epoch"), F.coalesce(F.min(F.when(F.col("n") >= 200, F.col("epoch"))), F.max("epoch")).alias("first_passing"))


@query("SELECT p_partkey, unnest([1, 10, 100]) AS factor, p_size * unnest([1, 10, 100]) AS magnitude, concat('Take ', p_size * unnest([1, 10, 100]), ' ', p_name) AS question FROM part")
def magnitude_probes(t):
    """Each question at three magnitudes."""
    p = t("part").select("p_partkey", "p_name", "p_size", F.explode(F.array(F.lit(1), F.lit(10), F.lit(100))).alias("factor"))
    m = F.col("p_size") * F.col("factor")
    return p.select("p_partkey", "factor", m.alias("magnitude"), F.concat(F.lit("Take "), m.cast("string"), F.lit(" "), F.col("p_name")).alias("question"))


RULES = {"bulk": "Many large lines: ship as one.", "returned": "Something came back: review.", "plain": "Ship as ordered."}
RULES_SHA = hashlib.sha256("\n".join(f"{k}={v}" for k, v in sorted(RULES.items())).encode()).hexdigest()


@query("WITH g AS (SELECT l_orderkey, CASE WHEN count(*) > 3 AND sum(l_quantity) > 100 THEN 'bulk' WHEN bool_or(l_returnflag = 'R') THEN 'returned' ELSE 'plain' END AS rule FROM lineitem GROUP BY l_orderkey), r AS (SELECT unnest(['bulk', 'returned', 'plain']) AS rule, unnest(['Many large lines: ship as one.', 'Something came back: review.', 'Ship as ordered.']) AS rule_text), a AS (SELECT sha256(string_agg(concat(rule, '=', rule_text), chr(10) ORDER BY rule)) AS h FROM r) SELECT l_orderkey, rule, rule_text, h AS approved FROM g JOIN r USING (rule), a")
def rule_dimension(t):
    """A derived key for each group joined with a dimension of rule texts whose approval digest must agree."""
    g = t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"), F.bool_or(F.col("l_returnflag") == "R").alias("r"))
    rule = F.when((F.col("n") > 3) & (F.col("q") > 100), "bulk").when(F.col("r"), "returned").otherwise("plain")
    return core.with_rules(g.select("l_orderkey", rule.alias("rule")), "rule", RULES, RULES_SHA)


@query(draws.bootstrap_sql("SELECT 'all' AS g, sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END - quality)::BIGINT AS x FROM labels JOIN documents USING (doc_id) GROUP BY source", "cluster", 2_000))
def cluster_bootstrap(t):
    """Whole clusters resampled."""
    s = t("labels").join(t("documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum(F.when(F.col("toxic") == 0, 1).otherwise(0) - F.col("quality")).alias("change"))
    return core.bootstrap_interval(s.select(F.lit("all").alias("g"), "change"), "change", "g", 2_000, "cluster")


@query("SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN concat('Last ', doc_id, '. First. Second.') ELSE 'One only.' END AS moved FROM documents")
def surface_form(t):
    """The last sentence moved to the front."""
    raw = F.when(F.col("doc_id") % 2 == 0, F.format_string("First. Second. Last %d.", "doc_id")).otherwise("One only.")
    return t("documents").select("doc_id", text.substring_after_last_sentence(raw).alias("moved"))


@query("SELECT e.user_id, count(*) AS pending FROM events e WHERE e.user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 60) GROUP BY 1")
def resume_pending(t):
    """What a resumed run still has to do."""
    from ..streaming.resume import new_rows

    done = t("events").filter("event_type = 'signup' and value > 60").select("user_id").distinct()
    return new_rows(t("events"), done, "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("pending"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS same FROM part")
def identity_evidence(t):
    """Equivalent forms agree at all points, others do not, and what cannot be evaluated stays open."""
    k = F.col("p_partkey") % 3
    left = F.format_string("1-(1-p)*(1-q)+%d", "p_size")
    right = F.when(k == 0, F.format_string("p+q-p*q+%d", "p_size")).when(k == 1, F.format_string("p+q+%d", "p_size")).otherwise(F.lit("p+"))
    return core.spread(t("part")).select("p_partkey", exact.identical_column(left, right).getField("same").alias("same"))
