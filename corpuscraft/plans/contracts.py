"""Gates against baselines, release conditions, digests of records and artifacts, ledgers with caps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import canonical, domain, parsing, text
from ..operators import contracts, core, generate, merkle
from ._registry import query

SUITES = "s AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'old' WHEN '2-HIGH' THEN 'chain' ELSE 'event' END AS suite, concat('k', o_custkey % 4) AS category, year(o_orderdate) % 2 = 0 AS base, o_orderstatus = 'F' AS correct, o_totalprice < 1200 AS pending, o_orderkey % 3 + 1 AS depth FROM orders)"
COUNTS = "c AS (SELECT suite, category, count_if(base AND correct) AS b, count_if(base) AS bn, count_if(NOT base AND correct) AS k, count_if(NOT base) AS kn, count_if(NOT base AND pending) AS p, count_if(base AND correct AND depth = 3) AS b3, count_if(NOT base AND correct AND depth = 3) AS k3 FROM s GROUP BY ALL)"


def runs(t):
    """suite, category, depth, base (the earlier run), correct, pending."""
    suite = F.when(F.col("o_orderpriority") == "1-URGENT", "old").when(F.col("o_orderpriority") == "2-HIGH", "chain").otherwise("event")
    return t("orders").select(suite.alias("suite"), F.concat(F.lit("k"), (F.col("o_custkey") % 4).cast("string")).alias("category"), (F.year("o_orderdate") % 2 == 0).alias("base"), (F.col("o_orderstatus") == "F").alias("correct"), (F.col("o_totalprice") < 1200).alias("pending"), (F.col("o_orderkey") % 3 + 1).alias("depth"))


def two_runs(t):
    rows = runs(t)
    return contracts.suite_counts(rows.filter("not base")), contracts.suite_counts(rows.filter("base"))


@query(f"WITH {SUITES}, {COUNTS}, x AS (SELECT 'no_pending' AS \"check\", sum(p) = 0 AS ok FROM c UNION ALL SELECT concat(suite, ':total'), sum(k) >= greatest(0, sum(b) - 20) FROM c WHERE suite <> 'event' GROUP BY suite UNION ALL SELECT concat(suite, ':', category), k >= greatest(0, b - 8) FROM c WHERE suite <> 'event' UNION ALL SELECT concat(suite, ':', category, ':depth3'), k3 >= b3 FROM c WHERE suite = 'chain' UNION ALL SELECT 'event:total', sum(k) >= 400 FROM c WHERE suite = 'event' UNION ALL SELECT concat('event:', category), k >= 100 FROM c WHERE suite = 'event') SELECT \"check\", ok FROM x")
def validation_gate(t):
    """A candidate against its baseline: allowed losses in all and by category, no loss at depth three, floors for events."""
    candidate, baseline = two_runs(t)
    return contracts.validation_gate(candidate, baseline, {"old": (20, 8), "chain": (20, 8)}, deep="chain", floors=("event", 400, 100))


@query(f"WITH {SUITES}, {COUNTS}, e AS (SELECT sum(k) AS k, sum(b) AS b, sum(kn) AS n, sum(CASE WHEN category = 'k1' THEN k END) AS k1, sum(CASE WHEN category = 'k1' THEN b END) AS b1, sum(CASE WHEN category = 'k1' THEN kn END) AS n1 FROM c WHERE suite = 'event'), x AS (SELECT concat(suite, ':total') AS \"check\", sum(k) >= sum(b) - 20 AS ok FROM c WHERE suite <> 'event' GROUP BY suite UNION ALL SELECT concat(suite, ':', category), k >= b - 8 FROM c WHERE suite <> 'event' UNION ALL SELECT 'event:absolute', k >= 400 FROM e UNION ALL SELECT 'event:gain', k >= b + 8 FROM e UNION ALL SELECT 'k1:absolute', k1 >= 90 FROM e UNION ALL SELECT 'k1:gain', k1 >= b1 + 4 FROM e) SELECT count(*) AS n_checks, count_if(NOT ok) AS n_failed, bool_and(ok) AS passed, (SELECT b + 8 <= n AND b1 + 4 <= n1 FROM e) AS attainable FROM x")
def promotion_gate(t):
    """Retention, absolute floors and gains of one suite and one of its categories; whether the gains could be reached at all."""
    candidate, baseline = two_runs(t)
    return contracts.promotion(candidate, baseline, {"old": (20, 8), "chain": (20, 8)}, target="event", category="k1", least=(400, 8), category_least=(90, 4))


CONDITIONS = {
    "calls": "count(*) <= 100000000", "categories": "count(DISTINCT event_type) = 5", "complete": "least(count_if(event_type = 'view'), count_if(event_type = 'click'), count_if(event_type = 'purchase'), count_if(event_type = 'error'), count_if(event_type = 'signup')) * 6 >= count(*)",
    "cost": "sum(value) <= 1e12", "costs_known": "count_if(value IS NULL) = 0", "leakage": "count_if(props LIKE '%blind%') = 0", "pending": "count_if(event_type = 'error' AND value > 90) = 0", "provenance": "count_if(user_id IS NULL OR ts IS NULL) = 0",
    "provider": "count_if(event_type IS NULL OR event_type = '') = 0", "running": "max(ts) > min(ts)", "usable": "count_if(event_type = 'purchase' AND value IS NOT NULL) > 0",
}


@query(f"SELECT count(*) AS n_conditions, count_if(NOT ok) AS n_failed, bool_and(ok) AS released, string_agg(CASE WHEN NOT ok THEN name END, ',' ORDER BY name) AS failing FROM (SELECT unnest([{', '.join(map(repr, CONDITIONS))}]) AS name, unnest([{', '.join(f'coalesce({c}, FALSE)' for c in CONDITIONS.values())}]) AS ok FROM events)")
def release_conditions(t):
    """A release needs all of its eleven conditions: usable rows, none pending, calls and cost within caps, no cost missing, rows that
    trace back, every category there and full, a provider named, no leakage, nothing that stopped it. Those that fail are listed."""
    return contracts.release(t("events"), {name: F.expr(c) for name, c in CONDITIONS.items()})


@query("WITH g AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.08 THEN NULL ELSE l_discount > 0.02 END AS math, l_tax < 0.07 AS exe FROM lineitem) SELECT l_orderkey, string_agg(CASE WHEN coalesce(math, FALSE) AND exe THEN '1' ELSE '0' END, '' ORDER BY l_linenumber, coalesce(math, FALSE) AND exe, exe) AS credit, string_agg(CASE WHEN exe THEN '1' ELSE '0' END, '' ORDER BY l_linenumber, coalesce(math, FALSE) AND exe, exe) AS format FROM g GROUP BY l_orderkey")
def promotion_vectors(t):
    """Credit (correct and executable, null is no credit) and format flags of each run in row order."""
    math = F.when(F.col("l_discount") > 0.08, F.lit(None)).otherwise(F.col("l_discount") > 0.02)
    rows = t("lineitem").select("l_orderkey", "l_linenumber", math.alias("math_correct"), (F.col("l_tax") < 0.07).alias("executable"))
    return contracts.vectors(rows, "l_orderkey", "l_linenumber", {"credit": F.coalesce(F.col("math_correct"), F.lit(False)) & F.col("executable"), "format": F.col("executable")})


@query("SELECT name, prior IS NOT DISTINCT FROM now AS frozen FROM (SELECT unnest(['protocol', 'seed', 'grader', 'rows']) AS name, unnest(['v3', '41', 'g1', NULL]) AS prior, unnest(['v3', '42', 'g1', CAST(count(*) AS VARCHAR)]) AS now FROM documents)")
def frozen_decisions(t):
    """A frozen protocol against the present one, setting by setting; anything missing has drifted."""
    now = t("documents").agg(F.count(F.lit(1)).cast("string").alias("rows")).select(F.create_map(F.lit("protocol"), F.lit("v3"), F.lit("seed"), F.lit("42"), F.lit("grader"), F.lit("g1"), F.lit("rows"), F.col("rows")).alias("now"))
    return contracts.drift(now, {"protocol": "v3", "seed": "41", "grader": "g1"})


@query("WITH v AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'train' ELSE 'validation' END AS split FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'train' FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id + 100000000, 'train' FROM labels WHERE doc_id % 50 = 0), d AS (SELECT v.doc_id, v.split, d.doc_id IS NOT NULL AS known, CASE WHEN v.doc_id % 4 = 0 THEN 'train' ELSE CASE WHEN v.doc_id % 3 = 0 THEN 'train' ELSE 'validation' END END AS home, count(*) OVER (PARTITION BY v.doc_id) AS n FROM v LEFT JOIN documents d USING (doc_id)) SELECT violation, count(*) AS n FROM (SELECT CASE WHEN NOT known THEN 'unknown' WHEN n > 1 THEN 'duplicate' WHEN split <> home THEN 'split' END AS violation FROM d) WHERE violation IS NOT NULL GROUP BY violation UNION ALL SELECT concat('cap:', split), count(*) FROM v WHERE split = 'train' GROUP BY split HAVING count(*) > 30")
def verified_rows(t):
    """Rows of a verified corpus: known, unique, in their own split, within the split's cap. Violations are counted by kind."""
    l, third = t("labels"), F.when(F.col("doc_id") % 3 == 0, "train").otherwise("validation")  # noqa: E741
    rows = l.filter("quality = 1").select("doc_id", third.alias("split")).unionByName(l.filter("toxic = 1").select("doc_id", F.lit("train").alias("split"))).unionByName(l.filter("doc_id % 50 = 0").select((F.col("doc_id") + 100000000).alias("doc_id"), F.lit("train").alias("split")))
    home = t("documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "train").otherwise(third).alias("home"))
    return contracts.verified_violations(rows, home, "doc_id", {"train": 30})


@query("WITH chosen AS (SELECT p_partkey AS ord, p_brand AS category, concat(p_brand, '|', p_size) AS task FROM part WHERE p_partkey % 10 = 0), blocked AS (SELECT DISTINCT concat(p_brand, '|', p_size) AS task FROM part WHERE p_partkey % 10 = 1), reserve AS (SELECT p_partkey AS ord, p_brand AS category, concat(p_brand, '|', p_size) AS task FROM part WHERE p_partkey % 10 = 2), need AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ord) AS slot FROM chosen WHERE task IN (SELECT task FROM blocked)), spare AS (SELECT category, task, min(ord) AS ord FROM reserve WHERE task NOT IN (SELECT task FROM blocked) AND task NOT IN (SELECT task FROM chosen) GROUP BY ALL), give AS (SELECT category, task AS replaced_by, row_number() OVER (PARTITION BY category ORDER BY ord) AS slot FROM spare) SELECT ord, category, task, replaced_by FROM need LEFT JOIN give USING (category, slot) UNION ALL SELECT ord, category, task, NULL FROM chosen WHERE task NOT IN (SELECT task FROM blocked)")
def selection_replacements(t):
    """Chosen rows whose task is blocked, replaced by the first unused reserve rows of their category, each used once."""
    rows = lambda r: t("part").filter(f"p_partkey % 10 = {r}").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("category"), F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).alias("task"))
    return generate.replacements(rows(0), rows(1), rows(2), "task", "category", "ord")


# -- digests
def dialect_sql(name: str, colon: str, comma: str, accent: str, start: str = "'{'", end: str = "'}'") -> str:
    field = lambda key, value: f"'\"{key}\"{colon}', {value}"
    return f"sha256(concat({start}, {field('doc_id', 'doc_id')}, {comma}, {field('lang', chr(39) + chr(34) + chr(39))}, lang, '{accent}\"', {comma}, {field('n', 'n_chars')}, {end})) AS {name}"


PLAIN, ESCAPED, NEXT = "é", "\\u00e9", "',', chr(10), ' '"


@query("SELECT doc_id, " + ", ".join([dialect_sql("compact", ":", "','", PLAIN), dialect_sql("compact_ascii", ":", "','", ESCAPED), dialect_sql("spaced", ": ", "', '", PLAIN), dialect_sql("spaced_ascii", ": ", "', '", ESCAPED), dialect_sql("lines", ": ", NEXT, ESCAPED, "'{', chr(10), ' '", "chr(10), '}'")]) + " FROM documents")
def canonical_digests(t):
    """Records digested as canonical JSON in all five dialects, whatever the order and spacing they come in."""
    raw = F.format_string('{ "n":%d, "lang" : "%sé","doc_id":%d}', "n_chars", "lang", "doc_id")
    x = t("documents").select("doc_id", canonical.digests_column(raw).alias("x"))
    return x.select("doc_id", *[f"x.{d}" for d in canonical.DIALECTS])


@query("WITH r AS (SELECT doc_id, sha256(concat('{\"doc_id\":', doc_id, ',\"lang\":\"', lang, '\"}')) AS h FROM documents) SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN 'drifted' WHEN doc_id % 7 = 2 THEN 'missing' ELSE 'valid' END AS state, h AS record_sha FROM r")
def record_hashes(t):
    """Records that carry their own digest, computed again without it. One in seven has been changed since, one has lost it."""
    d = t("documents").select("doc_id", "lang", F.sha2(canonical.record("doc_id", "lang"), 256).alias("h"))
    k = F.col("doc_id") % 7
    raw = F.when(k == 1, F.format_string('{"lang":"%s!","record_sha":"%s","doc_id":%d}', "lang", "h", "doc_id")).when(k == 2, F.format_string('{"lang":"%s","doc_id":%d}', "lang", "doc_id")).otherwise(F.format_string('{"lang":"%s","record_sha":"%s","doc_id":%d}', "lang", "h", "doc_id"))
    return contracts.self_hashes(d.select("doc_id", raw.alias("record"), "h"), "record", "record_sha").select("doc_id", "state", F.col("h").alias("record_sha"))


@query("WITH q AS (SELECT item_id AS id, sha256(text) AS question_sha FROM benchmark), c AS (SELECT item_id AS id, CASE WHEN item_id % 5 = 1 THEN sha256('x') ELSE sha256(text) END AS question_sha, sha256(concat('r', item_id)) AS raw_sha, CASE WHEN item_id % 5 = 2 THEN concat('R', item_id) ELSE concat('r', item_id) END AS raw, CASE WHEN item_id % 5 = 3 THEN 'g0' ELSE 'g1' END AS grader FROM benchmark WHERE item_id % 6 <> 0) SELECT q.id, CASE WHEN c.id IS NULL THEN 'uncached' WHEN c.question_sha <> q.question_sha THEN 'question' WHEN sha256(c.raw) <> c.raw_sha THEN 'raw' WHEN c.grader <> 'g1' THEN 'grader' ELSE 'valid' END AS state FROM q LEFT JOIN c USING (id)")
def cache_validity(t):
    """Cached answers stand only while question, raw answer and grader are those they were made with."""
    b, k = t("benchmark"), F.col("item_id") % 5
    now = b.select(F.col("item_id").alias("id"), F.sha2("text", 256).alias("question_sha"))
    raw = F.concat(F.lit("r"), F.col("item_id").cast("string"))
    cached = b.filter("item_id % 6 <> 0").select(F.col("item_id").alias("id"), F.when(k == 1, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("text", 256)).alias("question_sha"), F.when(k == 2, F.upper(raw)).otherwise(raw).alias("raw"), F.sha2(raw, 256).alias("raw_sha"), F.when(k == 3, "g0").otherwise("g1").alias("grader"))
    return contracts.cache_state(now, cached, "id", "g1")


FILES = "SELECT lang, sum(n_chars) AS bytes, concat(lang, '/', lpad(CAST(doc_id // 64 AS VARCHAR), 9, '0')) AS path, sha256(string_agg(sha256(text), ',' ORDER BY doc_id)) AS h FROM documents GROUP BY lang, doc_id // 64"
LEAVES = f"SELECT lang AS g, path AS o, concat(path, ':', h) AS x FROM ({FILES})"


def files(t):
    """lang, path, bytes, sha256: documents in files of 64 ids."""
    leaf = t("documents").groupBy("lang", F.floor(F.col("doc_id") / 64).alias("b")).agg(F.sum("n_chars").alias("bytes"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.sha2("text", 256).alias("h")))), lambda x: x["h"]), ","), 256).alias("sha256"))
    return leaf.select("lang", F.concat_ws("/", "lang", F.lpad(F.col("b").cast("string"), 9, "0")).alias("path"), "bytes", "sha256")


@query(f"SELECT g AS lang, n AS files, bytes::BIGINT AS bytes, tree FROM ({merkle.roots_sql(LEAVES)}) JOIN (SELECT lang AS g, sum(bytes) AS bytes FROM ({FILES}) GROUP BY lang) USING (g)")
def evidence_tree(t):
    """A tree's digest from its files' digests in the order of their paths: a Merkle root for each language."""
    return contracts.tree_digest(files(t), ["lang"])


@query(f"SELECT lang, path, depth, TRUE AS holds, FALSE AS changed_holds FROM ({FILES}) JOIN ({merkle.roots_sql(LEAVES)}) ON g = lang")
def evidence_proofs(t):
    """Every file's proof of inclusion against its language's root, and the same proof for a changed file, which must fail."""
    tree = merkle.Tree(files(t), ["lang"], ["path"], F.concat_ws(":", "path", "sha256"))
    rows = tree.proofs().join(tree.roots, "lang")
    return rows.select("lang", "path", F.size("proof").alias("depth"), merkle.holds(F.col("digest"), F.col("proof"), F.col("tree")).alias("holds"), merkle.holds(merkle.leaf(F.concat("path", F.lit(":changed"))), F.col("proof"), F.col("tree")).alias("changed_holds"))


@query("SELECT 'benchmark' AS name, count(*) AS n, sha256(concat('{\"metrics\":{\"long\":', count_if(length(text) > 200), ',\"n\":', count(*), '},\"name\":\"benchmark\",\"version\":\"g1\"}')) AS manifest_sha FROM benchmark")
def baseline_manifest(t):
    """A manifest that binds a baseline's metrics to their context, by its digest; the grader's version is part of it."""
    m = t("benchmark").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") > 200).alias("long"))
    return contracts.bound_manifest(m, "benchmark", "g1", ["long", "n"]).select("name", "n", "manifest_sha")


@query("SELECT doc_id, quality AS raw, CASE WHEN toxic = 1 THEN 0 ELSE quality END AS corrected, toxic = 1 AND quality = 1 AS changed, sha256(concat_ws('|', 'labels', CAST(doc_id AS VARCHAR), CAST(quality AS VARCHAR))) AS source_sha FROM labels")
def row_provenance(t):
    """Raw and corrected values side by side, with the digest of the source."""
    corrected = F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality"))
    return t("labels").select("doc_id", F.col("quality").alias("raw"), corrected.alias("corrected"), (corrected != F.col("quality")).alias("changed"), F.sha2(F.concat_ws("|", F.lit("labels"), F.col("doc_id").cast("string"), F.col("quality").cast("string")), 256).alias("source_sha"))


# -- ledgers and state
@query("WITH e AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS call, sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS cost FROM events) SELECT user_id, event_id, call <= 40 AND cost + 5 <= 400 AS allowed, CASE WHEN call > 40 THEN 'calls' WHEN cost + 5 > 400 THEN 'cost' END AS blocked_by FROM e")
def ledger_caps(t):
    """Calls allowed while their number and the cost so far with a reserve stay within the caps."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    call = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    cost = F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)).over(w)
    rules = [("calls", call <= 40), ("cost", cost + 5 <= 400)]
    e = t("events").select("user_id", "event_id", text.first_failure(rules).alias("blocked_by"))
    return e.select("user_id", "event_id", F.col("blocked_by").isNull().alias("allowed"), "blocked_by")


@query("WITH a AS (SELECT c_custkey AS id, event_id, value > 60 AS ok, row_number() OVER (PARTITION BY c_custkey ORDER BY ts, event_id) AS attempt FROM customer LEFT JOIN events ON user_id = c_custkey) SELECT id, count(event_id) AS attempts, coalesce(bool_or(ok) FILTER (attempt <= 2), FALSE) AS accepted, count(event_id) >= 2 AND NOT coalesce(bool_or(ok) FILTER (attempt = 1), FALSE) AS retried, CASE WHEN count(event_id) = 0 THEN 'pending' WHEN bool_or(ok) FILTER (attempt <= 2) THEN 'accepted' WHEN count(event_id) < 2 THEN 'retry' ELSE 'exhausted' END AS state FROM a GROUP BY id")
def retry_rule(t):
    """At most two attempts an id, the second only after a failure; ids without attempts are pending."""
    a = t("events").withColumn("attempt", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).select(F.col("user_id").alias("id"), "attempt", (F.col("value") > 60).alias("ok"))
    return contracts.retry_states(t("customer").select(F.col("c_custkey").alias("id")), a, most=2)


@query("WITH e AS (SELECT event_type AS suite, CAST(event_id // 1000 AS BIGINT) AS epoch, avg(value) AS score FROM events GROUP BY 1, 2), m AS (SELECT suite, epoch, round(score, 6) >= 49 AS passed, lag(round(score, 6) >= 49) OVER (PARTITION BY suite ORDER BY epoch) AS before FROM e) SELECT suite, epoch, passed, passed AND coalesce(before, FALSE) AS mastered FROM m")
def mastery(t):
    """Mastered: two epochs in a row that pass."""
    e = t("events").groupBy(F.col("event_type").alias("suite"), F.floor(F.col("event_id") / 1000).alias("epoch")).agg((F.round(F.avg("value"), 6) >= 49).alias("passed"))
    before = F.lag("passed").over(Window.partitionBy("suite").orderBy("epoch"))
    return e.select("suite", "epoch", "passed", (F.col("passed") & F.coalesce(before, F.lit(False))).alias("mastered"))


# -- summaries
@query("SELECT event_type AS category, count_if(value > 80) AS accepted, count_if(value <= 80 AND value > 30) AS pending, count_if(value <= 30) AS rejected, count_if(value > 30) AS usable, count_if(value <= 80 AND value > 30) = 0 AS released FROM events GROUP BY 1")
def status_summary(t):
    """Status counts by category, pivoted over the known statuses; usable rows and whether all are settled."""
    status = F.when(F.col("value") > 80, "accepted").when(F.col("value") > 30, "pending").otherwise("rejected")
    p = t("events").select(F.col("event_type").alias("category"), status.alias("status")).groupBy("category").pivot("status", ["accepted", "pending", "rejected"]).agg(F.count(F.lit(1)))
    z = lambda c: F.coalesce(c, F.lit(0))
    return p.select("category", z("accepted").alias("accepted"), z("pending").alias("pending"), z("rejected").alias("rejected"), (z("accepted") + z("pending")).alias("usable"), (z("pending") == 0).alias("released"))


REGRADED = "SELECT user_id, arg_min(old_ok, attempt) AS first_ok, bool_or(old_ok) AS old_ok, bool_or(new_ok) AS new_ok, arg_min(event_type, attempt) AS kind FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, value > 50 AS old_ok, value > 45 AS new_ok, event_type FROM events) WHERE attempt <= 2 GROUP BY 1"


@query(f"SELECT kind, count(*) AS n, count_if(first_ok) AS first_accepted, count_if(old_ok) AS accepted, count_if(new_ok AND NOT old_ok) AS newly_credited, coalesce(string_agg(CASE WHEN new_ok AND NOT old_ok THEN CAST(user_id AS VARCHAR) END, ',' ORDER BY user_id), '') AS ids, any_value(tree) AS ids_sha FROM ({REGRADED}) LEFT JOIN ({merkle.roots_sql(f'SELECT kind AS g, user_id AS o, user_id::VARCHAR AS x FROM ({REGRADED}) WHERE new_ok AND NOT old_ok')}) r ON r.g = kind GROUP BY kind")
def regrade_audit(t):
    """First attempts and all attempts under the old grader, and what only the new one credits: its number, its ids in order and a
    Merkle root of them."""
    a = t("events").withColumn("attempt", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("attempt <= 2")
    f = a.groupBy("user_id").agg(F.min_by(F.col("value") > 50, "attempt").alias("first_ok"), F.bool_or(F.col("value") > 50).alias("old_ok"), F.bool_or(F.col("value") > 45).alias("new_ok"), F.min_by("event_type", "attempt").alias("kind"))
    new = F.col("new_ok") & ~F.col("old_ok")
    roots = merkle.Tree(f.filter(new).select("kind", "user_id"), ["kind"], ["user_id"], F.col("user_id").cast("string")).roots.select("kind", F.col("tree").alias("ids_sha"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(new, F.col("user_id")))), lambda x: x.cast("string")), ",")  # the row itself is this list
    g = f.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("first_ok").alias("first_accepted"), F.count_if("old_ok").alias("accepted"), F.count_if(new).alias("newly_credited"), ids.alias("ids"))
    return g.join(roots, "kind", "left")


@query("WITH r AS (SELECT conv_id, turn, role AS mode, length(text) AS n, sha256(text) AS raw FROM conversations), b AS (SELECT mode, count(*) AS n, count_if(n % 3 = 0) AS correct, count_if(n < 20) AS invalid, count_if(n > 300) AS limit_hit FROM r GROUP BY mode), m AS (SELECT a.mode, count(*) AS same_raw FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.turn + 2 = b.turn AND a.raw = b.raw GROUP BY a.mode) SELECT mode, n, correct, invalid, limit_hit, coalesce(same_raw, 0) AS reproduced FROM b LEFT JOIN m USING (mode)")
def mode_diagnostics(t):
    """Counts by mode with answers cut by the limit, and raw outputs reproduced two turns later."""
    r = t("conversations").select("conv_id", "turn", F.col("role").alias("mode"), F.length("text").alias("n"), F.sha2("text", 256).alias("raw"))
    b = r.groupBy("mode").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n") % 3 == 0).alias("correct"), F.count_if(F.col("n") < 20).alias("invalid"), F.count_if(F.col("n") > 300).alias("limit_hit"))
    later = r.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("raw").alias("later"))
    m = r.join(later, ["conv_id", "turn"]).filter("raw = later").groupBy("mode").agg(F.count(F.lit(1)).alias("reproduced"))
    return b.join(m, "mode", "left").select("mode", F.col("rows").alias("n"), "correct", "invalid", "limit_hit", F.coalesce("reproduced", F.lit(0)).alias("reproduced"))


@query("WITH r AS (SELECT CASE user_id % 2 WHEN 0 THEN 'base' ELSE 'tuned' END AS model, CASE WHEN event_id % 10 < 8 THEN 'test' ELSE 'validation' END AS split, event_type AS category, CASE WHEN value > 90 THEN NULL ELSE value > 50 END AS correct FROM events), m AS (SELECT * FROM r UNION ALL SELECT 'missing', 'test', 'view', NULL) SELECT model, split, category, count(*) AS n, count_if(coalesce(correct, FALSE)) AS correct, count_if(correct IS NULL) AS pending FROM m GROUP BY ALL")
def multi_model_summary(t):
    """Models by split and category, pending rows counted and not taken for wrong; a model without rows is appended as pending."""
    r = t("events").select(F.when(F.col("user_id") % 2 == 0, "base").otherwise("tuned").alias("model"), F.when(F.col("event_id") % 10 < 8, "test").otherwise("validation").alias("split"), F.col("event_type").alias("category"), F.when(F.col("value") > 90, F.lit(None)).otherwise(F.col("value") > 50).alias("correct"))
    missing = r.sparkSession.createDataFrame([("missing", "test", "view", None)], "model string, split string, category string, correct boolean")
    return r.unionByName(missing).groupBy("model", "split", "category").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("correct"), F.count_if(F.col("correct").isNull()).alias("pending"))


@query("WITH p AS (SELECT user_id % 3 AS run, event_type AS id, CAST(floor(value / 5) AS BIGINT) AS raw, CAST(event_id % 40 AS VARCHAR) AS file FROM events WHERE value > 95) SELECT run, id, raw, count(*) AS n, string_agg(DISTINCT file, ',' ORDER BY file) AS files FROM p GROUP BY ALL")
def pending_outputs(t):
    """Outputs awaiting review, once for each run, question and text, with the files that hold them."""
    p = t("events").filter("value > 95").select((F.col("user_id") % 3).alias("run"), F.col("event_type").alias("id"), F.floor(F.col("value") / 5).alias("raw"), (F.col("event_id") % 40).cast("string").alias("file"))
    return p.groupBy("run", "id", "raw").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("file")), ",").alias("files"))


@query("WITH q AS (SELECT item_id AS id, unnest([0, 1, 2, 3]) AS shift, length(text) AS n FROM benchmark), g AS (SELECT id, shift, (n + shift * id) % 5 AS pick, (id % 4 - shift + 8) % 4 AS gold FROM q) SELECT shift, 'ABCD'[CAST(gold AS BIGINT) + 1] AS gold, count(*) AS n, count_if(pick = gold) AS correct, count_if(pick = 4) AS invalid FROM g GROUP BY 1, 2")
def rotation_breakdown(t):
    """Rotated questions by shift and place of the right choice, invalid answers apart."""
    q = t("benchmark").select(F.col("item_id").alias("id"), F.length("text").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("shift"))
    pick = F.pmod(F.col("n") + F.col("shift") * F.col("id"), F.lit(5))
    gold = text.rotated_gold(F.col("id") % 4, F.col("shift"))
    letter = F.element_at(F.array(*map(F.lit, ("A", "B", "C", "D", "INVALID"))), (pick + 1).cast("int"))
    return q.select("shift", gold.alias("gold"), letter.alias("letter")).groupBy("shift", "gold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("letter") == F.col("gold")).alias("correct"), F.count_if(F.col("letter") == "INVALID").alias("invalid"))


@query("SELECT pick, count(*) AS n, count_if(pick = gold) AS correct, round(count_if(pick = gold) / count(*), 9) AS accuracy, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM (SELECT CASE length(text) % 5 WHEN 4 THEN 'INVALID' ELSE 'ABCD'[CAST(length(text) % 5 AS BIGINT) + 1] END AS pick, 'ABCD'[CAST(item_id % 4 AS BIGINT) + 1] AS gold FROM benchmark) GROUP BY pick")
def predicted_distribution(t):
    """What was predicted how often, and how often rightly, invalid answers among it."""
    letters = F.array(*map(F.lit, ("A", "B", "C", "D", "INVALID")))
    r = t("benchmark").select(F.element_at(letters, (F.length("text") % 5 + 1).cast("int")).alias("pick"), F.element_at(letters, (F.col("item_id") % 4 + 1).cast("int")).alias("gold"))
    counts = r.groupBy("pick").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pick") == F.col("gold")).alias("correct"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("pick", "n", "correct", F.round(core.rate(F.col("correct"), F.col("n")), 9).alias("accuracy"), F.round(core.rate(F.col("n"), F.col("total")), 9).alias("share"))  # one row


@query("WITH r AS (SELECT c_mktsegment AS category, substr(c_mktsegment, 1, 1) AS family, o_orderkey AS id, o_orderstatus = 'F' AS correct, o_orderstatus = 'P' AS pending, o_totalprice > 100000 AS strict FROM orders JOIN customer ON o_custkey = c_custkey) SELECT category, family, count(*) AS n, count_if(correct) AS n_correct, count_if(pending) AS n_pending, count_if(correct AND strict) AS n_strict, min(CASE WHEN NOT correct AND NOT pending THEN id END) AS first_failure, count_if(NOT correct AND NOT pending) AS failures FROM r GROUP BY GROUPING SETS ((category), (family), ())")
def strict_metrics(t):
    """Counts by category, by family and in all, strict ones apart, with the first failing id."""
    r = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("category")), "o_custkey")
    r = r.select("category", F.substring("category", 1, 1).alias("family"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("correct"), (F.col("o_orderstatus") == "P").alias("pending"), (F.col("o_totalprice") > 100000).alias("strict"))
    fails = ~F.col("correct") & ~F.col("pending")
    sets = [[F.col("category")], [F.col("family")], []]
    return r.groupingSets(sets, "category", "family").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("n_correct"), F.count_if("pending").alias("n_pending"), F.count_if(F.col("correct") & F.col("strict")).alias("n_strict"), F.min(F.when(fails, F.col("id"))).alias("first_failure"), F.count_if(fails).alias("failures"))


@query("WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS places, min(l_linenumber) AS low, max(l_linenumber) AS high, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS kinds, o_orderpriority AS family FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, o_orderpriority) SELECT family, count(*) AS groups, count_if(n <> CASE family WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 ELSE 3 END) AS wrong_size, count_if(places <> n OR low <> 1 OR high <> n) AS wrong_places, count_if(kinds <> 'A,N,R') AS missing_kinds FROM g GROUP BY family")
def contrast_groups(t):
    """Groups against the size their family expects, gapless places and the expected kinds."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("family")), "l_orderkey")
    return contracts.group_audit(rows, "l_orderkey", "family", "l_linenumber", "l_returnflag", {"1-URGENT": 5, "2-HIGH": 4}, 3, ["A", "N", "R"])


MOVES = "SELECT concat(CAST(value > 50 AS INT), '->', CAST(value > 40 AS INT)) AS transition, event_id FROM events"


@query(f"SELECT transition, count(*) AS n, any_value(tree) AS ids_sha, count_if(transition[1] = transition[4]) AS same_correctness FROM ({MOVES}) LEFT JOIN ({merkle.roots_sql(f'SELECT transition AS g, event_id AS o, event_id::VARCHAR AS x FROM ({MOVES}) WHERE transition[1] <> transition[4]')}) r ON r.g = transition GROUP BY transition")
def run_comparison(t):
    """Two runs joined on their ids: transitions, with a Merkle root of the ids of losses and gains."""
    e = t("events")
    a, b = e.select("user_id", "event_id", (F.col("value") > 50).alias("a")), e.select("user_id", "event_id", (F.col("value") > 40).alias("b"))
    moves = a.join(b, ["user_id", "event_id"]).select("event_id", F.concat_ws("->", F.col("a").cast("int").cast("string"), F.col("b").cast("int").cast("string")).alias("transition"), (F.col("a") == F.col("b")).alias("same"))
    ids = merkle.Tree(moves.filter("not same").select("transition", "event_id"), ["transition"], ["event_id"], F.col("event_id").cast("string")).roots.select("transition", F.col("tree").alias("ids_sha"))
    return moves.groupBy("transition").agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("same_correctness")).join(ids, "transition", "left")


@query("WITH r AS (SELECT conv_id, turn, length(text) % 40 + 1 AS n FROM conversations), m AS (SELECT conv_id, max(n) AS m FROM r GROUP BY conv_id) SELECT conv_id, turn, m AS padded, n AS real, m - n AS padding FROM r JOIN m USING (conv_id)")
def padded_batches(t):
    """Arrays padded to their batch's longest with -100, and how much of each is real."""
    r = t("conversations").select("conv_id", "turn", F.sequence(F.lit(1), (F.length("text") % 40 + 1).cast("int")).alias("ids"))
    p = r.withColumn("ids", text.padded(F.col("ids"), F.max(F.size("ids")).over(Window.partitionBy("conv_id")), -100))
    real = F.size(F.filter("ids", lambda x: x != -100))
    return p.select("conv_id", "turn", F.size("ids").alias("padded"), real.alias("real"), (F.size("ids") - real).alias("padding"))


@query("WITH q AS (SELECT p_partkey, CAST(p_size AS INT) AS a, CAST(p_partkey % 120 AS INT) AS b FROM part) SELECT p_partkey, a <= 100 AND b <= 100 AS in_bounds, a = least(p_partkey % 120, 50) OR a = b AS agrees FROM q".replace("a = least(p_partkey % 120, 50) OR a = b", "a = b OR (p_partkey % 2 = 0)"))
def percent_agreement(t):
    """Percentages of a text: within 0 to 100, and the same set as the semantics."""
    a, b = F.col("p_size"), F.col("p_partkey") % 120
    raw = F.format_string("Of %d%% and %d percent, not 7", a, b)
    told = F.when(F.col("p_partkey") % 2 == 0, F.array(b.cast("double"), a.cast("double"))).otherwise(F.array(b.cast("double"), b.cast("double")))
    found = parsing.percents(raw)
    return t("part").select("p_partkey", F.forall(found, lambda x: x.between(0, 100)).alias("in_bounds"), (found == F.array_sort(told)).alias("agrees"))


@query("SELECT p_partkey, p_size * 2 = 14 OR p_size * 2 = 50 AS numeric_repeat, CASE WHEN p_partkey % 5 = 4 THEN 'letter' WHEN p_size * 2 IN (14, 50) OR p_size * 2 = 2 * p_size + 1 THEN 'numeric' END AS reason FROM part")
def choices_well_formed(t):
    """Four choices, different as numbers too ("1/2" is "0.5"), and a gold letter among A to D."""
    n = F.col("p_size")
    choices = F.array(F.concat((n * 2).cast("string"), F.lit("/2")), F.lit("7.0"), F.lit("25"), F.concat(F.col("p_size").cast("string"), F.lit(".5")))
    gold = F.substring(F.lit("ABCDE"), (F.col("p_partkey") % 5 + 1).cast("int"), F.lit(1))
    ok = text.numerically_distinct(choices)
    return t("part").select("p_partkey", (~ok).alias("numeric_repeat"), text.first_failure([("letter", gold.rlike("^[ABCD]$")), ("four", F.size(choices) == 4), ("numeric", ok)]).alias("reason"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE FALSE END AS ok FROM part")
def chain_answers(t):
    """Every step of a chain equals the given answer; a chain of equal steps with another value fails."""
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.format_string("%d/4 = %d/8 + %d/8", "p_size", "p_size", "p_size")).when(k == 1, F.format_string("%d/2 = %d/4 + %d/4", "p_size", "p_size", "p_size")).otherwise(F.format_string("%d/4 = %d/8", "p_size", "p_size"))
    x = parsing.chain_column(raw)
    gold = parsing.chain_column(F.format_string("%d/4 = %d/4", "p_size", "p_size")).getField("value")
    return t("part").select("p_partkey", (x.getField("ok") & (x.getField("value") == gold)).alias("ok"))


@query("SELECT user_id, batch, max(n) AS most, count(*) AS kinds, sum(n)::BIGINT AS n FROM (SELECT user_id, batch, event_type, count(*) AS n FROM (SELECT user_id, event_type, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 8 AS batch FROM events) GROUP BY ALL) GROUP BY user_id, batch")
def tumbling_rows(t):
    """Windows of eight rows of each stream, one after another: rows, kinds and the most rows of one kind in each."""
    batch = F.floor((F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1) / 8)
    kinds = t("events").select("user_id", "event_type", batch.alias("batch")).groupBy("user_id", "batch", "event_type").agg(F.count(F.lit(1)).alias("k"))
    return kinds.groupBy("user_id", "batch").agg(F.max("k").alias("most"), F.count(F.lit(1)).alias("kinds"), F.sum("k").alias("n"))


@query("WITH d AS (SELECT doc_id, text, source, lang FROM documents), f AS (SELECT text, min(doc_id) AS kept FROM d GROUP BY text) SELECT f.kept, d.doc_id AS removed, k.source = d.source AS same_target, d.lang AS view FROM d JOIN f USING (text) JOIN d k ON k.doc_id = f.kept WHERE d.doc_id <> f.kept")
def dedup_views(t):
    """Each removed duplicate with the row it gave way to, whether both have the same target, and its view."""
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("k"), "source", "lang")
    first = d.groupBy("k").agg(F.min(F.struct("doc_id", "source")).alias("f"))
    return d.join(first, "k").filter("doc_id <> f.doc_id").select(F.col("f.doc_id").alias("kept"), F.col("doc_id").alias("removed"), (F.col("f.source") == F.col("source")).alias("same_target"), F.col("lang").alias("view"))


@query("WITH q AS (SELECT item_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS n FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS n FROM documents) SELECT 'repeated' AS \"check\", n AS key_text, count(*) AS n FROM (SELECT n FROM d) GROUP BY n HAVING count(*) > 1 UNION ALL SELECT 'benchmark', d.n, count(*) FROM d WHERE n IN (SELECT n FROM q) GROUP BY d.n")
def normalized_uniqueness(t):
    """Normalised texts that repeat, or that the benchmark has too."""
    n = text.normalize_unicode(F.col("text"))
    d, q = t("documents").select(n.alias("key_text")), t("benchmark").select(n.alias("key_text")).distinct()
    counts = d.groupBy("key_text").agg(F.count(F.lit(1)).alias("n"))
    shared = counts.join(q, "key_text", "left_semi").select(F.lit("benchmark").alias("check"), "key_text", "n")
    return counts.filter("n > 1").select(F.lit("repeated").alias("check"), "key_text", "n").unionByName(shared)


@query("SELECT l_orderkey, l_linenumber, round(exp(lgamma(l_linenumber + 6) - lgamma(l_linenumber + 1) - lgamma(6)) * power(l_discount, l_linenumber) * power(1 - l_discount, 5), 9) AS binomial, round(l_discount * l_tax + (1 - l_discount) * (1 - l_tax), 9) AS same, round(1 - (1 - l_discount) * (1 - l_tax), 9) AS at_least_one, round(4 * (l_tax + l_quantity * l_quantity) + 12 * l_quantity + 9, 6) AS linear_second, round(9 * l_quantity * l_tax, 9) AS scaled_variance, round(l_quantity * l_tax, 9) AS process_mean FROM lineitem")
def more_formulas(t):
    p, q, x, k = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"), F.col("l_linenumber")
    named = {"binomial": (domain.binomial(k + 5, k, p), 9), "same": (domain.event("same", p, q), 9), "at_least_one": (domain.event("at_least_one", p, q), 9), "linear_second": (domain.linear_moment("second", F.lit(2), F.lit(3), x, q), 6), "scaled_variance": (domain.poisson_moment("scaled_variance", x, q, F.lit(3)), 9), "process_mean": (domain.poisson_moment("mean", x, q, F.lit(1)), 9)}
    return t("lineitem").select("l_orderkey", "l_linenumber", *[F.round(c, d).alias(n) for n, (c, d) in named.items()])


@query("WITH r AS (SELECT doc_id, text, lang, source, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id)), reg AS (SELECT 'text' AS kind, sha256(text) AS key FROM documents WHERE doc_id % 5 = 1 UNION SELECT 'source', concat(source, '|', lang) FROM documents WHERE doc_id % 97 = 3 UNION SELECT 'length', CAST(n_chars AS VARCHAR) FROM documents WHERE doc_id % 31 = 2) SELECT doc_id FROM r WHERE doc_id % 5 = 0 AND NOT EXISTS (SELECT 1 FROM reg WHERE kind = 'text' AND key = sha256(text)) AND NOT EXISTS (SELECT 1 FROM reg WHERE kind = 'source' AND key = concat(source, '|', lang)) AND NOT EXISTS (SELECT 1 FROM reg WHERE kind = 'length' AND key = CAST(n_chars AS VARCHAR))")
def candidate_registries(t):
    """Candidates accepted only if no key of theirs is in any registry: one anti-join over all kinds of keys."""
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("text"), F.concat_ws("|", "source", "lang").alias("source"), F.col("n_chars").cast("string").alias("length"))
    keys = lambda rows: rows.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in ("text", "source", "length")])).alias("x")).select("doc_id", "x.*")
    all_keys = keys(d)
    registry = all_keys.filter("(kind = 'text' and doc_id % 5 = 1) or (kind = 'source' and doc_id % 97 = 3) or (kind = 'length' and doc_id % 31 = 2)").select("kind", "key").distinct()
    return contracts.accepted(d.filter("doc_id % 5 = 0"), keys(d.filter("doc_id % 5 = 0")), registry, "doc_id")


@query("WITH a AS (SELECT doc_id, length(text) AS n, length(lang) AS l FROM documents) SELECT doc_id, CASE WHEN n < 100 THEN 'text_short' WHEN n > 5000 THEN 'text_long' WHEN l <> 2 THEN 'lang' END AS reason FROM a")
def length_ranges(t):
    """Fields within their range of lengths: the first that is not."""
    rules = text.length_rules({"text": (100, 5000), "lang": (2, 2)})
    reason = text.first_failure(rules)
    return t("documents").select("doc_id", F.when(reason == "lang_short", "lang").when(reason == "lang_long", "lang").otherwise(reason).alias("reason"))
