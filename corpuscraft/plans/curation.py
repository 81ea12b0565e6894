"""Normalisation, validation, joins, deduplication, contamination and split contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import alike, core, merkle, neardup
from ._registry import query

NORM = r"trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'))"
SPLIT = "split AS (SELECT doc_id, text, source, lang, CASE WHEN CAST(('0x' || substr(sha256(concat('split|', doc_id)), 1, 8)) AS UBIGINT) % 10 < 8 THEN 'train' WHEN CAST(('0x' || substr(sha256(concat('split|', doc_id)), 1, 8)) AS UBIGINT) % 10 = 8 THEN 'development' ELSE 'blind' END AS split FROM documents)"


def split(t):
    draw = core.hash_draw("split", 10, F.col("doc_id"))
    return t("documents").select("doc_id", "text", "source", "lang", F.when(draw < 8, "train").when(draw == 8, "development").otherwise("blind").alias("split"))


@query(f"SELECT doc_id, sha256({NORM}) AS norm_sha, length({NORM}) AS norm_length FROM documents")
def normalize_text(t):
    n = text.normalize_unicode(F.col("text"))
    return t("documents").select("doc_id", F.sha2(n, 256).alias("norm_sha"), F.length(n).alias("norm_length"))


@query(r"SELECT item_id, sha256(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS norm_sha FROM benchmark")
def normalize_ascii(t):
    return t("benchmark").select("item_id", F.sha2(text.normalize_ascii(F.col("text")), 256).alias("norm_sha"))


@query("SELECT p_partkey, sha256(concat('buy <num> of ', p_name, chr(10), 'pay <num> each')) AS signature, sha256(concat('take <num>/a of <num>')) AS other FROM part")
def template_signatures(t):
    """Numbers masked: equal for every size and price; a number that touches a letter is kept together."""
    q, p = F.format_string("Buy  %d of %s", "p_size", "p_name"), F.format_string("Pay %d/7   each", "p_size")
    return t("part").select("p_partkey", text.template_signature(q, p).alias("signature"), F.sha2(text.template_mask(F.format_string("take %d/a of -%d.5", "p_size", "p_size")), 256).alias("other"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size / 4 WHEN 2 THEN p_size + 0.5 END AS value, CASE WHEN p_partkey % 4 <> 3 THEN abs((CASE p_partkey % 4 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size / 4 ELSE p_size + 0.5 END) - p_size) <= greatest(1e-6, abs(p_size) * 1e-4) END AS matches FROM part")
def final_answers(t):
    """The last Answer: line as a number, compared within a tolerance."""
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.format_string("Answer: 1\nso\nAnswer: %d", "p_size")).when(k == 1, F.format_string("answer: %d/4 ", "p_size")).when(k == 2, F.format_string("Answer: %d.5", "p_size")).otherwise("Answer: about ten")
    v = text.last_answer_number(raw)
    return t("part").select("p_partkey", v.alias("value"), text.within_tolerance(v, F.col("p_size")).alias("matches"))


@query("SELECT p_partkey, concat('brand=', p_brand, ';type=', p_type) AS stratum, CASE WHEN p_size % 5 = 0 THEN 'zero' WHEN p_size % 5 = 1 THEN 'one' ELSE 'interior' END AS position, CASE WHEN p_size - 25 = 0 THEN 'zero' WHEN p_size < 25 THEN 'negative_integer' ELSE 'positive_integer' END AS kind FROM part")
def strata(t):
    axes = F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"), F.lit("noise"), F.col("p_name"))
    m = F.col("p_size") % 5
    return t("part").select("p_partkey", text.stratum(axes, ("noise",)).alias("stratum"), text.probability_position(F.when(m < 2, m).otherwise(0.5)).alias("position"), text.number_class(F.col("p_size") - 25).alias("kind"))


@query("SELECT doc_id, CASE WHEN length(trim(text)) = 0 THEN 'blank' WHEN n_chars < 200 THEN 'short' WHEN lang NOT IN ('en', 'de') THEN 'language' WHEN contains(lower(text), 'license') THEN 'off_scope' END AS reason FROM documents")
def validation_reasons(t):
    """The first rule that a document breaks."""
    rules = [("blank", F.length(F.trim("text")) > 0), ("short", F.col("n_chars") >= 200), ("language", F.col("lang").isin("en", "de")), ("off_scope", ~text.blocked_word(["license"], F.col("text")))]
    return t("documents").select("doc_id", text.first_failure(rules).alias("reason"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS text_sha FROM documents GROUP BY text")
def exact_dedup(t):
    """The first document of each text: a minimum, so a group of any size is combined before the shuffle."""
    return t("documents").groupBy(F.sha2("text", 256).alias("text_sha")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text_sha")


@query("SELECT m.doc_id AS kept, d.doc_id AS removed FROM documents d JOIN (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text) m USING (text) WHERE d.doc_id <> m.doc_id")
def dedup_log(t):
    return core.duplicate_log(t("documents"), F.col("text"), "doc_id")


@query(f"SELECT sha256({NORM}) AS norm_sha, count(*) AS n, min(doc_id) AS first_id, count(DISTINCT source) AS sources FROM documents GROUP BY {NORM} HAVING count(*) > 1")
def duplicate_groups(t):
    return t("documents").groupBy(F.sha2(text.normalize_unicode(F.col("text")), 256).alias("norm_sha")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.count_distinct("source").alias("sources")).filter("n > 1")


@query()
def near_dup_greedy(t):
    """Questions kept in order of id unless too like one already kept (matching-block ratio of 0.84 or more)."""
    items = t("benchmark").select(F.col("item_id").alias("id"), text.normalize_ascii(F.col("text")).alias("text"))
    twins = items.filter("id % 3 = 0").select((F.col("id") + 10_000).alias("id"), F.concat("text", F.lit(" again")).alias("text"))
    return alike.greedy(items.unionByName(twins), 0.84)


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contamination_contains(t):
    """Documents that hold a benchmark text: an equi-join on a hashed word run first, then the exact test on what is left."""
    return neardup.containing(t("documents").select("doc_id", "text"), t("benchmark").select("item_id", F.col("text").alias("needle")))


@query(r"WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS ws FROM documents), s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)), bw AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS ws FROM benchmark), bs AS (SELECT DISTINCT item_id, array_to_string(ws[i : i + 7], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM bw)) SELECT doc_id, item_id, count(*) AS shared FROM s JOIN bs USING (g) GROUP BY 1, 2")
def contamination_ngrams(t):
    """Shared runs of eight words."""
    return neardup.shared_runs(t("documents").select("doc_id", "text"), t("benchmark").select("item_id", "text"), 8)


@query(f"WITH {SPLIT} SELECT sha256(text) AS text_sha, count(DISTINCT split) AS owners, min(split) AS first_owner, max(split) AS last_owner FROM split GROUP BY text HAVING count(DISTINCT split) > 1")
def split_disjointness(t):
    """Texts that two splits own."""
    return core.owned_by_two(split(t).select(F.sha2("text", 256).alias("text_sha"), "split"), "text_sha", "split")


@query(f"WITH {SPLIT}, k AS (SELECT DISTINCT split, text FROM split) SELECT a.split AS left_split, b.split AS right_split, count(*) AS shared FROM k a JOIN k b ON a.text = b.text AND a.split < b.split GROUP BY 1, 2")
def split_overlap(t):
    """Pairs of splits and how many texts they share: three splits at most meet at a text."""
    k = split(t).select(F.sha2("text", 256).alias("k"), "split").groupBy("k").agg(F.array_sort(F.collect_set("split")).alias("s")).filter("size(s) > 1")
    pairs = k.select(F.explode(F.expr("flatten(transform(s, a -> transform(filter(s, b -> a < b), b -> struct(a as left_split, b as right_split))))")).alias("p")).select("p.*")
    return pairs.groupBy("left_split", "right_split").agg(F.count(F.lit(1)).alias("shared"))


@query(f"WITH {SPLIT}, g AS (SELECT source, CASE WHEN CAST(('0x' || substr(sha256(concat('group|', source)), 1, 8)) AS UBIGINT) % 5 = 0 THEN 'validation' ELSE 'train' END AS split, doc_id FROM split) SELECT source, min(split) AS split, count(*) AS n, count(DISTINCT split) AS splits FROM g GROUP BY source")
def group_split(t):
    """Whole groups go to one split."""
    s = t("documents").select("source", "doc_id", F.when(core.hash_draw("group", 5, F.col("source")) == 0, "validation").otherwise("train").alias("split"))
    return s.groupBy("source").agg(F.min("split").alias("split"), F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("splits"))


@query("WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), w AS (SELECT lang, ceil(sum(n) / 20.0) AS most FROM c GROUP BY lang) SELECT lang, source, n, most::BIGINT AS most FROM c JOIN w USING (lang) WHERE n > most")
def over_concentration(t):
    """Sources that hold more than a twentieth of a language's documents."""
    c = t("documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    most = c.groupBy("lang").agg(F.ceil(F.sum("n") / 20.0).alias("most"))
    return c.join(most, "lang").filter("n > most").select("lang", "source", "n", "most")


@query("SELECT conv_id, count(*) AS turns, count(DISTINCT turn) = count(*) AND min(turn) = 0 AND max(turn) = count(*) - 1 AS complete, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations GROUP BY conv_id")
def group_completeness(t):
    """Positions 0 to n - 1 without gap or repeat."""
    n = F.count(F.lit(1))
    return t("conversations").groupBy("conv_id").agg(n.alias("turns"), ((F.count_distinct("turn") == n) & (F.min("turn") == 0) & (F.max("turn") == n - 1)).alias("complete"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


@query("SELECT 'missing' AS \"check\", CAST(l.doc_id AS VARCHAR) AS key, '' AS detail FROM labels l LEFT JOIN (SELECT doc_id FROM documents WHERE lang = 'en') d USING (doc_id) WHERE d.doc_id IS NULL")
def lookup_completeness(t):
    return core.missing_keys(t("labels"), t("documents").filter("lang = 'en'"), "doc_id")


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def accepted_semi_anti(t):
    """Left-semi membership among the good, left-anti against the blocked."""
    return t("documents").select("doc_id").join(t("labels").filter("quality = 1"), "doc_id", "left_semi").join(t("labels").filter("toxic = 1"), "doc_id", "left_anti")


@query("SELECT d.doc_id, coalesce(l.quality, b.item_id, -1)::BIGINT AS value FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON d.doc_id = b.item_id")
def fallback_lookup(t):
    j = t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left").join(t("benchmark").select(F.col("item_id").alias("doc_id"), F.col("item_id").alias("other")), "doc_id", "left")
    return j.select("doc_id", F.coalesce(F.col("quality").cast("long"), "other", F.lit(-1).cast("long")).alias("value"))


@query("WITH a AS (SELECT doc_id FROM documents WHERE lang = 'en'), b AS (SELECT doc_id FROM labels) SELECT 'only_left' AS side, count(*) AS n FROM (SELECT doc_id FROM a EXCEPT SELECT doc_id FROM b) UNION ALL SELECT 'only_right', count(*) FROM (SELECT doc_id FROM b EXCEPT SELECT doc_id FROM a) UNION ALL SELECT 'shared', count(*) FROM (SELECT doc_id FROM a INTERSECT SELECT doc_id FROM b) UNION ALL SELECT 'union', count(*) FROM (SELECT doc_id FROM a UNION SELECT doc_id FROM b)")
def set_operations(t):
    """Difference both ways, intersection and distinct union of two id sets, in one pass over both."""
    a = t("documents").filter("lang = 'en'").select("doc_id", F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = t("labels").select("doc_id", F.lit(0).alias("a"), F.lit(1).alias("b"))
    sides = a.unionByName(b).groupBy("doc_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    flat = sides.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_left"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_right"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("shared"), F.count(F.lit(1)).alias("union"))
    return flat.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ("only_left", "only_right", "shared", "union"))), F.array("only_left", "only_right", "shared", "union"))).alias("side", "n"))


@query(f"SELECT g AS lang, tree AS digest, n FROM ({merkle.roots_sql('SELECT lang AS g, sha256(text) AS o, sha256(text) AS x FROM documents')})")
def manifest_digest(t):
    """A digest over the multiset of a language's texts, whatever their order: a Merkle root over their digests in order."""
    rows = t("documents").select("lang", F.sha2("text", 256).alias("h"))
    n = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return merkle.Tree(rows, ["lang"], ["h"], F.col("h")).roots.join(n, "lang").select("lang", F.col("tree").alias("digest"), "n")


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) % 7 AS axis_value, event_type AS category, count(*) AS n FROM events GROUP BY 1, 2")
def axis_audit(t):
    """Values of a JSON axis counted by category."""
    axes = F.from_json("props", "map<string,bigint>")
    rows = t("events").select("event_type", F.explode(axes).alias("axis", "value"))
    return rows.groupBy((F.col("value") % 7).alias("axis_value"), F.col("event_type").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH x AS (SELECT l_returnflag AS category, unnest([{'id': 'sum', 'hit': l_discount + l_tax = l_discount * l_tax}, {'id': 'swap', 'hit': l_discount = l_tax}, {'id': 'zero', 'hit': l_tax = 0}]) AS trap FROM lineitem) SELECT category, trap.id AS trap, count(*) AS possible, count_if(trap.hit) AS collisions, count(*) = count_if(trap.hit) AS missing FROM x GROUP BY 1, 2")
def trap_audit(t):
    """Traps exploded: how often each collides with the right answer, and whether it ever tells them apart."""
    d, x = F.col("l_discount"), F.col("l_tax")
    traps = F.array(*[F.struct(F.lit(i).alias("id"), hit.alias("hit")) for i, hit in (("sum", d + x == d * x), ("swap", d == x), ("zero", x == 0))])
    rows = t("lineitem").select(F.col("l_returnflag").alias("category"), F.explode(traps).alias("trap"))
    return rows.groupBy("category", F.col("trap.id").alias("trap")).agg(F.count(F.lit(1)).alias("possible"), F.count_if("trap.hit").alias("collisions"), (F.count(F.lit(1)) == F.count_if("trap.hit")).alias("missing"))
