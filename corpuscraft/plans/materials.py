"""Letters, folded keys, registries, joins of several models, assembly by quota, views of records and what remains of small reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import canonical, exact, text
from ..functions import questions as Q
from ..operators import core, merkle, neardup
from ..sources import documents as sources
from ._registry import query
from .curriculum import ANSWER, CATEGORY, EXPRESSION, NUMBERS, QUESTION, STORY, TASK, asked_rows
from .grading import by_row, sql_by_row

LETTERS = [
    ("B", "B", "B"),
    ("**Answer: c** since {n}", "C", "C"),
    ("A cat and {n} dogs", "A", "A"),
    ("Because D is {n}", "INVALID", "D"),
    ("", "INVALID", None),
    ("d) yes, {n}", "D", "D"),
    ("Answer : a, not B", "A", "A"),
    ("answer is C", "INVALID", "C"),
    ("E", "INVALID", None),
    ("ABCD", "INVALID", None),
    ("  **b**  ", "B", "B"),
    ("C:{n}", "C", "C"),
    ("D-{n}", "INVALID", "D"),
    ("Bad idea", "INVALID", None),
    ("Answer:B.", "B", "B"),
]


@query(f"SELECT event_id, {sql_by_row('event_id', f'event_id % {len(LETTERS)}', [s for _, s, _ in LETTERS])} AS strict, {sql_by_row('event_id', f'event_id % {len(LETTERS)}', [x for _, _, x in LETTERS])} AS loose FROM events")
def letter_parse(t):
    """The leading answer letter, never one from prose; and the older search for any letter that stands alone."""
    raw = by_row(F.col("event_id"), [a for a, _, _ in LETTERS], F.col("event_id") % len(LETTERS))
    return t("events").select("event_id", text.strict_letter(raw).alias("strict"), text.loose_letter(raw).alias("loose"))


PROOFS = [
    ("1-(1-p)*(1-q)+{n}", "p+q-p*q+{n}", True),
    ("1-(1-p)*(1-q)+{n}", "p+q+{n}", False),
    ("p+", "p+{n}", None),
    ("(a**2-b**2)/(a-b)+{n}", "a+b+{n}", True),
    ("(x+{n})**3", "x**3+3*{n}*x**2+3*{n}**2*x+{n}**3", True),
    ("x/y+y/x", "(x**2+y**2)/(x*y)+{n}", False),
    ("x/(y-y)", "{n}", None),
    ("t+(u-t)/2", "(u**2-t**2)/(2*(u-t))+0*{n}", True),
]


@query(f"SELECT p_partkey, CASE p_partkey % {len(PROOFS)} " + " ".join(f"WHEN {i} THEN {'NULL' if s is None else str(s).upper()}" for i, (_, _, s) in enumerate(PROOFS)) + " END AS same FROM part WHERE p_size > 0")
def identity_proof(t):
    """Two forms of one rational function proved equal by expansion; what is none stays open."""
    k = F.col("p_partkey") % len(PROOFS)
    left, right = (by_row(F.col("p_size"), [p[i] for p in PROOFS], k) for i in (0, 1))
    return core.spread(t("part")).filter("p_size > 0").select("p_partkey", exact.proved_column(left, right).getField("same").alias("same"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g'))) AS folded_sha FROM documents")
def folded_keys(t):
    """Normalised texts after case folding: a sharp s is two."""
    return t("documents").select("doc_id", F.sha2(text.normalize_folded(F.col("text")), 256).alias("folded_sha"))


@query("SELECT p_partkey, concat('buy <num> of item ff and x', p_size, ' for <num>') AS masked FROM part")
def compatible_masks(t):
    """Compatibility forms (full-width letters and digits, ligatures) are masked like their plain ones."""
    raw = F.concat(F.lit("Ｂuy  １２ of item ﬀ and X"), F.col("p_size").cast("string"), F.lit(" for -"), F.col("p_size").cast("string"), F.lit("/7"))
    return t("part").select("p_partkey", text.template_mask(raw).alias("masked"))


@query("SELECT item_id, shift, letter, CASE WHEN letter <> 'INVALID' THEN (instr('ABCD', letter) - 1 + shift) % 4 END AS original FROM (SELECT item_id, shift, CASE (length(text) + shift) % 5 WHEN 4 THEN 'INVALID' ELSE 'ABCD'[CAST((length(text) + shift) % 5 AS BIGINT) + 1] END AS letter FROM benchmark, (SELECT unnest([0, 1, 2, 3]) AS shift))")
def original_choices(t):
    """A letter given to a rotated question as the place of the choice before rotation; an invalid one has none."""
    q = t("benchmark").select("item_id", F.length("text").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("shift"))
    letter = F.element_at(F.array(*map(F.lit, ("A", "B", "C", "D", "INVALID"))), (F.pmod(F.col("n") + F.col("shift"), F.lit(5)) + 1).cast("int"))
    return q.select("item_id", "shift", letter.alias("letter")).select("*", text.original_index(F.col("letter"), F.col("shift")).alias("original"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat(p_size, ' seconds') WHEN 1 THEN concat(p_size, '/7 minutes') ELSE concat(p_size, ' minutes') END AS shown FROM part")
def duration_forms(t):
    """Times given as sixtieths are shown in seconds, as supplied."""
    raw = by_row(F.col("p_size"), ["{n} / 60", "{n}/7", "{n}"], F.col("p_partkey") % 3)
    return t("part").select("p_partkey", text.duration_text(raw).alias("shown"))


@query("SELECT \"check\", count(*) AS n FROM (SELECT 'unique' AS \"check\" FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'missing' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'unknown' FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) GROUP BY 1")
def one_to_one_contract(t):
    """What a join of results and questions needs: unique keys, no question without result, no result without question."""
    l, o = t("lineitem"), t("orders").select("o_orderkey")  # noqa: E741
    keys = l.select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    found = core.key_violations(l, "l_orderkey", "l_linenumber").unionByName(core.missing_keys(o, keys, "o_orderkey")).unionByName(core.missing_keys(keys, o, "o_orderkey").withColumn("check", F.lit("unknown")))
    return found.groupBy("check").agg(F.count(F.lit(1)).alias("n"))


PARTS = "SELECT *, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'validation' ELSE 'blind' END AS split FROM documents"


@query(f"""
WITH d AS ({PARTS}),
c AS (SELECT split, count(*) AS n, count_if(text IS NULL OR trim(text) = '') AS blank, count(*) - count(DISTINCT doc_id) AS repeated, count_if(n_chars IS DISTINCT FROM length(text)) AS drifted FROM d GROUP BY split),
h AS ({merkle.roots_sql(f"SELECT split AS g, doc_id AS o, concat_ws('|', doc_id, lang, source, sha256(text)) AS x FROM ({PARTS})")}),
k AS ({merkle.roots_sql(f"SELECT split AS g, source AS o, source AS x FROM (SELECT DISTINCT split, source FROM ({PARTS}))")})
SELECT split, c.n, blank, repeated, drifted, k.n AS root_keys, h.tree AS rows_sha, k.tree AS root_keys_sha, sha256(concat_ws('|', split, c.n, h.tree, k.tree, 'contract-1')) AS binding_sha FROM c JOIN h ON h.g = split JOIN k ON k.g = split
""")
def dataset_contract(t):
    """A dataset by its contract, split by split: rows, blank texts, repeated ids, stored lengths that differ, and digests of its rows,
    of its root keys (sources) and of all that together. Digests are Merkle roots; nothing in them depends on the table's size."""
    train, validation = F.col("doc_id") % 10 < 7, F.col("doc_id") % 10 < 9
    d = t("documents").withColumn("split", F.when(train, "train").when(validation, "validation").otherwise("blind"))
    blank = F.col("text").isNull() | (F.trim("text") == "")
    n = d.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(blank).alias("blank"), (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("repeated"), F.count_if(~F.col("n_chars").eqNullSafe(F.length("text"))).alias("drifted"))
    rows = merkle.Tree(d.select("split", "doc_id", F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "source", F.sha2("text", 256)).alias("x")), ["split"], ["doc_id"], F.col("x")).roots
    roots = d.select("split", "source").distinct()
    keys = merkle.Tree(roots, ["split"], ["source"], F.col("source")).roots
    many = roots.groupBy("split").agg(F.count(F.lit(1)).alias("root_keys"))
    both = n.join(rows.select("split", F.col("tree").alias("rows_sha")), "split").join(keys.select("split", F.col("tree").alias("root_keys_sha")), "split").join(many, "split")
    return both.withColumn("binding_sha", F.sha2(F.concat_ws("|", "split", F.col("n").cast("string"), "rows_sha", "root_keys_sha", F.lit("contract-1")), 256))


@query(r"WITH d AS (SELECT doc_id % 3 AS split, regexp_replace(regexp_replace(lower(text), '[0-9]+', '<num>', 'g'), '\s+', ' ', 'g') AS sig, text FROM documents), k AS (SELECT DISTINCT split, sig FROM d), x AS (SELECT DISTINCT split, text FROM d) SELECT a.split AS left_split, b.split AS right_split, (SELECT count(*) FROM x p JOIN x q ON p.text = q.text WHERE p.split = a.split AND q.split = b.split) AS texts, count(*) FILTER (a.sig = b.sig) AS templates FROM k a JOIN k b ON a.split < b.split GROUP BY ALL")
def template_overlap(t):
    """Pairs of splits: texts and templates that both have. Keys are grouped, so three splits at most meet at a key."""
    sig = F.regexp_replace(F.regexp_replace(F.lower("text"), "[0-9]+", "<num>"), r"\s+", " ")
    keys = t("documents").select((F.col("doc_id") % 3).alias("split"), F.explode(F.array(F.struct(F.lit("texts").alias("kind"), F.sha2("text", 256).alias("key")), F.struct(F.lit("templates").alias("kind"), sig.alias("key")))).alias("x")).select("split", "x.*")
    owners = keys.groupBy("kind", "key").agg(F.array_sort(F.collect_set("split")).alias("s"))
    pairs = owners.select("kind", F.explode(F.expr("filter(flatten(transform(s, a -> transform(s, b -> struct(a as left_split, b as right_split)))), p -> p.left_split < p.right_split)")).alias("p")).select("kind", "p.*")
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    every = t("documents").select((F.col("doc_id") % 3).alias("a")).distinct()
    grid = every.select(F.col("a").alias("left_split"), F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("right_split")).filter("left_split < right_split")
    return grid.join(pairs.groupBy("left_split", "right_split").agg(n("texts"), n("templates")), ["left_split", "right_split"], "left").select("left_split", "right_split", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("templates", F.lit(0)).alias("templates"))


@query("WITH f AS (SELECT item_id, text AS v FROM benchmark UNION ALL SELECT item_id, sha256(text) FROM benchmark UNION ALL SELECT item_id, concat('item-', item_id, '-dev') FROM benchmark), p AS (SELECT doc_id, CASE WHEN doc_id % 40 = 1 THEN concat(text, ' see ', (SELECT sha256(text) FROM benchmark WHERE item_id = doc_id % (SELECT count(*) FROM benchmark))) WHEN doc_id % 40 = 2 THEN concat('item-', doc_id % 9, '-dev ', text) ELSE text END AS payload FROM documents) SELECT doc_id, item_id FROM p JOIN f ON contains(payload, v) GROUP BY ALL")
def forbidden_values(t):
    """Payloads that hold a development id, text or committed digest."""
    b = t("benchmark")
    digest = F.sha2("text", 256)
    values = b.select("item_id", F.explode(F.array("text", digest, F.concat(F.lit("item-"), F.col("item_id").cast("string"), F.lit("-dev")))).alias("needle"))
    d, k = t("documents"), F.col("doc_id") % 40
    n = b.agg(F.count(F.lit(1)).alias("n"))
    asked = d.join(F.broadcast(n)).select("doc_id", "text", (F.col("doc_id") % F.col("n")).alias("item_id"))  # one row
    told = asked.join(b.select("item_id", digest.alias("sha")), "item_id", "left")
    payload = F.when(k == 1, F.concat("text", F.lit(" see "), "sha")).when(k == 2, F.concat(F.lit("item-"), (F.col("doc_id") % 9).cast("string"), F.lit("-dev "), "text")).otherwise(F.col("text"))
    return neardup.containing(told.select("doc_id", payload.alias("text")), values)


@query("SELECT o_orderpriority AS category, count(*) AS n, round(avg(CAST(o_orderstatus = 'F' AS INT)), 9) AS accuracy, row_number() OVER (ORDER BY avg(CAST(o_orderstatus = 'F' AS INT)), o_orderpriority) AS place, min(CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END) AS first_wrong FROM orders GROUP BY 1")
def worst_categories(t):
    """Accuracy by category, the lowest first, each with its first wrong row."""
    ok = F.col("o_orderstatus") == "F"
    c = t("orders").groupBy(F.col("o_orderpriority").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ok.cast("int")), 9).alias("accuracy"), F.min(F.when(~ok, F.col("o_orderkey"))).alias("first_wrong"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("accuracy", "category")))  # a row for each category


@query("WITH a AS (SELECT event_id AS id, event_type AS category, value > 30 AS base FROM events), b AS (SELECT event_id AS id, value > 45 AND event_id % 7 <> 0 AS mid FROM events), c AS (SELECT event_id AS id, value > 60 OR event_id % 11 = 0 AS big FROM events) SELECT category, concat(CAST(base AS INT), CAST(mid AS INT), CAST(big AS INT)) AS outcomes, count(*) AS n, count_if(NOT base AND big) AS wrong_right, count_if(base AND NOT big) AS right_wrong FROM a JOIN b USING (id) JOIN c USING (id) GROUP BY ALL")
def three_model_join(t):
    """Three runs joined on the question: how often each pattern of outcomes occurs."""
    e, v, i = t("events"), F.col("value"), F.col("event_id")
    a = e.select(i.alias("id"), F.col("event_type").alias("category"), (v > 30).alias("base"))
    b = e.select(i.alias("id"), ((v > 45) & (i % 7 != 0)).alias("mid"))
    c = e.select(i.alias("id"), ((v > 60) | (i % 11 == 0)).alias("big"))
    j = a.join(b, "id").join(c, "id")
    return j.groupBy("category", F.concat(*[F.col(x).cast("int").cast("string") for x in ("base", "mid", "big")]).alias("outcomes")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("base") & F.col("big")).alias("wrong_right"), F.count_if(F.col("base") & ~F.col("big")).alias("right_wrong"))


@query("WITH x AS (SELECT event_type AS family, user_id, max(CASE WHEN event_id % 2 = 0 THEN CAST(value > 50 AS INT) END) AS a, max(CASE WHEN event_id % 2 = 1 THEN CAST(value > 50 AS INT) END) AS b FROM events GROUP BY 1, 2) SELECT family, count_if(a = 1) AS a_accepted, count_if(b = 1) AS b_accepted, count(*) AS n, count_if(a = 1 AND b = 0) AS a1_b0, count_if(a = 0 AND b = 1) AS a0_b1, count_if(b = 1) >= ceil(0.8 * count(*)) AND count_if(a = 1 AND b = 0) <= 5 AS passes FROM x WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY family")
def arm_thresholds(t):
    """Two arms by family: acceptances, flips both ways, and the threshold that the second must reach."""
    ok = (F.col("value") > 50).cast("int")
    arm = lambda r: F.max(F.when(F.col("event_id") % 2 == r, ok))
    x = t("events").groupBy(F.col("event_type").alias("family"), "user_id").agg(arm(0).alias("a"), arm(1).alias("b")).dropna()
    n, lost = F.count(F.lit(1)), F.count_if((F.col("a") == 1) & (F.col("b") == 0))
    return x.groupBy("family").agg(F.count_if(F.col("a") == 1).alias("a_accepted"), F.count_if(F.col("b") == 1).alias("b_accepted"), n.alias("n"), lost.alias("a1_b0"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("a0_b1"), ((F.count_if(F.col("b") == 1) >= F.ceil(0.8 * n)) & (lost <= 5)).alias("passes"))


@query("SELECT p_brand AS concept, p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY sha256(concat('gs|', p_partkey)), p_partkey) <= 2 THEN 'validation' ELSE 'train' END AS split FROM part")
def concept_split(t):
    """Two rows of each concept, the first in hash order, are for validation."""
    first = core.stratified_sample(t("part").select("p_brand", "p_partkey"), "p_brand", 2, "gs", "p_partkey").select("p_partkey", F.lit("validation").alias("split"))
    return t("part").select(F.col("p_brand").alias("concept"), "p_partkey").join(first, "p_partkey", "left").select("concept", "p_partkey", F.coalesce("split", F.lit("train")).alias("split"))


@query("SELECT doc_id, source FROM documents ORDER BY sha256(concat('smoke|', doc_id)), doc_id LIMIT 25")
def smoke_rows(t):
    """The first rows in hash order, for a trial run: the limit is what it is for."""
    return t("documents").select("doc_id", "source").orderBy(core.hash_order("smoke", "doc_id"), "doc_id").limit(25)


@query("WITH c AS (SELECT p_brand AS family, p_partkey, concat(p_size, '|', p_type) AS task, concat(p_brand, '|', p_size) AS story FROM part), b AS (SELECT DISTINCT concat(p_size, '|', p_type) AS task FROM part WHERE p_partkey % 9 = 0), f AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY p_partkey) AS r FROM c WHERE task NOT IN (SELECT task FROM b)), q AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p_partkey) AS slot FROM f WHERE r = 1) SELECT family, slot, p_partkey, task FROM q WHERE slot <= 40")
def family_assembly(t):
    """Families filled to their quota: candidates in order, none whose task is blocked or already taken by an earlier one."""
    c = t("part").select(F.col("p_brand").alias("family"), "p_partkey", F.concat_ws("|", F.col("p_size").cast("string"), "p_type").alias("task"))
    blocked = t("part").filter("p_partkey % 9 = 0").select(F.concat_ws("|", F.col("p_size").cast("string"), "p_type").alias("task")).distinct()
    free = c.join(blocked, "task", "left_anti").groupBy("task").agg(F.min(F.struct("p_partkey", "family")).alias("x")).select("task", "x.*")
    return free.withColumn("slot", F.row_number().over(Window.partitionBy("family").orderBy("p_partkey"))).filter("slot <= 40").select("family", "slot", "p_partkey", "task")


@query(f"WITH {NUMBERS}, k AS (SELECT p_partkey, c, surface, turned, secs, i, j, m, s, {QUESTION} AS original FROM n), o AS (SELECT p_partkey, c, 1 - surface AS surface, turned, secs, i, j, m, s, original FROM k) SELECT p_partkey, unnest(['original', 'paraphrase', 'explain']) AS variant, unnest([original, {QUESTION}, concat('Explain: ', original)]) AS prompt FROM o")
def variant_views(t):
    """Each question, its other surface form and a request to explain it."""
    x = asked_rows(t)
    other = Q.question_column("category", F.when(F.col("surface") == "givens_first", "target_first").otherwise("givens_first"), "semantics", "given_order", "unit").getField("question")
    views = F.array(*[F.struct(F.lit(v).alias("variant"), p.alias("prompt")) for v, p in (("original", F.col("question")), ("paraphrase", other), ("explain", F.concat(F.lit("Explain: "), "question")))])
    return x.select("p_partkey", F.explode(views).alias("v")).select("p_partkey", "v.*")


@query("WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, value > 40 AS ok FROM events WHERE event_type = 'view'), r AS (SELECT user_id, event_id, place FROM a WHERE NOT ok AND place <= 12) SELECT user_id, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY place) AS ids, 'Check each step; answer only these.' AS rule_card FROM r GROUP BY user_id")
def retry_requests(t):
    """A second request for a packet's rejected ids alone, in their order, with a rule card."""
    a = t("events").filter("event_type = 'view'").select("user_id", "event_id", (F.col("value") > 40).alias("ok"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("place"))
    r = a.filter("not ok and place <= 12").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("place", "event_id"))).alias("x"))
    return r.select("user_id", "n", F.array_join(F.transform("x", lambda e: e["event_id"].cast("string")), ",").alias("ids"), F.lit("Check each step; answer only these.").alias("rule_card"))


@query(f"WITH {NUMBERS}, k AS (SELECT {STORY} AS story, {TASK} AS task, {CATEGORY} AS category, {ANSWER} AS answer FROM n) SELECT category, count(*) AS n, count(DISTINCT story) AS stories, count(DISTINCT task) AS tasks, count(DISTINCT answer) AS answers, max(per) <= ceil(count(*) / 2.0) AS spread FROM (SELECT *, count(*) OVER (PARTITION BY category, answer) AS per FROM k) GROUP BY category")
def split_summary(t):
    """Rows, stories, tasks and answers by category, and whether no answer holds more than half."""
    x = asked_rows(t).select("category", "story", "task", "answer")
    most = x.groupBy("category", "answer").agg(F.count(F.lit(1)).alias("k")).groupBy("category").agg(F.max("k").alias("k"))
    s = x.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("story").alias("stories"), F.count_distinct("task").alias("tasks"), F.count_distinct("answer").alias("answers"))
    return s.join(most, "category").select("category", "n", "stories", "tasks", "answers", (F.col("k") <= F.ceil(F.col("n") / 2.0)).alias("spread"))


@query("WITH d AS (SELECT lang, source, doc_id FROM documents), c AS (SELECT lang, source, count(*) AS n FROM d GROUP BY ALL), q AS (SELECT lang, ceil(count(*) / (SELECT count(DISTINCT source) FROM d)::DOUBLE / 1.0) AS bound FROM d GROUP BY lang) SELECT lang, max(n) AS most, CAST(min(bound) AS BIGINT) AS bound, count_if(n > bound) AS over FROM c JOIN q USING (lang) GROUP BY lang")
def concentration_bounds(t):
    """The commonest signature of each category against the bound that equal shares would give."""
    d = t("documents")
    kinds = d.agg(F.count_distinct("source").alias("kinds"))
    c = d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("k"))
    g = c.groupBy("lang").agg(F.sum("k").alias("n"), F.max("k").alias("most")).join(F.broadcast(kinds)).select("lang", "most", F.ceil(F.col("n") / F.col("kinds")).alias("bound"))  # one row
    over = c.join(g.select("lang", "bound"), "lang").groupBy("lang").agg(F.count_if(F.col("k") > F.col("bound")).alias("over"))
    return g.join(over, "lang").select("lang", "most", "bound", "over")


@query(f"WITH {NUMBERS}, k AS (SELECT p_partkey, {EXPRESSION} AS expression, {ANSWER} AS answer FROM n) SELECT p_partkey, concat('{{\"answer\":\"', answer, '\",\"expression\":\"', expression, '\"}}') AS record, sha256(concat('{{\"answer\":\"', answer, '\",\"expression\":\"', expression, '\"}}')) AS record_sha FROM k")
def stamped_records(t):
    """Records stamped with the digest of their own canonical JSON."""
    x = asked_rows(t).select("p_partkey", F.col("answer"), F.col("expression"))
    r = canonical.record("answer", "expression")
    return x.select("p_partkey", r.alias("record"), F.sha2(r, 256).alias("record_sha"))


NOTATIONS = [("C({n},2)+C (3,1)", "comb({n},2)+comb(3,1)"), ("comb({n},1)", "comb({n},1)"), ("ABC({n})", "ABC({n})"), ("C*{n}", "C*{n}"), ("2*C(  {n},0)", "2*comb(  {n},0)")]


@query(f"SELECT p_partkey, {sql_by_row('p_size', f'p_partkey % {len(NOTATIONS)}', [b for _, b in NOTATIONS])} AS shown FROM part")
def comb_notation(t):
    """C(n, k) written as comb(n, k); other names that end in C stay."""
    return t("part").select("p_partkey", text.comb_notation(by_row(F.col("p_size"), [a for a, _ in NOTATIONS], F.col("p_partkey") % len(NOTATIONS))).alias("shown"))


@query("WITH a AS (SELECT lang, source FROM documents WHERE doc_id % 2 = 0), b AS (SELECT lang, source FROM documents WHERE doc_id % 2 = 1) SELECT 'left' AS side, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def multiset_difference(t):
    """Rows that one table has more often than the other, both ways: none if they are the same."""
    rows = lambda r: t("documents").filter(f"doc_id % 2 = {r}").select("lang", "source")
    return core.multiset_difference(rows(0), rows(1))
