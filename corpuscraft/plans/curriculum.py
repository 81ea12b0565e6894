"""Questions of the closed grammar made from table rows: texts, answers, reading back, validation, misconceptions and order.

Every row of ``part`` gives one question; category, wording and numbers follow from its key and size, so the SQL can write the
same texts and answers by arithmetic of its own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import questions as Q
from ..functions import text
from ..operators import core, generate
from ._registry import query

# -- the SQL side: the same numbers as integers, canonical rationals as text
NUMBERS = "n AS (SELECT p_partkey, CAST(p_partkey % 18 AS INT) AS c, CAST(p_partkey // 18 AS BIGINT) AS cycle, p_partkey // 18 % 2 AS surface, p_partkey // 36 % 2 AS turned, p_partkey // 72 % 2 AS secs, CAST(p_size % 22 + 1 AS BIGINT) AS i, CAST(p_partkey * 5 % 22 + 1 AS BIGINT) AS j, CAST(p_partkey % 7 + 1 AS BIGINT) AS m, CAST(p_size % 5 + 1 AS BIGINT) AS s FROM part)"


def rat(n: str, d: str) -> str:
    """SQL of a canonical rational."""
    return f"CASE WHEN ({n}) % ({d}) = 0 THEN CAST(CAST(({n}) // ({d}) AS BIGINT) AS VARCHAR) ELSE concat(CAST(({n}) // gcd({n}, {d}) AS BIGINT), '/', CAST(({d}) // gcd({n}, {d}) AS BIGINT)) END"


VALUES = {
    "events": {"p": "concat(i, '/23')", "p_b": "concat(j, '/23')"},
    "moments": {"mean": "concat(i, '/23')", "variance": "CAST(j AS VARCHAR)", "scale": "CAST(m AS VARCHAR)", "offset": "CAST(-s AS VARCHAR)"},
    "poisson": {"mean": "concat(j, '/23')", "scale": "CAST(m AS VARCHAR)", "offset": "CAST(-s AS VARCHAR)"},
    "process": {"rate": "CAST(i AS VARCHAR)", "duration": rat("m", "4"), "scale": "CAST(m AS VARCHAR)", "offset": "CAST(-s AS VARCHAR)"},
    "uniform": {"lower": "CAST(s AS VARCHAR)", "upper": "CAST(s + j AS VARCHAR)", "cutoff": rat("2 * s + 1", "2")},
    "binomial": {"n": "CAST(j % 8 + 2 AS VARCHAR)", "r": "CAST(p_partkey % (j % 8 + 3) AS VARCHAR)", "p": "concat(i, '/23')"},
    "interval": {"lower": "CAST(-s AS VARCHAR)", "upper": "CAST(j AS VARCHAR)", "divisor": "CAST(m + 1 AS VARCHAR)"},
}
DOUBLES = {
    "events": {"p": "i / 23", "p_b": "j / 23"},
    "moments": {"mean": "i / 23", "variance": "j", "scale": "m", "offset": "-s"},
    "poisson": {"mean": "j / 23", "scale": "m", "offset": "-s"},
    "process": {"rate": "i", "duration": "m / 4", "seconds": "15 * m", "scale": "m", "offset": "-s"},
    "uniform": {"lower": "s", "upper": "s + j", "cutoff": "s + 0.5"},
    "binomial": {"n": "(j % 8 + 2)", "r": "(p_partkey % (j % 8 + 3))", "p": "i / 23"},
    "interval": {"lower": "-s", "upper": "j", "divisor": "m + 1"},
}
N, R = "(j % 8 + 2)", "(p_partkey % (j % 8 + 3))"
ANSWERS = {
    "both": ("i * j", "529"),
    "neither": ("(23 - i) * (23 - j)", "529"),
    "exactly_one": ("i * (23 - j) + (23 - i) * j", "529"),
    "at_least_one": ("529 - (23 - i) * (23 - j)", "529"),
    "same": ("i * j + (23 - i) * (23 - j)", "529"),
    "moment_mean": ("m * i - 23 * s", "23"),
    "moment_variance": ("m * m * j", "1"),
    "moment_second": ("m * m * (529 * j + i * i) - 46 * m * s * i + 529 * s * s", "529"),
    "poisson_variance": ("j", "23"),
    "poisson_scaled": ("m * m * j", "23"),
    "poisson_second": ("23 * j + j * j", "529"),
    "process_variance": ("i * m", "4"),
    "process_scaled": ("m * m * i * m", "4"),
    "process_second": ("4 * i * m + i * i * m * m", "16"),
    "uniform_mean": ("2 * s + j", "2"),
    "uniform_conditional": ("4 * s + 2 * j + 1", "4"),
    "binomial": (f"CAST(round(exp(lgamma({N} + 1) - lgamma({R} + 1) - lgamma({N} - {R} + 1))) AS BIGINT) * CAST(power(i, {R}) AS BIGINT) * CAST(power(23 - i, {N} - {R}) AS BIGINT)", f"CAST(power(23, {N}) AS BIGINT)"),
    "interval": ("(j - s) * (m + 1) + j + s", "2 * (m + 1)"),
}


def cases(make) -> str:
    """CASE c WHEN .. over all categories."""
    return "CASE c " + " ".join(f"WHEN {k} THEN {make(c)}" for k, c in enumerate(Q.CATEGORIES)) + " END"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def filled(template: str, values: dict[str, str]) -> str:
    """SQL that writes a template: {name} is a value's text, {name:time} a time with its unit, {name:square} a square."""
    out = []
    for part in re.split(r"(\{[\w:]+\}\)?)", template):
        m = re.fullmatch(r"\{(\w+)(:\w+)?\}(\)?)", part)
        if not m:
            out += [quoted(part)] if part else []
        elif m[2] == ":time":
            whole = "15 * m" if m[1] == "duration" else "60 * s + 30"
            out.append(f"CASE WHEN secs = 1 THEN concat({whole}, ') seconds') ELSE concat({values[m[1]]}, ') minutes') END")
        else:
            out.append("CAST((m + 1) * (m + 1) AS VARCHAR)" if m[2] else values[m[1]])
            out += [quoted(m[3])] if m[3] else []
    return f"concat({', '.join(out)})"


def asked(c: str) -> str:
    def one(surface: int, order: str) -> str:
        return filled(Q.FORMATS[c][surface].replace("{given}", Q.GIVEN[order]).replace("{ask}", Q.ASKS.get(c, "")), VALUES[Q.FAMILY_OF[c]])

    if c not in Q.FAMILIES["events"]:
        return f"CASE WHEN surface = 0 THEN {one(0, 'A_then_B')} ELSE {one(1, 'A_then_B')} END"
    return "CASE " + " ".join(f"WHEN surface = {k} AND turned = {t} THEN {one(k, o)}" for k in (0, 1) for t, o in enumerate(Q.GIVEN)) + " END"


def written(c: str) -> str:
    lam = "CASE WHEN secs = 1 THEN concat('(', i, ')*((', 15 * m, ')/60)') ELSE concat('(', i, ')*(', " + VALUES["process"]["duration"] + ", ')') END"
    values = VALUES[Q.FAMILY_OF[c]] | {"lam": lam}
    return filled(Q.EXPRESSIONS[c], values)


def measured(template: str, c: str) -> str:
    """SQL that computes an expression template in doubles."""
    return re.sub(r"\{(\w+)\}", lambda m: f"CAST({DOUBLES[Q.FAMILY_OF[c]][m[1]]} AS DOUBLE)", template)


def slots(c: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)(?::\w+)?\}", Q.FORMATS[c][0].replace("{given}", Q.GIVEN["A_then_B"]))) - {"ask"})


def json_of(names: list[str], values: dict[str, str]) -> str:
    return "concat('{', " + ", ',', ".join(f"'\"{k}\":\"', {values[k]}, '\"'" for k in names) + ", '}')"


QUESTION, EXPRESSION = cases(asked), cases(written)
ANSWER = cases(lambda c: rat(*ANSWERS[c]))
CATEGORY = "[" + ", ".join(map(quoted, Q.CATEGORIES)) + "][c + 1]"
FAMILY = cases(lambda c: quoted(Q.FAMILY_OF[c]))
SPLIT = "CASE WHEN CAST(('0x' || substr(sha256(concat('q|', p_partkey)), 1, 8)) AS UBIGINT) % 10 < 7 THEN 'train' WHEN CAST(('0x' || substr(sha256(concat('q|', p_partkey)), 1, 8)) AS UBIGINT) % 10 = 7 THEN 'development' ELSE 'final_blind' END"


def task_sql(c: str) -> str:
    f, v = Q.FAMILY_OF[c], VALUES[Q.FAMILY_OF[c]]
    q = lambda *xs: "concat('[', " + ", ',', ".join(f"'\"', {x}, '\"'" if x != "FLAG" else f"'{str(c == 'uniform_conditional').lower()}'" for x in xs) + ", ']')"
    if f == "events":
        return q("'events'", quoted(c), f"least({v['p']}, {v['p_b']})", f"greatest({v['p']}, {v['p_b']})")
    if f in ("binomial", "interval"):
        return q(quoted(f), quoted(f), *v.values())
    if f == "uniform":
        return q("'uniform'", "FLAG", v["lower"], v["upper"], v["cutoff"] if c == "uniform_conditional" else v["lower"])
    target = "mean" if c == "moment_mean" else "second_moment" if c.endswith("second") else "variance"
    plain = c in ("poisson_variance", "poisson_second", "process_variance", "process_second")
    names = [v["rate"], v["duration"]] if f == "process" else [v["variance"]] if c == "moment_variance" else [v["mean"], v["variance"]] if c == "moment_second" else [v["mean"]]
    tail = ["'1'" if plain else v["scale"]] + ([] if target == "variance" else ["'0'" if plain else v["offset"]])
    return q(quoted(f), quoted(target), *names, *tail)


def story_sql(c: str) -> str:
    f, v = Q.FAMILY_OF[c], VALUES[Q.FAMILY_OF[c]]
    names = {"moments": ("mean", "variance"), "poisson": ("mean",), "process": ("rate", "duration"), "uniform": ("lower", "upper"), "binomial": ("n", "p"), "interval": ("lower", "upper")}
    parts = [f"least({v['p']}, {v['p_b']})", f"greatest({v['p']}, {v['p_b']})"] if f == "events" else [v[n] for n in names[f]]
    return f"concat_ws('|', {quoted(f)}, {', '.join(parts)})"


TASK = cases(task_sql)
STORY = cases(story_sql)


# -- the Spark side
def specs(t) -> DataFrame:
    """p_partkey, category, family, surface, given_order, unit, semantics (JSON), cycle and the numbers behind them."""
    key, size = F.col("p_partkey"), F.col("p_size")
    d = core.spread(t("part").select("p_partkey", "p_size")).select("p_partkey", (key % 18).cast("int").alias("c"), F.floor(key / 18).alias("cycle"), (size % 22 + 1).cast("int").alias("i"), (key * 5 % 22 + 1).cast("int").alias("j"), (key % 7 + 1).cast("int").alias("m"), (size % 5 + 1).cast("int").alias("s"))
    pick = lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), (at + 1).cast("int"))
    quarter = pick(("1/4", "1/2", "3/4", "1", "5/4", "3/2", "7/4"), F.col("m") - 1)
    n = F.col("j") % 8 + 2
    tail = lambda f: F.format_string(f + ',"scale":"%d","offset":"%d"}', *([F.col("m"), -F.col("s")]))
    semantics = {
        "events": F.format_string('{"p":"%d/23","p_b":"%d/23"}', "i", "j"),
        "moments": F.concat(F.format_string('{"mean":"%d/23","variance":"%d"', "i", "j"), tail("")),
        "poisson": F.concat(F.format_string('{"mean":"%d/23"', "j"), tail("")),
        "process": F.concat(F.format_string('{"rate":"%d","duration":"%s"', "i", quarter), tail("")),
        "uniform": F.format_string('{"lower":"%d","upper":"%d","cutoff":"%d/2"}', "s", F.col("s") + F.col("j"), 2 * F.col("s") + 1),
        "binomial": F.format_string('{"n":"%d","r":"%d","p":"%d/23"}', n, F.col("p_partkey") % (n + 1), F.col("i")),
        "interval": F.format_string('{"lower":"%d","upper":"%d","divisor":"%d"}', -F.col("s"), F.col("j"), F.col("m") + 1),
    }
    d = d.withColumn("category", pick(Q.CATEGORIES, F.col("c"))).withColumn("family", generate.family_of(F.col("category")))
    found = F.coalesce(*[F.when(F.col("family") == f, x) for f, x in semantics.items()])
    at = lambda k: F.pmod(F.floor(F.col("p_partkey") / k), F.lit(2))
    split = core.hash_draw("q", 10, F.col("p_partkey"))
    return d.select("*", found.alias("semantics"), pick(Q.SURFACES, at(18)).alias("surface"), pick(tuple(Q.GIVEN), at(36)).alias("given_order"), pick(("minutes", "seconds"), at(72)).alias("unit"), F.when(split < 7, "train").when(split == 7, "development").otherwise("final_blind").alias("split"))


def asked_rows(t) -> DataFrame:
    """The specs with question, expression, answer, task and story."""
    x = specs(t).withColumn("x", Q.question_column("category", "surface", "semantics", "given_order", "unit"))
    return x.select("*", "x.question", "x.expression", "x.answer", "x.task", "x.story").drop("x")


@query(f"WITH {NUMBERS} SELECT p_partkey, {CATEGORY} AS category, {QUESTION} AS question, {EXPRESSION} AS expression FROM n")
def question_texts(t):
    """Eighteen categories in two surfaces, orders of givens and units."""
    return asked_rows(t).select("p_partkey", "category", "question", "expression")


@query(f"WITH {NUMBERS} SELECT p_partkey, {ANSWER} AS answer FROM n")
def question_answers(t):
    """Exact answers from the semantics alone."""
    return asked_rows(t).select("p_partkey", "answer")


@query(f"WITH {NUMBERS} SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN {cases(lambda c: json_of(slots(c), VALUES[Q.FAMILY_OF[c]]))} END AS semantics, CASE WHEN p_partkey % 11 <> 0 THEN CASE WHEN c < 5 AND turned = 1 THEN 'B_then_A' ELSE 'A_then_B' END END AS given_order, CASE WHEN p_partkey % 11 <> 0 THEN CASE WHEN c IN (11, 12, 13, 15) AND secs = 1 THEN 'seconds' ELSE 'minutes' END END AS unit FROM n")
def question_read_back(t):
    """Questions read back to semantics, order and unit; a text beyond its template gives nothing."""
    tampered = F.when(F.col("p_partkey") % 11 == 0, F.concat("question", F.lit(" Or not?"))).otherwise(F.col("question"))
    return asked_rows(t).select("p_partkey", Q.read_column(tampered, "category", "surface").alias("x")).select("p_partkey", "x.semantics", "x.given_order", "x.unit")


@query(f"WITH {NUMBERS} SELECT p_partkey, CASE p_partkey % 13 WHEN 1 THEN 'answer' WHEN 2 THEN 'expression' WHEN 3 THEN 'unreadable' WHEN 4 THEN 'semantics' END AS reason, sha256(concat({QUESTION}, chr(10), {ANSWER})) AS question_sha FROM n")
def question_validity(t):
    """Read back, rendered again, oracle against answer and expression: the first rule that fails, and the record's digest. Four in
    thirteen rows are spoilt: a wrong answer, a wrong expression, a changed text, numbers of another question."""
    k = F.col("p_partkey") % 13
    rows = asked_rows(t)
    number = F.regexp_extract("semantics", r'"(-?\d+)', 1).cast("int")
    other = F.regexp_replace("semantics", r'^(\{"\w+":")-?\d+', F.concat(F.lit("$1"), (number + 100).cast("string")))
    semantics = F.when(k == 4, other).otherwise(F.col("semantics"))
    own = F.when(F.col("c").isin(11, 12, 13, 15), F.col("unit")).otherwise(F.lit("minutes"))
    spoilt = Q.check_column(F.when(k == 3, F.concat(F.lit("Well. "), "question")).otherwise(F.col("question")), "category", "surface", "semantics", F.when(k == 1, F.concat("answer", F.lit("0"))).otherwise(F.col("answer")), F.when(k == 2, F.concat("expression", F.lit("+1"))).otherwise(F.col("expression")), own)
    changed = Q.check_column("question", "category", "surface", semantics, "answer", "expression", own)
    reason = F.when(k == 4, F.coalesce(F.when(changed.getField("reason").isin("unreadable"), F.lit("semantics")), changed.getField("reason"))).otherwise(spoilt.getField("reason"))
    return rows.select("p_partkey", reason.alias("reason"), F.sha2(F.concat_ws("\n", "question", "answer"), 256).alias("question_sha"))


def trap_sql() -> str:
    rows = []
    for k, c in enumerate(Q.CATEGORIES):
        n, d = ANSWERS[c]
        for name, template in Q.MISCONCEPTIONS[c].items():
            keep = " AND secs = 1" if "{seconds}" in template else ""
            rows.append(f"SELECT {quoted(c)} AS category, {quoted(name)} AS trap, abs(({measured(template, c)}) - CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE)) < 1e-9 AS hit, p_partkey FROM n WHERE c = {k}{keep}")
    return " UNION ALL ".join(rows)


@query(f"WITH {NUMBERS}, x AS ({trap_sql()}), f AS (SELECT category, p_partkey, bool_and(hit) AS none FROM x GROUP BY ALL) SELECT category, trap, count(*) AS possible, count_if(hit) AS collisions, count_if(NOT hit) AS discriminative FROM x GROUP BY ALL UNION ALL SELECT category, 'unsupported_plus_one_sanity_mutation', count(*), 0, count(*) FROM f WHERE none GROUP BY category")
def misconception_audit(t):
    """Every misconception of every question: how often its value happens to be right, and how often it tells right from wrong. Values
    less than 1e-9 apart are not told apart."""
    asked = core.spread(specs(t).groupBy("category", "semantics", "unit").agg(F.count(F.lit(1)).alias("n")))
    x = asked.select("category", "n", F.explode(Q.near_traps_column("category", "semantics", "unit").getField("traps")).alias("trap"))
    hit = F.when(F.col("trap.collides"), F.col("n")).otherwise(0)
    return x.groupBy("category", F.col("trap.id").alias("trap")).agg(F.sum("n").alias("possible"), F.sum(hit).alias("collisions"), F.sum(F.col("n") - hit).alias("discriminative"))


@query(f"WITH {NUMBERS} SELECT p_partkey, i <> j AND i + j <> 23 AND len(list_distinct([i * j, (23 - i) * (23 - j), i * (23 - j) + (23 - i) * j, 529 - (23 - i) * (23 - j), i * j + (23 - i) * (23 - j)])) = 5 AS discriminative FROM n")
def discriminative_stories(t):
    """Stories of two events whose five questions have five different answers."""
    i, j = F.col("i"), F.col("j")
    answers = F.array(i * j, (23 - i) * (23 - j), i * (23 - j) + (23 - i) * j, 529 - (23 - i) * (23 - j), i * j + (23 - i) * (23 - j))
    return specs(t).select("p_partkey", ((i != j) & (i + j != 23) & (F.size(F.array_distinct(answers)) == 5)).alias("discriminative"))


@query(f"WITH {NUMBERS}, k AS (SELECT p_partkey, {SPLIT} AS split, {TASK} AS task FROM n) SELECT task, count(*) AS n, count(DISTINCT split) AS owners, min(p_partkey) AS first_id FROM k GROUP BY task")
def task_registry(t):
    """Tasks keyed without regard to order, units or numbers that cannot matter, and the splits that own them."""
    return asked_rows(t).groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("owners"), F.min("p_partkey").alias("first_id"))


@query(f"WITH {NUMBERS}, k AS (SELECT {SPLIT} AS split, {STORY} AS story, {TASK} AS task FROM n) SELECT story, count(DISTINCT task) AS tasks, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM k GROUP BY story HAVING count(DISTINCT split) > 1")
def story_leakage(t):
    """Primitive stories that more than one split uses."""
    g = asked_rows(t).groupBy("story").agg(F.count_distinct("task").alias("tasks"), F.array_sort(F.collect_set("split")).alias("splits"))
    return g.filter(F.size("splits") > 1).select("story", "tasks", F.array_join("splits", ",").alias("splits"))


@query(f"WITH {NUMBERS}, k AS (SELECT {SPLIT} AS split, {CATEGORY} AS category, {ANSWER} AS answer FROM n) SELECT category, answer, count(*) AS n, count(DISTINCT split) AS owners FROM k GROUP BY ALL HAVING count(DISTINCT split) > 1")
def answer_disjointness(t):
    """Answers of a category that two splits share."""
    return asked_rows(t).groupBy("category", "answer").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("owners")).filter("owners > 1")


COMBINATIONS = {
    "event_same_denominator_b_then_a": {"family": "events", "given_order": "B_then_A", "denominator_relation": "same"},
    "process_seconds_fractional_duration": {"family": "process", "unit": "seconds", "duration_form": "fraction"},
    "binomial_even_n_above_half": {"family": "binomial", "n_parity": "even", "probability_region": "above_half"},
    "uniform_seconds_cutoff": {"family": "uniform", "concept": "uniform_conditional", "unit": "seconds"},
}


@query(f"WITH {NUMBERS}, k AS (SELECT *, {SPLIT} AS split FROM n), x AS (SELECT split, unnest(['event_same_denominator_b_then_a', 'process_seconds_fractional_duration', 'binomial_even_n_above_half', 'uniform_seconds_cutoff']) AS name, unnest([c < 5 AND turned = 1, c BETWEEN 11 AND 13 AND secs = 1 AND m <> 4, c = 16 AND j % 2 = 0 AND 2 * i > 23, c = 15 AND secs = 1]) AS hit FROM k) SELECT name, count_if(hit AND split = 'train') AS train, count_if(hit AND split = 'development') AS development, count_if(hit AND split = 'final_blind') AS final_blind, count_if(hit AND split <> 'final_blind') = 0 AND count_if(hit AND split = 'final_blind') > 0 AS held_out FROM x GROUP BY name")
def held_out_combinations(t):
    """Axis-value requirements (maps) matched against each row's axes, counted by split: held out means blind only."""
    i, j = F.col("i"), F.col("j")
    axes = F.map_from_arrays(
        F.array(*map(F.lit, ("family", "concept", "given_order", "unit", "denominator_relation", "duration_form", "n_parity", "probability_region"))),
        F.array(F.col("family"), F.col("category"), F.col("given_order"), F.col("unit"), F.lit("same"), F.when(F.col("m") == 4, "integer").otherwise("fraction"), F.when(j % 2 == 0, "even").otherwise("odd"), F.when(2 * i > 23, "above_half").otherwise("below_half")),
    )
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), F.create_map(*[F.lit(x) for kv in req.items() for x in kv]).alias("req")) for n, req in COMBINATIONS.items()])
    x = specs(t).select("split", axes.alias("axes"), F.explode(wanted).alias("w")).select("split", F.col("w.name").alias("name"), generate.matches(F.col("w.req"), F.col("axes")).alias("hit"))
    count = lambda s: F.count_if(F.col("hit") & (F.col("split") == s))
    return x.groupBy("name").agg(count("train").alias("train"), count("development").alias("development"), count("final_blind").alias("final_blind")).select("*", ((F.col("train") + F.col("development") == 0) & (F.col("final_blind") > 0)).alias("held_out"))


@query(f"WITH {NUMBERS}, k AS (SELECT {EXPRESSION} AS expression, {TASK} AS task, {STORY} AS story, {QUESTION} AS question FROM n), u AS (SELECT 'expression' AS kind, expression AS key FROM k UNION ALL SELECT 'task', task FROM k UNION ALL SELECT 'story', story FROM k UNION ALL SELECT 'question', question FROM k) SELECT kind, count(DISTINCT key) AS keys, count(*) AS material FROM u GROUP BY kind")
def prior_material(t):
    """A registry of four kinds of keys: one pass that explodes them, tagged."""
    kinds = ("expression", "task", "story", "question")
    u = asked_rows(t).select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in kinds])).alias("x")).select("x.*")
    return u.groupBy("kind").agg(F.count_distinct("key").alias("keys"), F.count(F.lit(1)).alias("material"))


POSITIONS = {f: [k for k, x in enumerate(Q.SCHEDULE) if x == f] for f in Q.FAMILIES}
PLACE = "[" + ", ".join(str(POSITIONS[f]) for f in Q.FAMILIES) + "]"
FIRST, SIZES = [Q.CATEGORIES.index(cs[0]) for cs in Q.FAMILIES.values()], [len(cs) for cs in Q.FAMILIES.values()]
FAMILY_AT = cases(lambda c: str(list(Q.FAMILIES).index(Q.FAMILY_OF[c])))
ORDERED = f"o AS (SELECT *, {FAMILY_AT} AS f FROM n), w AS (SELECT p_partkey, cycle, c, f, cycle * 18 + ({PLACE}[f + 1])[((c - {FIRST}[f + 1] - cycle) % {SIZES}[f + 1] + {SIZES}[f + 1]) % {SIZES}[f + 1] + 1] AS pos FROM o)"


def ordered(t) -> DataFrame:
    """Rows by cycles: each family's categories, rotated by the cycle, take the family's places of a fixed schedule. The place is
    arithmetic on the row itself, so nothing is sorted or gathered."""
    d = specs(t)
    at = F.lit(None).cast("int")
    for f, places in POSITIONS.items():
        inner = F.pmod(F.col("c") - Q.CATEGORIES.index(Q.FAMILIES[f][0]) - F.col("cycle"), F.lit(len(places)))
        at = F.when(F.col("family") == f, F.element_at(F.array(*map(F.lit, places)), (inner + 1).cast("int"))).otherwise(at)
    return d.select("p_partkey", "cycle", "category", "family", (F.col("cycle") * 18 + at).alias("at"))


@query(f"WITH {NUMBERS}, {ORDERED} SELECT p_partkey, cycle, CAST(pos AS BIGINT) AS position FROM w")
def curriculum_cycles(t):
    return ordered(t).select("p_partkey", "cycle", F.col("at").cast("long").alias("position"))


@query(f"WITH {NUMBERS}, {ORDERED}, b AS (SELECT pos // 8 AS batch, count(*) AS n, max(per) AS category_most, count_if(f = 0) AS events FROM (SELECT pos, f, count(*) OVER (PARTITION BY pos // 8, c) AS per FROM w) GROUP BY 1) SELECT events, count(*) AS batches, max(category_most) AS category_most, count_if(events NOT IN (2, 3) OR category_most > 2) AS violations FROM b WHERE n = 8 GROUP BY events")
def microbatch_audit(t):
    """Full batches of eight rows in the curriculum's order: events in each, and the most rows of one category."""
    rows = ordered(t).select(F.floor(F.col("at") / 8).alias("batch"), "category", "family")
    kinds = rows.groupBy("batch", "category", "family").agg(F.count(F.lit(1)).alias("k"))
    b = kinds.groupBy("batch").agg(F.sum("k").alias("n"), F.max("k").alias("most"), F.sum(F.when(F.col("family") == "events", F.col("k")).otherwise(0)).alias("events")).filter("n = 8")
    return b.groupBy("events").agg(F.count(F.lit(1)).alias("batches"), F.max("most").alias("category_most"), F.count_if(~F.col("events").isin(2, 3) | (F.col("most") > 2)).alias("violations"))


@query(f"WITH {NUMBERS}, {ORDERED}, k AS (SELECT CAST(pos // 288 AS BIGINT) AS win, c, count(*) AS n FROM w GROUP BY 1, 2) SELECT win, sum(n)::BIGINT AS n, min(n) AS fewest, max(n) AS most, count(*) = 18 AND min(n) = max(n) AS balanced FROM k GROUP BY win")
def window_balance(t):
    """Windows of 288 rows: every category equally often."""
    k = ordered(t).groupBy(F.floor(F.col("at") / 288).alias("win"), "category").agg(F.count(F.lit(1)).alias("k"))
    return k.groupBy("win").agg(F.sum("k").alias("n"), F.min("k").alias("fewest"), F.max("k").alias("most"), ((F.count(F.lit(1)) == 18) & (F.min("k") == F.max("k"))).alias("balanced"))


@query(f"WITH {NUMBERS}, k AS (SELECT p_partkey, {QUESTION} AS question, {EXPRESSION} AS expression, {ANSWER} AS answer FROM n) SELECT p_partkey, unnest(['expression', 'answer']) AS mode, unnest([concat(question, chr(10), 'Reply with one line: Expression: <expression>'), concat(question, chr(10), 'Reply with one line: Answer: <number>')]) AS prompt, unnest([concat('Expression: ', expression), concat('Answer: ', answer)]) AS target FROM k")
def training_views(t):
    """Two training views of each record."""
    return generate.views(asked_rows(t), {"expression": ("Expression: ", "expression"), "answer": ("Answer: ", "answer")}, {"expression": "Reply with one line: Expression: <expression>", "answer": "Reply with one line: Answer: <number>"})


@query(f"WITH {NUMBERS}, k AS (SELECT p_partkey, c, cycle, {QUESTION} AS question FROM n) SELECT CAST(p_partkey // 12 AS BIGINT) AS packet, count(*) AS n, concat('[', string_agg(concat('{{\"id\":', p_partkey, ',\"question\":\"', question, '\"}}'), ',' ORDER BY p_partkey), ']') AS payload, CAST(strlen(concat('[', string_agg(concat('{{\"id\":', p_partkey, ',\"question\":\"', question, '\"}}'), ',' ORDER BY p_partkey), ']')) + 512 AS DOUBLE) * 0.3 / 1e6 + 900 * 1.2 / 1e6 AS cost_bound FROM k GROUP BY 1")
def request_packets(t):
    """Requests of twelve rows reduced to id and question, as JSON, with an upper bound of their cost by bytes and answer tokens."""
    return generate.requests(asked_rows(t), "p_partkey", 12, input_price=0.3, output_price=1.2, output_tokens=900)


@query(f"WITH {NUMBERS} SELECT p_partkey, concat('{{\"flag\":true,\"p\":\"', {rat('i', '100')}, '\",\"q\":\"', {rat('i', 'j')}, '\",\"unit\":\"minutes\"}}') AS canonical FROM n")
def canonical_semantics(t):
    """Numbers of any spelling as canonical rationals, flags and labels untouched, keys sorted."""
    raw = F.format_string('{"unit":"minutes", "q":"%d/%d", "p":0.%02d, "flag":true}', "i", "j", "i")
    return specs(t).select("p_partkey", Q.canonical_column(raw).getField("text").alias("canonical"))


@query(f"WITH {NUMBERS} SELECT {FAMILY} AS family, count(*) AS n, count(DISTINCT c) AS categories FROM n GROUP BY 1")
def family_dimension(t):
    """Categories joined to a dimension of families."""
    spark_rows = specs(t).select("category")
    dim = generate.family_dimension(spark_rows.sparkSession)
    return spark_rows.join(F.broadcast(dim), "category").groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("category").alias("categories"))  # eighteen rows


@query(f"WITH {NUMBERS}, k AS (SELECT p_partkey, unnest(['both', 'neither', 'exactly_one', 'at_least_one', 'same']) AS category, unnest([i * j, (23 - i) * (23 - j), i * (23 - j) + (23 - i) * j, 529 - (23 - i) * (23 - j), i * j + (23 - i) * (23 - j)]) AS a FROM n) SELECT p_partkey, category, concat('s', p_partkey, '_', category) AS question_id, {rat('a', '529')} AS answer FROM k")
def story_bundles(t):
    """One story of two events as five questions."""
    d = specs(t).select("p_partkey", F.format_string('{"p":"%d/23","p_b":"%d/23"}', "i", "j").alias("semantics"), F.explode(F.array(*map(F.lit, Q.FAMILIES["events"]))).alias("category"))
    x = Q.question_column("category", F.lit("givens_first"), "semantics", F.lit("A_then_B"), F.lit("minutes"))
    return d.select("p_partkey", "category", F.concat(F.lit("s"), F.col("p_partkey").cast("string"), F.lit("_"), "category").alias("question_id"), x.getField("answer").alias("answer"))


#: The stages that take a question apart, and what is asked at each.
STAGES = {
    "extract_mean": "Return only the numerical value of E[X].",
    "extract_variance": "Return only the numerical value of Var(X).",
    "extract_scale": "Return only the multiplier applied to X.",
    "extract_offset": "Return only the constant added after multiplying X.",
    "mean": "Set up E[Y], where Y is the transformed quantity before any squaring.",
    "variance": "Set up Var(Y), where Y is the transformed quantity before any squaring.",
}
HINT = "Use Var(a*X+b)=a**2*Var(X) and E[Y**2]=Var(Y)+E[Y]**2. "
ONLY = "Return only Expression: followed by a fully substituted numerical expression. Keep arithmetic unevaluated."
REQUEST = r"^Find [^.]*\. ?|,? ?Find [^.]*\.$"
MEAN_SQL, VARIANCE_SQL = f"concat(CASE c WHEN {Q.CATEGORIES.index('moment_second')} THEN i ELSE j END, '/23')", f"CASE c WHEN {Q.CATEGORIES.index('moment_second')} THEN j::VARCHAR ELSE concat(j, '/23') END"
STAGE_SQL = {"extract_mean": "mean", "extract_variance": "variance", "extract_scale": "m::VARCHAR", "extract_offset": "(-s)::VARCHAR", "mean": "concat(m, '*', mean, '+', -s)", "variance": "concat(m, '**2*', variance)", "original": "expression", "hinted": "expression"}
PROMPT_SQL = {k: f"concat(story, chr(10), {quoted(v)}" + ("" if k.startswith("extract") else f", chr(10), {quoted(ONLY)}") + ")" for k, v in STAGES.items()} | {"original": f"concat(question, chr(10), {quoted(ONLY)})", "hinted": f"concat({quoted(HINT)}, question, chr(10), {quoted(ONLY)})"}


@query(f"WITH {NUMBERS}, k AS (SELECT p_partkey, m, s, {MEAN_SQL} AS mean, {VARIANCE_SQL} AS variance, {QUESTION} AS question, {EXPRESSION} AS expression FROM n WHERE c IN ({Q.CATEGORIES.index('moment_second')}, {Q.CATEGORIES.index('poisson_scaled')})), q AS (SELECT *, regexp_replace(question, '{REQUEST}', '') AS story FROM k) SELECT p_partkey, unnest([{', '.join(map(quoted, STAGE_SQL))}]) AS stage, unnest([{', '.join(PROMPT_SQL[k] for k in STAGE_SQL)}]) AS prompt, unnest([{', '.join(STAGE_SQL.values())}]) AS expression FROM q")
def diagnostic_probes(t):
    """A question about a transformed quantity as eight prompts that isolate what fails: each given number alone, the mean, the variance,
    the question itself and with a hint. Sub-tasks keep the story without its request."""
    x = asked_rows(t).filter(F.col("category").isin("moment_second", "poisson_scaled"))
    given = lambda name: F.get_json_object("semantics", f"$.{name}")
    mean, scale, offset = given("mean"), given("scale"), given("offset")
    variance = F.coalesce(given("variance"), mean)
    story = F.regexp_replace("question", REQUEST, "")
    expressions = {"extract_mean": mean, "extract_variance": variance, "extract_scale": scale, "extract_offset": offset, "mean": F.concat(scale, F.lit("*"), mean, F.lit("+"), offset), "variance": F.concat(scale, F.lit("**2*"), variance)}
    only = F.lit("\n" + ONLY)
    stages = [F.struct(F.lit(k).alias("stage"), F.concat(story, F.lit("\n" + request), F.lit("") if k.startswith("extract") else only).alias("prompt"), expressions[k].alias("expression")) for k, request in STAGES.items()]
    whole = [F.struct(F.lit(k).alias("stage"), F.concat(F.lit(start), "question", only).alias("prompt"), F.col("expression")) for k, start in (("original", ""), ("hinted", HINT))]
    return x.select("p_partkey", F.explode(F.array(*stages, *whole)).alias("x")).select("p_partkey", "x.*")


@query(f"WITH {NUMBERS}, f AS (SELECT p_partkey, unnest([1, 1, 10, 10]) AS factor, unnest(['original', 'paraphrase', 'original', 'paraphrase']) AS wording, m, j FROM n) SELECT p_partkey, factor, wording, CASE wording WHEN 'original' THEN concat('X has a Poisson distribution with mean (', {rat('j * factor', '23')}, '). Define Y=(', m, ')*X+(0). Find Var(Y).') ELSE concat('Find Var(Y). Given X is Poisson with mean (', {rat('j * factor', '23')}, ') and Y=(', m, ')*X+(0).') END AS question, {rat('m * m * j * factor', '23')} AS answer FROM f")
def perturbation_grid(t):
    """Numbers by wording, two by two: each record at two magnitudes in two wordings."""
    d = specs(t).select("p_partkey", "j", "m", F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.lit(w).alias("wording")) for f in (1, 10) for w in ("original", "paraphrase")])).alias("v")).select("p_partkey", "j", "m", "v.*")
    s = Q.canonical_column(F.format_string('{"mean":"%d/23","scale":"%d","offset":"0"}', F.col("j") * F.col("factor"), "m")).getField("text")
    x = Q.question_column(F.lit("poisson_scaled"), F.when(F.col("wording") == "original", "givens_first").otherwise("target_first"), s, F.lit("A_then_B"), F.lit("minutes"))
    return d.select("p_partkey", "factor", "wording", x.alias("x")).select("p_partkey", "factor", "wording", "x.question", "x.answer")


@query(f"WITH {NUMBERS} SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'exactly_one' WHEN 1 THEN 'process_variance' ELSE 'uniform_conditional' END AS category, CASE p_partkey % 3 WHEN 0 THEN {rat('i * (23 - j) + (23 - i) * j', '529')} WHEN 1 THEN {rat('i * m', '4')} ELSE {rat('4 * s + 2 * j + 1', '4')} END AS answer FROM n")
def legacy_bindings(t):
    """Older records name their numbers otherwise (miss chances, seconds, waits): adapted to semantics, then answered."""
    k = F.col("p_partkey") % 3
    track = F.when(k == 0, "detectors").when(k == 1, "poisson_time").otherwise("uniform_time")
    d = specs(t).select("p_partkey", track.alias("track"), F.create_map(F.lit("miss_a"), F.format_string("%d/23", 23 - F.col("i")), F.lit("miss_b"), F.format_string("%d/23", 23 - F.col("j")), F.lit("rate"), F.col("i").cast("string"), F.lit("seconds"), (15 * F.col("m")).cast("string"), F.lit("lower"), F.col("s").cast("string"), F.lit("upper"), (F.col("s") + F.col("j")).cast("string"), F.lit("waited_seconds"), (60 * F.col("s") + 30).cast("string")).alias("bindings"))
    return generate.adapted(d).select("p_partkey", "category", "answer")


STYLE = "CASE style WHEN 'direct_definition' THEN text WHEN 'conditions_first' THEN concat('Conditions first: ', text) WHEN 'quantity_first' THEN CASE WHEN len(sen) > 1 THEN concat(rtrim(sen[-1], '.'), '. Given: ', rtrim(array_to_string(sen[:-2], '. '), '.'), '.') ELSE concat('Requested quantity first. Given: ', text) END WHEN 'operational_story' THEN concat('An analyst records this operating condition: ', replace(replace(text, 'Set up', 'Give one numerical expression for'), 'what is', 'determine')) WHEN 'validation_compact' THEN concat('Write one executable expression using only these data. ', replace(replace(text, 'Set up', 'Represent'), 'find', 'represent')) ELSE CASE WHEN len(sen) > 1 THEN concat('Requested result: ', rtrim(sen[-1], '.'), '. Conditions: ', rtrim(array_to_string(sen[:-2], '. '), '.'), '.') ELSE concat('Requested result: ', text) END END"


@query(f"WITH b AS (SELECT item_id, text, list_filter(list_transform(string_split(text, '. '), lambda x: trim(x)), lambda x: x <> '') AS sen, unnest(['direct_definition', 'conditions_first', 'quantity_first', 'operational_story', 'validation_compact', 'validation_reverse']) AS style FROM benchmark) SELECT item_id, style, {STYLE} AS shown FROM b")
def surface_styles(t):
    """Six wordings of a text by its sentences."""
    return t("benchmark").select("item_id", "text", F.explode(F.array(*map(F.lit, text.STYLES))).alias("style")).select("item_id", "style", text.surface(F.col("text"), F.col("style")).alias("shown"))


@query("SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]+/', '') AS shown FROM pages")
def display_paths(t):
    """Paths shown from their root; what lies elsewhere stays as it is."""
    return t("pages").select("page_id", text.relative_to(F.col("url"), r"^[a-z]+://[^/]+/").alias("shown"))
