"""Envelopes, transports, exact algebra and the grading of responses to questions of the closed grammar."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import algebra, domain, exact, parsing, text
from ..functions import questions as Q
from ..operators import core, evidence, generate
from ..operators.shared import Scratch
from ._registry import query
from .curriculum import ANSWERS, CATEGORY, EXPRESSION, NUMBERS, QUESTION, N, R, asked_rows, cases, measured, quoted, rat


def by_row(column, texts, k):
    """The text of each row's kind, with {n} the row's number."""
    raw = F.element_at(F.array(*map(F.lit, texts)), (k + 1).cast("int"))
    return F.replace(raw, F.lit("{n}"), column.cast("string"))


def sql_by_row(n: str, k: str, outcomes) -> str:
    """CASE k of literals (None is null) with {n} filled in."""
    return f"CASE {k} " + " ".join(f"WHEN {i} THEN " + ("NULL" if x is None else f"replace({quoted(x)}, '{{n}}', CAST({n} AS VARCHAR))") for i, x in enumerate(outcomes)) + " END"


# -- envelopes (raw text, what comes of it)
A = '{"question_id":"q{n}","expression":"1+{n}"}'
ENVELOPES = [
    ('{"answers":[' + A + "]}", "1+{n}"),
    ('{"answers":[],"answers":[' + A + "]}", None),
    ('{"answers":[' + A + "]}}", "1+{n}"),
    ('{"answers":[' + A + "]}  }", "1+{n}"),
    ('{"answers":[]}', None),
    ('{"answers":[{"question_id":"q{n}","expression":"  "}]}', None),
    ('{"required_response":{"answers":[' + A + "]}}", "1+{n}"),
    ('{"answers":[' + A + '],"required_response":{"answers":[' + A + "]}}", None),
    ('{"answers":[' + A + "]} and {n}", None),
    ('{"answers":[{"question_id":"q{n}","expression":"<{n}>"}]}', None),
    ('{"answers":[{"question_id":"zz{n}","expression":"{n}"}]}', None),
    ('{"answers":[' + A + "," + A + "]}", None),
    ('[{"question_id":"q{n}","expression":"1"}]', None),
]


@query(f"SELECT event_id, {sql_by_row('event_id', f'event_id % {len(ENVELOPES)}', [x for _, x in ENVELOPES])} AS expression, CASE WHEN event_id % {len(ENVELOPES)} IN (2, 3, 6) THEN 1 ELSE 0 END AS n_repairs FROM events")
def envelope_parse(t):
    """Strict answer envelopes: duplicate keys, needless braces, empty lists, blanks, nesting, unknown ids, trailing text."""
    raw = by_row(F.col("event_id"), [a for a, _ in ENVELOPES], F.col("event_id") % len(ENVELOPES))
    x = core.spread(t("events")).select("event_id", exact.envelope_column(raw, F.array(F.format_string("q%d", "event_id"))).alias("x"))
    return x.select("event_id", F.get("x.items", F.lit(0))["expression"].alias("expression"), F.size("x.repairs").alias("n_repairs"))


TWO = '{"question_id":"a{n}","expression":"{n}"},{"question_id":"b{n}","expression":"{n}*2"}'
STRICT = [
    ('{"answers":[' + TWO + "]}", 2),
    ('{"answers":[{"question_id":"b{n}","expression":"{n}*2"},{"question_id":"a{n}","expression":"{n}"}]}', 0),
    ('{"answers":[' + TWO + "]}}", 0),
    ('{"answers":[{"question_id":"a{n}","expression":"{n}"}]}', 0),
    ('{"answers":[{"question_id":"a{n}","expression":" {n}"},{"question_id":"b{n}","expression":"{n}"}]}', 0),
    ('  {"answers":[' + TWO + "]}\n", 2),
    ('{"answers":[' + TWO + '],"note":"{n}"}', 0),
]


@query(f"SELECT p_partkey, CASE p_partkey % {len(STRICT)} " + " ".join(f"WHEN {i} THEN {n}" for i, (_, n) in enumerate(STRICT)) + " END AS n_items FROM part")
def strict_envelopes(t):
    """The strictest form: expected ids in their order, trimmed lines, nothing else."""
    raw = by_row(F.col("p_partkey"), [a for a, _ in STRICT], F.col("p_partkey") % len(STRICT))
    ids = F.array(F.format_string("a%d", "p_partkey"), F.format_string("b%d", "p_partkey"))
    return core.spread(t("part")).select("p_partkey", F.size(exact.strict_envelope_column(raw, ids).getField("items")).alias("n_items"))


INNER = '{"intermediates":{"s":"{n}"},"answers":[' + A + "]}"
ECHOES = [
    (INNER, "1+{n}"),
    ('{"question_id":"q{n}","question":"What of {n}?","output_structure":' + INNER + "}", "1+{n}"),
    ('{"question_id":"q{n}","question":"What of it?","output_structure":' + INNER + "}", None),
    ('{"question_id":"q0{n}","question":"What of {n}?","output_structure":' + INNER + "}", None),
    (INNER + "}", "1+{n}"),
    ('{"answers":[' + A + "]}", None),
]


@query(f"SELECT p_partkey, {sql_by_row('p_partkey', f'p_partkey % {len(ECHOES)}', [x for _, x in ECHOES])} AS expression FROM part")
def echo_envelopes(t):
    """Structures echoed around an answer are unwrapped only if id and question are the source's."""
    raw = by_row(F.col("p_partkey"), [a for a, _ in ECHOES], F.col("p_partkey") % len(ECHOES))
    x = exact.echo_column(raw, F.format_string("q%d", "p_partkey"), F.format_string("What of %d?", "p_partkey"))
    return core.spread(t("part")).select("p_partkey", F.get(x.getField("items"), F.lit(0))["expression"].alias("expression"))


FENCE = "```"
TRANSPORTS = [
    ("Expression: {n}/2", "stop", "{n}/2"),
    ("{n}/3 + 1", "stop", "{n}/3 + 1"),
    (FENCE + 'json\n{"answers":[' + A + "]}\n" + FENCE, "stop", "1+{n}"),
    ('{"answers":[' + A + "]}", "length", None),
    ("I would say {n}", "stop", None),
    (FENCE + '{"answers":[' + A + "]}" + FENCE + " or " + FENCE + "{n}" + FENCE, "stop", None),
    ("Answer {n}\n" + FENCE + '{"answers":[' + A + "]}" + FENCE, "stop", None),
    (FENCE + '{"answers":[' + A + "]}", "stop", None),
]


@query(f"SELECT p_partkey, {sql_by_row('p_partkey', f'p_partkey % {len(TRANSPORTS)}', [x for _, _, x in TRANSPORTS])} AS expression FROM part")
def transports(t):
    """One answer in a labelled line, bare, fenced or in JSON; cut, unpaired or competing ones are refused."""
    k = F.col("p_partkey") % len(TRANSPORTS)
    raw, finish = by_row(F.col("p_partkey"), [a for a, _, _ in TRANSPORTS], k), by_row(F.col("p_partkey"), [f for _, f, _ in TRANSPORTS], k)
    x = exact.transport_column(raw, finish, F.array(F.format_string("q%d", "p_partkey")))
    return core.spread(t("part")).select("p_partkey", F.get(x.getField("items"), F.lit(0))["expression"].alias("expression"))


FENCED = [
    ("Here:\n" + FENCE + "json\nx{n}\n" + FENCE + "\n", "x{n}"),
    (FENCE + "a{n}" + FENCE + " and " + FENCE + "b" + FENCE, None),
    (FENCE + "a{n}" + FENCE + " Answer: b", None),
    (FENCE + "a{n}" + FENCE + " and " + FENCE + "b", None),
    ("no block {n}", None),
    ("  " + FENCE + "y{n}" + FENCE, "y{n}"),
]


@query(f"SELECT event_id, {sql_by_row('event_id', f'event_id % {len(FENCED)}', [x for _, x in FENCED])} AS block FROM events")
def fenced_payload(t):
    """The only complete fenced block; unpaired marks or an answer outside give nothing."""
    raw = by_row(F.col("event_id"), [a for a, _ in FENCED], F.col("event_id") % len(FENCED))
    return t("events").select("event_id", parsing.fenced_block(raw).alias("block"))


STRICT_ANSWERS = [
    ("So.\nAnswer: {n}/4", "{n}/4"),
    ("Answer: {n}\nAnswer: {n}", None),
    ("Answer: {n}.50  ", "{n}.50"),
    ("Answer: about {n}", None),
    ("the sum = {n}", None),
    ("Answer: 2/0", "2/0"),
]


@query(f"WITH a AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS n, p_partkey % {len(STRICT_ANSWERS)} AS k, {sql_by_row('p_size', f'p_partkey % {len(STRICT_ANSWERS)}', [x for _, x in STRICT_ANSWERS])} AS predicted FROM part) SELECT p_partkey, coalesce(predicted, 'INVALID') AS predicted, k = 0 AS correct, k = 0 AND n % 2 = 1 AS reduced_correct, k IN (0) AS reviewed_correct FROM a")
def strict_answers(t):
    """A single Answer: line of exact value; for questions of reducing, in lowest terms too; without a line, the tail is reviewed."""
    raw = by_row(F.col("p_size"), [a for a, _ in STRICT_ANSWERS], F.col("p_partkey") % len(STRICT_ANSWERS))
    x = parsing.strict_answer_column(raw, F.format_string("%d/4", "p_size"), F.lit("value"))
    r = parsing.strict_answer_column(raw, F.format_string("%d/4", "p_size"), F.lit("reduce"))
    return core.spread(t("part")).select("p_partkey", x.getField("predicted").alias("predicted"), x.getField("correct").alias("correct"), r.getField("correct").alias("reduced_correct"), x.getField("reviewed_correct").alias("reviewed_correct"))


OBJECTS = [
    ('{"k": {n}}', "{n}"),
    ('Sure: {"k": {n}} done', "{n}"),
    ('{"k": 1, "k": {n}}', None),
    ("no json {n}", None),
    ('{"j": {n}}', None),
    ('{"k": {n}', None),
    ('[{"k": {n}}]', "{n}"),
    ('[{"k": 1}, {"k": {n}}]', None),
    ('{"a": {"b": "}"}, "k": {n}}', "{n}"),
    ('{"k": {n}} or {"k": 2}', None),
    ("```json\n{\"k\": {n}}\n```", "{n}"),
]


@query(f"SELECT event_id, CAST({sql_by_row('event_id', f'event_id % {len(OBJECTS)}', [x for _, x in OBJECTS])} AS BIGINT) AS k FROM events")
def json_fallback(t):
    """JSON, JSON within prose or an array, duplicate keys, cut objects, two objects, none."""
    raw = by_row(F.col("event_id"), [a for a, _ in OBJECTS], F.col("event_id") % len(OBJECTS))
    return t("events").select("event_id", parsing.json_object(raw, "k bigint").getField("k").alias("k"))


BINDINGS = [
    ("Bindings: p = 1/2 ; q={n}\nExpression: p*q", True, 2),
    ("Bindings: p=1; p={n}\nExpression: p", False, 2),
    ("Bindings: n={n}\nExpression: n", True, 1),
    ("Bindings: p={n};\nExpression: p", True, 1),
    ("Bindings: ={n}\nExpression: 1", False, 1),
    ("Bindings: p {n}\nExpression: p", False, 1),
    ("Bindings:\nExpression: {n}", False, 0),
    ("Expression: {n}", False, 0),
    ("so\nBindings: a=1;b=2;c={n}\nExpression: a", True, 3),
]


@query(f"SELECT p_partkey, CASE p_partkey % {len(BINDINGS)} " + " ".join(f"WHEN {i} THEN {v}" for i, (_, v, _) in enumerate(BINDINGS)) + f" END AS valid, CASE p_partkey % {len(BINDINGS)} " + " ".join(f"WHEN {i} THEN {n}" for i, (_, _, n) in enumerate(BINDINGS)) + " END AS n FROM part")
def binding_lines(t):
    """Bindings of a response: a name given twice, without value or without name makes the line invalid, not an error."""
    x = parsing.bindings(by_row(F.col("p_size"), [a for a, _, _ in BINDINGS], F.col("p_partkey") % len(BINDINGS)))
    return core.spread(t("part")).select("p_partkey", x.getField("valid").alias("valid"), x.getField("n").alias("n"))


TEACHER = [
    ('{"answer_letter":"B","explanation":"e{n}"}', "B", "e{n}", None),
    ('```json\n{"answer_letter":"C","common_mistake":"m{n}"}\n```', "C", None, "m{n}"),
    ("Answer: A\n\nSince so {n}. The common mistake is the mean.", "A", "Since so {n}.", "The common mistake is the mean."),
    ("Answer: B\nSo {n}. One common misconception: A common mistake.", "B", "So {n}.", "One common misconception: A common mistake."),
    ("I think so {n}", None, None, None),
    ("Answer: E\nbecause {n}. A common mistake.", None, None, None),
    ("  Answer:\nD\n {n} holds. A common mistakes", None, None, None),
    ('{"answer_letter":"B"', None, None, None),
    ("Answer: C\nno mistake named {n}", None, None, None),
    ("[{n}]", None, None, None),
    ("```\nAnswer: D\n{n}\nis it. A common mistake here\n```", "D", "{n}\nis it.", "A common mistake here"),
]


@query(f"SELECT event_id, {sql_by_row('event_id', f'event_id % {len(TEACHER)}', [a for _, a, _, _ in TEACHER])} AS answer, {sql_by_row('event_id', f'event_id % {len(TEACHER)}', [e for _, _, e, _ in TEACHER])} AS explanation, {sql_by_row('event_id', f'event_id % {len(TEACHER)}', [m for _, _, _, m in TEACHER])} AS misconception FROM events")
def teacher_answers(t):
    """Letter, explanation and misconception from JSON, a fenced block or plain lines."""
    raw = by_row(F.col("event_id"), [a for a, _, _, _ in TEACHER], F.col("event_id") % len(TEACHER))
    x = t("events").select("event_id", text.teacher_fields(raw).alias("x"))
    return x.select("event_id", F.col("x.answer_letter").alias("answer"), "x.explanation", F.col("x.common_mistake").alias("misconception"))


RAW = [
    ("Expression: {n}/2", "{n}/2"),
    ("expression :{n}+1", "{n}+1"),
    ("{n} * (1 - 1/2)", "{n} * (1 - 1/2)"),
    ("{n}^2", None),
    ("x = {n}", None),
    ("{n}.5", None),
    ("{n}\n{n}", None),
    ("comb({n}, 1)", "comb({n}, 1)"),
    ("gcd({n}, 2)", None),
    ("{n}/0", None),
    ("  Expression: {n}  ", "{n}"),
    ("Expression: Expression: {n}", None),
    ("(1/2)*{n} # half", None),
]


@query(f"SELECT p_partkey, {sql_by_row('p_size', f'p_partkey % {len(RAW)}', [x for _, x in RAW])} AS expression FROM part")
def raw_contracts(t):
    """Responses that are one unchanged expression, with an optional label; all else is refused."""
    raw = by_row(F.col("p_size"), [a for a, _ in RAW], F.col("p_partkey") % len(RAW))
    return core.spread(t("part")).select("p_partkey", algebra.raw_column(raw).getField("expression").alias("expression"))


# -- algebra
CHAINS = [
    ("{n}/4 = {n}/8 + {n}/8", True),
    ("{n} + 1 = {n}", False),
    ("{n}", False),
    ("2*{n} = {n} + {n} = {n}*2 = 4*{n}/2", True),
    ("{n} = = {n}", False),
    ("{n} = x", False),
    ("{n}**2 = {n}*{n}", True),
    ("1/3 = 0.333{n}", False),
    ("{n}/{n} = 1 = comb({n}, 0)", True),
]


@query(f"SELECT p_partkey, CASE p_partkey % {len(CHAINS)} " + " ".join(f"WHEN {i} THEN {ok}" for i, (_, ok) in enumerate(CHAINS)) + " END AS ok FROM part")
def exact_chains(t):
    """Every step of a chain has the same exact value; a single step, a gap or a name is no chain."""
    raw = by_row(F.col("p_size"), [a for a, _ in CHAINS], F.col("p_partkey") % len(CHAINS))
    return core.spread(t("part")).select("p_partkey", parsing.chain_column(raw).getField("ok").alias("ok"))


@query(f"SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN {rat('CAST(p_size AS BIGINT)', '3')} WHEN 3 THEN {rat('CAST(p_size AS BIGINT) * p_size', '4')} WHEN 4 THEN CAST(0 AS VARCHAR) END AS root FROM part")
def exact_roots(t):
    """Exact roots of rationals; what is no square of one, or negative, has none."""
    raw = by_row(F.col("p_size"), ["{n}*{n}/9", "2*({n}*{n}+1)**2", "-{n}", "({n}*{n}/4)**2", "{n}-{n}"], F.col("p_partkey") % 5)
    return core.spread(t("part")).select("p_partkey", parsing.square_root_column(raw).getField("value").alias("root"))


RATIOS = [("a*{n}/(b*c)", "a,{n}", "b,c"), ("({n}/c)/(b/a)", "a,{n}", "b,c"), ("x+{n}", "sum({n},x)", ""), ("{n}*(x/(y/(z/2)))", "x,z,{n}", "2,y"), ("{n}/", None, None)]


@query(f"SELECT p_partkey, list_sort(string_split({sql_by_row('p_size', f'p_partkey % {len(RATIOS)}', [a for _, a, _ in RATIOS])}, ',')) AS parts, {sql_by_row('p_size', f'p_partkey % {len(RATIOS)}', [b for _, _, b in RATIOS])} AS below FROM (SELECT * FROM part WHERE p_size > 2) WHERE p_partkey % {len(RATIOS)} <> 2".replace("list_sort(string_split(", "array_to_string(list_sort(string_split(").replace(", ',')) AS parts", ", ',')), ',') AS parts"))
def ratio_forms(t):
    """Products and quotients as multisets above and below the line, in any nesting."""
    k = F.col("p_partkey") % len(RATIOS)
    x = algebra.ratio_column(by_row(F.col("p_size"), [a for a, _, _ in RATIOS], k))
    rows = core.spread(t("part")).filter(f"p_size > 2 and p_partkey % {len(RATIOS)} <> 2")
    return rows.select("p_partkey", F.array_join(x.getField("above"), ",").alias("parts"), F.array_join(x.getField("below"), ",").alias("below"))


@query(f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN {rat('CAST(p_size AS BIGINT)', '8')} WHEN 1 THEN {rat('CAST(p_size AS BIGINT) * p_size + 3', '2')} WHEN 2 THEN NULL ELSE {rat('25 * CAST(p_size AS BIGINT)', '10')} END AS value FROM part")
def old_calculator(t):
    """The older calculator's notation: decimals, ^, multiplication and division signs, a superscript two."""
    raw = by_row(F.col("p_size"), ["0.5 × {n} ÷ 2^2", "({n}² + 3) ÷ 2", "{n}^9", "2.5×{n}"], F.col("p_partkey") % 4)
    return core.spread(t("part")).select("p_partkey", algebra.old_column(raw).getField("value").alias("value"))


@query(f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN {rat('CAST(p_size AS BIGINT) * (p_size + 1)', '6')} WHEN 1 THEN CAST(3 * p_size AS VARCHAR) WHEN 2 THEN NULL ELSE CAST(p_size + 2 AS VARCHAR) END AS value FROM part")
def substituted_bindings(t):
    """Expressions in the names a response has bound itself; roots must be rational, unknown names are refused."""
    k = F.col("p_partkey") % 4
    raw = by_row(F.col("p_size"), ["a*b/6", "sqrt(9*a^2)", "a*c", "a+4**(1/2)"], k)
    env = F.format_string('{"a":"%d","b":"%d+1"}', "p_size", "p_size")
    return core.spread(t("part")).select("p_partkey", algebra.substitute_column(raw, env).getField("value").alias("value"))


COUNTS = {"neither": 3, "at_least_one": 4, "exactly_one": 3, "same": 3, "uniform_conditional": 5, "interval": 7, "poisson_second": 3, "process_second": 3, "process_variance": 2, "process_scaled": 2}


@query(f"WITH {NUMBERS} SELECT {CATEGORY} AS category, count(*) AS questions, sum(CASE WHEN c = 16 THEN 2 + CAST(p_partkey % (j % 8 + 3) IN (0, j % 8 + 2) AS INT) + CAST(p_partkey % (j % 8 + 3) = 1 AS INT) + CAST(p_partkey % (j % 8 + 3) = j % 8 + 1 AS INT) ELSE {cases(lambda c: str(COUNTS.get(c, 1)))} END)::BIGINT AS refs, count(*) AS credited FROM n GROUP BY 1")
def reference_bank(t):
    """Reviewed equivalent expressions as rows; a response is credited by a semi-join on question and folded form."""
    question = ["category", "semantics", "unit"]
    asked = core.spread(asked_rows(t).groupBy(*question, "expression").agg(F.count(F.lit(1)).alias("n")))  # questions asked of many rows are folded once
    own = algebra.folded_column(F.concat(F.lit("0+"), "expression")).getField("form")
    asked = Scratch(asked.sparkSession, "bank").put(asked.select(*question, "n", own.alias("form"), Q.references_column(*question).getField("references").alias("refs")), "questions")
    bank = core.spread(asked.select(*question, "n", F.explode("refs").alias("ref"))).select(*question, "n", algebra.folded_column("ref").getField("form").alias("form"))
    credited = asked.join(bank.select(*question, "form"), [*question, "form"], "left_semi").groupBy("category").agg(F.sum("n").alias("credited"))
    questions = asked.filter(F.size("refs") > 0).groupBy("category").agg(F.sum("n").alias("questions"))
    counts = bank.groupBy("category").agg(F.sum("n").alias("refs"))
    return questions.join(counts, "category").join(credited, "category").select("category", "questions", "refs", "credited")


@query("SELECT p_partkey, p_partkey % 4 IN (0, 3) AS ok, CASE p_partkey % 4 WHEN 1 THEN 'b' WHEN 2 THEN 'a' END AS first_wrong FROM part")
def intermediate_steps(t):
    """Named intermediate quantities, each against its expected value; a missing one fails."""
    steps = by_row(F.col("p_size"), ['{"a":"{n}+1","b":"2*{n}"}', '{"a":"1+{n}","b":"2*{n}+1"}', '{"b":"2*{n}"}', '{"a":"{n}+2-1","b":"{n}+{n}","c":"0"}'], F.col("p_partkey") % 4)
    x = algebra.steps_column(steps, F.format_string('{"a":"%d+1","b":"%d*2"}', "p_size", "p_size"))
    return core.spread(t("part")).select("p_partkey", x.getField("ok").alias("ok"), x.getField("first_wrong").alias("first_wrong"))


# -- grading
def responses(rows):
    """Responses of eight kinds to questions."""
    k = F.col("p_partkey") % 8
    first = F.get(Q.traps_column("category", "semantics", "unit").getField("traps"), F.lit(0))["expression"]
    e = F.col("expression")
    given = F.array_join(F.transform(F.map_entries(F.from_json("semantics", "map<string,string>")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), "; ")
    raw = (
        F.when(k == 0, F.concat(F.lit("Expression: "), e))
        .when(k == 1, F.concat(F.lit("0+1*("), e, F.lit(")")))
        .when(k == 2, F.concat(F.lit("Bindings: "), given, F.lit("\nExpression: "), e))
        .when(k == 3, F.concat(F.lit("Expression: "), first))
        .when(k == 4, F.concat(F.lit("x = "), e, F.lit("; so the result holds")))
        .when(k == 5, F.lit("I think it is likely."))
        .when(k == 6, F.concat(F.lit("Expression: "), "answer"))
        .otherwise(F.concat(e, F.lit("\n"), e, F.lit("+1")))
    )
    return rows.withColumn("k", k).withColumn("raw", raw)


def event_rows(t):
    """The five questions on two events."""
    return asked_rows(t).filter("family = 'events'")


EVENT_TRAPS = cases(lambda c: f"abs(({measured(next(iter(Q.MISCONCEPTIONS[c].values())), c)}) - CAST({ANSWERS[c][0]} AS DOUBLE) / {ANSWERS[c][1]}) < 1e-9" if c in Q.FAMILIES["events"] else "FALSE")
RESPONSES = f"r AS (SELECT p_partkey, c, p_partkey % 8 AS k, {EVENT_TRAPS} AS hit FROM n WHERE c < 5)"


# where the first misconception has the right value, where even a reviewed structure, and where the bare answer has one
TRAP_VALUES = {**{c: "hit" for c in Q.FAMILIES["events"]}, **dict.fromkeys(("moment_variance", "poisson_scaled", "process_scaled"), "m = 1")}
TRAP_FORMS = {"process_variance": "m = 4", "binomial": f"{R} IN (0, {N})"}
ANSWER_FORMS = {"poisson_variance": "TRUE", "process_variance": "i = 1 OR m = 4", "interval": "s = j"}
GRADED = f"r AS (SELECT *, p_partkey % 8 AS k, {EVENT_TRAPS} AS hit FROM n), g AS (SELECT p_partkey, k, CASE WHEN k IN (0, 1, 2) OR k = 3 AND {cases(lambda c: TRAP_FORMS.get(c, 'FALSE'))} OR k = 6 AND {cases(lambda c: ANSWER_FORMS.get(c, 'FALSE'))} THEN 'accepted' WHEN k IN (4, 5) THEN 'non_executable_or_format' WHEN k = 6 OR k = 3 AND {cases(lambda c: TRAP_VALUES.get(c, 'FALSE'))} THEN 'equivalence_pending' ELSE 'mathematical_error' END AS outcome FROM r)"


@query(f"WITH {NUMBERS}, {GRADED} SELECT p_partkey, outcome, outcome = 'accepted' AS primary_correct, k IN (0, 1, 3, 6) AS whole_raw_executable, k IN (0, 3, 6) AS strict_one_line, k = 2 AS bindings_match FROM g")
def graded_responses(t):
    """Reviewed structure and exact value make an answer correct; an equal value of another structure is pending; an unreadable last
    line never selects an earlier result."""
    x = responses(asked_rows(t)).select("p_partkey", algebra.grade_column("raw", "category", "semantics", "unit").alias("x"))
    return x.select("p_partkey", "x.outcome", "x.primary_correct", "x.whole_raw_executable", "x.strict_one_line", "x.bindings_match")


@query(f"WITH {NUMBERS}, {RESPONSES} SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'parse_or_format_error' WHEN k = 1 THEN 'accepted' WHEN k IN (0, 2, 3, 4, 5, 6, 7) THEN 'parse_or_format_error' END AS classification, p_partkey % 5 <> 0 AND k = 1 AS accepted, CASE WHEN p_partkey % 5 = 0 THEN 'cut' WHEN k IN (2, 7) THEN 'line' WHEN k <> 1 THEN 'contract' END AS reason FROM r")
def gate_classes(t):
    """The four gates of an answer field: cut responses, more than a line, and labels or prose in the field are never graded."""
    finish = F.when(F.col("p_partkey") % 5 == 0, "length").otherwise("stop")
    x = responses(event_rows(t)).select("p_partkey", algebra.gated_column("raw", finish, "category", "semantics", "unit").alias("x"))
    r = F.col("x.reason")
    short = F.when(r == "finish_reason_not_stop", "cut").when(r == "not_one_trimmed_line", "line").when(r.isNotNull(), "contract")
    return x.select("p_partkey", "x.classification", "x.accepted", short.alias("reason"))


@query(f"WITH {NUMBERS}, {RESPONSES}, g AS (SELECT p_partkey, k, k IN (0, 1, 2) AS ok, k IN (1, 3) AS steps_ok, p_partkey % 9 = 0 AS cut FROM r) SELECT p_partkey, CASE WHEN cut THEN 'truncation' WHEN NOT ok THEN 'answer_error' WHEN NOT steps_ok THEN 'intermediate_error' ELSE 'accepted' END AS verdict FROM g")
def arm_judgements(t):
    """A judge that adds cut responses and wrong intermediates to wrong answers: the first that applies."""
    g = algebra.grade_column("raw", "category", "semantics", "unit").getField("primary_correct")
    steps = algebra.steps_column(F.when(F.col("k").isin(1, 3), F.format_string('{"s":"%d+1"}', "i")).otherwise(F.lit('{"s":"0"}')), F.format_string('{"s":"1+%d"}', "i")).getField("ok")
    rules = [("truncation", F.col("p_partkey") % 9 != 0), ("answer_error", g), ("intermediate_error", steps)]
    return responses(event_rows(t)).select("p_partkey", F.coalesce(text.first_failure(rules), F.lit("accepted")).alias("verdict"))


def mode_sql() -> str:
    out = []
    for k, c in enumerate(Q.CATEGORIES[:5]):
        names = list(Q.MISCONCEPTIONS[c])
        right = f"CAST({ANSWERS[c][0]} AS DOUBLE) / {ANSWERS[c][1]}"
        v = [f"({measured(Q.MISCONCEPTIONS[c][n], c)})" for n in names]
        got = f"CASE p_partkey % 4 WHEN 0 THEN {right} WHEN 1 THEN {v[0]} WHEN 2 THEN {v[1]} ELSE i / 23 + 7 END"
        out.append(f"SELECT p_partkey, {quoted(names[0])} AS n0, {quoted(names[1])} AS n1, {got} AS got, {right} AS gold, {v[0]} AS v0, {v[1]} AS v1 FROM n WHERE c = {k}")
    return " UNION ALL ".join(out)


@query(f"WITH {NUMBERS}, v AS ({mode_sql()}), h AS (SELECT *, abs(got - gold) < 1e-9 AS g, abs(got - v0) < 1e-9 AS a, abs(got - v1) < 1e-9 AS b FROM v) SELECT CASE WHEN g THEN 'correct' WHEN a AND b THEN 'ambiguous' WHEN a THEN n0 WHEN b THEN n1 ELSE 'other' END AS mode, count(*) AS n FROM h GROUP BY 1")
def error_modes(t):
    """Which named misconception a response's value equals: the only one, else ambiguous or other."""
    rows = asked_rows(t).filter("family = 'events'")
    k = F.col("p_partkey") % 4
    template = lambda i: F.create_map(*[x for c in Q.FAMILIES["events"] for x in (F.lit(c), F.lit(list(Q.MISCONCEPTIONS[c].values())[i]))])[F.col("category")]
    fill = lambda c: F.replace(F.replace(c, F.lit("{p}"), F.get_json_object("semantics", "$.p")), F.lit("{p_b}"), F.get_json_object("semantics", "$.p_b"))
    response = F.when(k == 0, F.col("answer")).when(k == 1, fill(template(0))).when(k == 2, fill(template(1))).otherwise(F.format_string("%d/23+7", "i"))
    return rows.select(algebra.mode_column(response, "category", "semantics", "unit").getField("mode").alias("mode")).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


# -- joins of answers and questions
ATTEMPTS = "a AS (SELECT user_id, event_id, CAST(user_id * 7 % (SELECT count(*) FROM part) AS BIGINT) + 1 AS q, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, value, event_type FROM events)"


def attempts(t):
    n = t("part").agg(F.count(F.lit(1)).alias("n"))
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t("events").select("user_id", "event_id", "value", "event_type", order.alias("attempt")).join(F.broadcast(n)).select("user_id", "event_id", "value", "event_type", "attempt", (F.col("user_id") * 7 % F.col("n") + 1).alias("q"))  # one row


@query(f"WITH {NUMBERS}, k AS (SELECT p_partkey AS q, {QUESTION} AS prompt, {EXPRESSION} AS expression FROM n), {ATTEMPTS}, f AS (SELECT user_id, q, arg_min(event_id, attempt) AS event_id, min(attempt) AS attempt FROM a WHERE event_type = 'purchase' AND value > 50 GROUP BY 1, 2) SELECT user_id, event_id, attempt, prompt, concat('Expression: ', expression) AS target FROM f JOIN k USING (q)")
def accepted_training_rows(t):
    """The first accepted attempt of each question joined with the question: training rows; the rest is dropped."""
    a = attempts(t).withColumn("ok", (F.col("event_type") == "purchase") & (F.col("value") > 50))
    first = generate.first_accepted(a.withColumn("key", F.struct("user_id", "q")), "key", "attempt", "ok", "event_id", "attempt").select("key.user_id", "key.q", "event_id", "attempt")
    q = asked_rows(t).select(F.col("p_partkey").alias("q"), F.col("question").alias("prompt"), F.concat(F.lit("Expression: "), "expression").alias("target"))
    return first.join(q, "q").select("user_id", "event_id", "attempt", "prompt", "target")


@query("SELECT l_orderkey, l_linenumber, o_orderpriority AS category, l_quantity > 10 AND l_discount < 0.08 AND l_tax < 0.07 AS usable FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def training_row_join(t):
    """Results joined to their curriculum rows by id, with a status filter and the conjunction of all gates."""
    gates = F.create_map(F.lit("long"), F.col("l_quantity") > 10, F.lit("cheap"), F.col("l_discount") < 0.08, F.lit("taxed"), F.col("l_tax") < 0.07)
    l = t("lineitem").select("l_orderkey", "l_linenumber", F.forall(F.map_values(gates), lambda g: g).alias("usable"))  # noqa: E741
    o = t("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("category"))
    return l.join(o, "l_orderkey").select("l_orderkey", "l_linenumber", "category", "usable")


@query("WITH a AS (SELECT item_id AS id, unnest([0, 1, 2, 3]) AS shift, length(text) AS n FROM benchmark), p AS (SELECT id, shift, (n + shift * id) % 4 AS pick FROM a), q AS (SELECT id, shift, (n + shift) % 4 AS pick FROM a) SELECT shift, count(*) AS n, count_if(p.pick = q.pick) AS same_pick, count_if(p.pick = (id + shift) % 4 AND q.pick = (id + shift) % 4) AS both_correct FROM p JOIN q USING (id, shift) GROUP BY shift")
def composite_key_join(t):
    """Two runs joined on question and rotation."""
    a = t("benchmark").select(F.col("item_id").alias("id"), F.length("text").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("shift"))
    p = a.select("id", "shift", ((F.col("n") + F.col("shift") * F.col("id")) % 4).alias("pick"))
    q = a.select("id", "shift", ((F.col("n") + F.col("shift")) % 4).alias("other"))
    gold = (F.col("id") + F.col("shift")) % 4
    return p.join(q, ["id", "shift"]).groupBy("shift").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pick") == F.col("other")).alias("same_pick"), F.count_if((F.col("pick") == gold) & (F.col("other") == gold)).alias("both_correct"))


@query("WITH s AS (SELECT p_brand, p_size, min(p_partkey) AS first_key FROM part GROUP BY ALL) SELECT l_orderkey, l_linenumber, first_key AS anchor FROM lineitem JOIN part p ON p.p_partkey = l_partkey LEFT JOIN s ON s.p_brand = p.p_brand AND s.p_size = CAST(l_quantity AS BIGINT)")
def semantic_anchor(t):
    """Each row with the first source row of its category and key, or none."""
    p = t("part").select("p_partkey", "p_brand", "p_size")
    left = t("lineitem").join(p.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").select("l_orderkey", "l_linenumber", "p_brand", F.col("l_quantity").cast("int").alias("p_size"))
    return generate.first_match(left, p.select("p_brand", "p_size", "p_partkey", F.col("p_partkey").alias("anchor")), ["p_brand", "p_size"], "p_partkey").select("l_orderkey", "l_linenumber", "anchor")


# -- audits of decisions
@query("WITH d AS (SELECT event_id, user_id AS packet, value, CASE WHEN value > 60 THEN 'PASS' WHEN value > 40 THEN 'REPAIR' WHEN value > 10 THEN 'REJECT' ELSE 'ERROR' END AS critic, event_id % 3 = 0 AS fixed, event_type <> 'error' AS valid FROM events) SELECT stage, reason, count(*) AS n FROM (SELECT CASE WHEN NOT valid THEN 'generator' WHEN critic = 'ERROR' OR critic = 'REJECT' THEN 'critic' WHEN critic = 'REPAIR' AND NOT fixed THEN 'repair' ELSE 'accepted' END AS stage, CASE WHEN NOT valid THEN 'invalid_candidate' WHEN critic IN ('ERROR', 'REJECT') THEN lower(critic) WHEN critic = 'REPAIR' AND NOT fixed THEN 'invalid_repair' WHEN critic = 'REPAIR' THEN 'repaired' ELSE 'passed' END AS reason FROM d) GROUP BY ALL")
def generator_critic(t):
    """Candidates validated, criticised and, where repair is asked, validated once more: how each ends and at which stage."""
    v = F.col("value")
    d = t("events").select(
        (F.col("event_type") != "error").alias("valid"), F.when(v > 60, "PASS").when(v > 40, "REPAIR").when(v > 10, "REJECT").otherwise("ERROR").alias("critic"), (F.col("event_id") % 3 == 0).alias("fixed")
    )
    x = core.critic_outcome(F.col("valid"), F.col("critic"), F.col("fixed"))
    return d.select(x.alias("x")).groupBy("x.stage", "x.reason").agg(F.count(F.lit(1)).alias("n"))


PLANTED = ("cost", "response_id", "response_sha", "requested", "tag", "decisions", "chain")


#: Records that are chained together in one window.
LINKED = 2_048


def attempt_ledger(t):
    """(plan, ledger): orders as packets of lines to be answered with their quantity. A first answer is wrong where the discount is
    over 0.08, and asked again; one record in 19 of each kind is then spoilt in one way. Written as a table before it is audited.

    Lines are dealt once, by ranges of their packets, and numbered there; records are written out only where they are chained, each
    run of them with a copy of the record before it."""
    line = lambda dealt: dealt.groupBy(F.col("l_orderkey").alias("packet"), F.col("l_linenumber").alias("place"))
    expected = F.min("l_quantity").cast("long").cast("string").alias("expected")
    id_of = lambda packet, place: F.concat_ws("-", packet.cast("string"), place.cast("string"))
    plan = line(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity").repartition("l_orderkey")).agg(expected).select("packet", "place", id_of(F.col("packet"), F.col("place")).alias("id"), "expected")
    dealt = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice").repartitionByRange("l_orderkey")
    lines = line(dealt).agg(expected, (F.max("l_discount") > 0.08).alias("fails"), (F.max("l_tax") > 0.07).alias("fails_again"), (F.max("l_extendedprice") % 7).alias("price"))
    tries = lines.select("*", F.explode(F.when(F.col("fails"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("attempt"))
    bad = F.when(F.col("attempt") == 0, F.col("fails")).otherwise(F.col("fails_again"))
    made = tries.groupBy("packet", "attempt").agg(F.array_sort(F.collect_list(F.struct("place", "expected", bad.alias("bad")))).alias("x"), F.max("price").alias("paid"))
    scratch = Scratch(made.sparkSession, "ledger")
    n = core.numbered_ranges(made, ["packet", "attempt"], "seq", scratch)
    run = F.floor(F.col("seq") / LINKED)
    runs = n.select("*", F.explode(F.when(F.col("seq") % LINKED == LINKED - 1, F.array(run, run + 1)).otherwise(F.array(run))).alias("run")).repartition("run").sortWithinPartitions("run", "seq")
    id_at = lambda e: id_of(F.col("packet"), e["place"]).alias("id")
    raw = F.to_json(F.struct(F.transform("x", lambda e: F.struct(id_at(e), F.when(e["bad"], F.concat(F.lit("not "), e["expected"])).otherwise(e["expected"]).alias("answer"))).alias("items")))
    ids, told = F.transform("x", id_at), F.transform("x", lambda e: F.struct(id_at(e), (~e["bad"]).alias("accepted")))
    hit = lambda k: F.col("seq") % 19 == PLANTED.index(k)
    spoilt = runs.select(
        "run", "seq", "packet", F.col("attempt").cast("long").alias("attempt"),
        F.concat(evidence.tag_of(F.col("packet"), F.col("attempt").cast("long")), F.when(hit("tag"), "x").otherwise("")).alias("tag"), F.when(hit("requested"), F.slice(ids, 1, F.size(ids) - 1)).otherwise(ids).alias("requested"), raw.alias("raw"), F.when(hit("response_sha"), "0").otherwise(F.sha2(raw, 256)).alias("response_sha"),
        F.when(hit("response_id"), "").otherwise(F.concat(F.lit("r"), F.col("seq").cast("string"))).alias("response_id"), F.array("paid", F.col("paid") / 2, F.lit(None).cast("double")).alias("receipts"), (F.col("paid") + F.when(hit("cost"), 1).otherwise(0)).alias("cost"),
        F.when(hit("decisions") & (F.col("attempt") == 1), F.transform(told, lambda d: F.struct(d["id"].alias("id"), (~d["accepted"]).alias("accepted")))).otherwise(told).alias("decisions"),
    )
    before = F.lag(evidence.body_digest()).over(Window.partitionBy("run").orderBy("seq"))
    linked = spoilt.withColumn("previous", before).filter(F.col("run") == run).drop("run").withColumn("previous", F.when(hit("chain") & (F.col("seq") > 1), "0").otherwise(F.col("previous")))
    ledger = scratch.put(linked, "attempts")
    scratch.drop("rows")
    return plan, ledger


@query("""
WITH w AS (SELECT l_orderkey, l_linenumber, max(l_discount) AS d FROM lineitem GROUP BY ALL),
l AS (SELECT l_orderkey AS packet, 0 AS attempt FROM w GROUP BY 1 UNION ALL SELECT l_orderkey, 1 FROM w WHERE d > 0.08 GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY packet, attempt) AS seq FROM l),
f AS (SELECT seq, attempt, ['cost', 'response_id', 'response_sha', 'requested', 'tag', 'decisions', 'chain'][seq % 19 + 1] AS fault FROM r WHERE seq % 19 < 7)
SELECT seq, fault FROM f WHERE (fault <> 'decisions' OR attempt = 1) AND (fault <> 'chain' OR seq > 1)
UNION ALL SELECT seq, 'decisions' FROM f WHERE fault = 'requested'
""")
def derivation_audit(t):
    """Every record of a stored ledger derived again from the plan and the raw responses: what cannot be is told by its kind."""
    plan, ledger = attempt_ledger(t)
    return evidence.audit(ledger, plan)


@query("SELECT lang AS category, count(*) AS n, sum(length(text))::BIGINT AS characters, coalesce(sum(length(text)) = sum(n_chars), FALSE) AS reproduced FROM documents GROUP BY lang")
def offline_verification(t):
    """Rows measured and summed again, against what the table has stored of them."""
    d = t("documents").withColumnRenamed("lang", "category")
    n = F.count(F.lit(1)).alias("n")
    again = d.groupBy("category").agg(n, F.sum(F.length("text")).alias("characters"))
    return core.reproduced(again, d.groupBy("category").agg(n, F.sum("n_chars").alias("characters")), ["category"], ["n", "characters"])


@query("WITH k AS (SELECT event_id, value, CASE event_id % 3 WHEN 0 THEN '5.0.0' WHEN 1 THEN '4.9.1' END AS version, CAST(event_id % 50 AS DOUBLE) AS first_step, CAST(event_id % 50 + 1 + event_id % 20 AS DOUBLE) AS last_step FROM events) SELECT event_id, round(CASE WHEN version = '5.0.0' THEN value * last_step / (last_step - first_step) END, 9) AS corrected FROM k")
def loss_correction(t):
    """A loss averaged over all steps though an invocation ran only its last ones, set right for the version that did so."""
    k = F.col("event_id")
    version = F.when(k % 3 == 0, "5.0.0").when(k % 3 == 1, "4.9.1")
    first, last = (k % 50).cast("double"), (k % 50 + 1 + k % 20).cast("double")
    return t("events").select("event_id", F.round(domain.corrected_loss(F.col("value"), version, first, last), 9).alias("corrected"))
