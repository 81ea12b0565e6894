"""Text functions as Column expressions (all JVM-side)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The number pattern of the template mask and the answer-letter pattern.
NUMBER = r"(?<![\w])[-+]?(?:\d+/\d+|\d+(?:\.\d+)?)(?![\w])"
LETTER = r"(?i)^(?:Answer\s*:\s*)?([ABCD])(?:$|[\s.\):,])"


def normalize_unicode(c: Column) -> Column:
    """Lower case, runs of anything but Unicode letters, digits and _ as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


def casefold(c: Column) -> Column:
    """Case folding with the JVM's own tables: through upper case, so that sharp s, ligatures and final sigma meet their plain forms."""
    upper = F.replace(F.upper(c), F.lit("\u1e9e"), F.lit("SS"))  # the capital sharp s; without it the optimiser would drop upper()
    return F.replace(F.lower(upper), F.lit("\u03c2"), F.lit("\u03c3"))


def normalize_folded(c: Column) -> Column:
    """``normalize_unicode`` on folded text."""
    return normalize_unicode(casefold(c))


def nfkc(c: Column) -> Column:
    """Compatibility composition. Texts of ASCII alone are their own and skip the Arrow round trip."""

    @F.pandas_udf("string")
    def composed(x):
        return x.str.normalize("NFKC")

    return F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(composed(c))


def duration_text(minutes: Column) -> Column:
    """A time written as n/60 in seconds, any other in minutes."""
    return F.when(F.endswith(F.replace(minutes, F.lit(" "), F.lit("")), F.lit("/60")), F.concat(F.regexp_replace(minutes, r"\s*/\s*60$", ""), F.lit(" seconds"))).otherwise(F.concat(minutes, F.lit(" minutes")))


def normalize_ascii(c: Column) -> Column:
    """Lower case, everything but a-z, 0-9 and white space as a space, spaces collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+", " "))


def template_mask(c: Column) -> Column:
    """Compatibility forms, lower case, numbers as <num>, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(nfkc(c)), NUMBER, "<num>"), r"\s+", " "))


def template_signature(question: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("\n", template_mask(question), template_mask(prompt)), 256)


def strict_letter(c: Column) -> Column:
    """The leading answer letter, or INVALID; never a letter from prose."""
    found = F.upper(F.regexp_extract(F.regexp_replace(F.trim(c), r"\*\*", ""), LETTER, 1))
    return F.when(found == "", "INVALID").otherwise(found)


def loose_letter(c: Column) -> Column:
    """The first letter A-D that stands alone in the upper-cased text, or null."""
    found = F.regexp_extract(F.upper(c), r"\b([ABCD])\b", 1)
    return F.when(found != "", found)


def last_answer_number(c: Column) -> Column:
    """The number on the last Answer: line, where it is a whole, decimal or fraction; else null."""
    line = F.regexp_replace(F.element_at(F.regexp_extract_all(c, F.lit(r"(?im)^\s*Answer:\s*(.+)$"), F.lit(1)), -1), r"\s+$", "")
    n = F.regexp_extract(line, r"^([-+]?\d+(?:\.\d+)?)(?:/(\d+))?$", 1).try_cast("double")
    d = F.regexp_extract(line, r"^([-+]?\d+(?:\.\d+)?)/(\d+)$", 2)
    return F.when(d == "", n).otherwise(F.try_divide(n, d.try_cast("double")))


def within_tolerance(value: Column, gold: Column) -> Column:
    return F.abs(value - gold) <= F.greatest(F.lit(1e-6), F.abs(gold) * 1e-4)


def comb_notation(c: Column) -> Column:
    return F.regexp_replace(c, r"\bC\s*\(", "comb(")


def number_class(x: Column) -> Column:
    kind = F.when(x == F.floor(x), "integer").otherwise("fraction")
    return F.when(x == 0, "zero").when(x < 0, F.concat(F.lit("negative_"), kind)).otherwise(F.concat(F.lit("positive_"), kind))


def probability_position(x: Column) -> Column:
    return F.when(x == 0, "zero").when(x == 1, "one").otherwise("interior")


def stratum(axes: Column, without: tuple[str, ...] = ()) -> Column:
    """Sorted key=value pairs of a map joined by semicolons."""
    entries = F.filter(F.map_entries(axes), lambda e: ~e["key"].isin(*without)) if without else F.map_entries(axes)
    return F.array_join(F.array_sort(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")


def rotate(choices: Column, shift: Column, size: int = 4) -> Column:
    """The array rotated left by shift."""
    return F.concat(F.slice(choices, shift + 1, F.lit(size)), F.slice(choices, F.lit(1), shift))


def rotated_gold(index: Column, shift: Column, size: int = 4) -> Column:
    return F.element_at(F.array(*map(F.lit, "ABCDEFGH"[:size])), (F.pmod(index - shift, F.lit(size)) + 1).cast("int"))


def original_index(letter: Column, shift: Column, size: int = 4) -> Column:
    at = F.instr(F.lit("ABCDEFGH"[:size]), letter)
    return F.when(at > 0, F.pmod(at - 1 + shift, F.lit(size)))


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that a row breaks, or null; a rule that is null counts as broken."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules], F.lit(None).cast("string"))


def blocked_word(words: list[str], *columns: Column) -> Column:
    """Whether any of the words is a substring of the lower-cased columns."""
    blob = F.lower(F.concat_ws(" ", *columns))
    return reduce(lambda a, b: a | b, [F.contains(blob, F.lit(w)) for w in words])


def substring_after_last_sentence(c: Column) -> Column:
    """The last sentence first: splits at ". " and rotates right by one."""
    parts = F.split(F.regexp_replace(c, r"\.$", ""), r"\. ")
    n = F.size(parts)
    return F.when(n > 1, F.concat(F.array_join(F.concat(F.slice(parts, n, F.lit(1)), F.slice(parts, F.lit(1), n - 1)), ". "), F.lit("."))).otherwise(c)


# The wordings of ``surface`` and the leads and exchanges below.
STYLES = ("direct_definition", "conditions_first", "quantity_first", "operational_story", "validation_compact", "validation_reverse")


def surface(c: Column, style: Column) -> Column:
    """A text in another wording: with a lead, with words exchanged, or with its last sentence first. Null for an unknown style."""
    parts = F.filter(F.transform(F.split(c, r"\. "), lambda x: F.trim(x)), lambda x: x != "")
    several, last = F.size(parts) > 1, F.rtrim(F.element_at(parts, -1), F.lit("."))
    head = F.rtrim(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), ". "), F.lit("."))
    swapped = lambda lead, *pairs: F.concat(F.lit(lead), reduce(lambda x, ab: F.replace(x, F.lit(ab[0]), F.lit(ab[1])), pairs, c))
    turned = lambda lead, middle, alone: F.when(several, F.concat(F.lit(lead), last, F.lit(middle), head, F.lit("."))).otherwise(F.concat(F.lit(alone), c))
    shown = (
        c,
        F.concat(F.lit("Conditions first: "), c),
        turned("", ". Given: ", "Requested quantity first. Given: "),
        swapped("An analyst records this operating condition: ", ("Set up", "Give one numerical expression for"), ("what is", "determine")),
        swapped("Write one executable expression using only these data. ", ("Set up", "Represent"), ("find", "represent")),
        turned("Requested result: ", ". Conditions: ", "Requested result: "),
    )
    return F.coalesce(*[F.when(style == n, x) for n, x in zip(STYLES, shown, strict=True)])


def relative_to(path: Column, root: str) -> Column:
    """A path without its root (a pattern at its start); another path stays as it is."""
    return F.regexp_replace(path, root, "")


def padded(ids: Column, width: Column, fill: int) -> Column:
    """An array filled up to a width."""
    return F.concat(ids, F.array_repeat(F.lit(fill), F.greatest(width - F.size(ids), F.lit(0)).cast("int")))


def numeric(c: Column) -> Column:
    """The value of a whole, decimal or fraction, or null."""
    whole = c.try_cast("double")
    parts = F.split(c, "/")
    return F.coalesce(whole, F.when(F.size(parts) == 2, F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))))


def numerically_distinct(choices: Column) -> Column:
    """Whether no two choices are the same text or the same number."""
    keys = F.transform(choices, lambda c: F.coalesce(F.round(numeric(c), 12).cast("string"), F.trim(c)))
    return F.size(F.array_distinct(keys)) == F.size(choices)


def length_rules(ranges: dict[str, tuple[int, int]]) -> list[tuple[str, Column]]:
    """Rules for ``first_failure``: each column no shorter and no longer than its range."""
    return [rule for c, (low, high) in ranges.items() for rule in ((f"{c}_short", F.length(c) >= low), (f"{c}_long", F.length(c) <= high))]


#: How a plain answer begins, and how the sentence begins that tells its misconception.
PLAIN_ANSWER = r"(?s)^Answer:\s*([ABCD])\s*\n+(.+)$"
MISTAKE = r"(?s)^(.*?)((?:A|The|One) common (?:mistake|misconception)\b.*)$"
TEACHER_FIELDS = ("answer_letter", "explanation", "common_mistake")


def teacher_fields(raw):
    """answer_letter, explanation, common_mistake (a struct) of a teacher's answer: a JSON object, fenced or not, or plain text that
    begins with its letter and names a common mistake. Anything else, JSON of another kind too, has none of them."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    bare = strip(raw)
    bare = F.when(F.startswith(bare, F.lit("```")), F.regexp_replace(bare, r"^```(?:json)?\s*|\s*```$", "")).otherwise(bare)
    doc = F.try_parse_json(bare)
    body = strip(F.regexp_extract(bare, PLAIN_ANSWER, 2))
    plain = doc.isNull() & (F.regexp_extract(bare, PLAIN_ANSWER, 1) != "") & F.regexp_like(body, F.lit(MISTAKE))
    of_json = {f: F.when(F.schema_of_variant(doc).startswith("OBJECT"), F.try_variant_get(doc, f"$.{f}", "string")) for f in TEACHER_FIELDS}
    of_text = {"answer_letter": F.regexp_extract(bare, PLAIN_ANSWER, 1), "explanation": strip(F.regexp_extract(body, MISTAKE, 1)), "common_mistake": strip(F.regexp_extract(body, MISTAKE, 2))}
    return F.struct(*[F.when(plain, of_text[f]).otherwise(of_json[f]).alias(f) for f in TEACHER_FIELDS])
