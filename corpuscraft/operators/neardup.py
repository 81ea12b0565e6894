"""Containment and shared word runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: The most characters of needles that one automaton holds (some 50 bytes each in every Python worker).
PATTERN_CHARACTERS = 1_000_000
#: The most rows of word runs (16 bytes each) that are sent to all tasks; more are joined by a shuffle.
RUNS_SENT = 1_000_000


def words(c):
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def word_runs(df: DataFrame, id_col: str, n: int, whole: bool = False) -> DataFrame:
    """(id, run): each distinct run of n words as a 64-bit hash; with ``whole``, a text of fewer words is one run."""
    hashed = df.select(id_col, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hs"))
    runs = F.expr(f"array_distinct(transform(sequence(1, size(hs) - {n - 1}), i -> xxhash64(slice(hs, i, {n}))))")
    long = F.size("hs") >= n
    found = F.when(long, runs).when(F.lit(whole) & (F.size("hs") > 0), F.array(F.xxhash64("hs"))) if whole else F.when(long, runs)
    return hashed.select(id_col, F.explode(found).alias("run"))


def sent(runs: DataFrame) -> DataFrame:
    """A broadcast of a table of runs where its size allows it, else the table."""
    return F.broadcast(runs) if runs.limit(RUNS_SENT + 1).count() <= RUNS_SENT else runs


def shared_runs(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """doc_id, item_id, shared: how many distinct runs of n words both have. The items' runs go to the documents where they are few
    enough, so that only hits are shuffled."""
    return word_runs(docs, "doc_id", n).join(sent(word_runs(items, "item_id", n)), "run").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))


def by_runs(docs: DataFrame, needles: DataFrame, n: int) -> DataFrame:
    """Pairs (doc_id, item_id) for needles of three words or more, by a shuffle however many they are: a needle's words but its first
    and last stand whole in any document that holds it, so a run of its inner words, n of them or as many as it has, is among the
    document's runs. An equi-join on the run finds candidates and the exact test decides."""
    keyed = needles.select("item_id", "needle", words(F.col("needle")).alias("ws")).withColumn("inner", F.least(F.size("ws") - 2, F.lit(n)))
    out = None
    for k in range(1, n + 1):
        some = keyed.filter(F.col("inner") == k).select("item_id", "needle", F.xxhash64(F.transform(F.slice("ws", 2, k), lambda w: F.xxhash64(w))).alias("run"))
        found = word_runs(docs, "doc_id", k).join(some, "run").select("doc_id", "item_id", "needle")
        hit = found.join(docs, "doc_id").filter(F.contains("text", F.col("needle"))).select("doc_id", "item_id")
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()


_automata: dict = {}


def automaton(patterns: list[tuple[int, str]], token: str):
    """The automaton of a worker's present patterns, built once for all of its tasks, and the numbers of empty ones."""
    if token not in _automata:
        import ahocorasick

        built = ahocorasick.Automaton()
        for number, pattern in patterns:
            if pattern:
                built.add_word(pattern, number)
        built.make_automaton()
        _automata.clear()
        _automata[token] = built, [number for number, pattern in patterns if not pattern]
    return _automata[token]


def found_in(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, pattern) for each of the ``patterns`` (pattern: a number, needle: distinct) that a document holds, in one
    walk of its text through an automaton of all of them. They are sent to the tasks; their size is the caller's to bound."""
    import pyarrow as pa

    sent_rows = docs.sparkSession.sparkContext.broadcast([(r["pattern"], r["needle"]) for r in patterns.select("pattern", "needle").collect()])
    token, kind = uuid.uuid4().hex, docs.schema["doc_id"].dataType

    def walk(batches):
        known, empty = automaton(sent_rows.value, token)
        for b in batches:
            rows, hits = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                held = () if text is None else {*empty, *(number for _, number in known.iter(text))} if len(known) else empty
                rows += [i] * len(held)
                hits += held
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(hits, pa.int64())], names=["doc_id", "pattern"])

    return docs.select("doc_id", "text").mapInArrow(walk, f"doc_id {kind.simpleString()}, pattern long")


def containing(docs: DataFrame, needles: DataFrame, n: int = 4) -> DataFrame:
    """Pairs (doc_id, item_id) whose document holds the needle as a substring.

    Needles of up to ``PATTERN_CHARACTERS`` in all go to every task as one automaton: short and long ones are found in one pass over
    the documents, and only hits leave it. Beyond that size, needles of three words or more are joined by runs of their inner words,
    and the others go in parts of that size, a pass each. The empty needle is in every text; nulls are in none and hold none.
    """
    keyed = needles.filter("needle is not null").select("item_id", "needle")
    patterns = Scratch(docs.sparkSession, "needles").put(keyed.groupBy("needle").agg(F.min("item_id").alias("any")).select("needle", F.monotonically_increasing_id().alias("pattern"), F.length("needle").cast("long").alias("n"), (F.size(words(F.col("needle"))) > 2).alias("long")), "patterns")
    size = patterns.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("long"), F.col("n"))), F.lit(0))).first()
    whole = size[0] <= PATTERN_CHARACTERS
    some = patterns if whole else patterns.filter("not long")
    parts = 1 if whole else max(1, -(-2 * size[1] // PATTERN_CHARACTERS))
    hits = None
    for k in range(parts):
        found = found_in(docs, some.filter(F.pmod(F.xxhash64("needle"), F.lit(parts)) == k))
        hits = found if hits is None else hits.unionByName(found)
    named = patterns.select("pattern", "needle").join(keyed, "needle").select("pattern", "item_id")
    out = hits.join(named, "pattern").select("doc_id", "item_id").distinct()
    return out if whole else out.unionByName(by_runs(docs, keyed.filter(F.size(words(F.col("needle"))) > 2), n)).distinct()
