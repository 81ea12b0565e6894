"""Repeated passages by fingerprints of windows, grouped by minimiser. Suffixes are not ordered or compared as a suffix array does.

Of all places of all texts, only minimisers are kept: in each stretch of ``words`` words, the run of ``GRAM`` words whose hash
is least. Equal stretches choose the same place in themselves, so every passage of ``words`` words or more that repeats has at
least one kept place in each of its copies. Places are grouped by their ``GRAM`` words. Each stretch of ``words`` words that
chose the place is told by a 64-bit hash, and equal stretches at equal distances before it are copies (but for hash collisions).
Of equal stretches the one in the smallest document id, then at the smallest place, is the first; the others repeat it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, fresh, steps, task, texts_of
from .words import mix, runs, word_hashes

WORDS, GRAM = 50, 10
#: Slots of 64 bits of the filter of repeated grams that is sent to the tasks: 8 MB whatever the input. It only spares work.
SLOTS = 1 << 20
#: A gram found more often than this is compared by shuffled rows, not within one task; the result is the same.
TOGETHER = 4_096
_B = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = np.uint64(_B), np.uint64(pow(_B, -1, 1 << 64))
    grow = np.concatenate([np.ones(1, np.uint64), np.full(n, base)])
    back = np.concatenate([np.ones(1, np.uint64), np.full(n, inverse)])
    return np.multiply.accumulate(grow), np.multiply.accumulate(back)


def window_hashes(h: np.ndarray, words: int) -> np.ndarray:
    """A hash of each stretch of ``words`` words, from sums of hashes times powers."""
    size = 1 << max(12, int(len(h)).bit_length())
    up, down = powers(size)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    return mix((sums[words:] - sums[:-words]) * down[: len(h) - words + 1])


def minimisers(grams: np.ndarray, width: int) -> np.ndarray:
    """For each stretch of ``width`` grams, the place of the least one, of equal ones the leftmost."""
    order = np.argsort(grams, kind="stable")
    least = np.empty(len(grams), dtype=np.int64)
    least[order] = np.arange(len(grams))
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        more = width - span
        least = np.minimum(least[: len(least) - more], least[more:])
    return order[least]


def suffixes(h: np.ndarray, words: int = WORDS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text's word hashes: the kept suffixes' grams and places, and each's first stretch and the one after its last."""
    grams = runs(h, gram)
    at = minimisers(grams, words - gram + 1)
    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return grams[at[edge]], at[edge], edge, np.append(edge[1:], len(at))


def repeated_grams(df: DataFrame, scratch: Scratch, words: int, id_col: str, text_col: str) -> DataFrame:
    """gram, n: the first words of kept suffixes that are found more than once."""

    def count(batches):
        import pyarrow as pa

        for ids, texts in steps(batches):
            hashes, counts = word_hashes(texts)
            ends = np.cumsum(counts)
            found = [suffixes(hashes[e - n : e], words)[0] for i, e, n in zip(ids, ends, counts, strict=True) if n >= words and i is not None]
            if found:
                g, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], names=["gram", "n"])

    grams = texts_of(df, id_col, text_col).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(task(count, "words"), "gram long, n long")
    return scratch.put(grams.groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1"), "grams")


def gram_filter(grams: DataFrame) -> np.ndarray:
    """One bit for each repeated gram: of 64 x SLOTS bits, so that few others pass; when it is full, all pass."""
    bits = grams.select(F.expr(f"cast(gram & {SLOTS - 1} as int)").alias("slot"), F.expr("shiftleft(1L, cast(shiftrightunsigned(gram, 58) as int))").alias("bit"))
    found = bits.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most SLOTS rows
    out = np.zeros(SLOTS, dtype=np.uint64)
    out[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def candidates(df: DataFrame, grams: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Kept suffixes whose gram repeats: gram, sig (a hash of gram, stretches and their places in it), doc_id, copy (a hash of the
    text, which tells rows of one id apart), place, first (stretch), n, stretches (their hashes), total (of the gram).

    Of equal suffixes of a step only the first carries n, their number, and the stretches: copies cost a few numbers each.
    """
    bits = df.sparkSession.sparkContext.broadcast(gram_filter(grams))

    def emit(batches):
        import pyarrow as pa

        known = bits.value
        for ids, copies, texts in steps(batches):
            hashes, counts = word_hashes(texts)
            ends = np.cumsum(counts)
            cols, parts = ([], [], [], [], [], []), []
            for i, c, e, n in zip(ids, copies, ends, counts, strict=True):
                if n < words or i is None:
                    continue
                h = hashes[e - n : e]
                g, place, first, last = suffixes(h, words)
                keep = np.flatnonzero((known[(g & np.uint64(SLOTS - 1)).astype(np.int64)] >> (g >> np.uint64(58))) & np.uint64(1))
                if len(keep):
                    size = (last - first)[keep]
                    parts.append(window_hashes(h, words)[np.repeat(first[keep] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))])
                    for col, x in zip(cols, (g[keep], np.full(len(keep), i), np.full(len(keep), c), place[keep], first[keep], size), strict=True):
                        col.append(x)
            if not parts:
                continue
            gram, doc, copy, place, first, size = (np.concatenate(c) for c in cols)
            stretch, ends = np.concatenate(parts), np.cumsum(size)
            before = np.repeat(place - first + ends - size, size) - np.arange(len(stretch))
            sig = mix(gram + np.add.reduceat(mix(stretch + mix(before.astype(np.uint64))), ends - size))
            order = np.lexsort((copy, place, doc, sig))
            opens = np.flatnonzero(np.concatenate([[True], sig[order][1:] != sig[order][:-1]]))
            n = np.zeros(len(sig), dtype=np.int64)
            n[order[opens]] = np.diff(np.append(opens, len(sig)))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, size, 0))]), pa.int32()), pa.array(stretch[np.repeat(n > 0, size)].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*[pa.array(np.asarray(x).astype(np.int64, copy=False) if x.dtype != np.uint64 else x.view(np.int64)) for x in (gram, sig, doc, copy, place, first, n)], lists], names=["gram", "sig", "doc_id", "copy", "place", "first", "n", "stretches"])

    docs = texts_of(df, id_col, text_col).selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) copy", "text")
    return docs.mapInArrow(task(emit, "words"), "gram long, sig long, doc_id long, copy long, place long, first long, n long, stretches array<bigint>").join(grams.withColumnRenamed("n", "total"), "gram")


SEGMENTS = "sig long, rel long, size long, odoc long, ocopy long, ostart long"


def segments(sig, rel, odoc, ocopy, ostart):
    """Rows (a repeated stretch each, sorted by sig and place) as runs whose first copies run along with them."""
    import pyarrow as pa

    same = lambda x: x[1:] == x[:-1]
    opens = np.flatnonzero(np.concatenate([[True], ~(same(sig) & same(odoc) & same(ocopy) & (np.diff(rel) == 1) & (np.diff(ostart) == 1))])) if len(sig) else np.zeros(0, dtype=np.int64)
    cols = [sig[opens], rel[opens], np.diff(np.append(opens, len(sig))), odoc[opens], ocopy[opens], ostart[opens]]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64, copy=False)) for c in cols], names=["sig", "rel", "size", "odoc", "ocopy", "ostart"])


def compare(batches):
    """Different suffixes sorted by gram, document and place: compares those of a gram and yields the runs of their repeated
    stretches, with the first copies."""
    import pyarrow as pa

    def runs_of(t):
        gram, sig, n, doc, copy, place, first = (t.column(c).to_numpy() for c in ("gram", "sig", "n", "doc_id", "copy", "place", "first"))
        lists = t.column("stretches").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        stretch = lists.flatten().to_numpy().view(np.uint64)
        row = np.repeat(np.arange(len(doc)), size)
        start = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        key = mix(mix(gram.view(np.uint64)[row]) + stretch + mix((place[row] - start).astype(np.uint64)))
        _, index, inverse = np.unique(key, return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=n[row])
        once = np.zeros(len(sig), dtype=bool)  # a suffix that came from several steps is told once
        once[np.unique(sig, return_index=True)[1]] = True
        use = np.flatnonzero((total[inverse] > 1) & once[row])
        origin = index[inverse[use]]
        return segments(sig[row[use]], (start - place[row])[use], doc[row[origin]], copy[row[origin]], start[origin])

    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        gram = t.column("gram").to_numpy()
        if not len(gram):
            continue
        done = int(np.searchsorted(gram, gram[-1]))  # the last gram may go on in the next batch
        if done:
            yield runs_of(t.slice(0, done))
        held = t.slice(done)
    if held is not None and held.num_rows:
        yield runs_of(held)


def gather(batches):
    """Repeated stretches sorted by sig and place, as runs."""
    for b in batches:
        if b.num_rows:
            yield segments(*(b.column(c).to_numpy() for c in ("sig", "rel", "odoc", "ocopy", "ostart")))


def repeated_passages(df: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start_word, end_word, is_first: the spans of words that lie in repeated stretches, within and across documents.

    ``is_first``: every stretch in the span is the first of its kind; otherwise the stretches repeat earlier ones. Spans of one
    kind in a document are merged. Texts under ``words`` words, null texts and rows without id have none; rows that repeat an
    id are one document whose spans are told by place only. Words are runs without white space, A-Z lower-cased.
    """
    return merge_spans(repeated_stretches(df, words, id_col, text_col).select("doc_id", "start_word", "end_word", "is_first"), "doc_id", "is_first")


def repeated_stretches(df: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Spans before merging: doc_id, copy, start_word, end_word, is_first (by id and place), own (by id, text and place), cut_word
    (the first word of a repeat that lies outside its own first copy, which a repeat overlaps only in periodic text).

    The suffixes of a gram are compared in one task up to ``TOGETHER`` of them; those of a commoner gram as shuffled stretches,
    counted before the shuffle. Both ways give the same rows. Copies of a suffix get its runs in a join that Spark may split.
    """
    scratch = Scratch(df.sparkSession, "suffixes")
    grams = repeated_grams(df, scratch, words, id_col, text_col)
    found = scratch.put(candidates(df, grams, words, id_col, text_col), "found")
    scratch.drop("grams")
    kinds = found.filter("n > 0")
    near = kinds.filter(F.col("total") <= TOGETHER).drop("total").repartition("gram").sortWithinPartitions("gram", "doc_id", "place", "copy").mapInArrow(task(compare), SEGMENTS)
    k = F.col("first") + F.col("k")
    each = kinds.filter(F.col("total") > TOGETHER).select("gram", "sig", "n", "doc_id", "copy", "place", "first", F.posexplode("stretches").alias("k", "stretch")).select("gram", "sig", "n", "doc_id", "copy", "stretch", k.alias("start"), (F.col("place") - k).alias("before"))
    same = ["gram", "stretch", "before"]
    groups = each.groupBy(*same).agg(F.sum("n").alias("copies"), F.min(F.struct("doc_id", "start", "copy")).alias("o")).filter("copies > 1")
    shared = each.select("sig", *same).distinct().join(groups, same).select("sig", (-F.col("before")).alias("rel"), F.col("o.doc_id").alias("odoc"), F.col("o.copy").alias("ocopy"), F.col("o.start").alias("ostart"))
    far = shared.repartition("sig").sortWithinPartitions("sig", "rel").mapInArrow(task(gather), SEGMENTS)
    spans = found.select("sig", "doc_id", "copy", "place").join(near.unionByName(far), "sig").withColumn("start_word", F.col("place") + F.col("rel"))
    here = (F.col("doc_id") == F.col("odoc")) & (F.col("start_word") == F.col("ostart"))
    cut = F.when((F.col("doc_id") == F.col("odoc")) & (F.col("copy") == F.col("ocopy")), F.greatest("start_word", F.col("ostart") + words)).otherwise(F.col("start_word"))
    return spans.select("doc_id", "copy", "start_word", (F.col("start_word") + F.col("size") - 1 + words).alias("end_word"), here.alias("is_first"), (here & (F.col("copy") == F.col("ocopy"))).alias("own"), cut.alias("cut_word"))


def merge_spans(spans: DataFrame, *by: str) -> DataFrame:
    """Joins touching spans (start_word, end_word) of one document and kind."""
    order = Window.partitionBy(*by).orderBy("start_word", "end_word")
    reach = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("opens", F.when(reach >= F.col("start_word"), 0).otherwise(1))
    island = F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = marked.withColumn("island", island).groupBy(*by, "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"))
    return merged.select("doc_id", "start_word", "end_word", *[c for c in by if c != "doc_id"])


def remove_repeats(df: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, each text without the words that only repeat earlier ones; all columns, all rows.

    All words of a stretch whose first copy lies elsewhere go, also those that begin or end a stretch that is the first of its
    kind. Where a stretch overlaps its own first copy, that copy stays. Text between two words goes with the word before it.
    Rows are told apart by id and text, so a repeated id with another text is a document of its own; rows equal in both are
    copies that are treated alike. Rows without id stay as they are.
    """
    repeats = repeated_stretches(df, words, id_col, text_col).filter("not own and cut_word < end_word")
    spans = merge_spans(repeats.select("doc_id", "copy", F.col("cut_word").alias("start_word"), "end_word"), "doc_id", "copy")
    doc, copy, cut = fresh("doc"), fresh("copy"), fresh("cut")
    per_doc = spans.groupBy(F.col("doc_id").alias(doc), F.col("copy").alias(copy)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(cut))
    per_doc = Scratch(df.sparkSession, "cuts").put(per_doc, "cuts")
    names = df.columns
    row = (df[id_col].cast("long") == F.col(doc)) & (F.xxhash64(df[text_col].cast("string")) == F.col(copy))
    tagged = df.join(per_doc.hint("shuffle_merge"), row, "left")

    @F.pandas_udf("string")
    def trimmed(text, cut):
        import pandas as pd

        return pd.Series([t if c is None else trim(t, c) for t, c in zip(text, cut, strict=True)])

    return tagged.withColumn(text_col, F.when(F.col(cut).isNotNull(), trimmed(F.col(text_col), F.col(cut))).otherwise(F.col(text_col))).select(*names)


def trim(text: str, cut) -> str:
    import re

    raw = text.encode()
    at = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw)]
    gone = np.zeros(len(at), dtype=bool)
    for s in cut:
        gone[s["start_word"] : s["end_word"]] = True
    edges = [*at, len(raw)]
    return (raw[: at[0]] if at else raw).decode() + b"".join(raw[edges[i] : edges[i + 1]] for i in range(len(at)) if not gone[i]).decode()
