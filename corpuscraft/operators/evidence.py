"""A ledger of attempts audited against the plan and the raw responses that it came from, in joins of few columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical
from .shared import Scratch

#: What a record's digest covers.
BODY = ("attempt", "cost", "decisions", "packet", "raw", "receipts", "requested", "response_id", "response_sha", "seq", "tag")
ITEMS = "items array<struct<id:string,answer:string>>"
#: Values used twice that a join sends to every task; more of them are merged.
FEW = 100_000


def body_digest() -> Column:
    """The digest of a record without the one it points back to."""
    return F.sha2(canonical.record(*BODY), 256)


def tag_of(packet: Column, attempt: Column) -> Column:
    return F.format_string("packet_%03d_attempt_%d", packet, attempt)


def sure(ok: Column) -> Column:
    return F.coalesce(ok, F.lit(False))


def faults(rows: DataFrame, holds: dict[str, Column]) -> DataFrame:
    """seq, fault: the names of what does not hold."""
    return rows.select("seq", F.explode(F.filter(F.array(*[F.when(~sure(ok), name) for name, ok in holds.items()]), lambda x: x.isNotNull())).alias("fault"))


def answered(requested: Column, raw: Column) -> Column:
    """The requested ids, each with the raw response's answer: null where the response leaves the id out, answers it twice or is no JSON."""
    items = F.coalesce(F.from_json(raw, ITEMS)["items"], F.array().cast("array<struct<id:string,answer:string>>"))

    def one(i):
        own = F.filter(items, lambda x: x["id"] == i)
        return F.struct(i.alias("id"), F.when(F.size(own) == 1, F.get(own, F.lit(0))["answer"]).alias("answer"))

    return F.transform(requested, one)


def of_packets(ledger: DataFrame, plan: DataFrame) -> DataFrame:
    """The faults that a packet's plan tells (a packet is a request's few rows): of each record only ids, their answers and the stored
    decisions are joined."""
    lines = plan.groupBy("packet").agg(F.array_sort(F.collect_list(F.struct("place", "id", "expected"))).alias("lines"))
    missed = ledger.filter("attempt = 0").select("packet", F.transform(F.filter("decisions", lambda d: ~d["accepted"]), lambda d: d["id"]).alias("ids"))
    missed = missed.filter(F.size("ids") > 0).groupBy("packet").agg(F.flatten(F.collect_list("ids")).alias("missed"))
    told = F.array_sort(F.transform("decisions", lambda d: F.struct(d["id"].alias("id"), d["accepted"].alias("accepted"))))
    rows = ledger.select("seq", "packet", "attempt", answered(F.col("requested"), F.col("raw")).alias("asked"), told.alias("told")).join(lines, "packet", "left").join(missed, "packet", "left")
    kind = dict(plan.dtypes)
    known = F.coalesce("lines", F.array().cast(f"array<struct<place:{kind['place']},id:{kind['id']},expected:{kind['expected']}>>"))
    of = lambda i: F.filter(known, lambda p: p["id"] == i)
    failed = F.array_sort(F.flatten(F.transform("missed", lambda i: F.transform(of(i), lambda p: F.struct(p["place"].alias("place"), p["id"].alias("id"))))))
    due = F.when(F.col("attempt") == 0, F.transform("lines", lambda p: p["id"])).otherwise(F.coalesce(F.transform(failed, lambda p: p["id"]), F.array().cast("array<string>")))

    def judged(a):
        """An id with whether its answer is the plan's, for each line of the packet that has it; an id of no line is not accepted."""
        one = lambda ok: F.struct(a["id"].alias("id"), ok.alias("accepted"))
        return F.when(F.size(of(a["id"])) == 0, F.array(one(F.lit(False)))).otherwise(F.transform(of(a["id"]), lambda p: one(sure(a["answer"] == p["expected"]))))

    again = F.array_sort(F.flatten(F.transform("asked", judged)))
    return faults(
        rows,
        {
            "plan": F.col("lines").isNotNull() & F.col("attempt").isin(0, 1),
            "requested": (F.transform("asked", lambda a: a["id"]) == due) & (F.size("asked") > 0),
            "decisions": (F.col("told") == again) & (F.size("asked") > 0),
        },
    )


def of_neighbours(ledger: DataFrame) -> DataFrame:
    """The faults that the record before tells: its digest (as bytes) and its packet and attempt."""
    hexadecimal = F.when(F.col("previous").rlike("^[0-9a-f]{64}$"), F.unhex("previous"))
    own = ledger.select("seq", "packet", "attempt", F.col("previous").isNull().alias("bare"), hexadecimal.alias("previous"))
    before = ledger.select((F.col("seq") + 1).alias("seq"), F.unhex(body_digest()).alias("digest_before"), F.struct("packet", "attempt").alias("before"))
    first = F.col("seq") == 1
    return faults(
        own.join(before, "seq", "left"),
        {
            "chain": F.when(first, F.col("bare")).otherwise(F.col("previous") == F.col("digest_before")),
            "order": F.when(first, True).otherwise(F.col("before") < F.struct("packet", "attempt")),
        },
    )


def used_twice(ledger: DataFrame, column: str, holds: Column, scratch: Scratch) -> DataFrame:
    """The faults of values that are right by themselves (``holds``) but that another record has too."""
    twice = scratch.put(ledger.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(column), f"twice-{column}")
    twice = twice.hint("broadcast" if twice.limit(FEW + 1).count() <= FEW else "merge")
    return ledger.filter(sure(holds)).select("seq", column).join(twice, column, "left_semi").select("seq", F.lit(column).alias("fault"))


def audit(ledger: DataFrame, plan: DataFrame) -> DataFrame:
    """seq, fault: everything that cannot be derived again. ``plan``: packet, place, id, expected. ``ledger``: seq (from 1), tag, packet,
    attempt (0 or 1), requested, raw, response_sha, response_id, receipts, cost, decisions (id, accepted), previous.

    Faults: ``plan`` (no such packet or attempt), ``tag`` (not the one of packet and attempt, or used twice), ``requested`` (a first
    attempt asks for its whole packet in order, a retry for exactly the failures of the first one in that order), ``response_id``
    (missing or used twice), ``response_sha``, ``cost`` (not the greatest valid receipt), ``decisions`` (not those of the raw response),
    ``chain`` (not the digest of the record before, or a gap), ``order`` (packets and attempts do not ascend).

    Each kind of fault is told from the columns it needs and the kinds are put together by a union, so whole records are never shuffled.
    """
    valid = F.filter("receipts", lambda c: F.coalesce((c >= 0) & (c < float("inf")), F.lit(False)))
    own = {"tag": F.col("tag") == tag_of(F.col("packet"), F.col("attempt")), "response_id": F.length("response_id") > 0}
    alone = faults(ledger, {**own, "response_sha": F.col("response_sha") == F.sha2("raw", 256), "cost": F.col("cost") == F.array_max(valid)})
    scratch = Scratch(ledger.sparkSession, "audit")
    kinds = [alone, of_packets(ledger, plan), of_neighbours(ledger), *[used_twice(ledger, c, ok, scratch) for c, ok in own.items()]]
    return reduce(DataFrame.unionByName, kinds)
