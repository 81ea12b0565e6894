"""Call ledgers as keyed state over a stream: requests, answers and failures, caps on calls and cost, and deadlines.

State and timers live in Spark's state store under a checkpoint, so a ledger is never reset: a restart continues it, and rows that
come again change nothing. What a row decides depends on the rows before it in its account alone, never on how they were dealt to
batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTCOME = Row("account", "seq", "tag", "outcome", "calls", "cost")
OUTCOMES = "account long, seq long, tag long, outcome string, calls long, cost double"
CAPS = "account long, seq long, allowed boolean, blocked_by string"


class Ledger(StatefulProcessor):
    """One account's calls. Rows: account, seq, event_time, at (ms), kind (request, response, failure, or a note that
    changes nothing), tag, cost, in this order.

    A request is ``cached`` where its tag was answered; otherwise the first of these refuses it: ``cost`` (spent and reserve exceed the
    cap), ``unpriced`` (an answer without a cost came), ``unresolved`` (the tag was started before), ``calls`` (cap reached). Else it is
    ``started`` and has until its deadline. An answer in time is a ``response`` and its cost is spent, a ``failure`` resolves nothing:
    the tag is never started again. Past the deadline a ``timeout`` is told once, by a timer or by the next row of the tag, and what
    still comes is ``expired``. Answers to what was not started are ``orphan``; rows up to the last seq seen are ``repeated``.
    """

    def __init__(self, calls: int, cost: float, reserve: float, patience_ms: int):
        self.caps, self.patience = (calls, cost, reserve), patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "seq long, calls long, cost double, unpriced long")
        self.tags = handle.getMapState("tags", "tag long", "status string, seq long, deadline long")

    def refused(self, status: str | None, calls: int, cost: float, unpriced: int) -> str | None:
        most, cap, reserve = self.caps
        rules = (("cached", status == "done"), ("cost", cost + reserve > cap), ("unpriced", unpriced > 0), ("unresolved", status is not None), ("calls", calls >= most))
        return next((name for name, hit in rules if hit), None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.totals.get() if self.totals.exists() else None
        last, calls, cost, unpriced = known or (-1, 0, 0.0, 0)
        # every call to the state is a message: an account's tags (of calls started, so at most the cap) are read once and written once
        tags = {slot[0]: tuple(v) for slot, v in self.tags.iterator()} if known and calls else {}
        before = dict(tags)
        for _, seq, _, at, kind, tag, price in sorted(rows, key=itemgetter(1)):
            said = []
            status, started, deadline = tags.get(tag, (None, None, None)) if kind != "note" else (None, None, None)
            if seq <= last:
                said.append((seq, "repeated"))
            elif kind != "note":
                if status == "started" and at > deadline:
                    said.append((started, "timeout"))
                    status = "timeout"
                    tags[tag] = (status, started, deadline)
                if kind == "request":
                    outcome = self.refused(status, calls, cost, unpriced)
                    if outcome is None:
                        outcome, calls, deadline = "started", calls + 1, at + self.patience
                        tags[tag] = ("started", seq, deadline)
                elif status == "started":
                    outcome = kind
                    tags[tag] = ("done" if outcome == "response" else "failed", started, deadline)
                    if outcome == "response":
                        cost, unpriced = cost + (price or 0.0), unpriced + (price is None)
                else:
                    outcome = "expired" if status == "timeout" else "orphan"
                said.append((seq, outcome))
            last = max(last, seq)
            for told, outcome in said:
                plain = outcome in ("timeout", "repeated")
                yield OUTCOME(key[0], told, tag, outcome, None if plain else calls, None if plain else cost)
        for tag, v in tags.items():
            if before.get(tag) != v:
                self.tags.updateValue((tag,), v)
        new = [v[2] for tag, v in tags.items() if v[0] == "started" and before.get(tag) != v]
        old = [v[2] for v in before.values() if v[0] == "started"]
        if new and (not old or min(new) < min(old)):  # an account has a timer for its first deadline; the next follows when it fires
            self.handle.registerTimer(min(new))
        self.totals.update((last, calls, cost, unpriced))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        waiting = []
        for (tag,), (status, started, deadline) in list(self.tags.iterator()):
            if status == "started" and deadline <= due:
                self.tags.updateValue((tag,), ("timeout", started, deadline))
                yield OUTCOME(key[0], started, tag, "timeout", None, None)
            elif status == "started":
                waiting.append(deadline)
        if waiting:
            self.handle.registerTimer(min(waiting))

    def close(self) -> None:
        pass


class Caps(StatefulProcessor):
    """Running totals against caps: a row is allowed while its number and the cost up to it, with a reserve, stay within them."""

    def __init__(self, calls: int, cost: float, reserve: float):
        self.caps = (calls, cost, reserve)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "seq long, calls long, cost double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        (last, calls, cost), (most, cap, reserve) = self.totals.get() if self.totals.exists() else (-1, 0, 0.0), self.caps
        for r in sorted(rows, key=lambda r: r["seq"]):
            if r["seq"] > last:  # a row that comes again is neither counted nor told twice
                last, calls, cost = r["seq"], calls + 1, cost + (r["cost"] or 0.0)
                blocked = "calls" if calls > most else "cost" if cost + reserve > cap else None
                yield Row(account=key[0], seq=last, allowed=blocked is None, blocked_by=blocked)
        self.totals.update((last, calls, cost))

    def close(self) -> None:
        pass


def outcomes(calls: DataFrame, most_calls: int, most_cost: float, reserve: float, patience_ms: int, lateness: str) -> DataFrame:
    """The outcome of every row of a stream of (account, seq, at: timestamp, kind, tag, cost). ``patience_ms`` is a call's time until its
    deadline, ``lateness`` how far the watermark that fires timers stays behind. A batch's rows of an account are ordered in one
    task: the bytes or files that the source gives a trigger bound them. Rows behind the watermark are late: they are dropped and counted."""
    rows = calls.withWatermark("at", lateness).select("account", "seq", F.col("at").alias("event_time"), F.unix_millis("at").alias("at"), "kind", "tag", "cost")
    return rows.groupBy("account").transformWithState(Ledger(most_calls, most_cost, reserve, patience_ms), OUTCOMES, "Append", "EventTime")


def capped(calls: DataFrame, most_calls: int, most_cost: float, reserve: float) -> DataFrame:
    """Which rows of a stream of (account, seq, cost) stay within the caps."""
    return calls.select("account", "seq", "cost").groupBy("account").transformWithState(Caps(most_calls, most_cost, reserve), CAPS, "Append", "None")
