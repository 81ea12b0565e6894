"""Queries that run as streams: ledgers as keyed state, arrivals in event time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.shared import Scratch
from ..streaming import ledger
from ..streaming.resume import Stream, once_each
from ._registry import query

#: A naive timestamp as an instant, whatever the session's zone.
INSTANT = "timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts))"
#: A ledger's caps, and its times in milliseconds.
CALLS, COST, RESERVE, PATIENCE, LATENESS = 7, 90, 5, 432_000_000, 3_600_000


def call_rows(rows):
    """An account's calls as a stream of the events table tells them: what a row is, which call it belongs to and what that cost."""
    kind = F.when(F.col("event_type") == "view", "request").when(F.col("event_type") == "purchase", "response").when(F.col("event_type") == "error", "failure").otherwise("note")
    tag = F.get_json_object("props", "$.k").cast("long") % 12
    return rows.select(F.col("user_id").alias("account"), F.col("event_id").alias("seq"), F.expr(INSTANT).alias("at"), kind.alias("kind"), tag.alias("tag"), F.when(F.col("event_id") % 97 > 0, F.col("value")).alias("cost"))


@query(f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, CASE event_type WHEN 'view' THEN 'request' WHEN 'purchase' THEN 'response' WHEN 'error' THEN 'failure' END AS kind, CAST(json_extract(props, '$.k') AS BIGINT) % 12 AS tag, CASE WHEN event_id % 97 > 0 THEN value END AS c FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM e WHERE kind IS NOT NULL),
s AS (
  SELECT user_id, 0::BIGINT AS rn, 0::BIGINT AS calls, 0::DOUBLE AS cost, 0 AS unpriced, list_transform(range(12), lambda x: 'free') AS st, list_transform(range(12), lambda x: -1::BIGINT) AS dl, list_transform(range(12), lambda x: -1::BIGINT) AS own, -1::BIGINT AS seq, 0::BIGINT AS tag, '' AS outcome, -1::BIGINT AS told FROM (SELECT DISTINCT user_id FROM n)
  UNION ALL
  SELECT user_id, rn, calls + (o = 'started')::INT, cost + CASE WHEN o = 'response' THEN coalesce(c, 0) ELSE 0 END, unpriced + (o = 'response' AND c IS NULL)::INT,
    list_transform(st, lambda x, i: CASE WHEN i = tag + 1 THEN CASE o WHEN 'started' THEN 'started' WHEN 'response' THEN 'done' WHEN 'failure' THEN 'failed' ELSE now END ELSE x END), list_transform(dl, lambda x, i: CASE WHEN i = tag + 1 AND o = 'started' THEN ms + {PATIENCE} ELSE x END), list_transform(own, lambda x, i: CASE WHEN i = tag + 1 AND o = 'started' THEN event_id ELSE x END), event_id, tag, o, CASE WHEN now = 'timeout' AND was = 'started' THEN own[tag + 1] ELSE -1 END
  FROM (SELECT *, CASE kind
      WHEN 'request' THEN CASE WHEN now = 'done' THEN 'cached' WHEN cost + {RESERVE} > {COST} THEN 'cost' WHEN unpriced > 0 THEN 'unpriced' WHEN now <> 'free' THEN 'unresolved' WHEN calls >= {CALLS} THEN 'calls' ELSE 'started' END
      ELSE CASE now WHEN 'started' THEN kind WHEN 'timeout' THEN 'expired' ELSE 'orphan' END END AS o
    FROM (SELECT n.*, s.calls, s.cost, s.unpriced, s.st, s.dl, s.own, s.st[n.tag + 1] AS was, CASE WHEN s.st[n.tag + 1] = 'started' AND n.ms > s.dl[n.tag + 1] THEN 'timeout' ELSE s.st[n.tag + 1] END AS now FROM s JOIN n ON n.user_id = s.user_id AND n.rn = s.rn + 1))
),
ends AS (SELECT user_id, unnest(st) AS st, unnest(dl) AS dl, unnest(own) AS own, unnest(range(12)) AS tag FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1)
SELECT user_id AS account, seq, tag, outcome, calls, round(cost, 6) AS cost FROM s WHERE rn > 0
UNION ALL SELECT user_id, told, tag, 'timeout', NULL, NULL FROM s WHERE told >= 0
UNION ALL SELECT user_id, own, tag, 'timeout', NULL, NULL FROM ends WHERE st = 'started' AND dl <= (SELECT max(ms) - {LATENESS} FROM e)
""")
def ledger_stream(t):
    """Requests, answers and failures of every account through a keyed state machine with deadlines and caps on calls and cost."""
    stream = Stream.over(t("events"))
    stream.run(lambda rows: ledger.outcomes(call_rows(rows), CALLS, COST, RESERVE, PATIENCE, f"{LATENESS} milliseconds"))
    return stream.rows.withColumn("cost", F.round("cost", 6))


@query("WITH c AS (SELECT *, ((event_id - lo) * 3) // (hi - lo + 1) AS part FROM events, (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events)), w AS (SELECT max(epoch_ms(ts)) - 3600000 AS mark FROM c WHERE part <= 1) SELECT user_id, count(*) AS n, round(max(value), 6) AS best, (SELECT count_if(part = 0) + count_if(part = 1 AND epoch_us(ts) <= mark * 1000) FROM c, w) AS late FROM events GROUP BY user_id")
def event_time_state(t):
    """Events that arrive in three runs of one stream, the second third once more with the last, the first once more under new ids:
    known and late rows change nothing, and the late ones are counted."""
    e = t("events").select("event_id", "user_id", "value", F.expr(INSTANT).alias("at"))
    ends = e.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))  # one row
    part = F.expr("((event_id - lo) * 3) div (hi - lo + 1)")
    cut = e.join(F.broadcast(ends)).withColumn("part", part)
    scratch = Scratch(e.sparkSession, "arrivals")
    arrivals = [cut.filter("part = 0"), cut.filter("part = 1"), cut.filter("part >= 1").unionByName(cut.filter("part = 0").withColumn("event_id", F.col("event_id") + 1_000_000_000))]
    stream, late = Stream(e.sparkSession, scratch.path("in"), e.schema), 0
    for rows in arrivals:
        rows.select(*e.columns).write.mode("append").parquet(scratch.path("in"))
        late += stream.run(lambda r: once_each(r, "event_id", "at", "1 hour"))
    return stream.rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 6).alias("best"), F.lit(late).cast("long").alias("late"))
