"""Generated groups of questions: drawn parameters, registries of what exists, slots filled in rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import core, slots
from ._registry import query

#: The families of slots and the contrasts that every group asks.
FAMILIES = ("events", "moments", "poisson", "process", "uniform")
CONTRASTS = ("both", "neither", "exactly_one", "at_least_one", "same")
ATTEMPTS = 8


def drawn_sql(table: str, seed: str, key: str, attempt: str) -> str:
    draw = lambda what, n: f"CAST(CAST(('0x' || substr(sha256(concat_ws('|', '{seed}:{what}', {key}, {attempt})), 1, 8)) AS UBIGINT) % ({n}) AS BIGINT)"
    inner = f"SELECT *, 101 + 2 * {draw('da', 'n')} AS da, 101 + 2 * {draw('db', 'n')} AS db, {draw('turn', '2')} AS turn FROM {table}, sp"
    numbers = f"SELECT *, 1 + {draw('na', 'da - 1')} AS na, 1 + {draw('nb', 'db - 1')} AS nb FROM ({inner})"
    keyed = "['task|' || family || '|' || na || '/' || da || '|' || nb || '/' || db, 'projection|' || family || '|' || na || '/' || da, 'group|' || family || '|' || na || '/' || da || '|' || nb || '/' || db || '|' || turn, 'question|' || question, 'prompt|' || nb || '/' || db || '|' || turn]"
    asked = f"SELECT *, CASE turn WHEN 0 THEN 'P(A)=' || na || '/' || da || '; P(B)=' || nb || '/' || db ELSE 'P(B)=' || nb || '/' || db || '; P(A)=' || na || '/' || da END AS question FROM ({numbers})"
    return f"SELECT *, {keyed} AS keys, na * db <> nb * da AND na * db + nb * da <> da * db AS valid FROM ({asked})"


def drawn(rows, seed: str, key: str, attempt, n):
    """``rows`` (with ``family``) with a drawn candidate: two fractions in an order, its question and the keys that it alone may hold."""
    draw = lambda what, most: core.hash_draw(f"{seed}:{what}", most, F.col(key), attempt)
    x = rows.select("*", (101 + 2 * draw("da", n)).alias("da"), (101 + 2 * draw("db", n)).alias("db"), draw("turn", F.lit(2)).alias("turn"))
    x = x.select("*", (1 + draw("na", F.col("da") - 1)).alias("na"), (1 + draw("nb", F.col("db") - 1)).alias("nb"))
    a, b, turn = F.concat_ws("/", "na", "da"), F.concat_ws("/", "nb", "db"), F.col("turn").cast("string")
    given = [F.concat(F.lit("P(A)="), a), F.concat(F.lit("P(B)="), b)]
    x = x.withColumn("question", F.when(F.col("turn") == 0, F.concat_ws("; ", *given)).otherwise(F.concat_ws("; ", *reversed(given))))
    named = {"task": ["family", a, b], "projection": ["family", a], "group": ["family", a, b, turn], "question": ["question"], "prompt": [b, turn]}
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), F.concat_ws("|", *v).alias("key")) for k, v in named.items()])
    cross = F.col("na") * F.col("db"), F.col("nb") * F.col("da")
    return x.select(*rows.columns, F.struct("na", "da", "nb", "db", "question").alias("candidate"), keys.alias("keys"), ((cross[0] != cross[1]) & (cross[0] + cross[1] != F.col("da") * F.col("db"))).alias("valid"))


NAMES = "['events', 'moments', 'poisson', 'process', 'uniform']"


@query(f"""
WITH RECURSIVE sp AS (SELECT greatest(40, ((SELECT count(*) FROM supplier) + (SELECT count(*) FROM part)) // 16) AS n),
slots AS (SELECT s_suppkey AS slot, {NAMES}[s_nationkey % 5 + 1] AS family FROM supplier),
old AS (SELECT DISTINCT unnest(keys) AS key FROM ({drawn_sql(f"(SELECT p_partkey, {NAMES}[p_size % 5 + 1] AS family FROM part)", 'old', 'p_partkey', '0')})),
made AS (SELECT * FROM ({drawn_sql(f'(SELECT slot, family, unnest(range(0, {ATTEMPTS})) AS attempt FROM slots)', 'slot', 'slot', 'attempt')}) WHERE valid),
k AS (SELECT slot, attempt, unnest(keys) AS key FROM made),
c AS (SELECT * FROM k WHERE (slot, attempt) NOT IN (SELECT slot, attempt FROM k JOIN old USING (key))),
s AS (
  SELECT 0 AS r, slot, CAST(NULL AS BIGINT) AS got FROM slots
  UNION ALL
  SELECT s.r + 1, s.slot, coalesce(s.got, w.attempt) FROM s LEFT JOIN (
    SELECT slot, attempt FROM (
      SELECT p.slot, p.attempt, p.key, min(p.slot) OVER (PARTITION BY p.key) AS first FROM (
        SELECT c.* FROM c JOIN s ON s.slot = c.slot AND s.got IS NULL AND s.r = c.attempt
        WHERE NOT EXISTS (SELECT 1 FROM c c2 JOIN (SELECT c3.key FROM s JOIN c c3 ON c3.slot = s.slot AND c3.attempt = s.got) t ON t.key = c2.key WHERE c2.slot = c.slot AND c2.attempt = c.attempt)
      ) p
    ) GROUP BY slot, attempt HAVING bool_and(slot = first)
  ) w ON w.slot = s.slot AND s.got IS NULL WHERE s.r < {ATTEMPTS}
)
SELECT family, s.slot, s.got AS attempt, contrast, unnest(range(0, 5)) AS contrast_position, CASE WHEN s.got IS NULL THEN 'exhausted' ELSE 'filled' END AS state, CASE WHEN s.got IS NOT NULL THEN question || '; find: ' || contrast END AS question
FROM (SELECT *, unnest(['both', 'neither', 'exactly_one', 'at_least_one', 'same']) AS contrast FROM s JOIN slots USING (slot) WHERE r = {ATTEMPTS}) s LEFT JOIN (SELECT slot, attempt, question FROM made) m ON m.slot = s.slot AND m.attempt = s.got
""".replace("contrast, unnest(range(0, 5)) AS contrast_position", "contrast, list_position(['both', 'neither', 'exactly_one', 'at_least_one', 'same'], contrast) - 1 AS contrast_position"))
def coverage_slots(t):
    """A group of five contrasting questions for every slot: candidates are drawn until one is free in all registries (tasks,
    projections, groups, questions, prompts) of the past and of this run; a slot that finds none says so."""
    family = lambda c: F.element_at(F.array(*map(F.lit, FAMILIES)), (c % 5 + 1).cast("int")).alias("family")
    suppliers, parts = t("supplier"), t("part")
    n = suppliers.select(F.lit(1).alias("x")).unionByName(parts.select(F.lit(1).alias("x"))).agg(F.greatest(F.lit(40), F.floor(F.count(F.lit(1)) / 16))).first()[0]
    past = drawn(parts.select("p_partkey", family(F.col("p_size"))), "old", "p_partkey", F.lit(0), F.lit(n)).select(F.explode("keys").alias("k")).select("k.kind", "k.key")
    grid = suppliers.select(F.col("s_suppkey").alias("slot"), family(F.col("s_nationkey")))
    got = slots.fill(grid, lambda rows, r: drawn(rows, "slot", "slot", F.lit(r), F.lit(n)), past, ATTEMPTS)
    rows = got.select("family", "slot", F.col("attempt").cast("long").alias("attempt"), "candidate", F.posexplode(F.array(*map(F.lit, CONTRASTS))).alias("contrast_position", "contrast"))
    state = F.when(F.col("attempt").isNull(), "exhausted").otherwise("filled")
    return rows.select("family", "slot", "attempt", "contrast", F.col("contrast_position").cast("long").alias("contrast_position"), state.alias("state"), F.concat(F.col("candidate.question"), F.lit("; find: "), "contrast").alias("question"))
