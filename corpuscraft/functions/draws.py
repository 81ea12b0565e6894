"""Draws from hashes: uniform numbers and binomial counts, the same on every machine and in every run."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def uniform(*keys: Column) -> Column:
    """A number from 0 to below 1: the first 13 hex digits of a sha256."""
    digest = F.sha2(F.concat_ws("|", *[k.cast("string") for k in keys]), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / float(1 << 52)


def binomial(n: Column, p: Column, u: Column) -> Column:
    """How many of ``n`` draws hit with chance ``p``, by inversion of ``u``: weights relative to the mode, over ten standard deviations
    and ten to each side (what lies beyond weighs under 1e-20), the upper side first. The work is that of the deviation, not of n."""
    d = n.cast("double")
    up = lambda i: (d - i) * p / ((i + 1) * (1 - p))
    down = lambda i: i * (1 - p) / ((d - i + 1) * p)
    none = F.array().cast("array<bigint>")

    def mass(places: Column, ratio) -> Column:
        step = lambda acc, i: once(acc["w"] * ratio(i), lambda w: F.struct(w.alias("w"), (acc["s"] + w).alias("s")))
        return F.aggregate(places, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s")), step, lambda acc: acc["s"])

    def seek(places: Column, ratio, left: Column, mode: Column, by: int) -> Column:
        def step(acc, i):
            moved = once(acc["w"] * ratio(i), lambda w: F.struct(w.alias("w"), (acc["left"] - w).alias("left"), (i + by).alias("at")))
            return F.when(acc["left"] >= 0, moved).otherwise(acc)

        return F.aggregate(places, F.struct(F.lit(1.0).alias("w"), left.alias("left"), mode.alias("at")), step)

    def drawn(x: Column) -> Column:
        mode, first, last = x["mode"], F.greatest(F.lit(0).cast("long"), x["mode"] - x["reach"]), F.least(n, x["mode"] + x["reach"])
        above = F.when(last > mode, F.sequence(mode, last - 1)).otherwise(none)
        below = F.when(first < mode, F.sequence(mode, first + 1, F.lit(-1).cast("long"))).otherwise(none)
        fall = lambda risen: F.when(risen["left"] < 0, risen["at"]).otherwise(once(seek(below, down, risen["left"], mode, -1), lambda f: F.when(f["left"] < 0, f["at"]).otherwise(mode)))
        rise = lambda over: F.when(over < 0, mode).otherwise(once(seek(above, up, over, mode, 1), fall))
        return once(u * (1 + mass(above, up) + mass(below, down)) - 1, rise)  # below 0: the mode itself

    start = F.struct(F.least(n, F.floor((d + 1) * p)).alias("mode"), (F.ceil(F.sqrt(d * p * (1 - p)) * 10) + 10).alias("reach"))
    return F.when((n <= 0) | (p <= 0), F.lit(0).cast("long")).when(p >= 1, n).otherwise(once(start, drawn))


@lru_cache(maxsize=256)
def weights(n: int, p: float) -> tuple[int, np.ndarray, np.ndarray, float]:
    """The mode of a binomial, the weights above and below it relative to the mode's, and the sum of all, as ``binomial`` adds them."""
    d = float(n)
    mode, reach = min(n, math.floor((d + 1) * p)), math.ceil(math.sqrt(d * p * (1 - p)) * 10) + 10
    i, j = np.arange(mode, min(n, mode + reach), dtype=np.float64), np.arange(mode, max(0, mode - reach), -1, dtype=np.float64)
    up, down = np.cumprod((d - i) * p / ((i + 1) * (1 - p))), np.cumprod(j * (1 - p) / ((d - j + 1) * p))
    mass = lambda w: float(np.cumsum(w)[-1]) if len(w) else 0.0  # noqa: E731  in order, as a fold adds
    return mode, up, down, 1 + mass(up) + mass(down)


def count_of(n: int, p: float, u: float) -> int:
    """``binomial`` of one draw, in whole arrays with the same sums in the same order."""
    if n <= 0 or p <= 0:
        return 0
    if p >= 1:
        return n
    mode, up, down, total = weights(n, p)
    left = u * total - 1
    for side, by in ((up, 1), (down, -1)):
        if left < 0:
            break
        after = np.subtract.accumulate(np.concatenate([[left], side]))
        left = float(after[-1])
        if left < 0:
            return mode + by * int(np.argmax(after < 0))
    return mode


def net_column(us: Column, ns: Column, xs: Column) -> Column:
    """The net change of a resample: multinomial counts of changes ``xs`` that ``ns`` rows have, by conditional binomials of ``us``."""

    def run(us, ns, xs):
        import pandas as pd

        def net(u, n, x):
            left = rest = int(sum(n))
            out = 0
            for v, k, change in zip(u.tolist(), n.tolist(), x.tolist(), strict=True):
                got = count_of(left, k / rest, v)
                left, rest, out = left - got, rest - k, out + got * change
            return out

        return pd.Series([net(*row) for row in zip(us, ns, xs, strict=True)], dtype="int64")

    return F.pandas_udf(run, "long")(us, ns, xs)


def bootstrap_sql(changes: str, seed: str, reps: int) -> str:
    """The bootstrap of ``operators.core`` in SQL, over a query of (g, x): the same draws from the same hashes."""
    seek = lambda places, ratio, left, at: f"list_reduce(list_transform({places}, lambda i: {{'w': 0.0::DOUBLE, 'left': 0.0::DOUBLE, 'at': i}}), lambda a, e: CASE WHEN a.left >= 0 THEN {{'w': a.w * ({ratio}), 'left': a.left - a.w * ({ratio}), 'at': e.at + {at}}} ELSE a END, {{'w': 1.0::DOUBLE, 'left': {left}, 'at': mode}})"
    mass = lambda places, ratio: f"list_reduce(list_transform({places}, lambda i: {{'w': 0.0::DOUBLE, 's': 0.0::DOUBLE, 'at': i}}), lambda a, e: {{'w': a.w * ({ratio}), 's': a.s + a.w * ({ratio}), 'at': e.at}}, {{'w': 1.0::DOUBLE, 's': 0.0::DOUBLE, 'at': mode}}).s"
    up, down, above, below = "(d - e.at) * p / ((e.at + 1) * (1 - p))", "e.at * (1 - p) / ((d - e.at + 1) * p)", "range(mode, last_)", "range(mode, first_, -1)"
    return f"""
WITH RECURSIVE c AS (SELECT g, x, count(*) AS n FROM ({changes}) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY x) AS idx, sum(n) OVER (PARTITION BY g ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest FROM c),
s AS (
  SELECT g, rep::BIGINT AS rep, 0::BIGINT AS idx, m AS todo, 0::BIGINT AS net FROM (SELECT g, sum(n)::BIGINT AS m FROM c GROUP BY g), range({reps}) r(rep)
  UNION ALL
  SELECT g, rep, idx, todo - got, net + got * x FROM (SELECT *, CASE WHEN todo <= 0 THEN 0 WHEN p >= 1 THEN todo WHEN over < 0 THEN mode WHEN risen.left < 0 THEN risen.at WHEN fallen.left < 0 THEN fallen.at ELSE mode END AS got
    FROM (SELECT *, {seek(below, down, 'risen.left', -1)} AS fallen FROM (SELECT *, {seek(above, up, 'over', 1)} AS risen
    FROM (SELECT *, u * (1 + {mass(above, up)} + {mass(below, down)}) - 1 AS over
    FROM (SELECT *, greatest(0, mode - reach) AS first_, least(todo, mode + reach) AS last_
    FROM (SELECT *, least(todo, floor((d + 1) * p)::BIGINT) AS mode, ceil(sqrt(d * p * (1 - p)) * 10)::BIGINT + 10 AS reach
    FROM (SELECT s.g, s.rep, k.idx, s.todo, s.net, k.x, s.todo::DOUBLE AS d, k.n::DOUBLE / k.rest::DOUBLE AS p, CAST(('0x' || substr(sha256(concat_ws('|', '{seed}', s.g, s.rep, k.x)), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM s JOIN k ON k.g = s.g AND k.idx = s.idx + 1)))))))
),
t AS (SELECT rep, sum(net) AS net FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY g, rep ORDER BY idx DESC) = 1) GROUP BY rep)
SELECT quantile_cont(net, 0.025)::DOUBLE AS low, quantile_cont(net, 0.975)::DOUBLE AS high, count(*) AS reps FROM t"""
