"""Gates against baselines, release conditions, self-hashes, cached answers, retry states and audits of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical
from . import merkle


def suite_counts(rows: DataFrame) -> DataFrame:
    """suite, category, n, correct, pending and those of depth three."""
    return rows.groupBy("suite", "category").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("correct"), F.count_if("pending").alias("pending"), F.count_if(F.col("correct") & (F.col("depth") == 3)).alias("deep_correct"))


def sides(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """Both runs by suite and category; what one side lacks counts as nought."""
    b = baseline.select("suite", "category", F.col("correct").alias("base"), F.col("deep_correct").alias("deep_base"))
    both = candidate.join(b, ["suite", "category"], "full")
    return both.select("suite", "category", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "correct", "pending", "deep_correct", "base", "deep_base")])


def retention(both: DataFrame, allowed: dict[str, tuple[int, int]]) -> list[DataFrame]:
    """Checks that a suite loses no more than allowed in all and in any category."""
    loss = lambda k: F.create_map(*[F.lit(x) for s, a in allowed.items() for x in (s, a[k])])[F.col("suite")]
    some = both.filter(F.col("suite").isin(*allowed))
    floor = lambda base, k: F.greatest(F.lit(0), base - loss(k))
    total = some.groupBy("suite").agg(F.sum("correct").alias("correct"), F.sum("base").alias("base"))
    return [
        total.select(F.concat("suite", F.lit(":total")).alias("check"), (F.col("correct") >= floor(F.col("base"), 0)).alias("ok")),
        some.select(F.concat_ws(":", "suite", "category").alias("check"), (F.col("correct") >= floor(F.col("base"), 1)).alias("ok")),
    ]


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validation_gate(candidate: DataFrame, baseline: DataFrame, allowed: dict[str, tuple[int, int]], deep: str, floors: tuple[str, int, int]) -> DataFrame:
    """check, ok: no pending rows, retention, no loss at depth three in one suite, floors in another."""
    both, (suite, total, each) = sides(candidate, baseline), floors
    own = both.filter(F.col("suite") == suite)
    return union([
        both.agg((F.sum("pending") == 0).alias("ok")).select(F.lit("no_pending").alias("check"), "ok"),
        *retention(both, allowed),
        both.filter(F.col("suite") == deep).select(F.concat_ws(":", "suite", "category", F.lit("depth3")).alias("check"), (F.col("deep_correct") >= F.col("deep_base")).alias("ok")),
        own.agg((F.sum("correct") >= total).alias("ok")).select(F.lit(f"{suite}:total").alias("check"), "ok"),
        own.select(F.concat_ws(":", "suite", "category").alias("check"), (F.col("correct") >= each).alias("ok")),
    ])


def promotion(candidate: DataFrame, baseline: DataFrame, allowed: dict[str, tuple[int, int]], target: str, category: str, least: tuple[int, int], category_least: tuple[int, int]) -> DataFrame:
    """n_checks, n_failed, passed, attainable: retention, and for a suite and one of its categories a floor and a gain. A gain that
    more right answers than questions would need is not attainable."""
    both = sides(candidate, baseline)
    own = both.filter(F.col("suite") == target)
    one = lambda c: F.sum(F.when(F.col("category") == category, F.col(c)).otherwise(0))
    sums = own.agg(F.sum("correct").alias("k"), F.sum("base").alias("b"), F.sum("n").alias("n"), one("correct").alias("k1"), one("base").alias("b1"), one("n").alias("n1"))
    named = {f"{target}:absolute": F.col("k") >= least[0], f"{target}:gain": F.col("k") >= F.col("b") + least[1], f"{category}:absolute": F.col("k1") >= category_least[0], f"{category}:gain": F.col("k1") >= F.col("b1") + category_least[1]}
    checks = union([*retention(both, allowed), sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), ok.alias("ok")) for n, ok in named.items()])).alias("x")).select("x.*")])
    verdict = checks.agg(F.count(F.lit(1)).alias("n_checks"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("n_failed"), F.every(F.coalesce("ok", F.lit(False))).alias("passed"))
    reach = sums.select(((F.col("b") + least[1] <= F.col("n")) & (F.col("b1") + category_least[1] <= F.col("n1"))).alias("attainable"))
    return verdict.join(F.broadcast(reach))  # one row each


def release(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """n_conditions, n_failed, released, failing: named aggregates, all of which must hold; one without an answer fails."""
    named = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(ok, F.lit(False)).alias("ok")) for n, ok in sorted(conditions.items())])
    failing = F.filter("x", lambda c: ~c["ok"])
    listed = F.when(F.size(failing) > 0, F.array_join(F.transform(failing, lambda c: c["name"]), ","))
    return rows.agg(named.alias("x")).select(F.size("x").cast("long").alias("n_conditions"), F.size(failing).cast("long").alias("n_failed"), (F.size(failing) == 0).alias("released"), listed.alias("failing"))


def vectors(rows: DataFrame, group: str, order: str, flags: dict[str, Column]) -> DataFrame:
    """Flags of a group's rows in order, as strings of 1 and 0."""
    bits = F.array_sort(F.collect_list(F.struct(F.col(order), *[F.when(c, "1").otherwise("0").alias(n) for n, c in flags.items()])))
    picked = lambda name: F.array_join(F.transform("x", lambda b: b[name]), "").alias(name)
    return rows.groupBy(group).agg(bits.alias("x")).select(group, *[picked(n) for n in flags])


def drift(now: DataFrame, prior: dict[str, str]) -> DataFrame:
    """name, frozen: each setting of a one-row map against the frozen one."""
    frozen = F.create_map(*[F.lit(x) for kv in prior.items() for x in kv])
    return now.select(F.explode("now").alias("name", "value")).select("name", F.col("value").eqNullSafe(frozen[F.col("name")]).alias("frozen"))


def verified_violations(rows: DataFrame, home: DataFrame, key: str, caps: dict[str, int]) -> DataFrame:
    """violation, n: unknown ids, repeated ids, rows outside their own split (the first that applies), and splits over their cap."""
    repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    d = rows.join(repeated, key).join(home, key, "left")
    kind = F.when(F.col("home").isNull(), "unknown").when(F.col("__n") > 1, "duplicate").when(F.col("split") != F.col("home"), "split")
    found = d.select(kind.alias("violation")).filter("violation is not null").groupBy("violation").agg(F.count(F.lit(1)).alias("n"))
    most = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col("split")]
    over = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(F.concat(F.lit("cap:"), F.col("split")).alias("violation"), "n")
    return found.unionByName(over)


def self_hashes(rows: DataFrame, record: str, field: str) -> DataFrame:
    """Adds ``state`` to records (JSON) that carry their own digest: valid, drifted or missing."""
    x = canonical.self_hash_column(F.col(record), F.lit(field))
    state = F.when(F.col("__x.stored").isNull(), "missing").when(F.col("__x.stored") == F.col("__x.computed"), "valid").otherwise("drifted")
    return rows.withColumn("__x", x).withColumn("state", state).drop("__x")


def cache_state(now: DataFrame, cached: DataFrame, key: str, grader: str) -> DataFrame:
    """key, state of each question's cached answer: uncached, made for another question, changed, of another grader, or valid."""
    c = cached.select(key, F.col("question_sha").alias("__q"), F.sha2("raw", 256).alias("__r"), "raw_sha", "grader", F.lit(True).alias("__there"))
    state = F.when(F.col("__there").isNull(), "uncached").when(~F.col("__q").eqNullSafe(F.col("question_sha")), "question").when(~F.col("__r").eqNullSafe(F.col("raw_sha")), "raw").when(~F.col("grader").eqNullSafe(F.lit(grader)), "grader").otherwise("valid")
    return now.join(c, key, "left").select(key, state.alias("state"))


def tree_digest(files: DataFrame, group: list[str]) -> DataFrame:
    """files, bytes and tree of (path, bytes, sha256) rows: the root of a Merkle tree over "path:sha256" in the order of paths."""
    sums = files.groupBy(*group).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    roots = merkle.Tree(files, group, ["path"], F.concat_ws(":", "path", "sha256")).roots.drop("depth")
    return sums.join(roots, group) if group else sums.join(F.broadcast(roots))  # one row each


def bound_manifest(metrics: DataFrame, name: str, version: str, values: list[str]) -> DataFrame:
    """One row of metrics with its name, version and the digest that binds them together."""
    m = metrics.withColumn("name", F.lit(name)).withColumn("version", F.lit(version)).withColumn("metrics", F.struct(*sorted(values)))
    return m.withColumn("manifest_sha", F.sha2(canonical.record("metrics", "name", "version"), 256))


def retry_states(ids: DataFrame, attempts: DataFrame, most: int) -> DataFrame:
    """id, attempts, accepted, retried, state: pending, accepted within ``most`` attempts, to be tried again, or exhausted."""
    within = F.col("attempt") <= most
    a = attempts.groupBy("id").agg(F.count(F.lit(1)).alias("attempts"), F.bool_or(F.when(within, F.col("ok"))).alias("ok"), F.bool_or(F.when(F.col("attempt") == 1, F.col("ok"))).alias("first"))
    j = ids.join(a, "id", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    accepted = F.coalesce("ok", F.lit(False))
    state = F.when(F.col("attempts") == 0, "pending").when(accepted, "accepted").when(F.col("attempts") < most, "retry").otherwise("exhausted")
    return j.select("id", "attempts", accepted.alias("accepted"), ((F.col("attempts") >= 2) & ~F.coalesce("first", F.lit(False))).alias("retried"), state.alias("state"))


def group_audit(rows: DataFrame, group: str, family: str, place: str, kind: str, sizes: dict[str, int], size: int, kinds: list[str]) -> DataFrame:
    """family, groups, wrong_size, wrong_places, missing_kinds: groups against expected sizes, places 1 to n and kinds."""
    g = rows.groupBy(group, family).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(place).alias("places"), F.min(place).alias("low"), F.max(place).alias("high"), F.array_sort(F.collect_set(kind)).alias("kinds"))
    want = F.coalesce(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col(family)], F.lit(size))
    return g.groupBy(family).agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") != want).alias("wrong_size"), F.count_if((F.col("places") != F.col("n")) | (F.col("low") != 1) | (F.col("high") != F.col("n"))).alias("wrong_places"), F.count_if(F.col("kinds") != F.array(*map(F.lit, sorted(kinds)))).alias("missing_kinds")
    )


def accepted(rows: DataFrame, keys: DataFrame, registry: DataFrame, id_col: str) -> DataFrame:
    """The ids of rows none of whose keys (kind, key) is registered."""
    hit = keys.join(registry, ["kind", "key"], "left_semi").select(id_col).distinct()
    return rows.select(id_col).join(hit, id_col, "left_anti")
