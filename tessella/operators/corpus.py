"""Relational steps over task corpora: dedup, strata, splits, quotas, joins and audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.hashing import digest_mod5, stable_order
from tessella.operators.positions import numbered, ranked
from tessella.sources.staging import staged


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in ``order``, by a minimum with map-side combining."""
    rest = [c for c in df.columns if c not in keys]
    # Only sortable columns may stand in the minimum; the order decides, then the rest.
    first = F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("__first")
    return df.groupBy(*keys).agg(first).select(*(F.col(c) if c in keys else F.col(f"__first.{c}") for c in df.columns))


def removed(df: DataFrame, keys: Sequence[str], key_id: str, order: Sequence[str]) -> DataFrame:
    """Ids that ``first_of_each`` leaves out."""
    return df.select(key_id).join(first_of_each(df, keys, order).select(key_id), key_id, "left_anti")


def grouped_copies(df: DataFrame, keys: Sequence[str], key_id: str) -> DataFrame:
    """One row for each key: its first id, how many ids, and their spread, without lists."""
    return df.groupBy(*keys).agg(F.min(key_id).alias("representative"), F.count("*").alias("copies"), F.max(key_id).alias("last_id"))


def copies_with_ids(df: DataFrame, keys: Sequence[str], key_id: str) -> DataFrame:
    """keys, representative (the first id), copies, place (1, 2, ...) and id: a row for each id in the order of its group, which may be of any size."""
    rows = ranked(df.select(*keys, key_id), list(keys), [key_id], "place", "copies")
    first = rows.where("place = 1").select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(key_id).alias("representative"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(first, same).select(*keys, "representative", "copies", "place", key_id)


def _hash_ranked(df: DataFrame, strata: list[str], key: str, seed: str = "") -> DataFrame:
    """``df`` with __rank in stable order within each stratum and __n, the stratum's rows."""
    return ranked(df.withColumn("__order", stable_order(key, seed)), strata, ["__order", key], "__rank", "__n").drop("__order")


def quotas(df: DataFrame, stratum: str, key: str, shares: Mapping[str, float], rest: str) -> DataFrame:
    """``profile`` by quota in each stratum: the first ``bround(share * n)`` keys in stable order, and so on."""
    before, chosen = F.lit(0), None
    for name, share in shares.items():
        upto = before + F.bround(F.col("__n") * F.lit(share)).cast("long")
        chosen = F.when(F.col("__rank") <= upto, name) if chosen is None else chosen.when(F.col("__rank") <= upto, name)
        before = upto
    profile = chosen.otherwise(rest) if chosen is not None else F.lit(rest)
    return _hash_ranked(df, [stratum], key).withColumn("profile", profile).drop("__rank", "__n")


def residual_quotas(df: DataFrame, stratum: str, key: str, legacy: str, shares: Mapping[str, float], rest: str) -> DataFrame:
    """``profile``: the legacy one where a row has it; the others fill up each stratum's quotas in stable order.

    A stratum whose legacy rows exceed a quota is an error.
    """
    within = df.groupBy(stratum).agg(F.count("*").alias("__all"), *(F.count_if(F.col(legacy) == name).alias(f"__have_{i}") for i, name in enumerate(shares)), F.count_if(F.col(legacy) == rest).alias("__have_rest"))
    left, total = {}, F.lit(0)
    for i, share in enumerate(shares.values()):
        wanted = F.bround(F.col("__all") * F.lit(share)).cast("long")
        left[i], total = wanted - F.col(f"__have_{i}"), total + wanted
    left["rest"] = F.col("__all") - total - F.col("__have_rest")
    bad = F.least(*left.values(), F.lit(0)) < 0
    within = within.select(stratum, *(F.when(bad, F.raise_error(F.lit("legacy profiles exceed a quota"))).otherwise(c).alias(f"__left_{i}") for i, c in left.items()))
    new = _hash_ranked(df.where(F.col(legacy).isNull()), [stratum], key).join(within, stratum)
    before, chosen = F.lit(0), None
    for i, name in enumerate(shares):
        before = before + F.col(f"__left_{i}")
        chosen = F.when(F.col("__rank") <= before, name) if chosen is None else chosen.when(F.col("__rank") <= before, name)
    filled = new.withColumn("profile", chosen.otherwise(rest)).select(*df.columns, "profile")
    return filled.unionByName(df.where(F.col(legacy).isNotNull()).withColumn("profile", F.col(legacy)))


def top_quota(df: DataFrame, stratum: Sequence[str], n: int, key: str, seed: str = "") -> DataFrame:
    """n rows of each stratum in stable order."""
    order = Window.partitionBy(*stratum).orderBy(stable_order(key, seed), key)
    return df.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= n).drop("__rank")


def round_robin(df: DataFrame, stratum: Sequence[str], n: int, key: str, seed: str = "") -> DataFrame:
    """n rows, one of each stratum in turn; ``turn`` is the round. The limit is the operator's own."""
    order = Window.partitionBy(*stratum).orderBy(stable_order(key, seed), key)
    # No stratum gives more than n, so most rows go before the shuffle.
    return df.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= n).orderBy("turn", *stratum).limit(n)


def one_each_then_fill(df: DataFrame, stratum: str, n: int, key: str, seed: str = "") -> DataFrame:
    """n rows: the first of each stratum in stable order, by key, then others in stable order over all. The limit is the operator's own.

    Firsts are minima with map-side combining; both cuts keep n rows a task.
    """
    rows = df.withColumn("__order", stable_order(key, seed))
    first = rows.groupBy(stratum).agg(F.min(F.struct("__order", key)).alias("__first"))
    firsts = staged(first.select(F.col(f"__first.{key}").alias(key)), "firsts")
    left = max(0, n - firsts.count())
    others = rows.join(firsts, key, "left_anti").orderBy("__order", key).limit(left)
    return df.join(firsts.orderBy(key).limit(n).unionByName(others.select(key)), key, "left_semi")


def hash_split(df: DataFrame, group: str) -> DataFrame:
    """``split``: dev for groups whose digest is 0 modulo 5, else train; a group is never cut. Where no group is dev, the last one is."""
    dev = digest_mod5(F.col(group).cast("string")) == 0
    last = None if not df.where(dev).isEmpty() else df.agg(F.max(group)).first()[0]
    return df.withColumn("split", F.when(dev if last is None else F.col(group) == last, "dev").otherwise("train"))


def allocate(df: DataFrame, key: str, rules: Sequence[tuple[str, Column, int]], rest: str) -> DataFrame:
    """``split``: each rule (split, condition, n) takes the first n keys that it fits and no earlier rule took, in stable order seeded
    by split and place of the rule; ``rest`` takes what is left. A rule that finds fewer than n is an error."""
    taken = None
    for i, (split, condition, n) in enumerate(rules):
        pool = df.where(condition)
        if taken is not None:
            pool = pool.join(taken.select(key), key, "left_anti")
        found = staged(pool.orderBy(stable_order(key, f"{split}-{i}"), key).limit(n).select(key, F.lit(split).alias("split")), "allocated")
        if (got := found.count()) < n:
            raise ValueError(f"rule {i} for {split} finds {got} of {n}")
        taken = found if taken is None else taken.unionByName(found)
    if taken is None:
        return df.withColumn("split", F.lit(rest))
    return df.join(taken, key, "left").withColumn("split", F.coalesce("split", F.lit(rest)))


def leaks(df: DataFrame, split: str, group: str) -> DataFrame:
    """Groups that stand in more than one split."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def complete(parts: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """missing, extra, repeated: how parts differ from the whole's keys."""
    n = lambda d, name: d.agg(F.count("*").alias(name))
    missing = n(whole.select(key).subtract(parts.select(key)), "missing")
    extra = n(parts.select(key).subtract(whole.select(key)), "extra")
    twice = n(parts.groupBy(key).count().where("count > 1"), "repeated")
    return missing.crossJoin(extra).crossJoin(twice)


def priority_buckets(df: DataFrame, buckets: Sequence[tuple[str, Column, int]], key: str, seed: str = "") -> DataFrame:
    """``bucket``: the first whose condition a row meets, its first n rows in stable order."""
    named = None
    for name, condition, _ in buckets:
        named = F.when(condition, name) if named is None else named.when(condition, name)
    rows = df.withColumn("bucket", named).where("bucket is not null")
    rows = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("bucket").orderBy(stable_order(key, seed), key)))
    limit = F.create_map(*(F.lit(x) for name, _, n in buckets for x in (name, n)))
    return rows.where(F.col("__rank") <= limit[F.col("bucket")]).drop("__rank")


def capped_buckets(df: DataFrame, buckets: Sequence[tuple[str, Column, int]], key: str, group: str, cap: int, seed: str = "") -> DataFrame:
    """``bucket``: for one bucket after the other its first n fitting rows in stable order, no row twice and at most ``cap`` of a group in all.

    A row is taken if fewer than the group's remaining places lie ahead of it in its group, so the cap is a rank, not a loop.
    """
    picked = None
    for name, condition, n in buckets:
        pool = df.where(condition)
        if picked is None:
            pool = pool.withColumn("__used", F.lit(0))
        else:
            used = picked.groupBy(group).agg(F.count("*").alias("__used"))
            pool = pool.join(picked.select(key), key, "left_anti").join(used, group, "left").withColumn("__used", F.coalesce("__used", F.lit(0)))
        order = [stable_order(key, f"{seed}{name}"), F.col(key)]
        rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
        some = pool.withColumn("__rank", rank).where(F.col("__rank") <= cap).where(F.col("__rank") + F.col("__used") <= cap)
        found = staged(some.orderBy(*order).limit(n).select(*df.columns, F.lit(name).alias("bucket")), "bucket")
        picked = found if picked is None else picked.unionByName(found)
    return picked


def disjoint_quotas(df: DataFrame, categories: Sequence[tuple[str, int]], key: str, order: Sequence[Column]) -> DataFrame:
    """``category``: for one category after the other the first n rows with a positive count in its column, by that count and then ``order``;
    a row that is taken is gone for the rest."""
    picked = None
    for name, n in categories:
        pool = df.where(F.col(name) > 0)
        if picked is not None:
            pool = pool.join(picked.select(key), key, "left_anti")
        found = staged(pool.orderBy(F.desc(name), *order, key).limit(n).select(key, F.lit(name).alias("category")), "category")
        picked = found if picked is None else picked.unionByName(found)
    return picked


def with_replacement(df: DataFrame, stratum: str, n: int, key: str) -> DataFrame:
    """n rows of each stratum in stable order, going round again where it has fewer; ``turn`` is the round."""
    rows = _hash_ranked(df, [stratum], key).where(F.col("__rank") <= n)
    rounds = F.floor((F.lit(n) - F.col("__rank")) / F.col("__n")).cast("int")
    return rows.withColumn("turn", F.explode(F.sequence(F.lit(0), rounds))).drop("__rank", "__n")


def replayed(base: DataFrame, extra: DataFrame, key: str, seed: str) -> DataFrame:
    """Base rows and extra rows (with ``turn``, the round), ``role`` telling which, ordered by ``place``: a hash of key, role and round."""
    rows = base.withColumns({"role": F.lit("base_unique"), "turn": F.lit(0)}).unionByName(extra.withColumn("role", F.lit("replay")))
    return rows.withColumn("place", F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), "role", F.col("turn").cast("string")), 256))


def coverage_plan(rows: Column, batch: Column, steps: Column) -> dict[str, Column]:
    """What a loader that drops the last part of a batch covers."""
    epoch = F.floor(rows / batch).cast("long")
    covered = epoch * batch
    return {
        "steps_per_epoch": epoch, "covered_rows": covered, "dropped_rows": rows - covered, "prompt_slots": steps * batch,
        "full_coverage": (rows == covered) & (steps >= epoch),
    }


def guarded(paths: Sequence[str], forbidden: Sequence[str]) -> list[str]:
    """The paths, if none has a forbidden part (whole names between slashes, any case); else an error."""
    bad = sorted({p for p in paths if {x.lower() for x in p.split("/")} & {f.lower() for f in forbidden}})
    if bad:
        raise ValueError(f"these sources aren't for training: {', '.join(bad)}")
    return list(paths)


def is_guarded(path: Column, forbidden: Sequence[str]) -> Column:
    """Whether a path has a forbidden part, for tables of paths; a null path has none."""
    return F.coalesce(F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*(F.lit(f.lower()) for f in forbidden))), F.lit(False))


def unique_first(df: DataFrame, task: str, key: str) -> DataFrame:
    """``place``: (0, ...) for the first row of each task, then the repeats, both in stable order."""
    order = Window.partitionBy(task).orderBy(key)
    return df.withColumn("repeat", (F.row_number().over(order) > 1).cast("int")).withColumn("order_key", stable_order(key))


def epoch_order(df: DataFrame, task: str, key: str, seed: str = "") -> DataFrame:
    """key, ``repeat``, ``position`` (0, 1, ...): the first row of each task, by key, in stable order, then the repeats in stable order.

    First rows are minima with map-side combining; positions come from sorted ranges, so no task orders an epoch or a task's repeats.
    Null tasks are one task; rows that share task and key are in any order.
    """
    first = df.groupBy(F.col(task).alias("__task")).agg(F.min(key).alias(key))
    heads = first.select("__task", key, F.lit(0).alias("repeat"))
    told = df.select(task, key).join(heads.withColumnRenamed(key, "__key"), F.col(task).eqNullSafe(F.col("__task")) & (F.col(key) == F.col("__key")), "left")
    rows = told.select(key, F.coalesce("repeat", F.lit(1)).alias("repeat"), stable_order(key, seed).alias("__order"))
    return numbered(rows, ["repeat", "__order", key], "position").drop("__order")


def same_multiset(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """equal: whether both hold the same texts as often."""
    # A null is no empty text.
    count = lambda d: d.groupBy(F.coalesce(F.sha2(F.col(column), 256), F.lit("null")).alias("h")).agg(F.count("*").alias("n"))
    left, right = count(a), count(b)
    odd = left.join(right, ["h", "n"], "left_anti").unionByName(right.join(left, ["h", "n"], "left_anti"))
    return odd.agg((F.count("*") == 0).alias("equal"), F.count("*").alias("different"))


def marker_leaks(df: DataFrame, text: str, markers: Sequence[str]) -> DataFrame:
    """Rows whose text has a marker, with the markers found."""
    found = F.filter(F.array(*(F.lit(m) for m in markers)), lambda m: F.contains(F.lower(F.col(text)), F.lower(m)))
    return df.withColumn("markers", found).where(F.size("markers") > 0)


def record_audit(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """``problems``: missing (null) and empty required fields of each row that has some."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"missing:{c}")).when(F.trim(F.col(c).cast("string")) == "", F.lit(f"empty:{c}")) for c in required]
    return df.withColumn("problems", F.array_compact(F.array(*checks))).where(F.size("problems") > 0)


#: Ids whose sorted list one task hashes, about.
DIGEST_IDS = 50_000


def ids_digest(df: DataFrame, key: str) -> DataFrame:
    """n and digest: one SHA-256 that seals a set of integer ids, whatever their order.

    A digest of one sorted list of all ids would need all of them in one task. So ids are dealt to buckets by value, a power of two of
    them, each for about DIGEST_IDS; each sorted bucket has a digest, and the digest of these, in order, is the result.
    """
    n = df.count()
    buckets = 1 << max(0, (max(1, n) // DIGEST_IDS).bit_length())
    each = df.groupBy(F.pmod(F.col(key), F.lit(buckets)).alias("b")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), "\n"), 256).alias("d"))
    whole = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.array_sort(F.collect_list(F.struct("b", "d"))).alias("x"))
    return whole.select("n", F.sha2(F.array_join(F.transform("x", lambda x: x["d"]), "\n"), 256).alias("digest"))


def reusable(rows: DataFrame, verified: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Keys of rows whose fields all equal those of a verified row; nulls are equal."""
    same = F.col("a." + key) == F.col("b." + key)
    for c in fields:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return rows.alias("a").join(verified.alias("b"), same, "left_semi").select(key)


def readiness(df: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """group, repeated (rows beyond the first of each key), empty (blank or null texts), ready."""
    blank = F.col(text).isNull() | (F.trim(text) == "")
    counts = df.groupBy(group).agg((F.count("*") - F.count_distinct(key)).alias("repeated"), F.count_if(blank).alias("empty"))
    return counts.withColumn("ready", (F.col("repeated") == 0) & (F.col("empty") == 0))


def checks(*found: DataFrame) -> DataFrame:
    """gate, passed: a row for each column of one-row tables of booleans."""
    out = None
    for df in found:
        names = ", ".join(f"'{c}', `{c}`" for c in df.columns)
        rows = df.selectExpr(f"stack({len(df.columns)}, {names}) AS (gate, passed)")
        out = rows if out is None else out.unionByName(rows)
    return out
