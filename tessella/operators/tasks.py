"""Tasks and their bookkeeping: filling families, batches by turn, trajectories of an oracle, catalogues, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.positions import ranked
from tessella.operators.rollouts import canonical


def filled_families(candidates: DataFrame, family: str, order: list[str], verified: Column, n: int) -> DataFrame:
    """The first n verified candidates of each family, with ``turn``; sorted by (turn, family) the families interleave."""
    rank = F.row_number().over(Window.partitionBy(family).orderBy(*order))
    return candidates.where(verified).withColumn("turn", rank).where(F.col("turn") <= n)


def rejections(candidates: DataFrame, family: str, reason: Column) -> DataFrame:
    """family, reason, n: why candidates were turned down (null: they weren't)."""
    return candidates.withColumn("reason", reason).where("reason is not null").groupBy(family, "reason").agg(F.count("*").alias("n"))


def next_batch(candidates: DataFrame, done: DataFrame, key: str, group: str, n: int) -> DataFrame:
    """The next n candidates that aren't done: groups with the fewest done come first, one of each in turn, by key."""
    have = done.groupBy(group).agg(F.count("*").alias("__have"))
    rows = candidates.join(done.select(key), key, "left_anti").join(have, group, "left")
    # No group gives more than n, so tasks keep n rows of each ahead of the shuffle.
    rows = rows.withColumn("__place", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("__place") <= n)
    return rows.withColumn("turn", F.coalesce("__have", F.lit(0)) + F.col("__place")).drop("__have", "__place").orderBy("turn", group, key).limit(n)


def oracle_trajectory(tasks: DataFrame, key: str, profile: str, stale: str, repaired: str) -> DataFrame:
    """key, place, action, arguments: the steps that solve each task; after a drift the stale query is run first."""
    drifted = F.col(profile) != "direct_clean"
    names = F.when(drifted, F.concat(F.array(F.lit("execute_sql")), canonical(F.col(profile)))).otherwise(canonical(F.col(profile)))
    rows = tasks.select(key, stale, repaired, profile, F.posexplode(names).alias("place", "action"))
    sql = F.when(F.col("action") == "execute_sql", F.when(F.col("place") == 0, F.col(stale)).otherwise(F.col(repaired))).when(F.col("action") == "submit_solution", F.col(repaired))
    return rows.select(key, "place", "action", F.when(sql.isNotNull(), F.to_json(F.struct(sql.alias("sql")))).otherwise("{}").alias("arguments"))


def unique_name(base: str, taken: Sequence[str]) -> str:
    """``base``, or with the first of _2, _3, ... that no column has, whatever the case."""
    have = {t.casefold() for t in taken}
    name, k = base, 1
    while name.casefold() in have:
        k += 1
        name = f"{base}_{k}"
    return name


def experiments(manifest: DataFrame, json: str) -> DataFrame:
    """experiment_id, tasks, success_rate, unsafe, category, selected: the results of a manifest (a map by experiment), one row each.

    Older manifests hold the results and the choice one level down.
    """
    kind = "map<string,struct<category:string,tasks:int,task_success_rate:double,unsafe_tasks:int>>"
    shape = f"struct<results:{kind},selected_experiment_id:string,tune_selection:struct<results:{kind}>,candidate:struct<experiment_id:string>>"
    m = manifest.select(F.from_json(json, shape).alias("m"))
    rows = m.select(F.coalesce("m.selected_experiment_id", "m.candidate.experiment_id").alias("chosen"), F.explode(F.coalesce("m.results", "m.tune_selection.results")).alias("experiment_id", "r"))
    guessed = F.when(F.contains("experiment_id", F.lit("grpo")), "GRPO").otherwise("SFT")
    return rows.select("experiment_id", F.coalesce("r.tasks", F.lit(0)).alias("tasks"), F.coalesce("r.task_success_rate", F.lit(0.0)).alias("success_rate"), F.coalesce("r.unsafe_tasks", F.lit(0)).alias("unsafe"),
                       F.coalesce("r.category", guessed).alias("category"), (F.col("experiment_id") == F.col("chosen")).alias("selected"))


def asks_about(question: Column, terms: Column) -> Column:
    """Whether a question names one of the ambiguous terms."""
    return F.coalesce(F.exists(terms, lambda t: (F.trim(t) != "") & F.contains(F.lower(question), F.lower(F.trim(t)))), F.lit(False))


def encoded_index(split: Column, family: Column, place: Column, splits: Sequence[str], families: Sequence[str], room: int = 1_000_000) -> Column:
    """One number for (split, family, place): places below ``room``."""
    at = lambda c, names: F.array_position(F.array(*(F.lit(n) for n in names)), c) - 1
    return (at(split, splits) * len(families) + at(family, families)) * room + place


def spaced(df: DataFrame, group: str, key: str) -> DataFrame:
    """``place``: 1, 2, ... of each group in the order of key, for groups of any size."""
    return ranked(df, [group], [key], "place")
