"""Splits by whole groups: seeded trials run side by side as Spark tasks, each over a stream of the groups' counts."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.positions import numbered
from tessella.sources.staging import staged

#: Decimal places to which costs are compared, so that the order of a sum doesn't decide.
PLACES = 9


def group_counts(df: DataFrame, group: str, labels: Sequence[str]) -> tuple[DataFrame, int]:
    """A row for each group: group, size, ``cells`` (for each label value that it has: its number, its rows here, its rows in all),
    and how many label values there are. Nulls are a group and a value of their own."""
    long = df.select(group, F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("value")) for c in labels))).alias("x"))
    each = staged(long.groupBy(group, "x").agg(F.count("*").alias("n")), "cells")
    whole = numbered(each.groupBy("x").agg(F.sum("n").alias("whole")), ["x"], "cell")
    values = whole.count()
    cells = each.join(whole.withColumnRenamed("x", "y"), F.col("x").eqNullSafe(F.col("y")))
    # Every row has one value of each label, so the first label's cells add up to the group's rows.
    size = F.sum(F.when(F.col("x.label") == labels[0], F.col("n")))
    lists = cells.groupBy(group).agg(size.alias("size"), F.array_sort(F.collect_list(F.struct("cell", "n", "whole"))).alias("cells"))
    return staged(lists, "groups"), values


class _Deal:
    """What one trial has dealt so far: rows and cells of each split."""

    def __init__(self, shares: np.ndarray, total: float, values: int, weight: float) -> None:
        self.shares, self.weight, self.place = shares, weight, 0
        self.want = shares * total
        self.rows = np.zeros(len(shares))
        self.have = np.zeros((len(shares), values))
        self.whole = np.zeros(values)

    def rise(self, size: int, at: np.ndarray, n: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """How much each split's part of the cost rises if it takes the group: no other part changes."""
        want, room = whole[None] * self.shares[:, None], np.maximum(whole[None] * self.shares[:, None], 3)
        off, far = self.have[:, at] - want, self.rows - self.want
        rows = ((far + size) ** 2 - far**2) / np.maximum(self.want, 1) ** 2
        return self.weight * rows + (((off + n) ** 2 - off**2) / room**2).sum(1)

    def take(self, k: int, size: int, at: np.ndarray, n: np.ndarray, whole: np.ndarray) -> None:
        self.rows[k] += size
        self.have[k, at] += n
        self.whole[at] = whole
        self.place += 1

    def cost(self) -> float:
        """Squared relative distance of rows and cells from each split's share."""
        want = self.whole[None] * self.shares[:, None]
        return float(self.weight * (((self.rows - self.want) / np.maximum(self.want, 1)) ** 2).sum() + (((self.have - want) / np.maximum(want, 3)) ** 2).sum())


Choice = Callable[[_Deal, int, np.ndarray, np.ndarray, np.ndarray], int]


def _stream(choose: Choice, new: Callable[[], _Deal], names: Sequence[str] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Deals the groups of each trial as they come, in order: the splits by group, if ``names`` has their names, else the cost by trial."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trial, deal = None, new()
        for b in batches:
            trials, sizes, fixed = (b.column(c).to_numpy(zero_copy_only=False) for c in ("trial", "size", "fixed"))
            lists = b.column("cells")
            ends, flat = lists.offsets.to_numpy(), lists.values
            at, n, whole = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("cell", "n", "whole"))
            picked, costs = [], []
            for i in range(b.num_rows):
                if trials[i] != trial:
                    if trial is not None:
                        costs.append((trial, deal.cost()))
                    trial, deal = trials[i], new()
                s = slice(ends[i], ends[i + 1])
                k = int(fixed[i]) if fixed[i] >= 0 else choose(deal, sizes[i], at[s], n[s], whole[s])
                deal.take(k, sizes[i], at[s], n[s], whole[s])
                picked.append(k)
            if names is not None:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([names[k] for k in picked], pa.string())], ["__group", "split"])
            elif costs:
                yield _costs(costs)
        if names is None and trial is not None:
            yield _costs([(trial, deal.cost())])

    return run


def _costs(rows: list[tuple[int, float]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(t) for t, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.float64())], ["trial", "cost"])


def _best(counts: DataFrame, group: str, order: list, choose: Choice, new: Callable[[], _Deal], names: Sequence[str], trials: int, seed: int) -> DataFrame:
    """group, split by the trial of least cost (ties: the first trial).

    The first pass keeps a number for each trial; only the best one is dealt again and written.
    """
    spark = counts.sparkSession
    parts = min(trials, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("trial").cast("string"), F.col("__group").cast("string")), 256)
    rows = counts.withColumnRenamed(group, "__group").select("__group", "size", "fixed", "cells")
    every = rows.withColumn("trial", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trials - 1).cast("long")))).withColumn("__key", key)
    every = every.repartition(parts, "trial").sortWithinPartitions("trial", *order, "__key", "__group")
    costs = every.drop("__key").mapInArrow(_stream(choose, new, None), "trial long, cost double")
    best = costs.agg(F.min_by("trial", F.struct(F.round("cost", PLACES), "trial"))).first()[0]
    one = rows.withColumn("trial", F.lit(best if best is not None else 0).cast("long")).withColumn("__key", key)
    # A deal is a sequence: one task streams over the groups of the best trial, with the splits' sums in memory.
    one = one.repartition(1).sortWithinPartitions(*order, "__key", "__group").drop("__key")
    kind = counts.schema[group].dataType.simpleString()
    return staged(one.mapInArrow(_stream(choose, new, names), f"__group {kind}, split string"), "split").withColumnRenamed("__group", group)


def group_split(df: DataFrame, group: str, labels: Sequence[str], shares: Mapping[str, float], frozen: Mapping | None = None, trials: int = 1, seed: int = 0) -> DataFrame:
    """group, split: whole groups dealt so that rows and labels come near their shares in every split.

    Each trial takes the frozen groups first, then the others, largest first and equal ones in a hash order of its own; a group goes where
    the cost rises least (ties: the first split). The trial of least cost counts. Trials run side by side; a trial is a stream over
    the groups that keeps the sums of each split, so neither groups nor trials have to fit in a task or on the driver.
    An empty table gives an empty result; a null group is one of its own.
    """
    counts, values = group_counts(df, group, labels)
    total = counts.agg(F.sum("size")).first()[0] or 0
    names, part = list(shares), np.array(list(shares.values()))
    at = {g: names.index(s) for g, s in (frozen or {}).items()}
    fixed = F.lit(-1)
    if at:
        told = df.sparkSession.createDataFrame(list(at.items()), f"__g {df.schema[group].dataType.simpleString()}, __k int")
        counts = counts.join(told, F.col(group).eqNullSafe(F.col("__g")), "left")
        fixed = F.coalesce("__k", F.lit(-1))
    counts = counts.withColumn("fixed", fixed)

    def least(deal: _Deal, size: int, at: np.ndarray, n: np.ndarray, whole: np.ndarray) -> int:
        return int(np.argmin(np.round(deal.rise(size, at, n, whole), PLACES)))

    order = [F.col("fixed") < 0, F.desc("size")]
    return _best(counts, group, order, least, lambda: _Deal(part, total, values, 4.0), names, max(1, trials), seed)


def exact_split(df: DataFrame, group: str, labels: Sequence[str], shares: Mapping[str, float], trials: int = 5000, seed: int = 0) -> DataFrame:
    """group, split: so many whole groups to each split as its share says (one at least), by the best of random deals.

    Groups per split are rounded half to even, the last split has the rest. Each trial is a hash order of the groups, cut at these
    numbers; rows and labels give its cost as in ``group_split``. Fewer groups than splits are an error.
    """
    counts, values = group_counts(df, group, labels)
    groups, total = counts.agg(F.count("*"), F.sum("size")).first()
    names, part = list(shares), np.array(list(shares.values()))
    if groups < len(names):
        raise ValueError("there are fewer groups than splits")
    ends: list[int] = []
    for k in range(len(names) - 1):
        dealt = ends[-1] if ends else 0
        ends.append(dealt + min(max(round(groups * part[k]), 1), groups - dealt - (len(names) - 1 - k)))

    def by_place(deal: _Deal, size: int, at: np.ndarray, n: np.ndarray, whole: np.ndarray) -> int:
        return bisect_right(ends, deal.place)

    return _best(counts.withColumn("fixed", F.lit(-1)), group, [], by_place, lambda: _Deal(part, total, values, 8.0), names, max(1, trials), seed)
