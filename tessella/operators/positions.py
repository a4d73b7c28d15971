"""Positions in a global order without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.staging import staged


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``name``: 0, 1, ... in the order of ``keys`` (ties in any order).

    Rows are dealt by range and sorted where they are, and written so that the ranges hold fast
    (a second pass would sample other ones); a table with one row for each
    partition gives the number of rows ahead of it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    rows = staged(rows.withColumns({"__part": F.shiftright("__id", 33), "__n": F.col("__id").bitwiseAND((1 << 33) - 1)}).drop("__id"), "numbered")
    sizes = sorted((r["__part"], r["n"]) for r in rows.groupBy("__part").agg(F.count("*").alias("n")).collect())
    ahead, total = [], 0
    for part, n in sizes:
        ahead += [F.lit(part), F.lit(total)]
        total += n
    start = F.element_at(F.create_map(*ahead), F.col("__part")) if ahead else F.lit(0)
    return rows.withColumn(name, (start + F.col("__n")).cast("long")).drop("__part", "__n")


def ranked(df: DataFrame, strata: list[str], keys: list[str], rank: str, size: str | None = None) -> DataFrame:
    """``rank``: 1, 2, ... in the order of ``keys`` within each stratum; ``size``: the stratum's rows.

    A window would sort a whole stratum in one task. Here ranges of (stratum, keys) are sorted where they are, and
    one row for each range and stratum in it tells how many of the stratum's rows lie ahead.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *strata, *keys).sortWithinPartitions(*strata, *keys).withColumn("__id", F.monotonically_increasing_id())
    rows = staged(rows.withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND((1 << 33) - 1)}).drop("__id"), "ranked")
    each = rows.groupBy(*strata, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    of = Window.partitionBy(*strata)
    ahead = F.coalesce(F.sum("__n").over(of.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumns({"__ahead": ahead, "__size": F.sum("__n").over(of)}).drop("__n")
    names = {s: f"__s{i}" for i, s in enumerate(strata)}
    each = each.withColumnsRenamed(names).withColumnRenamed("__part", "__p")
    same = F.col("__part") == F.col("__p")
    for s, n in names.items():
        same &= F.col(s).eqNullSafe(F.col(n))
    out = rows.join(each, same).withColumn(rank, (F.col("__ahead") + F.col("__at") - F.col("__first") + 1).cast("long"))
    if size:
        out = out.withColumn(size, F.col("__size"))
    return out.drop("__part", "__at", "__p", "__first", "__ahead", "__size", *names.values())
