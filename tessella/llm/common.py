"""What the training-data operators share: table access, staging, bounded joins."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Most rows of a key table that a join may broadcast; above it the join shuffles.
BROADCAST_KEYS = 200_000

#: Rows and bytes of one Arrow batch, so that a Python worker holds little at once.
ARROW_ROWS, ARROW_BYTES = 512, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Keeps the Arrow batches of Python stages small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, one is made if everything runs on this machine; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    This cuts lineage the way ``checkpoint()`` does, in compressed columns: a lost
    executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["staged_path"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing lazy reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.__dict__["staged_path"])
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sized(keys: DataFrame) -> DataFrame:
    """``keys``, marked for broadcast only where a count shows at most ``BROADCAST_KEYS`` rows."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def keep_keys(big: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``big`` whose ``on`` is in ``keys`` (distinct), joined to the columns of ``keys``.

    The keys are broadcast only after a count shows at most ``BROADCAST_KEYS``; beyond
    that both sides are shuffled.
    """
    return big.join(sized(keys), on)


def drop_keys(big: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``big`` whose ``on`` is not in ``keys``, broadcast like in keep_keys."""
    return big.join(sized(keys), on, "left_anti")


#: A key is hot with more than half of a task's even share of the rows, and HOT among one of ONE_OF at least.
HOT, ONE_OF = 16, 16


def hot_keys(rows: DataFrame, key: str, by: str) -> list:
    """The hot keys, two for each shuffle partition at most, by the rows whose hash of ``by`` is one of ONE_OF."""
    parts, seen = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), Observation()
    some = rows.where(F.pmod(F.xxhash64(F.lit("hot"), key, by), F.lit(ONE_OF)) == 0).observe(seen, F.count(F.lit(1)).alias("n"))
    found = some.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") >= HOT) & F.col(key).isNotNull()).orderBy(F.desc("n"), key).limit(2 * parts).collect()
    return [r[0] for r in found if r.n * 2 * parts > seen.get["n"]]


def with_totals(rows: DataFrame, key: str, by: str, totals: dict[str, Column], hot: list | None = None) -> DataFrame:
    """``rows`` with aggregates over the rows of the same key. ``rows`` are read several times: a staged table.
    ``hot``: the hot keys, where they are known.

    A window has no map-side combine and takes a key's rows in one task. So the hot keys' rows stay where they
    are: their aggregates are combined ahead of the shuffle, and the few results are broadcast. Which
    keys count as hot (``by``: a column that tells a key's rows apart) doesn't change the result.
    """
    window = Window.partitionBy(key)
    over = {name: total.over(window) for name, total in totals.items()}
    hot = hot_keys(rows, key, by) if hot is None else hot
    if not hot:
        return rows.withColumns(over)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    apart = rows.where(is_hot)
    sums = apart.groupBy(key).agg(*(total.alias(name) for name, total in totals.items()))
    return rows.where(~is_hot).withColumns(over).unionByName(apart.join(F.broadcast(sums), key))


def split_join(rows: DataFrame, side: DataFrame, on: str, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``side``, which has one row for each ``on`` at most; ``how``: inner or left.

    ``rows`` are read several times (a staged table) and may hold hot keys, told apart by ``by``: those rows stay where they are, and
    the few rows of ``side`` for them, two for each shuffle partition at most, are broadcast.
    """
    hot = hot_keys(rows, on, by)
    if not hot:
        return rows.join(side, on, how)
    is_hot = F.coalesce(F.col(on).isin(hot), F.lit(False))
    return rows.where(~is_hot).join(side, on, how).unionByName(rows.where(is_hot).join(F.broadcast(side.where(F.col(on).isin(hot))), on, how))
