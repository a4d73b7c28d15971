"""Readers and writers of corpus files, with explicit schemas and without driver loops over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.sources.ranges import file_digests
from tessella.sources.staging import few


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSONL file or folder; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON array (``.json``) or JSONL, by suffix."""
    return spark.read.schema(schema).json(path, multiLine=path.endswith(".json"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and value of every line, read in splits: a row for each split tells how many lines of its file lie ahead."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value").withColumn("id", F.monotonically_increasing_id())
    splits = text.groupBy("file", "split").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Where the splits are few, the lines stay where they are.
    splits = few(splits.withColumn("ahead", before).drop("n"), "splits")
    return text.join(splits, ["file", "split"]).select("file", (F.col("ahead") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def read_with_errors(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """Good rows; and file, line, text and error of every line that isn't one: no JSON object, or a value of another type. Blank lines are neither."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    read = T.StructType([*wanted, T.StructField("_bad", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    rows = numbered_lines(spark, path).where(F.trim("value") != "").withColumn("row", F.from_json("value", read, options))
    fails = F.col("row").isNull() | F.col("row._bad").isNotNull()
    error = F.when(F.try_parse_json("value").isNull(), "not JSON").otherwise("a value of another type")
    return rows.where(~fails).select(*(F.col(f"row.`{f.name}`") for f in wanted)), rows.where(fails).select("file", "line", F.col("value").alias("text"), error.alias("error"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """zstd Parquet; Spark's committer shows the files of a job at once. By default an existing folder is an error."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def append_jsonl(df: DataFrame, path: str, *partitions: str) -> None:
    """Adds rows to a cache, by partition, so that a later run can leave out what is there."""
    df.write.mode("append").partitionBy(*partitions).json(path)


def not_yet(df: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that the cache doesn't have."""
    return df.join(cache.select(*keys).distinct(), keys, "left_anti")


def read_meanings(spark: SparkSession, path: str) -> DataFrame:
    """db_id, table_name, the columns of CSV files in ``<db_id>/.../<table>.csv``, and ``_bad``: a malformed line as it stands, else null."""
    options = {"header": True, "recursiveFileLookup": True, "pathGlobFilter": "*.csv", "encoding": "UTF-8"}
    names = spark.read.csv(path, **options).columns
    schema = T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField("_bad", T.StringType())])
    rows = spark.read.csv(path, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", enforceSchema=True, **options)
    file, root = F.input_file_name(), path.rstrip("/").rsplit("/", 1)[-1]
    clean = [F.col(f"`{c}`").alias(c.lstrip("\ufeff")) for c in names]
    return rows.select(F.regexp_extract(file, rf"{root}/([^/]+)/", 1).alias("db_id"), F.regexp_extract(file, r"([^/]+)\.csv$", 1).alias("table_name"), *clean, "_bad")


def list_files(spark: SparkSession, path: str, glob: str = "*", most_bytes: int | None = None) -> DataFrame:
    """path, length of files that match; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files if most_bytes is None else files.where(F.col("length") <= most_bytes)


def seal(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """name, length, sha256 of files of any size: a manifest to check them by later."""
    return file_digests(spark, path, glob).select(F.regexp_extract("file", r"([^/]+)$", 1).alias("name"), "length", "sha256")


def columns_of(tables: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """table_name, position, column_name, data_type of every table."""
    rows = [(t, i, f.name, f.dataType.simpleString()) for t, df in sorted(tables.items()) for i, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string")


def ddl(name: str, df: DataFrame) -> str:
    """A table's definition as text."""
    return f"CREATE TABLE `{name}` (" + ", ".join(f"`{f.name}` {f.dataType.simpleString().upper()}" for f in df.schema) + ")"


def ddl_with_samples(name: str, df: DataFrame, order: list[str], rows: int = 3) -> str:
    """A definition and the first rows in ``order``, for a prompt."""
    some = df.orderBy(*order).limit(rows).select(F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in df.columns)).alias("line"))
    return "\n".join([ddl(name, df), " | ".join(df.columns), *(r.line for r in some.collect())])


def schema_of(definition: str) -> T.StructType:
    """A schema from DDL text."""
    return T.StructType.fromDDL(definition)


def healthy(tables: dict[str, DataFrame]) -> dict[str, bool]:
    """Whether each table can be read and has a row."""
    found = {}
    for name, df in tables.items():
        try:
            found[name] = not df.isEmpty()
        except Exception:  # noqa: BLE001  any failure to read is the answer
            found[name] = False
    return found
