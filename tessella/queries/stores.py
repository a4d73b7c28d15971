"""Sources and sinks: what is written is read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.registry import query, table
from tessella.sources import files, ranges
from tessella.sources.staging import shared_dir


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _text(df: DataFrame, line: str, to: str) -> str:
    """Lines of text as one file of a small table."""
    df.selectExpr(line).coalesce(1).write.text(to)
    return to


@query("s01_jsonl_scan", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def jsonl_scan(spark: SparkSession, sf: str) -> DataFrame:
    """JSONL with blank lines between."""
    lines = table(spark, sf, "nation").selectExpr("explode(array('', to_json(named_struct('id', n_nationkey, 'name', n_name)), '   ')) AS value")
    lines.write.text(to := _place(spark, "lines"))
    return files.read_jsonl(spark, to, "id int, name string")


@query("s02_json_array", "SELECT r_regionkey AS id, r_name AS name FROM region")
def json_array(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON array, over several lines, and read as such by its suffix."""
    rows = table(spark, sf, "region").agg(F.array_sort(F.collect_list(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))).alias("a"))
    return files.read_records(spark, _text(rows, "replace(to_json(a), ',', ',\n') AS value", f"{_place(spark, 'array')}.json"), "id int, name string")


@query("s03_bad_lines", """SELECT CAST(k AS BIGINT) AS line, CASE n_nationkey % 3 WHEN 1 THEN 'not JSON' ELSE 'a value of another type' END AS error FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) * 2 AS k FROM nation) WHERE n_nationkey % 3 > 0""")
def bad_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that are no records, by number: broken JSON, and a text where a number should be."""
    rows = table(spark, sf, "nation").coalesce(1).sortWithinPartitions("n_nationkey")
    value = "explode(array('', CASE n_nationkey % 3 WHEN 0 THEN to_json(named_struct('id', n_nationkey)) WHEN 1 THEN '{broken' ELSE '{\"id\": \"zz\"}' END)) AS value"
    good, bad = files.read_with_errors(spark, _text(rows, value, _place(spark, "lines")), "id long")
    return bad.select("line", "error")


@query("s03_good_lines", "SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE n_nationkey % 3 = 0")
def good_lines(spark: SparkSession, sf: str) -> DataFrame:
    value = "CASE n_nationkey % 3 WHEN 0 THEN to_json(named_struct('id', n_nationkey)) WHEN 1 THEN '{broken' ELSE '{\"id\": \"zz\"}' END AS value"
    return files.read_with_errors(spark, _text(table(spark, sf, "nation"), value, _place(spark, "lines")), "id long")[0]


@query("s08_guarded_sink", "SELECT r_regionkey, true AS refused FROM region")
def guarded_sink(spark: SparkSession, sf: str) -> DataFrame:
    """A second write is refused, and what was there stays."""
    from pyspark.errors import AnalysisException

    files.write_parquet(table(spark, sf, "region"), to := _place(spark, "once"))
    try:
        files.write_parquet(table(spark, sf, "nation"), to)
        refused = False
    except AnalysisException:
        refused = True
    return files.read_parquet(spark, to).select("r_regionkey", F.lit(refused).alias("refused"))


@query("s10_ordered_columns", "SELECT * FROM (VALUES (0, 'r_regionkey'), (1, 'r_name')) t(position, column_name)")
def ordered_columns(spark: SparkSession, sf: str) -> DataFrame:
    return files.columns_of({"region": table(spark, sf, "region")}, spark).select("position", "column_name")


@query("s13_ddl_with_samples", """SELECT 'CREATE TABLE `region` (`r_regionkey` INT, `r_name` STRING)' || chr(10) || 'r_regionkey | r_name' || chr(10) || string_agg(r_regionkey || ' | ' || r_name, chr(10) ORDER BY r_regionkey) AS shown
    FROM (SELECT * FROM region ORDER BY r_regionkey LIMIT 3)""")
def samples(spark: SparkSession, sf: str) -> DataFrame:
    """A definition with its first rows, as a prompt shows them."""
    return spark.createDataFrame([(files.ddl_with_samples("region", table(spark, sf, "region"), ["r_regionkey"]),)], "shown string")


@query("s14_listed_files", """
    SELECT 'region=' || n_regionkey AS name, CAST(sum(strlen(n_name) + 1) AS BIGINT) AS length FROM nation GROUP BY n_regionkey HAVING sum(strlen(n_name) + 1) <= 50""")
def listed(spark: SparkSession, sf: str) -> DataFrame:
    """Files by pattern and size, contents unread: a file of names for each region."""
    nations = table(spark, sf, "nation").select(F.col("n_name").alias("value"), F.col("n_regionkey").alias("region"))
    nations.repartition(1).write.partitionBy("region").text(to := _place(spark, "listed"))
    return files.list_files(spark, to, "*.txt", 50).select(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("name"), "length")


@query("s17_schema_of_ddl", """
    SELECT table_name, CAST(ordinal_position - 1 AS INTEGER) AS position, column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END AS data_type
    FROM information_schema.columns WHERE table_name IN ('nation', 'region', 'supplier')""")
def schema_of_ddl(spark: SparkSession, sf: str) -> DataFrame:
    """Schemas read back from the tables' definitions, without their data."""
    rows = []
    for name in ("nation", "region", "supplier"):
        said = files.ddl(name, table(spark, sf, name))
        rows += [(name, i, f.name, f.dataType.simpleString()) for i, f in enumerate(files.schema_of(said[said.index("(") + 1 : -1]).fields)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string")


@query("s04_parquet_scan", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def scan(spark: SparkSession, sf: str) -> DataFrame:
    return files.read_parquet(spark, f"{sf}/orders.parquet").where("o_orderdate >= TIMESTAMP '1997-01-01'").select("o_orderkey", "o_orderpriority")


@query("s05_parquet_round_trip", "SELECT * FROM customer")
def parquet(spark: SparkSession, sf: str) -> DataFrame:
    files.write_parquet(table(spark, sf, "customer"), to := _place(spark, "customer"))
    return files.read_parquet(spark, to)


@query("s06_jsonl_round_trip", "SELECT doc_id, text, lang FROM documents")
def jsonl(spark: SparkSession, sf: str) -> DataFrame:
    files.write_jsonl(table(spark, sf, "documents").select("doc_id", "text", "lang"), to := _place(spark, "documents"))
    return files.read_jsonl(spark, to, "doc_id long, text string, lang string")


@query("s07_appended_cache", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def cache(spark: SparkSession, sf: str) -> DataFrame:
    """What a cache lacks, after most of the orders have been put there."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    for status in ("F", "O"):
        to = _place(spark, "cache") if status == "F" else to
        files.append_jsonl(orders.where(F.col("o_orderstatus") == status), to, "o_orderstatus")
    return files.not_yet(orders, files.read_jsonl(spark, to, "o_orderkey long"), ["o_orderkey"]).select("o_orderkey")


@query("s09_columns", """SELECT * FROM (VALUES ('nation', 0, 'n_nationkey', 'int'), ('nation', 1, 'n_name', 'string'), ('nation', 2, 'n_regionkey', 'int'),
    ('region', 0, 'r_regionkey', 'int'), ('region', 1, 'r_name', 'string')) t(table_name, position, column_name, data_type)""")
def columns(spark: SparkSession, sf: str) -> DataFrame:
    return files.columns_of({t: table(spark, sf, t) for t in ("nation", "region")}, spark)


@query("s11_ddl", "SELECT * FROM (VALUES ('region', 'CREATE TABLE `region` (`r_regionkey` INT, `r_name` STRING)')) t(table_name, ddl)")
def ddl(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([("region", files.ddl("region", table(spark, sf, "region")))], "table_name string, ddl string")


@query("s12_csv_meanings", "SELECT 'shop' AS db_id, n_name AS column_name, CAST(n_regionkey AS VARCHAR) AS meaning FROM nation")
def meanings(spark: SparkSession, sf: str) -> DataFrame:
    to = _place(spark, "meanings")
    rows = table(spark, sf, "nation").select(F.col("n_name").alias("column_name"), F.col("n_regionkey").cast("string").alias("meaning"))
    rows.coalesce(1).write.option("header", True).csv(f"{to}/shop")
    return files.read_meanings(spark, to).select("db_id", "column_name", "meaning")


_ORDER_FILES = """f AS (SELECT o_orderkey % 4 AS step, string_agg('{"o_orderkey":' || o_orderkey || '}' || chr(10), '' ORDER BY o_orderkey) AS t FROM orders GROUP BY 1)"""


def _order_files(spark: SparkSession, sf: str) -> str:
    """Orders as four files with numbers for names."""
    rows = table(spark, sf, "orders").select("o_orderkey")
    ranges.write_numbered(rows, F.col("o_orderkey") % 4, F.to_json(F.struct("o_orderkey")), to := _place(spark, "numbered"), ["o_orderkey"])
    return to


@query("s15_sealed_files", f"WITH {_ORDER_FILES} SELECT step || '.jsonl' AS name, CAST(strlen(t) AS BIGINT) AS length, sha256(t) AS sha256 FROM f")
def sealed(spark: SparkSession, sf: str) -> DataFrame:
    """name, length and SHA-256 of files, each read as a stream."""
    return files.seal(spark, _order_files(spark, sf), "*.jsonl")


@query("s15_sealed_blocks", f"""
    WITH {_ORDER_FILES} SELECT step || '.jsonl' AS name, CAST(strlen(t) AS BIGINT) AS length, CAST(ceil(strlen(t) / 1000) AS BIGINT) AS blocks,
        sha256(list_aggregate(list_transform(range(0, CAST(ceil(strlen(t) / 1000) AS BIGINT)), lambda i: sha256(substr(t, 1 + i * 1000, 1000))), 'string_agg', '')) AS root FROM f""")
def sealed_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Files that no task reads whole: a digest of the digests of their blocks."""
    blocks = ranges.file_digests(spark, _order_files(spark, sf), "*.jsonl", 1000)
    return ranges.block_seals(blocks).select(F.regexp_extract("file", r"([^/]+)$", 1).alias("name"), "length", "blocks", "root")


@query("s16_numbered_files", "SELECT o_orderkey % 4 AS step, row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) AS line, o_orderkey FROM orders")
def numbered_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files in the order of their numbers, read by byte ranges, with the number of each line."""
    lines = ranges.with_line(ranges.read_numbered(spark, _order_files(spark, sf), range_bytes=20_000))
    return lines.select("step", "line", F.get_json_object("value", "$.o_orderkey").cast("long").alias("o_orderkey"))


@query("s18_health", "SELECT * FROM (VALUES ('nation', true), ('region', true), ('absent', false)) t(table_name, healthy)")
def health(spark: SparkSession, sf: str) -> DataFrame:
    found = files.healthy({"nation": table(spark, sf, "nation"), "region": table(spark, sf, "region"), "absent": table(spark, sf, "region").where("r_regionkey < 0")})
    return spark.createDataFrame(sorted(found.items()), "table_name string, healthy boolean")
