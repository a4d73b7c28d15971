"""Family A: schema drift materialised as lazy views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans import drift
from tessella.queries.results import sealed_sql
from tessella.registry import query, table


@query("d02_rename_column", "SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR AS gross FROM orders WHERE o_totalprice > 200000")
def rename_column(spark: SparkSession, sf: str) -> DataFrame:
    out = drift.rename_column(table(spark, sf, "orders"), "O_TotalPrice", "gross_amount")
    return out.where("gross_amount > 200000").select("o_orderkey", "o_custkey", F.col("gross_amount").cast("decimal(18,2)").cast("string").alias("gross"))


@query("d03_rename_table", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def rename_table(spark: SparkSession, sf: str) -> DataFrame:
    tables = {"nation": table(spark, sf, "nation"), "region": table(spark, sf, "region")}
    after = drift.apply_one(tables, {"type": "rename_table", "table": "region", "new_name": "world region"})
    return after["nation"].join(after["world region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("d04_replace_column", "SELECT p_partkey, p_size, p_brand, CAST(p_size AS VARCHAR) AS size_text FROM part WHERE p_size >= 40")
def replace_column(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand")
    moved = drift.replace_column(part, "p_size", "size_text", "string")
    if moved.columns[-1] != "size_text":
        raise AssertionError("a column of another type goes last")
    return moved.withColumn("p_size", F.col("size_text").cast("int")).where("p_size >= 40").select("p_partkey", "p_size", "p_brand", "size_text")


@query("d05_add_column", "SELECT c_custkey, c_name, 'new' AS audit_tag FROM customer WHERE c_nationkey < 5")
def add_column(spark: SparkSession, sf: str) -> DataFrame:
    return drift.add_column(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), "audit_tag", "string", "new").where("c_nationkey < 5").drop("c_nationkey")


CHANGES = (
    {"type": "rename_table", "table": "supplier", "new_name": "vendor"},
    {"type": "rename_column", "table": "vendor", "old_name": "s_suppkey", "new_name": "vendor_id"},
    {"type": "replace_column", "table": "vendor", "old_name": "s_nationkey", "new_name": "nation_code", "declared_type": "string"},
    {"type": "add_column", "table": "vendor", "new_name": "audit_flag", "declared_type": "int", "default": 0},
    {"type": "metric_definition_change", "metric_name": "revenue"},
)


@query("d06_compound_drift", "SELECT s_suppkey AS vendor_id, s_name, CAST(s_nationkey AS VARCHAR) AS nation_code, 0 AS audit_flag FROM supplier")
def compound(spark: SparkSession, sf: str) -> DataFrame:
    return drift.apply_all({"supplier": table(spark, sf, "supplier")}, CHANGES)["vendor"].select("vendor_id", "s_name", "nation_code", "audit_flag")


@query(
    "d07_versions",
    """SELECT * FROM (VALUES ('v1', 's_suppkey'), ('v1', 's_name'), ('v1', 's_nationkey'), ('v1', 's_acctbal'),
       ('v2', 'vendor_id'), ('v2', 's_name'), ('v2', 's_acctbal'), ('v2', 'nation_code'), ('v2', 'audit_flag')) t(version, column_name)""",
)
def versions(spark: SparkSession, sf: str) -> DataFrame:
    known = drift.Versions(spark)
    known.create("shop", "v1", {"supplier": table(spark, sf, "supplier")})
    known.evolve("shop", "v1", "v2", CHANGES)
    both = [known.columns("shop", v).withColumn("version", F.lit(v)) for v in ("v1", "v2")]
    return both[0].unionByName(both[1]).select("version", "column_name")


@query(
    "d08_schema_after",
    """SELECT * FROM (VALUES (0, 'vendor_id', 'bigint'), (1, 's_name', 'string'), (2, 's_acctbal', 'double'),
       (3, 'nation_code', 'string'), (4, 'audit_flag', 'int')) t(position, column_name, data_type)""",
)
def schema_after(spark: SparkSession, sf: str) -> DataFrame:
    fields = drift.schema_after(table(spark, sf, "supplier").schema, CHANGES)
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)], "position int, column_name string, data_type string")


@query("r09_projection_contract", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_acctbal < 0")
def projection_contract(spark: SparkSession, sf: str) -> DataFrame:
    """A wildcard after an added column: the contract is the columns that were there before."""
    before = table(spark, sf, "customer").drop("c_acctbal").columns
    after = drift.add_column(table(spark, sf, "customer"), "audit_tag", "string", "new")
    return after.where("c_acctbal < 0").select(*before)


@query("k05_metric_redefinition", """
    SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS old_metric,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS new_metric
    FROM lineitem GROUP BY 1""")
def metric(spark: SparkSession, sf: str) -> DataFrame:
    """A metric under its old and its new definition, in one pass."""
    price, rate = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(4,2)")
    definitions = {"old_metric": F.sum(price), "new_metric": F.sum(price * (1 - rate))}
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(*(v.cast("double").alias(k) for k, v in definitions.items()))


_OLD, _NEW = (sealed_sql("m", ("s", "l_returnflag"), ("n", f"CAST({c} AS DECIMAL(18,2))")) for c in ("old_metric", "new_metric"))


@query("k05_metric_fingerprints", f"""
    WITH m AS (SELECT l_returnflag, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS old_metric, sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS new_metric FROM lineitem GROUP BY 1)
    SELECT x.row_count, x.value_hash AS old_hash, y.value_hash AS new_hash, x.value_hash <> y.value_hash AS differ FROM {_OLD} x, {_NEW} y""")
def metric_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Both definitions of a metric run, and their results differ."""
    from tessella.functions.seals import multiset_fingerprint

    price, rate = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(4,2)")
    both = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.sum(price).cast("decimal(18,2)").alias("old_metric"), F.sum(price * (1 - rate)).cast("decimal(18,2)").alias("new_metric"))
    old = multiset_fingerprint(both.select("l_returnflag", "old_metric")).withColumnRenamed("value_hash", "old_hash")
    new = multiset_fingerprint(both.select("l_returnflag", "new_metric")).select(F.col("value_hash").alias("new_hash"))
    return old.crossJoin(new).withColumn("differ", F.col("old_hash") != F.col("new_hash"))


@query("k14_drift_smoke", """
    SELECT 'UNRESOLVED_COLUMN' AS stale_error, count(*) AS row_count, true AS equal FROM orders WHERE o_totalprice > 1000""")
def smoke(spark: SparkSession, sf: str) -> DataFrame:
    """A stale query fails on the new version, the repaired one gives the old result: error class, counts, equality."""
    from pyspark.errors import AnalysisException

    from tessella.functions.seals import multiset_fingerprint

    known = drift.Versions(spark)
    known.create("shop", "v1", {"orders": table(spark, sf, "orders")})
    known.evolve("shop", "v1", "v2", [{"type": "rename_column", "table": "orders", "old_name": "o_totalprice", "new_name": "gross_amount"}])
    stale = "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > 1000"
    try:
        known.query("shop", "v2", stale).schema  # noqa: B018
        failure = None
    except AnalysisException as error:
        failure = (error.getCondition() or "").split(".")[0]
    old = multiset_fingerprint(known.query("shop", "v1", stale))
    new = multiset_fingerprint(known.query("shop", "v2", "SELECT o_orderkey, gross_amount FROM {orders} WHERE gross_amount > 1000"))
    new = new.select(F.col("row_count").alias("n"), F.col("value_hash").alias("v"))
    return old.crossJoin(new).select(F.lit(failure).alias("stale_error"), "row_count", ((F.col("row_count") == F.col("n")) & (F.col("value_hash") == F.col("v"))).alias("equal"))
