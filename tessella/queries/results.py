"""Family C: bounded reads, fingerprints of results, equivalence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.hashing import digest_mod5, same_result, short_id, stable_choice
from tessella.functions.seals import canonical_row, changed_keys, differing_ranges, multiset_fingerprint, ordered_fingerprint
from tessella.registry import query, table


def field_sql(kind: str, value: str) -> str:
    """A value of a canonical row in DuckDB's SQL; kind: i, n, s."""
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE '{kind}' || strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def sealed_sql(rows: str, *fields: tuple[str, str]) -> str:
    """row_count and value_hash of rows (a FROM clause), for up to 4096**2 different rows."""
    row = " || ".join(field_sql(*f) for f in fields)
    return f"""
    (WITH each AS (SELECT sha256({row}) AS h, count(*) AS n FROM {rows} GROUP BY 1),
          node AS (SELECT CASE WHEN (SELECT count(*) FROM each) > 4096 THEN left(h, 3) ELSE '' END AS p, sha256(string_agg(sha256(h || ':' || n), '' ORDER BY h)) AS d, sum(n) AS n FROM each GROUP BY 1)
     SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS row_count, CASE WHEN max(p) = '' THEN max(d) ELSE sha256(coalesce(string_agg(d, '' ORDER BY p), '')) END AS value_hash FROM node)"""


@query("x01_multiset_fingerprint", f"SELECT * FROM {sealed_sql('nation', ('i', 'n_nationkey'), ('s', 'n_name'), ('i', 'n_regionkey'))}")
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return multiset_fingerprint(table(spark, sf, "nation"))


@query("x01_multiset_fingerprint_orders", f"SELECT * FROM {sealed_sql('orders', ('i', 'o_orderkey'), ('i', 'o_custkey'), ('n', 'CAST(o_totalprice AS DECIMAL(18,2))'))}")
def fingerprint_orders(spark: SparkSession, sf: str) -> DataFrame:
    return multiset_fingerprint(table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price")))


@query("x01_ordered_fingerprint", f"""
    WITH r AS (SELECT sha256({field_sql("i", "o_orderkey")} || {field_sql("s", "o_orderpriority")}) AS d, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders),
         a AS (SELECT i // 4096 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d, count(*) AS n FROM r GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS row_count, CASE WHEN count(*) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS value_hash FROM a""")
def fingerprint_ordered(spark: SparkSession, sf: str) -> DataFrame:
    return ordered_fingerprint(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")


_PRICED = f"{field_sql('i', 'c_custkey')} || {field_sql('s', 'c_name')} || {field_sql('i', 'c_nationkey')}"


@query("x01_differing_ranges", f"""
    WITH a AS (SELECT sha256({field_sql("i", "c_custkey")}) || sha256({_PRICED}) AS h FROM customer),
         c AS (SELECT c_custkey, CASE WHEN c_custkey % 500 = 1 THEN upper(c_name) ELSE c_name END AS c_name, c_nationkey FROM customer WHERE c_custkey % 700 <> 2),
         b AS (SELECT sha256({field_sql("i", "c_custkey")}) || sha256({_PRICED}) AS h FROM c),
         x AS (SELECT left(h, k) AS range, string_agg(h, '' ORDER BY h) AS d, count(*) AS n FROM a, (SELECT CASE WHEN count(*) > 4096 THEN 6 ELSE 3 END AS k FROM a) GROUP BY 1),
         y AS (SELECT left(h, k) AS range, string_agg(h, '' ORDER BY h) AS d, count(*) AS n FROM b, (SELECT CASE WHEN count(*) > 4096 THEN 6 ELSE 3 END AS k FROM a) GROUP BY 1)
    SELECT range, coalesce(x.n, 0) AS old_rows, coalesce(y.n, 0) AS new_rows FROM x FULL JOIN y USING (range) WHERE x.d IS DISTINCT FROM y.d""")
def ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Where two versions of the customers differ, by ranges of keys."""
    return differing_ranges(*_versions(spark, sf), "c_custkey")


@query("x01_changed_keys", f"""
    SELECT sha256({field_sql("i", "c_custkey")}) AS key, CASE WHEN c_custkey % 700 = 2 THEN 'removed' ELSE 'changed' END AS change FROM customer
    WHERE c_custkey % 700 = 2 OR (c_custkey % 500 = 1 AND upper(c_name) <> c_name)""")
def keys(spark: SparkSession, sf: str) -> DataFrame:
    """Which customers differ between two versions."""
    return changed_keys(*_versions(spark, sf), "c_custkey")


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    old = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    name = F.when(F.col("c_custkey") % 500 == 1, F.upper("c_name")).otherwise(F.col("c_name"))
    return old, old.where("c_custkey % 700 <> 2").withColumn("c_name", name)


@query("x06_canonical_rows", f"SELECT sha256({field_sql('i', 's_suppkey')} || {field_sql('s', 's_name')}) AS row_hash FROM supplier")
def rows(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    return df.select(F.sha2(canonical_row(df), 256).alias("row_hash"))


@query("x07_same_result", """
    WITH a AS (SELECT DISTINCT lower(trim(n_name)) AS x, CAST(n_regionkey AS DOUBLE) AS y FROM nation),
         b AS (SELECT DISTINCT lower(trim(upper(n_name))) AS x, CAST(n_regionkey AS DOUBLE) AS y FROM nation WHERE n_nationkey <> 3),
         d AS (SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_b)
    SELECT only_a = 0 AND only_b = 0 AS equal, only_a, only_b FROM d""")
def same(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    return same_result(nation.select("n_name", "n_regionkey"), nation.where("n_nationkey <> 3").select(F.concat(F.lit(" "), F.upper("n_name")), F.col("n_regionkey").cast("double")))


@query("x02_bounded_read", "SELECT * FROM (SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM orders) > 100 AS truncated FROM orders ORDER BY o_orderkey LIMIT 100)")
def bounded(spark: SparkSession, sf: str) -> DataFrame:
    """At most 100 rows, as an agent sees them, and whether there are more: one row above the limit tells."""
    from tessella.operators.results import bounded as read

    return read(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey"), 100)


@query("k08_task_ids", "SELECT o_orderkey, 't_' || substr(sha256('[\"' || CAST(o_orderkey AS VARCHAR) || '\",\"' || o_orderpriority || '\"]'), 1, 16) AS task_id FROM orders")
def task_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", short_id("t_", "o_orderkey", "o_orderpriority").alias("task_id"))


@query("d10_stable_choice", "SELECT p_partkey, CAST(('0x' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 8)) AS BIGINT) % 7 AS choice FROM part")
def choice(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", stable_choice(F.col("p_partkey").cast("string"), 7).alias("choice"))


@query("e09_digest_mod5", """
    SELECT c_custkey, CAST(list_sum(list_transform(string_split(sha256(CAST(c_custkey AS VARCHAR)), ''), lambda d: CAST(('0x' || d) AS INTEGER))) % 5 AS INTEGER) AS residue FROM customer""")
def residue(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", digest_mod5(F.col("c_custkey").cast("string")).cast("int").alias("residue"))


@query("r22_sql_normalisation", r"SELECT doc_id, lower(regexp_replace(regexp_replace(text, ';+$', ''), '^\s+|\s+$', '', 'g')) AS normal FROM documents")
def normalised(spark: SparkSession, sf: str) -> DataFrame:
    text = F.lower(F.regexp_replace(F.regexp_replace("text", r";+$", ""), r"^\s+|\s+$", ""))
    return table(spark, sf, "documents").select("doc_id", text.alias("normal"))
