"""Family E: documents stand for tasks (source is their database, lang their drift type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import corpus, splits
from tessella.registry import query, table


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("task_id"), F.col("source").alias("db_id"), F.col("lang").alias("kind"), "text", "n_chars")


_TASKS = "SELECT doc_id AS task_id, source AS db_id, lang AS kind, text, n_chars FROM documents"


def ordered(seed: str = "", key: str = "task_id") -> str:
    """SQL of the stable order."""
    return f"sha256('{seed}:' || CAST({key} AS VARCHAR))" if seed else f"sha256(CAST({key} AS VARCHAR))"


@query("e01_first_of_each", f"SELECT task_id, db_id FROM ({_TASKS}) QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY task_id) = 1")
def first(spark: SparkSession, sf: str) -> DataFrame:
    rows = tasks(spark, sf).select("task_id", "db_id", F.sha2("text", 256).alias("signature"))
    return corpus.first_of_each(rows, ["signature"], ["task_id"]).select("task_id", "db_id")


@query("e01_removed", f"SELECT task_id FROM ({_TASKS}) QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY task_id) > 1")
def removed(spark: SparkSession, sf: str) -> DataFrame:
    rows = tasks(spark, sf).select("task_id", F.sha2("text", 256).alias("signature"))
    return corpus.removed(rows, ["signature"], "task_id", ["task_id"])


@query("e02_grouped_copies", f"SELECT sha256(text) AS signature, min(task_id) AS representative, count(*) AS copies, max(task_id) AS last_id FROM ({_TASKS}) GROUP BY 1")
def copies(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.grouped_copies(tasks(spark, sf).withColumn("signature", F.sha2("text", 256)), ["signature"], "task_id")


@query("e02_copies_with_ids", f"""
    SELECT sha256(text) AS signature, min(task_id) OVER g AS representative, count(*) OVER g AS copies, row_number() OVER (PARTITION BY sha256(text) ORDER BY task_id) AS place, task_id FROM ({_TASKS}) WINDOW g AS (PARTITION BY sha256(text))""")
def copies_with_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Each group of copies with its ids in order."""
    return corpus.copies_with_ids(tasks(spark, sf).withColumn("signature", F.sha2("text", 256)), ["signature"], "task_id")


@query("e03_unique_ids", "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, count(*) = count(DISTINCT doc_id) AS is_unique FROM documents")
def unique(spark: SparkSession, sf: str) -> DataFrame:
    return tasks(spark, sf).agg(F.count("*").alias("n"), F.count_distinct("task_id").alias("ids"), (F.count("*") == F.count_distinct("task_id")).alias("is_unique"))


@query("e04_enriched", f"""
    SELECT task_id, CASE WHEN n_chars < 1000 THEN 'easy' WHEN n_chars < 4000 THEN 'medium' ELSE 'hard' END AS difficulty,
           CASE kind WHEN 'en' THEN 'clean_no_drift' WHEN 'fr' THEN 'silent_result_mismatch' ELSE 'explicit_schema_error' END AS failure_mode,
           db_id || '/' || kind AS stratum FROM ({_TASKS})""")
def enriched(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_chars")
    mode = F.when(F.col("kind") == "en", "clean_no_drift").when(F.col("kind") == "fr", "silent_result_mismatch").otherwise("explicit_schema_error")
    return tasks(spark, sf).select("task_id", F.when(n < 1000, "easy").when(n < 4000, "medium").otherwise("hard").alias("difficulty"), mode.alias("failure_mode"), F.concat("db_id", F.lit("/"), "kind").alias("stratum"))


@query("e05_profile_quotas", f"""
    WITH r AS (SELECT task_id, kind, row_number() OVER (PARTITION BY kind ORDER BY {ordered()}, task_id) AS k, count(*) OVER (PARTITION BY kind) AS n FROM ({_TASKS}))
    SELECT task_id, kind, CASE WHEN k <= CAST(round_even(n * 0.30::DOUBLE, 0) AS INTEGER) THEN 'must_ask'
        WHEN k <= CAST(round_even(n * 0.30::DOUBLE, 0) AS INTEGER) + CAST(round_even(n * 0.25::DOUBLE, 0) AS INTEGER) THEN 'knowledge_only' ELSE 'schema_only' END AS profile FROM r""")
def profiles(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.quotas(tasks(spark, sf).select("task_id", "kind"), "kind", "task_id", {"must_ask": 0.30, "knowledge_only": 0.25}, "schema_only")


@query("e06_residual_quotas", f"""
    WITH t AS (SELECT task_id, kind, CASE task_id % 20 WHEN 0 THEN 'must_ask' WHEN 1 THEN 'knowledge_only' WHEN 2 THEN 'schema_only' END AS legacy FROM ({_TASKS})),
         w AS (SELECT kind, CAST(round_even(count(*) * 0.30::DOUBLE, 0) AS BIGINT) - count(*) FILTER (legacy = 'must_ask') AS a, CAST(round_even(count(*) * 0.25::DOUBLE, 0) AS BIGINT) - count(*) FILTER (legacy = 'knowledge_only') AS b FROM t GROUP BY 1),
         r AS (SELECT t.*, row_number() OVER (PARTITION BY kind, legacy IS NULL ORDER BY {ordered()}) AS k FROM t)
    SELECT task_id, kind, CASE WHEN legacy IS NOT NULL THEN legacy WHEN k <= a THEN 'must_ask' WHEN k <= a + b THEN 'knowledge_only' ELSE 'schema_only' END AS profile FROM r JOIN w USING (kind)""")
def residual(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks of earlier versions keep their profile; new ones fill up the quotas."""
    legacy = F.when(F.col("task_id") % 20 == 0, "must_ask").when(F.col("task_id") % 20 == 1, "knowledge_only").when(F.col("task_id") % 20 == 2, "schema_only")
    rows = tasks(spark, sf).select("task_id", "kind").withColumn("legacy", legacy)
    return corpus.residual_quotas(rows, "kind", "task_id", "legacy", {"must_ask": 0.30, "knowledge_only": 0.25}, "schema_only").drop("legacy")


SHARES = {"train": 0.7, "tune": 0.15, "test": 0.15}


# Sizes, label counts in one order, and all groups' label counts.
_COUNTS = f"""
    size AS (SELECT db_id, count(*) AS n FROM ({_TASKS}) GROUP BY 1), kinds AS (SELECT kind, count(*) AS whole FROM ({_TASKS}) GROUP BY 1),
    cell AS (SELECT db_id, kind, count(*) AS n FROM ({_TASKS}) GROUP BY 1, 2),
    each AS (SELECT db_id, kind, whole, coalesce(c.n, 0) AS n FROM size CROSS JOIN kinds LEFT JOIN cell c USING (db_id, kind)),
    part(i, split, share) AS (VALUES (1, 'train', 0.7::DOUBLE), (2, 'tune', 0.15::DOUBLE), (3, 'test', 0.15::DOUBLE))"""


@query("e07_group_split", f"""
    WITH RECURSIVE {_COUNTS},
         lists AS (SELECT db_id, list(CAST(n AS DOUBLE) ORDER BY kind) AS c, list(CAST(whole AS DOUBLE) ORDER BY kind) AS w FROM each GROUP BY 1),
         total AS (SELECT CAST(sum(n) AS DOUBLE) AS total, max(db_id) AS frozen FROM size),
         o AS (SELECT trial, db_id, n, c, w, db_id = frozen AS fixed, row_number() OVER (PARTITION BY trial ORDER BY db_id <> frozen, n DESC, sha256('0:' || trial || ':' || db_id), db_id) AS k
               FROM range(20) t(trial), size JOIN lists USING (db_id), total),
         run AS (
           SELECT trial, CAST(0 AS BIGINT) AS k, [0, 0, 0]::DOUBLE[] AS had, list_transform([1, 2, 3], lambda s: list_transform(w, lambda x: 0::DOUBLE)) AS have, []::BIGINT[] AS dealt FROM o WHERE k = 1
           UNION ALL
           SELECT trial, k, list_transform([1, 2, 3], lambda s: had[s] + CASE WHEN s = i THEN n ELSE 0 END),
                  list_transform([1, 2, 3], lambda s: list_transform(range(1, len(c) + 1), lambda l: have[s][l] + CASE WHEN s = i THEN c[l] ELSE 0 END)), list_append(dealt, i)
           FROM (SELECT *, CASE WHEN fixed THEN 3 ELSE list_position(rise, list_min(rise)) END AS i FROM (
             SELECT r.trial, o.k, r.had, r.have, r.dealt, o.n, o.c, o.fixed, list_transform([1, 2, 3], lambda s: round(
                4 * (power(had[s] + n - total * [0.7, 0.15, 0.15][s], 2) - power(had[s] - total * [0.7, 0.15, 0.15][s], 2)) / power(greatest(total * [0.7, 0.15, 0.15][s], 1), 2)
                + list_sum(list_transform(range(1, len(c) + 1), lambda l: (power(have[s][l] + c[l] - w[l] * [0.7, 0.15, 0.15][s], 2) - power(have[s][l] - w[l] * [0.7, 0.15, 0.15][s], 2)) / power(greatest(w[l] * [0.7, 0.15, 0.15][s], 3), 2))), 9)) AS rise
             FROM run r JOIN o ON o.trial = r.trial AND o.k = r.k + 1, total))),
         ended AS (SELECT r.*, round(list_sum(list_transform([1, 2, 3], lambda s: 4 * power((had[s] - total * [0.7, 0.15, 0.15][s]) / greatest(total * [0.7, 0.15, 0.15][s], 1), 2)
                + list_sum(list_transform(range(1, len(w) + 1), lambda l: power((have[s][l] - w[l] * [0.7, 0.15, 0.15][s]) / greatest(w[l] * [0.7, 0.15, 0.15][s], 3), 2))))), 9) AS cost
             FROM run r, total, (SELECT any_value(w) AS w FROM lists) WHERE k = (SELECT count(*) FROM size)),
         best AS (SELECT * FROM ended ORDER BY cost, trial LIMIT 1)
    SELECT o.db_id, p.split FROM o JOIN best b ON o.trial = b.trial JOIN part p ON p.i = b.dealt[o.k]""")
def group_split(spark: SparkSession, sf: str) -> DataFrame:
    """Sources dealt whole, the last of them frozen in test; the best of 20 trials."""
    last = tasks(spark, sf).agg(F.max("db_id")).first()[0]
    return splits.group_split(tasks(spark, sf), "db_id", ["kind"], SHARES, {last: "test"}, trials=20)


@query("e08_exact_split", f"""
    WITH {_COUNTS},
         g AS (SELECT count(*) AS g, sum(n) AS total FROM size),
         ends AS (SELECT total, greatest(CAST(round_even(g * 0.7::DOUBLE, 0) AS BIGINT), 1) AS a, greatest(CAST(round_even(g * 0.15::DOUBLE, 0) AS BIGINT), 1) AS b FROM g),
         r AS (SELECT trial, db_id, n, row_number() OVER (PARTITION BY trial ORDER BY sha256('0:' || trial || ':' || db_id), db_id) AS k FROM range(300) t(trial), size),
         d AS (SELECT trial, db_id, n, CASE WHEN k <= a THEN 1 WHEN k <= a + b THEN 2 ELSE 3 END AS i FROM r, ends),
         rows AS (SELECT trial, sum(8 * power((n - total * share) / (total * share), 2)) AS cost FROM (SELECT trial, i, sum(n) AS n FROM d GROUP BY 1, 2) JOIN part USING (i), ends GROUP BY 1),
         cells AS (SELECT trial, sum(power((n - whole * share) / greatest(whole * share, 3), 2)) AS cost
                   FROM (SELECT trial, i, kind, any_value(whole) AS whole, sum(each.n) AS n FROM d JOIN each USING (db_id) GROUP BY 1, 2, 3) JOIN part USING (i) GROUP BY 1),
         best AS (SELECT trial FROM rows JOIN cells USING (trial) ORDER BY round(rows.cost + cells.cost, 9), trial LIMIT 1)
    SELECT db_id, split FROM d JOIN best USING (trial) JOIN part USING (i)""")
def exact_split(spark: SparkSession, sf: str) -> DataFrame:
    """Sources dealt by exact counts; the best of 300 deals."""
    return splits.exact_split(tasks(spark, sf), "db_id", ["kind"], SHARES, trials=300)


@query("e10_allocated", f"""
    WITH d AS (SELECT DISTINCT db_id FROM ({_TASKS})), a AS (SELECT db_id FROM d WHERE db_id LIKE 'src1%' ORDER BY {ordered("train-0", "db_id")}, db_id LIMIT 4),
         b AS (SELECT db_id FROM d WHERE db_id NOT IN (SELECT db_id FROM a) ORDER BY {ordered("dev-1", "db_id")}, db_id LIMIT 5),
         c AS (SELECT db_id FROM d WHERE db_id > 'src2' AND db_id NOT IN (SELECT db_id FROM a UNION SELECT db_id FROM b) ORDER BY {ordered("train-2", "db_id")}, db_id LIMIT 3)
    SELECT db_id, CASE WHEN db_id IN (SELECT db_id FROM a UNION SELECT db_id FROM c) THEN 'train' WHEN db_id IN (SELECT db_id FROM b) THEN 'dev' ELSE 'test' END AS split FROM d""")
def allocated(spark: SparkSession, sf: str) -> DataFrame:
    """Sources to splits by provenance, each rule in its own stable order."""
    rules = [("train", F.col("db_id").startswith("src1"), 4), ("dev", F.lit(True), 5), ("train", F.col("db_id") > "src2", 3)]
    return corpus.allocate(tasks(spark, sf).select("db_id").distinct(), "db_id", rules, "test")


_SPLIT = "CASE WHEN list_sum(list_transform(string_split(sha256(db_id), ''), lambda d: CAST(('0x' || d) AS INTEGER))) % 5 = 0 THEN 'dev' ELSE 'train' END"


@query("e09_hash_split", f"SELECT task_id, {_SPLIT} AS split FROM ({_TASKS})")
def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.hash_split(tasks(spark, sf), "db_id").select("task_id", "split")


@query("e11_canonical_choice", f"SELECT kind, arg_max(db_id, (n, db_id)) AS chosen, max(n) AS n FROM (SELECT kind, db_id, count(*) AS n FROM ({_TASKS}) GROUP BY 1, 2) GROUP BY kind")
def canonical(spark: SparkSession, sf: str) -> DataFrame:
    sizes = tasks(spark, sf).groupBy("kind", "db_id").agg(F.count("*").alias("n"))
    return sizes.groupBy("kind").agg(F.max_by("db_id", F.struct("n", "db_id")).alias("chosen"), F.max("n").alias("n"))


@query("e12_split_leaks", f"SELECT kind, count(DISTINCT {_SPLIT}) AS splits FROM ({_TASKS}) GROUP BY kind HAVING count(DISTINCT {_SPLIT}) > 1")
def leaks(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.leaks(corpus.hash_split(tasks(spark, sf), "db_id"), "split", "kind")


@query("e13_partition_complete", """
    WITH p AS (SELECT doc_id FROM documents WHERE doc_id % 7 <> 3 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 11 = 0 AND doc_id % 7 <> 3 UNION ALL SELECT -1 - r_regionkey FROM region)
    SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM p)) AS missing, (SELECT count(DISTINCT doc_id) FROM p WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS extra,
           (SELECT count(*) FROM (SELECT doc_id FROM p GROUP BY 1 HAVING count(*) > 1)) AS repeated""")
def complete(spark: SparkSession, sf: str) -> DataFrame:
    """How parts with holes, repeats and strangers differ from the whole."""
    rows = tasks(spark, sf).select("task_id")
    some = rows.where("task_id % 7 <> 3")
    strangers = table(spark, sf, "region").select((-1 - F.col("r_regionkey")).cast("long").alias("task_id"))
    return corpus.complete(some.unionByName(some.where("task_id % 11 = 0")).unionByName(strangers), rows, "task_id")


@query("e14_round_robin", f"""
    SELECT task_id, db_id, turn FROM (SELECT task_id, db_id, CAST(row_number() OVER (PARTITION BY db_id ORDER BY {ordered("e14")}, task_id) AS INTEGER) AS turn FROM ({_TASKS}))
    ORDER BY turn, db_id LIMIT 150""")
def round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.round_robin(tasks(spark, sf).select("task_id", "db_id"), ["db_id"], 150, "task_id", "e14")


@query("e15_pilot", f"""
    SELECT task_id, db_id, kind, turn FROM (SELECT task_id, db_id, kind, CAST(row_number() OVER (PARTITION BY db_id, kind ORDER BY {ordered("e15")}, task_id) AS INTEGER) AS turn FROM ({_TASKS}))
    ORDER BY turn, db_id, kind LIMIT 120""")
def pilot(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.round_robin(tasks(spark, sf).select("task_id", "db_id", "kind"), ["db_id", "kind"], 120, "task_id", "e15")


_BUCKETS = (("long", "n_chars > 4000", 20), ("foreign", "kind <> 'en'", 30), ("short", "n_chars < 1500", 40))


def _bucket_sql(cap: int) -> str:
    """The buckets one after the other, as chained queries."""
    out, before, used = [f"t AS ({_TASKS})"], "SELECT NULL::BIGINT AS task_id, NULL AS db_id WHERE false", "b0"
    out.append(f"b0 AS ({before})")
    for i, (name, condition, n) in enumerate(_BUCKETS, 1):
        order = ordered(f"e16{name}")
        out.append(f"""f{i} AS (SELECT t.task_id, t.db_id, row_number() OVER (PARTITION BY t.db_id ORDER BY {ordered(f"e16{name}", "t.task_id")}) + (SELECT count(*) FROM {used} u WHERE u.db_id = t.db_id) AS k
            FROM t WHERE {condition} AND task_id NOT IN (SELECT task_id FROM {used}))""")
        out.append(f"g{i} AS (SELECT task_id, db_id FROM f{i} WHERE k <= {cap} ORDER BY {order}, task_id LIMIT {n})")
        out.append(f"b{i} AS (SELECT task_id, db_id FROM {used} UNION ALL SELECT task_id, db_id FROM g{i})")
        used = f"b{i}"
    return "WITH " + ", ".join(out) + " " + " UNION ALL ".join(f"SELECT task_id, '{name}' AS bucket FROM g{i}" for i, (name, *_) in enumerate(_BUCKETS, 1))


@query("e16_priority_buckets", _bucket_sql(5))
def buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Buckets by priority, no task twice, at most five of a source in all."""
    named = [(name, F.expr(condition), n) for name, condition, n in _BUCKETS]
    return corpus.capped_buckets(tasks(spark, sf), named, "task_id", "db_id", 5, "e16").select("task_id", "bucket")


@query("e17_failure_ranking", """
    WITH f AS (SELECT source AS db_id, lang AS kind, count(*) AS n, count(*) FILTER (quality = 0) AS failures FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)
    SELECT db_id, kind, n, failures, round(failures::DOUBLE / n, 6) AS rate, CAST(row_number() OVER (PARTITION BY kind ORDER BY failures::DOUBLE / n DESC, n DESC, db_id) AS INTEGER) AS place FROM f""")
def ranking(spark: SparkSession, sf: str) -> DataFrame:
    rows = tasks(spark, sf).join(table(spark, sf, "labels").withColumnRenamed("doc_id", "task_id"), "task_id")
    rates = rows.groupBy("db_id", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("failures"))
    order = Window.partitionBy("kind").orderBy((F.col("failures") / F.col("n")).desc(), F.desc("n"), "db_id")
    return rates.withColumns({"place": F.row_number().over(order), "rate": F.round(F.col("failures") / F.col("n"), 6)})


_FLAGGED = """SELECT source AS db_id, count(*) AS n, count(*) FILTER (quality = 0) AS low_quality, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (lang <> 'en') AS foreign_text,
    CAST(count(*) FILTER (quality = 0 OR toxic = 1) AS DOUBLE) / count(*) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY 1"""


@query("e17_disjoint_quotas", f"""
    WITH c AS ({_FLAGGED}), a AS (SELECT db_id FROM c WHERE low_quality > 0 ORDER BY low_quality DESC, rate DESC, n DESC, db_id LIMIT 4),
         b AS (SELECT db_id FROM c WHERE toxic > 0 AND db_id NOT IN (SELECT db_id FROM a) ORDER BY toxic DESC, rate DESC, n DESC, db_id LIMIT 5),
         d AS (SELECT db_id FROM c WHERE foreign_text > 0 AND db_id NOT IN (SELECT db_id FROM a UNION SELECT db_id FROM b) ORDER BY foreign_text DESC, rate DESC, n DESC, db_id LIMIT 6)
    SELECT db_id, 'low_quality' AS category FROM a UNION ALL SELECT db_id, 'toxic' FROM b UNION ALL SELECT db_id, 'foreign_text' FROM d""")
def disjoint(spark: SparkSession, sf: str) -> DataFrame:
    """Sources to look at, by kind of failure, none twice."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    counts = rows.groupBy(F.col("source").alias("db_id")).agg(
        F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("low_quality"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("lang") != "en").alias("foreign_text"), (F.count_if(bad) / F.count("*")).alias("rate")
    )
    return corpus.disjoint_quotas(counts, [("low_quality", 4), ("toxic", 5), ("foreign_text", 6)], "db_id", [F.desc("rate"), F.desc("n")]).select("db_id", "category")


@query("e18_with_replacement", f"""
    WITH r AS (SELECT task_id, db_id, kind, row_number() OVER (PARTITION BY db_id, kind ORDER BY {ordered()}, task_id) AS k, count(*) OVER (PARTITION BY db_id, kind) AS n FROM ({_TASKS}))
    SELECT task_id, db_id || kind AS stratum, CAST(unnest(range(0, CAST(floor((12 - k) / n) AS BIGINT) + 1)) AS INTEGER) AS turn FROM r WHERE k <= 12""")
def replacement(spark: SparkSession, sf: str) -> DataFrame:
    rows = tasks(spark, sf).select("task_id", F.concat("db_id", "kind").alias("stratum"))
    return corpus.with_replacement(rows, "stratum", 12, "task_id")


@query("e19_replayed", f"""
    WITH r AS (SELECT task_id, db_id, row_number() OVER (PARTITION BY db_id ORDER BY {ordered()}, task_id) AS k, count(*) OVER (PARTITION BY db_id) AS n FROM ({_TASKS})),
         u AS (SELECT task_id, 'base_unique' AS role, 0 AS turn FROM r UNION ALL SELECT task_id, 'replay', CAST(unnest(range(0, CAST(floor((3 - k) / n) AS BIGINT) + 1)) AS INTEGER) FROM r WHERE k <= 3)
    SELECT task_id, role, turn, sha256('e19:' || task_id || ':' || role || ':' || turn) AS place FROM u""")
def replayed(spark: SparkSession, sf: str) -> DataFrame:
    """All tasks once, three more of each source, in one shuffled order."""
    base = tasks(spark, sf).select("task_id", "db_id")
    return corpus.replayed(base, corpus.with_replacement(base, "db_id", 3, "task_id"), "task_id", "e19").select("task_id", "role", "turn", "place")


@query("e23_coverage_plan", """
    WITH p AS (SELECT s_suppkey, s_suppkey * 7 AS n, 16 AS b, s_suppkey % 9 + 1 AS k FROM supplier)
    SELECT s_suppkey, n // b AS steps_per_epoch, n // b * b AS covered_rows, n - n // b * b AS dropped_rows, k * b AS prompt_slots, n % b = 0 AND k >= n // b AS full_coverage FROM p""")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    plan = corpus.coverage_plan((F.col("s_suppkey") * 7).cast("long"), F.lit(16).cast("long"), (F.col("s_suppkey") % 9 + 1).cast("long"))
    return table(spark, sf, "supplier").select("s_suppkey", *(c.alias(n) for n, c in plan.items()))


@query("e29_source_guard", """
    SELECT page_id, len(list_filter(string_split(lower(url), '/'), lambda x: x IN ('fr', 'de', 'gate'))) = 0 AS allowed FROM pages""")
def guard(spark: SparkSession, sf: str) -> DataFrame:
    """Which pages may be trained on, by the parts of their addresses."""
    return table(spark, sf, "pages").select("page_id", (~corpus.is_guarded(F.col("url"), ["FR", "de", "gate"])).alias("allowed"))


@query("e20_category_quota", f"""
    SELECT task_id, kind FROM (SELECT task_id, kind, row_number() OVER (PARTITION BY kind ORDER BY {ordered("e20")}, task_id) AS k FROM ({_TASKS})) WHERE k <= 50""")
def category(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.top_quota(tasks(spark, sf).select("task_id", "kind"), ["kind"], 50, "task_id", "e20")


@query("e21_excluded", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def excluded(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("e22_unique_first", f"""
    SELECT task_id, CAST(row_number() OVER (PARTITION BY sha256(text) ORDER BY task_id) > 1 AS INTEGER) AS repeat, {ordered()} AS order_key FROM ({_TASKS})""")
def unique_first(spark: SparkSession, sf: str) -> DataFrame:
    rows = tasks(spark, sf).select("task_id", F.sha2("text", 256).alias("task"))
    return corpus.unique_first(rows, "task", "task_id").select("task_id", "repeat", "order_key")


@query("e22_epoch_order", f"""
    SELECT task_id, repeat, row_number() OVER (ORDER BY repeat, {ordered("e22")}, task_id) - 1 AS position
    FROM (SELECT task_id, CAST(row_number() OVER (PARTITION BY sha256(text) ORDER BY task_id) > 1 AS INTEGER) AS repeat FROM ({_TASKS}))""")
def epoch_order(spark: SparkSession, sf: str) -> DataFrame:
    """The order of an epoch: every text once, then what repeats."""
    rows = tasks(spark, sf).select("task_id", F.sha2("text", 256).alias("task"))
    return corpus.epoch_order(rows, "task", "task_id", "e22")


@query("e24_one_each_then_fill", f"""
    WITH r AS (SELECT task_id, db_id, row_number() OVER (PARTITION BY db_id ORDER BY {ordered("e24")}, task_id) AS k FROM ({_TASKS}))
    SELECT task_id, db_id FROM r ORDER BY k > 1, CASE WHEN k > 1 THEN {ordered("e24")} END, task_id LIMIT 90""")
def fill(spark: SparkSession, sf: str) -> DataFrame:
    """One of each database first, then others by hash up to a target of 90."""
    return corpus.one_each_then_fill(tasks(spark, sf).select("task_id", "db_id"), "db_id", 90, "task_id", "e24")


@query("e25_mixture", "SELECT doc_id AS id, 'document' AS role, CAST(NULL AS INTEGER) AS toxic FROM documents UNION ALL SELECT doc_id, 'label', toxic FROM labels UNION ALL SELECT item_id, 'benchmark', NULL FROM benchmark")
def mixture(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("role"))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit("label").alias("role"), "toxic")
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("role"))
    return docs.unionByName(labels, allowMissingColumns=True).unionByName(items, allowMissingColumns=True)


@query("e26_interleaved", f"""
    SELECT task_id, kind, row_number() OVER (PARTITION BY kind ORDER BY task_id) AS place FROM ({_TASKS})""")
def interleaved(spark: SparkSession, sf: str) -> DataFrame:
    """Place of each task within its family; sorting by (place, kind) interleaves the families."""
    from tessella.operators.positions import ranked

    return ranked(tasks(spark, sf).select("task_id", "kind"), ["kind"], ["task_id"], "place")


@query("e27_marker_leaks", """
    SELECT doc_id, array_to_string(list_filter(['password', 'secret', 'license', 'token', 'api_key'], lambda m: contains(lower(text), m)), ',') AS markers FROM documents
    WHERE len(list_filter(['password', 'secret', 'license', 'token', 'api_key'], lambda m: contains(lower(text), m))) > 0""")
def markers(spark: SparkSession, sf: str) -> DataFrame:
    found = corpus.marker_leaks(table(spark, sf, "documents"), "text", ["password", "secret", "license", "token", "api_key"])
    return found.select("doc_id", F.array_join("markers", ",").alias("markers"))


@query("e27_benchmark_markers", """
    WITH m AS (SELECT DISTINCT lower(left(text, 40)) AS marker FROM benchmark WHERE length(text) >= 40)
    SELECT doc_id, marker FROM documents JOIN m ON contains(lower(text), marker)""")
def benchmark_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Beginnings of benchmark items in documents: one pass with an automaton of all of them."""
    from tessella.functions import matching

    markers = table(spark, sf, "benchmark").where("length(text) >= 40").select(F.lower(F.substring("text", 1, 40)).alias("marker"))
    docs = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    return matching.present(docs, "doc_id", "text", markers, "marker").select(F.col("key").alias("doc_id"), F.col("pattern").alias("marker"))


@query("e28_same_multiset", """
    WITH a AS (SELECT coalesce(text, '(null)') AS t, count(*) AS n FROM documents GROUP BY 1),
         b AS (SELECT coalesce(CASE WHEN doc_id % 10 = 3 THEN NULL WHEN doc_id % 10 = 4 THEN '' ELSE text END, '(null)') AS t, count(*) AS n FROM documents GROUP BY 1)
    SELECT count(*) = 0 AS equal, count(*) AS different FROM (SELECT * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT * FROM (SELECT * FROM b EXCEPT SELECT * FROM a))""")
def multiset(spark: SparkSession, sf: str) -> DataFrame:
    """How many texts come in other numbers once some are nulled and some emptied."""
    docs = table(spark, sf, "documents")
    changed = F.when(F.col("doc_id") % 10 == 3, F.lit(None)).when(F.col("doc_id") % 10 == 4, "").otherwise(F.col("text"))
    return corpus.same_multiset(docs, docs.withColumn("text", changed), "text")


@query("e30_record_audit", """
    SELECT conv_id, turn, 'missing:text' AS problem FROM conversations WHERE turn % 5 = 2 UNION ALL SELECT conv_id, turn, 'empty:text' FROM conversations WHERE turn % 5 = 3
    UNION ALL SELECT conv_id, turn, 'empty:role' FROM conversations WHERE conv_id % 9 = 0""")
def audit(spark: SparkSession, sf: str) -> DataFrame:
    """Problems of records of which some fields were taken away."""
    text = F.when(F.col("turn") % 5 == 2, F.lit(None)).when(F.col("turn") % 5 == 3, "  ").otherwise(F.coalesce("text", F.lit("x")))
    role = F.when(F.col("conv_id") % 9 == 0, "").otherwise(F.col("role"))
    rows = table(spark, sf, "conversations").withColumns({"text": F.when(F.trim(text) == "", F.when(text.isNotNull(), F.when(F.col("turn") % 5 == 3, "  ").otherwise("x"))).otherwise(text), "role": role})
    return corpus.record_audit(rows, ["role", "text"]).select("conv_id", "turn", F.explode("problems").alias("problem"))


@query("e31_duplicate_ids", """
    WITH r AS (SELECT source, count(*) AS n, count(DISTINCT text) AS texts, count(*) FILTER (text IS NULL OR trim(text) = '') AS empty FROM documents GROUP BY 1)
    SELECT source, n - texts AS repeated, empty, n = texts AND empty = 0 AS ready FROM r""")
def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Readiness of each source: repeated texts and empty ones."""
    return corpus.readiness(table(spark, sf, "documents"), "source", "text", "text")


@query("e32_overlap", "SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def overlap(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "custkey")
    return corpus.overlap(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'P'"), "custkey")


@query("e33_release_gates", f"""
    WITH d AS (SELECT *, {_SPLIT.replace("db_id", "source")} AS split FROM documents)
    SELECT 'unique_ids' AS gate, count(*) = count(DISTINCT doc_id) AS passed FROM d
    UNION ALL SELECT 'no_null_text', count(*) FILTER (text IS NULL) = 0 FROM d
    UNION ALL SELECT 'labels_known', count(*) = 0 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM d)
    UNION ALL SELECT 'lengths_match', count(*) FILTER (length(text) <> n_chars) = 0 FROM d
    UNION ALL SELECT 'group_isolation', count(*) = 0 FROM (SELECT source FROM d GROUP BY 1 HAVING count(DISTINCT split) > 1)
    UNION ALL SELECT 'both_splits', count(DISTINCT split) = 2 FROM d
    UNION ALL SELECT 'no_marker_leaks', count(*) FILTER (contains(lower(text), 'api_key')) = 0 FROM d
    UNION ALL SELECT 'sizes', count(*) BETWEEN 100 AND 1000000 FROM d
    UNION ALL SELECT 'benchmark_unseen', count(*) = 0 FROM d WHERE text IN (SELECT text FROM benchmark)""")
def gates(spark: SparkSession, sf: str) -> DataFrame:
    """Nine checks before a release, one row each."""
    docs, labels = corpus.hash_split(table(spark, sf, "documents"), "source"), table(spark, sf, "labels")
    n = F.count("*")
    once = docs.agg(
        (n == F.count_distinct("doc_id")).alias("unique_ids"), (F.count_if(F.col("text").isNull()) == 0).alias("no_null_text"), (F.count_if(F.length("text") != F.col("n_chars")) == 0).alias("lengths_match"),
        (F.count_distinct("split") == 2).alias("both_splits"), (F.count_if(F.contains(F.lower("text"), F.lit("api_key"))) == 0).alias("no_marker_leaks"), n.between(100, 1_000_000).alias("sizes"),
    )
    none = lambda df, gate: df.agg((F.count("*") == 0).alias(gate))
    return corpus.checks(
        once, none(labels.join(docs, "doc_id", "left_anti"), "labels_known"), none(corpus.leaks(docs, "split", "source"), "group_isolation"), none(docs.join(table(spark, sf, "benchmark"), "text", "left_semi"), "benchmark_unseen")
    )


@query("e34_described", """
    SELECT coalesce(source, '(all)') AS source, coalesce(lang, '(all)') AS lang, count(*) AS n, count(DISTINCT doc_id) AS ids FROM documents GROUP BY GROUPING SETS ((source, lang), (source), (lang), ())""")
def described(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("source", "lang", "doc_id")
    every = [[F.col("source"), F.col("lang")], [F.col("source")], [F.col("lang")], []]
    counts = docs.groupingSets(every, "source", "lang").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"))
    return counts.withColumns({"source": F.coalesce("source", F.lit("(all)")), "lang": F.coalesce("lang", F.lit("(all)"))})


@query("e35_ids_digest", """
    WITH n AS (SELECT count(*) AS n, CASE WHEN count(*) < 50000 THEN 1 ELSE 1 << CAST(floor(log2(count(*) // 50000)) + 1 AS INTEGER) END AS k FROM documents),
         b AS (SELECT doc_id % k AS b, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY doc_id)) AS d FROM documents, n GROUP BY 1)
    SELECT (SELECT n FROM n) AS n, sha256(string_agg(d, chr(10) ORDER BY b)) AS digest FROM b""")
def ids_digest(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.ids_digest(table(spark, sf, "documents"), "doc_id")


_SIX = ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "note")


@query("e36_reused", "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0")
def reused(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose six fields are as verified before, where some were changed or lost since."""
    rows = table(spark, sf, "orders").withColumn("note", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")))
    changed = rows.withColumns({"o_custkey": F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")), "o_orderpriority": F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_orderpriority"))})
    return corpus.reusable(rows, changed, "o_orderkey", _SIX)


@query("j08_index_lookup", """
    WITH s AS (SELECT doc_id, lang, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS k FROM documents)
    SELECT label_id, s.doc_id AS source_id, lang FROM (SELECT doc_id AS label_id, doc_id * 37 % (SELECT count(*) FROM documents) AS at_index FROM labels) l JOIN s ON s.k = l.at_index""")
def lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that an index points at: an equi-join on the place."""
    from tessella.operators.positions import numbered

    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), "lang")
    index = table(spark, sf, "labels").select(F.col("doc_id").alias("label_id"), (F.col("doc_id") * 37 % docs.count()).alias("k"))
    return numbered(docs, ["source_id"], "k").join(index, "k").select("label_id", "source_id", "lang")


# Joins: labels are outcomes of tasks; customers and orders stand for other keyed rows.


@query("j01_inner", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def inner(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query("j02_three_way", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P'")
def three_way(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer = table(spark, sf, "orders").where("o_orderstatus = 'P'"), table(spark, sf, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("j03_left_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("j04_left_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("j07_positional", "SELECT a.doc_id AS left_id, b.doc_id AS right_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents) a JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM labels) b USING (k)")
def positional(spark: SparkSession, sf: str) -> DataFrame:
    from tessella.operators.positions import numbered

    left = numbered(table(spark, sf, "documents").select(F.col("doc_id").alias("left_id")), ["left_id"], "k")
    right = numbered(table(spark, sf, "labels").select(F.col("doc_id").alias("right_id")), ["right_id"], "k")
    return left.join(right, "k").select("left_id", "right_id")


@query("j09_latest_left", """
    SELECT c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def latest(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("x"))
    return table(spark, sf, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("x.o_orderkey").alias("last_order"), F.col("x.o_orderstatus").alias("last_status"))


@query("j10_existential", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_shipdate > o.o_orderdate AND l.l_quantity >= 45)")
def existential(spark: SparkSession, sf: str) -> DataFrame:
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem").where("l_quantity >= 45")
    return orders.join(lines, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate")), "left_semi").select("o_orderkey")


@query("j11_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables of fixed size."""
    return table(spark, sf, "region").select("r_name").crossJoin(table(spark, sf, "nation").select("n_name"))
