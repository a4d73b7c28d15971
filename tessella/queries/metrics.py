"""Family G: evaluation metrics and rewards; labels stand for two arms' outcomes (quality, toxic)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import metrics
from tessella.operators.corpus import checks
from tessella.operators import reward as rewards
from tessella.registry import query, table

#: Rollouts: a labelled document is an episode, its language the drift type, its source the variant's group.
_ROWS = """SELECT doc_id, source, lang, n_chars, quality = 1 AS success, toxic = 1 AS unsafe, CASE WHEN n_chars < 1000 THEN 'easy' WHEN n_chars < 4000 THEN 'medium' ELSE 'hard' END AS difficulty,
           CASE WHEN n_chars > 8000 THEN 'turn_limit' WHEN toxic = 1 THEN 'fallback_submitted' ELSE 'submitted' END AS termination, n_chars % 7 + 1 AS tool_calls FROM documents JOIN labels USING (doc_id)"""


def rollouts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    n = F.col("n_chars")
    return rows.select(
        "doc_id", "source", "lang", "n_chars", (F.col("quality") == 1).alias("success"), (F.col("toxic") == 1).alias("unsafe"), F.when(n < 1000, "easy").when(n < 4000, "medium").otherwise("hard").alias("difficulty"),
        F.when(n > 8000, "turn_limit").when(F.col("toxic") == 1, "fallback_submitted").otherwise("submitted").alias("termination"), (n % 7 + 1).alias("tool_calls"),
    )


@query("a01_execution_summary", f"""
    SELECT coalesce(difficulty, '(all)') AS difficulty, count(*) AS n, count(*) FILTER (success) AS correct, round(count(*) FILTER (success)::DOUBLE / count(*), 6) AS rate, count(*) FILTER (tool_calls > 5) AS over_budget
    FROM ({_ROWS}) GROUP BY GROUPING SETS ((difficulty), ())""")
def summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = rollouts(spark, sf)
    out = rows.groupingSets([[F.col("difficulty")], []], "difficulty").agg(
        F.count("*").alias("n"), F.count_if("success").alias("correct"), F.round(F.count_if("success") / F.count("*"), 6).alias("rate"), F.count_if(F.col("tool_calls") > 5).alias("over_budget")
    )
    return out.withColumn("difficulty", F.coalesce("difficulty", F.lit("(all)")))


_METRICS = """count(*) AS n, round(count(*) FILTER (success)::DOUBLE / count(*), 6) AS success_rate,
    CASE WHEN count(*) FILTER (termination <> 'turn_limit') = 0 THEN 0.0 ELSE round(count(*) FILTER (success AND termination <> 'turn_limit')::DOUBLE / count(*) FILTER (termination <> 'turn_limit'), 6) END AS submit_precision,
    count(*) FILTER (unsafe) AS unsafe, round(avg(tool_calls), 6) AS mean_tools"""


@query("a02_metrics", f"SELECT {_METRICS} FROM ({_ROWS})")
def overall(spark: SparkSession, sf: str) -> DataFrame:
    return rollouts(spark, sf).agg(*metrics.evaluation())


@query("a03_metrics_by_key", f"SELECT lang, {_METRICS} FROM ({_ROWS}) GROUP BY lang")
def by_key(spark: SparkSession, sf: str) -> DataFrame:
    return rollouts(spark, sf).groupBy("lang").agg(*metrics.evaluation())


@query("a04_slices", f"SELECT coalesce(source, '(all)') AS source, coalesce(lang, '(all)') AS lang, coalesce(difficulty, '(all)') AS difficulty, {_METRICS} FROM ({_ROWS}) GROUP BY GROUPING SETS ((source), (lang), (difficulty), (lang, difficulty), ())")
def slices(spark: SparkSession, sf: str) -> DataFrame:
    source, lang, difficulty = map(F.col, ("source", "lang", "difficulty"))
    out = rollouts(spark, sf).groupingSets([[source], [lang], [difficulty], [lang, difficulty], []], "source", "lang", "difficulty").agg(*metrics.evaluation())
    return out.withColumns({c: F.coalesce(c, F.lit("(all)")) for c in ("source", "lang", "difficulty")})


@query("a05_ranking", f"""
    SELECT source, CAST(row_number() OVER (ORDER BY success_rate DESC, unsafe, mean_tools, n DESC, source) AS INTEGER) AS place FROM (SELECT source, {_METRICS} FROM ({_ROWS}) GROUP BY source)""")
def ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Places of the variants: one row each, few by nature, so one window over the aggregates."""
    rows = rollouts(spark, sf).groupBy("source").agg(*metrics.evaluation())
    order = Window.orderBy(F.desc("success_rate"), "unsafe", "mean_tools", F.desc("n"), "source")
    return rows.select("source", F.row_number().over(order).alias("place"))


@query("a06_recovery", f"""
    SELECT round(count(*) FILTER (success AND lang <> 'en')::DOUBLE / greatest(1, count(*) FILTER (lang <> 'en')), 6) AS drift_recovery,
           round(count(*) FILTER (termination IN ('submitted', 'fallback_submitted') AND NOT unsafe)::DOUBLE / count(*), 6) AS safe_submission FROM ({_ROWS})""")
def recovery(spark: SparkSession, sf: str) -> DataFrame:
    drift = F.col("lang") != "en"
    safe = F.col("termination").isin("submitted", "fallback_submitted") & ~F.col("unsafe")
    return rollouts(spark, sf).agg(
        F.round(F.count_if(F.col("success") & drift) / F.greatest(F.lit(1), F.count_if(drift)), 6).alias("drift_recovery"), F.round(F.count_if(safe) / F.count("*"), 6).alias("safe_submission")
    )


@query("a07_tool_histogram", "SELECT event_type AS tool, count(*) AS calls, count(DISTINCT user_id) AS sessions FROM events GROUP BY 1")
def tools(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("calls"), F.count_distinct("user_id").alias("sessions"))


_Z = "1.96::DOUBLE"


@query("a08_wilson", f"""
    SELECT lang, coalesce(round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6), 0) AS low, coalesce(round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6), 0) AS high
    FROM (SELECT lang, count(*)::DOUBLE AS n, count(*) FILTER (success)::DOUBLE / count(*) AS p, {_Z} AS z FROM ({_ROWS}) GROUP BY lang UNION ALL SELECT 'none', NULL, NULL, {_Z})""")
def wilson(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of success rates by language, and that of no rows."""
    counts = rollouts(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), F.count_if("success").alias("good"))
    counts = counts.unionByName(spark.createDataFrame([("none", 0, 0)], "lang string, n long, good long"))
    low, high = metrics.wilson(F.col("good"), F.col("n"))
    return counts.select("lang", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("a09_usage", "SELECT event_type, round(avg(coalesce(value, 0)), 6) AS mean_value FROM events GROUP BY 1")
def usage(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg(F.coalesce("value", F.lit(0.0))), 6).alias("mean_value"))


@query("a11_checkpoint_choice", f"SELECT lang, arg_max(source, (good, n, source)) AS chosen FROM (SELECT lang, source, count(*) AS n, count(*) FILTER (success) AS good FROM ({_ROWS}) GROUP BY 1, 2) GROUP BY lang")
def checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    scores = rollouts(spark, sf).groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_if("success").alias("good"))
    return scores.groupBy("lang").agg(F.max_by("source", F.struct("good", "n", "source")).alias("chosen"))


@query("a12_candidate_gate", f"""
    WITH m AS (SELECT {_METRICS} FROM ({_ROWS}))
    SELECT 'success' AS gate, success_rate >= 0.7 AS passed FROM m UNION ALL SELECT 'precision', submit_precision >= 0.8 FROM m UNION ALL SELECT 'unsafe', unsafe = 0 FROM m UNION ALL SELECT 'tools', mean_tools <= 7 FROM m
    UNION ALL SELECT 'size', n >= 100 FROM m UNION ALL SELECT 'all', success_rate >= 0.7 AND submit_precision >= 0.8 AND unsafe = 0 AND mean_tools <= 7 AND n >= 100 FROM m""")
def gate(spark: SparkSession, sf: str) -> DataFrame:
    m = rollouts(spark, sf).agg(*metrics.evaluation())
    m = m.select((F.col("success_rate") >= 0.7).alias("success"), (F.col("submit_precision") >= 0.8).alias("precision"), (F.col("unsafe") == 0).alias("unsafe"), (F.col("mean_tools") <= 7).alias("tools"), (F.col("n") >= 100).alias("size"))
    return checks(m.withColumn("all", F.expr(" AND ".join(m.columns))))


@query("a13_exposures", "SELECT n AS exposures, count(*) AS tasks FROM (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1) GROUP BY n")
def exposures(spark: SparkSession, sf: str) -> DataFrame:
    """Count of counts: how many tasks come once, twice, ..."""
    once = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("exposures"))
    return once.groupBy("exposures").agg(F.count("*").alias("tasks"))


@query("a14_top_errors", "SELECT user_id, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY errors DESC, user_id LIMIT 10")
def errors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("errors")).orderBy(F.desc("errors"), "user_id").limit(10)


@query("a15_length_spread", "SELECT lang, min(n_chars) AS low, CAST(median(n_chars) AS DOUBLE) AS mid, max(n_chars) AS high FROM documents GROUP BY lang")
def lengths(spark: SparkSession, sf: str) -> DataFrame:
    """The least, the middle and the largest text length of each language."""
    return metrics.quantiles(table(spark, sf, "documents"), "lang", "n_chars", {"low": 0.0, "mid": 0.5, "high": 1.0}).select("lang", F.col("low").cast("long").alias("low"), "mid", F.col("high").cast("long").alias("high"))


@query("a15_price_quantiles", """
    SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(median(l_extendedprice), 6) AS p50, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY 1""")
def prices(spark: SparkSession, sf: str) -> DataFrame:
    """Exact quantiles of a few very large groups."""
    found = metrics.quantiles(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p99": 0.99})
    return found.select("l_returnflag", *(F.round(c, 6).alias(c) for c in ("p10", "p50", "p99")))


@query("a16_prompt_groups", "SELECT regexp_replace(replace(url, '/', '_'), '_[^_]*_[^_]*$', '') AS prompt_group, count(*) AS n FROM pages GROUP BY 1")
def groups(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").groupBy(F.regexp_replace(F.replace("url", F.lit("/"), F.lit("_")), "_[^_]*_[^_]*$", "").alias("prompt_group")).agg(F.count("*").alias("n"))


@query("a17_reward_gap", f"""
    SELECT difficulty, round(avg(tool_calls) FILTER (success), 6) AS good, round(avg(tool_calls) FILTER (NOT success), 6) AS bad, round(avg(tool_calls) FILTER (success) - avg(tool_calls) FILTER (NOT success), 6) AS gap,
           coalesce(avg(tool_calls) FILTER (success) < avg(tool_calls) FILTER (NOT success), false) AS passed FROM ({_ROWS}) GROUP BY 1""")
def gap(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = F.avg(F.when(F.col("success"), F.col("tool_calls"))), F.avg(F.when(~F.col("success"), F.col("tool_calls")))
    return rollouts(spark, sf).groupBy("difficulty").agg(F.round(good, 6).alias("good"), F.round(bad, 6).alias("bad"), F.round(good - bad, 6).alias("gap"), F.coalesce(good < bad, F.lit(False)).alias("passed"))


#: Facts of episodes from events: a user is an episode, its events by time the calls.
_FACTS = """
    WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events),
    f AS (SELECT user_id, count(*) AS calls, sum(length(props)) * 10 AS tokens, user_id % 3 = 0 AS must_ask, user_id % 2 = 0 AS add_column, user_id % 5 <> 0 AS drifted,
        coalesce(arg_max(value > 50, s) FILTER (event_type = 'purchase'), false) AS success, coalesce(bool_or(value > 40) FILTER (event_type = 'signup'), false) AS matched,
        bool_or(event_type = 'signup') AS attempted, bool_or(event_type = 'purchase') AS executed, bool_or(event_type = 'click') AS inspected,
        min(s) FILTER (event_type = 'view') AS v, min(s) FILTER (event_type = 'click') AS d, min(s) FILTER (event_type = 'signup') AS a,
        coalesce(bool_or(value > 80) FILTER (event_type = 'purchase'), false) AS semantic_match, arg_min(event_type, s) = 'view' AS first_right, max(s) FILTER (event_type = 'error') AS submitted,
        max(s) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'signup') AS asks, count(*) FILTER (event_type IN ('view', 'click')) AS retrievals, count(*) FILTER (value > 95) AS invalid_sql FROM e GROUP BY user_id),
    g AS (SELECT *, coalesce(v < d, false) AS ordered_inspection, coalesce(p = a + 1, false) AS post_valid, coalesce(submitted > p, false) AS terminal_validated,
        add_column AND coalesce(v < d AND d < p, false) AS complete, coalesce(p < d, true) AS premature FROM f)
    SELECT *, success AND terminal_validated AND (NOT drifted OR ordered_inspection) AND (NOT must_ask OR (matched AND post_valid)) AND (NOT add_column OR complete) AS protocol FROM g"""


def facts(spark: SparkSession, sf: str) -> DataFrame:
    from tessella.operators.sessions import sequenced

    e = sequenced(table(spark, sf, "events"), "user_id", ["ts", "event_id"]).withColumnRenamed("sequence", "s")
    kind, value, s, user = F.col("event_type"), F.col("value"), F.col("s"), F.col("user_id")
    when = lambda name, x: F.when(kind == name, x)
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    f = e.groupBy("user_id").agg(
        F.count("*").alias("calls"), (F.sum(F.length("props")) * 10).alias("tokens"), F.coalesce(F.max_by(value > 50, when("purchase", s)), F.lit(False)).alias("success"),
        some(when("signup", value > 40)).alias("matched"), some(kind == "signup").alias("attempted"), some(kind == "purchase").alias("executed"), some(kind == "click").alias("inspected"),
        F.min(when("view", s)).alias("v"), F.min(when("click", s)).alias("d"), F.min(when("signup", s)).alias("a"), some(when("purchase", value > 80)).alias("semantic_match"),
        (F.min_by("event_type", "s") == "view").alias("first_right"), F.max(when("error", s)).alias("submitted"), F.max(when("purchase", s)).alias("p"),
        F.count_if(kind == "signup").alias("asks"), F.count_if(kind.isin("view", "click")).alias("retrievals"), F.count_if(value > 95).alias("invalid_sql"),
    )
    bought = f.withColumn("success", F.col("success") & F.col("executed"))
    no = F.lit(False)
    g = bought.withColumns({
        "must_ask": user % 3 == 0, "add_column": user % 2 == 0, "drifted": user % 5 != 0, "ordered_inspection": F.coalesce(F.col("v") < F.col("d"), no), "post_valid": F.coalesce(F.col("p") == F.col("a") + 1, no),
        "terminal_validated": F.coalesce(F.col("submitted") > F.col("p"), no), "complete": (user % 2 == 0) & F.coalesce((F.col("v") < F.col("d")) & (F.col("d") < F.col("p")), no), "premature": F.coalesce(F.col("p") < F.col("d"), F.lit(True)),
        "format_valid": F.lit(True), "event_executed": F.col("executed"), "target_set": F.lit(True), "timed_out": F.col("calls") > 30, "turn_limited": F.col("calls") > 20, "no_submit": F.col("submitted").isNull(), "unsafe": user % 11 == 0,
        "dup_questions": F.greatest(F.lit(0), F.col("asks") - 2), "dup_executions": F.lit(0), "excess_asks": F.greatest(F.lit(0), F.col("asks") - 1), "excess_retrievals": F.greatest(F.lit(0), F.col("retrievals") - 2), "unknown_tools": F.lit(0),
    })
    return g.withColumn("protocol", F.expr(rewards.PROTOCOL))


def _score_sql(version: str) -> str:
    """The formula written out for one version, over the facts that vary here."""
    w = lambda t: f"{rewards.weight(t, version)!r}::DOUBLE"
    late, last = version in ("v2", "v3"), version == "v3"
    one = lambda c: f"CAST(({c}) AS INTEGER)"
    return f"""
    SELECT user_id, round({w("success")} * {one("protocol" if last else "success")} + {w("clarify")} * {one("matched")} + {w("valid")} * {one("executed")}
        + {w("efficient")} * {one(f"success AND calls <= {rewards.weight('calls', version)} AND asks <= 2" + (" AND protocol" if last else ""))} + {w("required_clarification")} * {one("must_ask AND matched")}
        + {w("clarification_attempt")} * {one("must_ask AND attempted")} + {w("post_clarification")} * {one("must_ask AND post_valid" + (" AND matched" if late else ""))}
        + {w("terminal")} * {one("terminal_validated" + (" AND success" if late else ""))} + {w("add_column_inspect")} * {one("add_column AND " + ("ordered_inspection" if late else "inspected"))}
        + {w("semantic_candidate")} * {one("semantic_match" if late else "false")} + {w("add_column")} * {one("complete")} + {w("decision_action")} * {one("first_right")}
        - {w("tool_cost")} * calls - least(0.1::DOUBLE, {w("token_cost")} * tokens) - {w("duplicate")} * greatest(0, asks - 2) - {w("repeated_tool")} * (greatest(0, asks - 1) + greatest(0, retrievals - 2))
        - {w("invalid")} * invalid_sql - {w("timeout")} * {one("calls > 30")} - {w("turn_limit")} * {one("calls > 20")} - {w("missing_submit")} * {one("submitted IS NULL")} - {w("unsafe")} * {one("user_id % 11 = 0")}
        - {w("missing_clarification")} * {one("must_ask AND NOT attempted")} - {w("unmatched_clarification")} * {one("must_ask AND attempted AND NOT matched")}
        - {w("invalid_post_clarification")} * {one("must_ask AND attempted AND NOT post_valid")} - {w("add_column_protocol")} * {one("add_column AND NOT complete")} - {w("premature_stale")} * {one("add_column AND premature")}, 4) + 0.0::DOUBLE AS score FROM ({_FACTS})"""


def _scored(version: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return facts(spark, sf).select("user_id", (rewards.score(version) + 0.0).alias("score"))

    return run


for _version in rewards.VERSIONS:
    query(f"a19_reward_{_version}", _score_sql(_version))(_scored(_version))


@query("a18_reward_delta", f"SELECT user_id % 3 = 0 AS must_ask, round(avg(b.score - a.score), 4) + 0.0::DOUBLE AS delta FROM ({_score_sql('v1')}) a JOIN ({_score_sql('v3')}) b USING (user_id) GROUP BY 1")
def delta(spark: SparkSession, sf: str) -> DataFrame:
    change = rewards.score("v3") - rewards.score("v1")
    return facts(spark, sf).groupBy("must_ask").agg((F.round(F.avg(change), 4) + 0.0).alias("delta"))


@query("j05_paired", "SELECT count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 0) AS losses, count(*) FILTER (quality = 0 AND toxic = 1) AS gains, count(*) FILTER (quality = 1 AND toxic = 1) AS both FROM labels")
def paired(spark: SparkSession, sf: str) -> DataFrame:
    """Two arms on shared keys: what the second gains and loses against the first."""
    labels = table(spark, sf, "labels")
    return metrics.paired(labels.select("doc_id", (F.col("quality") == 1).alias("ok")), labels.select("doc_id", (F.col("toxic") == 1).alias("ok")), "doc_id")


@query("j06_paired_by_group", "SELECT lang, count(*) FILTER (toxic = 1 AND quality = 0) AS gains, count(*) FILTER (toxic = 0 AND quality = 1) AS losses FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def paired_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.count_if((F.col("toxic") == 1) & (F.col("quality") == 0)).alias("gains"), F.count_if((F.col("toxic") == 0) & (F.col("quality") == 1)).alias("losses"))


@query("a25_within_budget", f"SELECT doc_id, tool_calls <= 5 AND n_chars <= 6144 AS within_budget FROM ({_ROWS})")
def budget(spark: SparkSession, sf: str) -> DataFrame:
    return rollouts(spark, sf).select("doc_id", ((F.col("tool_calls") <= 5) & (F.col("n_chars") <= 6144)).alias("within_budget"))
