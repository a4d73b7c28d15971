"""More of families F to H: what episodes of events did, and how they ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import episodes
from tessella.operators.rollouts import failure_labels
from tessella.queries.rollouts import events as calls
from tessella.queries.rollouts import runs
from tessella.queries.sessions import _EVENTS, events
from tessella.registry import SQL, query, table
from tessella.streaming import sessions as live


@query("a10_ordered_inspection", f"""
    WITH f AS (SELECT user_id, min(sequence) FILTER (event_type = 'view') AS v, min(sequence) FILTER (event_type = 'click') AS d, min(sequence) FILTER (event_type = 'purchase') AS x FROM ({_EVENTS}) GROUP BY 1)
    SELECT count(*) AS n, count(*) FILTER (v < d) AS ordered_inspection, count(*) FILTER (v < d AND d < x) AS before_execution, count(*) FILTER (x IS NOT NULL AND (d IS NULL OR x < d)) AS shortcut FROM f""")
def inspection(spark: SparkSession, sf: str) -> DataFrame:
    return episodes.inspection_summary(episodes.first_places(events(spark, sf)))


@query("a13_label_counts", f"SELECT label, count(*) AS rollouts FROM (SELECT unnest(string_split(labels, ',')) AS label FROM ({SQL['t11_failure_labels']})) GROUP BY label")
def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many failed rollouts have each label."""
    found = failure_labels(runs(spark, sf), calls(spark, sf))
    return found.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("rollouts"))


@query("a23_free_query", f"""
    SELECT user_id, coalesce(arg_max(props, sequence) FILTER (event_type = 'purchase') = arg_max(props, sequence) FILTER (event_type = 'error'), false) AS same FROM ({_EVENTS}) GROUP BY 1""")
def free_query(spark: SparkSession, sf: str) -> DataFrame:
    """Whether what was submitted last is what was executed last."""
    last = lambda kind: F.max_by("props", F.when(F.col("event_type") == kind, F.col("sequence")))
    facts = events(spark, sf).groupBy("user_id").agg(last("purchase").alias("x"), last("error").alias("y"), F.bool_or(F.col("event_type") == "purchase").alias("a"), F.bool_or(F.col("event_type") == "error").alias("b"))
    return facts.select("user_id", F.coalesce((F.col("x") == F.col("y")) & F.col("a") & F.col("b"), F.lit(False)).alias("same"))


_ENDINGS = f"""
    WITH r AS (SELECT user_id, sequence, event_type, count(*) OVER w AS calls, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS runs FROM ({_EVENTS}) WINDOW w AS (PARTITION BY user_id ORDER BY sequence)),
         x AS (SELECT user_id, sequence, CASE WHEN event_type = 'error' THEN 'submitted' WHEN runs > 3 THEN 'sql_budget' WHEN calls > 7 THEN 'turn_limit' END AS reason FROM r)
    SELECT user_id, coalesce(arg_min(reason, sequence) FILTER (reason IS NOT NULL), 'running') AS reason FROM x GROUP BY user_id"""


@query("h11_terminations", _ENDINGS)
def terminations(spark: SparkSession, sf: str) -> DataFrame:
    """How a session ends: the first of a submission and the budgets of calls and executions."""
    return episodes.terminations(events(spark, sf), most_calls=7, most_runs=3)


@query("h11_streamed_terminations", _ENDINGS)
def streamed_terminations(spark: SparkSession, sf: str) -> DataFrame:
    """The same by a stream in three runs, from the last row of each session."""
    rows = live.events_with_times(spark, sf).select("event_id", "user_id", "event_type", "ts", "at")
    found = live.in_cuts(rows, "at", 3, lambda stream: live.folded(stream, "user_id", live.Ending(7, 3), ["at", "event_id"]))
    return found.groupBy("user_id").agg(F.max_by("reason", "calls").alias("reason"))


@query("t17_recovery_contexts", f"""
    SELECT user_id, unnest(['pre_error', 'post_error', 'terminal']) AS context, first_error FROM (SELECT user_id, min(sequence) AS first_error FROM ({_EVENTS}) WHERE event_type = 'error' GROUP BY 1)""")
def contexts(spark: SparkSession, sf: str) -> DataFrame:
    return episodes.recovery_contexts(events(spark, sf))


@query("t31_premature", f"""
    SELECT user_id, coalesce(min(sequence) FILTER (event_type = 'purchase') < coalesce(min(sequence) FILTER (event_type = 'click'), 1000000), false) AS premature FROM ({_EVENTS}) GROUP BY 1""")
def premature(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an execution came before the first inspection."""
    f = episodes.first_places(events(spark, sf))
    return f.select("user_id", F.coalesce(F.col("purchase") < F.coalesce("click", F.lit(1_000_000)), F.lit(False)).alias("premature"))


@query("t07_post_clarification", f"""
    WITH n AS (SELECT user_id, sequence, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY sequence) AS after FROM ({_EVENTS}))
    SELECT user_id, sequence, coalesce(after IN ('purchase', 'view'), false) AS valid FROM n WHERE event_type = 'signup'""")
def post_clarification(spark: SparkSession, sf: str) -> DataFrame:
    """Whether what follows a question is one of the tools that may."""
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("sequence"))
    rows = events(spark, sf).withColumn("after", after).where("event_type = 'signup'")
    return rows.select("user_id", "sequence", F.coalesce(F.col("after").isin("purchase", "view"), F.lit(False)).alias("valid"))


@query("x11_applied_decisions", """
    SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'unsafe_post_diff_candidate' WHEN l.quality = 1 THEN 'contract_validated' WHEN l.doc_id IS NULL THEN 'missing_result_contract' ELSE 'result_contract_mismatch' END AS decision
    FROM documents d LEFT JOIN labels l USING (doc_id)""")
def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """A controller's decisions beside rollouts that it may not know."""
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").withColumn("known", F.lit(True)), "doc_id", "left")
    decision = F.when(F.col("toxic") == 1, "unsafe_post_diff_candidate").when(F.col("quality") == 1, "contract_validated").when(F.col("known").isNull(), "missing_result_contract").otherwise("result_contract_mismatch")
    return rows.select("doc_id", decision.alias("decision"))


@query("z22_action_payloads", "SELECT conv_id, role, array_to_string(list(CAST(length(coalesce(text, '')) AS VARCHAR) ORDER BY turn), ',') AS sizes FROM conversations GROUP BY 1, 2")
def payloads(spark: SparkSession, sf: str) -> DataFrame:
    sized = F.array_sort(F.collect_list(F.struct("turn", F.length(F.coalesce("text", F.lit(""))).cast("string").alias("n"))))
    return table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.array_join(F.transform(sized, lambda x: x["n"]), ",").alias("sizes"))


@query("z16_hidden_tools", f"""
    SELECT user_id, array_to_string(list_sort(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda t: NOT list_contains(seen, t))), ',') AS hidden FROM (SELECT user_id, list(DISTINCT event_type) AS seen FROM ({_EVENTS}) GROUP BY 1)""")
def hidden(spark: SparkSession, sf: str) -> DataFrame:
    """Tools that a session hasn't used, in order."""
    seen = events(spark, sf).groupBy("user_id").agg(F.collect_set("event_type").alias("seen"))
    every = F.array(*(F.lit(t) for t in ("click", "error", "purchase", "signup", "view")))
    return seen.select("user_id", F.array_join(F.array_sort(F.array_except(every, "seen")), ",").alias("hidden"))


@query("z12_generation_budget", "SELECT doc_id, CAST(greatest(1, least(512, 6144 - n_chars)) AS BIGINT) AS new_tokens FROM documents")
def generation(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.greatest(F.lit(1), F.least(F.lit(512), F.lit(6144) - F.col("n_chars"))).cast("long").alias("new_tokens"))
