"""Family T, X and A over rollouts: a user's events of three days stand for the tool calls of one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import rollouts, sessions, token_masks
from tessella.registry import query, table
from tessella.streaming import sessions as live

_EVENT = """
    user_id * 10 + (day(ts) - 1) DIV 3 AS rollout, event_id, ts, user_id,
    CASE event_type WHEN 'view' THEN 'get_schema_version' WHEN 'click' THEN 'inspect_schema_diff' WHEN 'purchase' THEN 'execute_sql'
        WHEN 'signup' THEN CASE event_id % 5 WHEN 0 THEN 'Ask-User' WHEN 1 THEN 'get_knowledge_definition' WHEN 2 THEN 'get_schema' ELSE 'ask_user' END
        ELSE CASE event_id % 3 WHEN 0 THEN 'submit_solution' ELSE 'execute_sql' END END AS tool,
    value > 50 AS ok, event_id % 17 = 0 AS masked, value > 50 AND event_id % 4 = 0 AS validated,
    CASE event_id % 6 WHEN 0 THEN false WHEN 1 THEN true END AS contract,
    concat('SELECT ', CAST(event_id % 3 AS STRING), CASE event_id % 2 WHEN 0 THEN ';' ELSE '' END) AS sql,
    event_id % 13 <> 0 AS read_only, event_id % 19 = 0 AS error,
    CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('SELECT ', CAST(event_id % 5 AS STRING)) END AS candidate"""
_ROLLOUT = """
    CASE rollout % 4 WHEN 0 THEN 'must_ask' WHEN 1 THEN 'knowledge_only' WHEN 2 THEN 'schema_only' ELSE 'direct_clean' END AS profile,
    CASE WHEN rollout % 3 = 0 THEN 'compound' ELSE 'atomic' END AS scenario,
    CASE rollout % 5 WHEN 0 THEN 'submitted' WHEN 1 THEN 'turn_limit' ELSE 'error' END AS termination,
    rollout % 7 = 0 AS success, rollout % 11 = 0 AS unsafe"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    columns = _EVENT.replace("DIV", "div")
    rows = table(spark, sf, "events").selectExpr(*_split(columns))
    rows = sessions.sequenced(rows, "rollout", ["ts", "event_id"]).withColumnRenamed("sequence", "at")
    return rows.withColumn("matches", F.col("event_id") % 3 == F.col("rollout") % 3).drop("ts")


def _split(columns: str) -> list[str]:
    """Top-level parts of a column list."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(columns[last:i])
            last = i + 1
    return [*out, columns[last:]]


def runs(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "events").select(F.expr("user_id * 10 + (day(ts) - 1) div 3").alias("rollout")).distinct()
    return keys.selectExpr("rollout", *_split(_ROLLOUT))


_DUCK = _EVENT.replace("DIV", "//").replace("AS STRING", "AS VARCHAR")
_E = f"""
    WITH raw AS (SELECT {_DUCK} FROM events),
         e AS (SELECT *, row_number() OVER (PARTITION BY rollout ORDER BY ts, event_id) AS pos, event_id % 3 = rollout % 3 AS matches FROM raw),
         r AS (SELECT rollout, {_ROLLOUT} FROM (SELECT DISTINCT rollout FROM raw))"""
_LISTS = f"""{_E},
         l AS (SELECT rollout, list(tool ORDER BY pos) AS t, list(ok ORDER BY pos) AS ok, list(masked ORDER BY pos) AS masked, list(matches ORDER BY pos) AS fits FROM e GROUP BY 1),
         d AS (SELECT r.*, t, ok, masked, fits, range(1, len(t) + 1) AS idx, nullif(coalesce(list_position(t, 'inspect_schema_diff'), 0), 0) AS diff FROM r JOIN l USING (rollout)),
         w AS (SELECT *, CASE WHEN diff < len(t) THEN t[diff + 1] END AS post, list_filter(idx, lambda i: t[i] = 'execute_sql' AND ok[i]) AS ran,
                      list_filter(idx, lambda i: t[i] = 'ask_user') AS asks, list_filter(idx, lambda i: lower(replace(t[i], '-', '_')) = 'ask_user' AND t[i] <> 'ask_user') AS aliases,
                      CASE profile WHEN 'must_ask' THEN 'ask_user' WHEN 'knowledge_only' THEN 'get_knowledge_definition' WHEN 'schema_only' THEN 'execute_sql' END AS want FROM d)"""


@query("t11_failure_labels", f"""{_LISTS},
    m AS (SELECT *, CASE WHEN profile = 'must_ask' THEN list_filter([CASE WHEN len(asks) = 0 THEN 'required_ask_omitted' END, CASE WHEN len(aliases) > 0 THEN 'malformed_ask_tool' END,
                    CASE WHEN asks[1] < diff THEN 'ask_before_diff' END, CASE WHEN len(asks) > 1 THEN 'repeated_ask' END], lambda x: x IS NOT NULL)
                    WHEN len(asks) + len(aliases) > 0 THEN ['unnecessary_ask'] ELSE [] END AS sub FROM w WHERE NOT success),
    n AS (SELECT *, CASE WHEN profile = 'must_ask' AND len(sub) = 0 THEN ['asked_but_recovery_failed'] ELSE sub END AS subtypes FROM m),
    k AS (SELECT *, list_filter([CASE WHEN len(list_filter(ran, lambda i: NOT list_contains(t[i + 1:], 'submit_solution'))) > 0 THEN 'successful_execute_no_submit' END,
                    CASE WHEN post <> want THEN 'post_diff_wrong_retrieval' END, CASE WHEN len(subtypes) > 0 THEN 'must_ask_error' END, CASE WHEN scenario = 'compound' THEN 'compound_recovery' END,
                    CASE WHEN termination = 'submitted' THEN 'wrong_submit' END, CASE WHEN list_contains(t, 'Ask-User') THEN 'invalid_tool_alias' END, CASE WHEN termination = 'turn_limit' THEN 'turn_limit' END,
                    CASE WHEN list_contains(t, 'execute_sql') AND len(ran) = 0 THEN 'execution_failure' END, CASE WHEN unsafe THEN 'unsafe' END], lambda x: x IS NOT NULL) AS found FROM n)
    SELECT rollout, CASE WHEN len(found) = 0 THEN 'other' ELSE array_to_string(found, ',') END AS labels, array_to_string(subtypes, ',') AS must_ask,
           CASE WHEN len(found) = 0 THEN 'other' ELSE found[1] END AS primary_failure FROM k""")
def labels(spark: SparkSession, sf: str) -> DataFrame:
    """All failure labels, the primary one, and what went wrong with asking."""
    found = rollouts.failure_labels(runs(spark, sf), events(spark, sf))
    return found.select("rollout", F.array_join("labels", ",").alias("labels"), "primary_failure", F.array_join("must_ask", ",").alias("must_ask"))


@query("t12_failure_flags", f"""{_LISTS}
    SELECT rollout, NOT success AND len(ran) > 0 AND NOT list_contains(t, 'submit_solution') AS terminal_no_submit, NOT success AND scenario = 'compound' AS compound_recovery,
           NOT success AND profile = 'must_ask' AS must_ask_decision, NOT success AND coalesce(post <> want, false) AS post_diff_wrong_retrieval FROM w""")
def flags(spark: SparkSession, sf: str) -> DataFrame:
    return rollouts.failure_flags(runs(spark, sf), events(spark, sf))


# Each trigger by itself, the newest that owes something decides.
_OWED = f"""{_E},
    v AS (SELECT * FROM e WHERE NOT masked),
    bad AS (SELECT rollout, pos FROM v WHERE tool = 'execute_sql' AND (NOT ok OR contract = false)),
    un AS (SELECT * FROM bad b WHERE NOT EXISTS (SELECT 1 FROM v x JOIN v y ON x.rollout = y.rollout WHERE x.rollout = b.rollout AND x.tool = 'get_schema_version' AND y.tool = 'inspect_schema_diff' AND x.pos < y.pos AND y.pos < b.pos)),
    f AS (SELECT rollout, pos, (SELECT min(x.pos) FROM v x WHERE x.rollout = un.rollout AND x.tool = 'get_schema_version' AND x.pos > un.pos) AS version FROM un),
    o AS (SELECT rollout, pos, CASE WHEN version IS NULL THEN 'get_schema_version'
                 WHEN NOT EXISTS (SELECT 1 FROM v x WHERE x.rollout = f.rollout AND x.tool = 'inspect_schema_diff' AND x.pos > f.version) THEN 'inspect_schema_diff' END AS owed FROM f),
    owed AS (SELECT rollout, coalesce((SELECT arg_max(owed, pos) FROM o WHERE o.rollout = r.rollout AND owed IS NOT NULL), 'none') AS required FROM r)"""


@query("t04_mandatory_recovery", f"{_OWED} SELECT rollout, required FROM owed")
def recovery(spark: SparkSession, sf: str) -> DataFrame:
    return rollouts.required_recovery(events(spark, sf))


_ALLOWED = f"""{_OWED},
    s AS (SELECT rollout, arg_max(validated, pos) FILTER (tool = 'execute_sql' AND NOT masked) AS validated, max(pos) FILTER (tool = 'ask_user' AND NOT masked) AS asked,
                 max(pos) FILTER (tool IN ('get_knowledge_definition', 'execute_sql') AND NOT masked) AS followed,
                 list(DISTINCT tool) FILTER (NOT masked AND tool IN ('get_schema_version', 'inspect_schema_diff', 'ask_user')) AS used FROM e GROUP BY 1)
    SELECT rollout, CASE WHEN required <> 'none' THEN required WHEN coalesce(validated, false) THEN 'submit_solution'
        WHEN asked IS NOT NULL AND coalesce(followed, 0) < asked THEN 'execute_sql,get_knowledge_definition'
        ELSE array_to_string(list_filter(['ask_user', 'execute_sql', 'get_knowledge_definition', 'get_schema', 'get_schema_version', 'inspect_schema_diff', 'submit_solution'],
                             lambda x: NOT coalesce(list_contains(used, x), false)), ',') END AS allowed FROM s JOIN owed USING (rollout)"""


@query("t03_allowed_tools", _ALLOWED)
def allowed(spark: SparkSession, sf: str) -> DataFrame:
    """What a rollout may do next."""
    return rollouts.allowed_tools(events(spark, sf)).select("rollout", F.array_join("allowed", ",").alias("allowed"))


@query("t03_streamed_tools", _ALLOWED)
def streamed(spark: SparkSession, sf: str) -> DataFrame:
    """The same by a stream in three runs, from the last row of each rollout."""
    rows = live.events_with_times(spark, sf).selectExpr("event_id", "ts", "at", *(c for c in _split(_EVENT.replace("DIV", "div")) if c.split()[-1] in ("rollout", "tool", "ok", "masked", "validated", "contract")))
    found = live.in_cuts(rows, "at", 3, lambda stream: live.folded(stream, "rollout", live.Tools(), ["at", "event_id"]))
    return found.groupBy("rollout").agg(F.max_by("allowed", "at").alias("allowed"))


@query("t03_execution_only", f"""{_E},
    s AS (SELECT rollout, arg_max(validated, pos) FILTER (tool = 'execute_sql' AND NOT masked) AS validated, count(*) FILTER (tool = 'get_schema' AND ok AND NOT masked) AS schemas,
                 list(DISTINCT tool) FILTER (NOT masked AND tool IN ('get_schema_version', 'inspect_schema_diff', 'ask_user')) AS used FROM e GROUP BY 1)
    SELECT rollout, CASE WHEN schemas = 0 THEN 'get_schema' WHEN coalesce(validated, false) THEN 'submit_solution'
        ELSE array_to_string(list_filter(['ask_user', 'execute_sql', 'get_knowledge_definition', 'get_schema', 'get_schema_version', 'inspect_schema_diff'], lambda x: NOT coalesce(list_contains(used, x), false)), ',') END AS allowed FROM s""")
def execution_only(spark: SparkSession, sf: str) -> DataFrame:
    return rollouts.allowed_tools(events(spark, sf), execution_only=True).select("rollout", F.array_join("allowed", ",").alias("allowed"))


@query("t07_after_ask", f"""{_E}
    SELECT rollout, CASE WHEN count(*) FILTER (tool = 'get_knowledge_definition') > 0 THEN 'get_knowledge_definition' WHEN count(*) FILTER (tool = 'execute_sql') > 0 THEN 'execute_sql' ELSE '' END AS allowed FROM e GROUP BY 1""")
def follow_up(spark: SparkSession, sf: str) -> DataFrame:
    """The tools that a rollout knows, restricted to what may follow a clarification."""
    known = events(spark, sf).groupBy("rollout").agg(F.collect_set("tool").alias("tools"))
    return known.select("rollout", F.array_join(rollouts.after_ask(F.col("tools"), True), ",").alias("allowed"))


@query("t09_applied_repair", f"""{_E},
    c AS (SELECT rollout, arg_max(candidate, pos) AS candidate FROM e WHERE tool = 'inspect_schema_diff' AND NOT masked AND candidate <> '' GROUP BY 1),
    p AS (SELECT rollout, 'SELECT ' || rollout % 5 AS proposed, 'select ' || rollout % 10 || ' ;' AS stale FROM r)
    SELECT rollout, CASE WHEN lower(proposed) = lower(rtrim(rtrim(stale, ';'))) AND lower(candidate) <> lower(proposed) THEN candidate ELSE '' END AS repair FROM p LEFT JOIN c USING (rollout)""")
def repair(spark: SparkSession, sf: str) -> DataFrame:
    """The audited candidate where an agent proposes the stale query again."""
    proposals = runs(spark, sf).selectExpr("rollout", "concat('SELECT ', CAST(rollout % 5 AS STRING)) AS proposed", "concat('select ', CAST(rollout % 10 AS STRING), ' ;') AS stale")
    return rollouts.applied_repair(proposals, events(spark, sf)).select("rollout", "repair")


_NAMES = """CASE profile WHEN 'direct_clean' THEN ['execute_sql', 'submit_solution'] WHEN 'schema_only' THEN ['get_schema_version', 'inspect_schema_diff', 'execute_sql', 'submit_solution']
    WHEN 'knowledge_only' THEN ['get_schema_version', 'inspect_schema_diff', 'get_knowledge_definition', 'execute_sql', 'submit_solution']
    ELSE ['get_schema_version', 'inspect_schema_diff', 'ask_user', 'execute_sql', 'submit_solution'] END"""
_DIVERGED = f"""{_LISTS},
    c AS (SELECT *, {_NAMES} AS names FROM w),
    x AS (SELECT *, list_filter(range(1, least(len(t), len(names)) + 1), lambda i: t[i] <> names[i])[1] AS wrong FROM c),
    div AS (SELECT *, CASE WHEN wrong IS NOT NULL THEN 'action_name' WHEN len(t) < len(names) THEN 'premature_termination' WHEN len(t) > len(names) THEN 'extra_action_after_canonical_sequence'
                           WHEN NOT success THEN 'outcome_mismatch' ELSE 'none' END AS kind,
                      CASE WHEN wrong IS NOT NULL THEN wrong - 1 WHEN len(t) < len(names) THEN len(t) WHEN len(t) > len(names) OR NOT success THEN len(names) - 1 END AS error_at FROM x)"""


@query("t14_first_divergence", f"{_DIVERGED} SELECT rollout, CAST(error_at AS INTEGER) AS error_at, kind FROM div")
def divergence(spark: SparkSession, sf: str) -> DataFrame:
    """Where rollouts leave the canonical actions, and how: five kinds."""
    return rollouts.first_divergence(runs(spark, sf), events(spark, sf))


# The next step from a list of events (t, ok, masked, fits of the first n).
_STEP = """
    z AS (SELECT *, list_filter(idx, lambda i: NOT masked[i]) AS v FROM {source}),
    y AS (SELECT *, list_filter(v, lambda i: t[i] = 'inspect_schema_diff')[1] AS seen FROM z),
    q AS (SELECT *, list_filter(v, lambda i: t[i] = 'ask_user' AND i > seen)[1] AS asked_at FROM y),
    step AS (SELECT *, CASE
        WHEN len(list_filter(v, lambda i: t[i] = 'execute_sql' AND ok[i] AND fits[i] AND (NOT list_contains(names, 'inspect_schema_diff') OR i > seen))) > 0 THEN 'submit_solution'
        WHEN NOT list_contains(names, 'inspect_schema_diff') THEN 'execute_sql'
        WHEN seen IS NULL AND len(list_filter(v, lambda i: t[i] = 'get_schema_version')) = 0 THEN 'get_schema_version'
        WHEN seen IS NULL THEN 'inspect_schema_diff'
        WHEN list_contains(names, 'ask_user') AND asked_at IS NULL THEN 'ask_user'
        WHEN list_contains(names, 'get_knowledge_definition') AND len(list_filter(v, lambda i: t[i] = 'get_knowledge_definition' AND i > coalesce(asked_at, seen))) = 0 THEN 'get_knowledge_definition'
        ELSE 'execute_sql' END AS target_action FROM q)"""


@query("t15_recovery_target", f"""{_LISTS}, c AS (SELECT *, {_NAMES} AS names FROM w), {_STEP.format(source='c')}
    SELECT rollout, CAST(list_position(names, target_action) - 1 AS INTEGER) AS target, target_action FROM step""")
def target(spark: SparkSession, sf: str) -> DataFrame:
    """The next canonical step from the state that a rollout reached."""
    return rollouts.recovery_target(runs(spark, sf), events(spark, sf))


_TERMINAL = f"""term AS (SELECT rollout, names, list_filter(ran, lambda i: fits[i] AND i > diff AND NOT list_contains(t[i + 1:], 'submit_solution')) AS ends FROM c)"""


@query("t16_terminal_recovery", f"""{_LISTS}, c AS (SELECT *, {_NAMES} AS names FROM w), {_TERMINAL}
    SELECT rollout, CAST(ends[-1] - 1 AS INTEGER) AS execute_at, CAST(len(names) - 1 AS INTEGER) AS target FROM term WHERE len(ends) > 0""")
def terminal(spark: SparkSession, sf: str) -> DataFrame:
    return rollouts.terminal_recovery(runs(spark, sf), events(spark, sf))


@query("t17_recovery_examples", f"""{_DIVERGED}, {_TERMINAL},
    cut AS (SELECT rollout, names, error_at, t[1:error_at + 1] AS t, ok[1:error_at + 1] AS ok, masked[1:error_at + 1] AS masked, fits[1:error_at + 1] AS fits, idx[1:error_at + 1] AS idx FROM div WHERE error_at IS NOT NULL), {_STEP.format(source='cut')}
    SELECT rollout, 'pre_error' AS context, CAST(error_at AS INTEGER) AS prefix, CAST(error_at AS INTEGER) AS target, names[error_at + 1] AS target_action FROM div WHERE error_at IS NOT NULL
    UNION ALL SELECT rollout, 'post_error', CAST(error_at + 1 AS INTEGER), CAST(list_position(names, target_action) - 1 AS INTEGER), target_action FROM step
    UNION ALL SELECT rollout, 'terminal', CAST(ends[-1] AS INTEGER), CAST(len(names) - 1 AS INTEGER), 'submit_solution' FROM term WHERE len(ends) > 0""")
def examples(spark: SparkSession, sf: str) -> DataFrame:
    """Training examples of recovery: before the error, after it, and at the end."""
    return rollouts.recovery_examples(runs(spark, sf), events(spark, sf))


_DECIDED = f"""{_E},
    s AS (SELECT rollout, (SELECT min(pos) FROM e x WHERE x.rollout = r.rollout AND tool = 'inspect_schema_diff' AND NOT error) AS diff FROM r),
    c AS (SELECT e.rollout, e.pos, NOT read_only AS bad, read_only AND ok AND matches AS fit FROM e JOIN s ON e.rollout = s.rollout AND e.pos > s.diff WHERE tool = 'execute_sql'),
    first AS (SELECT rollout, arg_min(bad, pos) AS bad, min(pos) AS pos FROM c WHERE bad OR fit GROUP BY 1),
    decided AS (SELECT s.rollout, coalesce(NOT bad, false) AS accepted,
        CASE WHEN diff IS NULL THEN 'schema_diff_not_inspected' WHEN bad THEN 'unsafe_post_diff_candidate' WHEN bad = false THEN 'contract_validated' ELSE 'result_contract_mismatch' END AS reason,
        CASE WHEN NOT bad THEN CAST(first.pos - 1 AS INTEGER) END AS event_at FROM s LEFT JOIN first USING (rollout))"""


@query("x10_recorded_decisions", f"{_DECIDED} SELECT rollout, accepted, reason, event_at FROM decided")
def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a recorded execution meets its result contract, and why not."""
    return rollouts.contract_decisions(events(spark, sf), runs(spark, sf))


@query("x11_controlled_rollouts", f"""{_DECIDED}
    SELECT rollout, reason, CASE WHEN accepted THEN 'contract_validated_auto_submit' ELSE termination END AS termination, accepted OR success AS success FROM r JOIN decided USING (rollout)""")
def controlled(spark: SparkSession, sf: str) -> DataFrame:
    """Rollouts as they end under the controller."""
    return rollouts.with_decisions(runs(spark, sf), decisions(spark, sf)).select("rollout", "reason", "termination", "success")


@query("x08_contract_matches", f"""{_E}, want AS (SELECT rollout % 3 AS k, 'SELECT ' || rollout % 3 AS sql FROM r GROUP BY ALL)
    SELECT event_id, regexp_replace(e.sql, ';', '') = want.sql AS result_contract_match FROM e JOIN want ON want.k = e.rollout % 3 WHERE tool = 'execute_sql' AND ok""")
def contract_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the fingerprint of each executed query's text is the expected one; the hashes themselves stay hidden."""
    hashed = lambda c: F.sha2(rollouts.normal_sql(F.col(c)), 256)
    rows = events(spark, sf).where("tool = 'execute_sql' AND ok").select("event_id", "rollout", hashed("sql").alias("value_hash"))
    wanted = runs(spark, sf).selectExpr("rollout", "concat('SELECT ', CAST(rollout % 3 AS STRING)) AS expected").select("rollout", hashed("expected").alias("expected_hash"))
    return rows.join(wanted, "rollout").select("event_id", (F.col("value_hash") == F.col("expected_hash")).alias("result_contract_match"))


@query("z08_scoring_rows", f"""{_E}
    SELECT rollout, count(*) AS tool_calls, count(*) FILTER (tool = 'execute_sql') AS executions, count(*) FILTER (tool = 'execute_sql' AND NOT read_only) AS unsafe_executions,
           arg_max(sql, pos) FILTER (tool = 'execute_sql' AND ok AND read_only) AS last_sql, count(DISTINCT rtrim(sql, ';')) FILTER (tool = 'execute_sql') AS queries,
           count(*) FILTER (tool = 'execute_sql') - count(DISTINCT rtrim(sql, ';')) FILTER (tool = 'execute_sql') AS duplicate_executions FROM e GROUP BY 1""")
def scored(spark: SparkSession, sf: str) -> DataFrame:
    return rollouts.scoring(events(spark, sf))


@query("z17_oracle_steps", f"{_E} SELECT rollout, min(pos) AS first_at, max(pos) AS last_at FROM e WHERE tool = 'execute_sql' AND ok AND matches GROUP BY 1")
def steps(spark: SparkSession, sf: str) -> DataFrame:
    return rollouts.oracle_steps(events(spark, sf), F.expr("tool = 'execute_sql' AND ok AND matches"))


_METRICS = """
    o_orderkey, o_orderkey % 2 = 0 AS task_success, o_orderkey % 3 = 0 AS clarification_required, o_orderkey % 5 < 3 AS clarification_attempted, o_orderkey % 5 < 2 AS clarification_matched,
    o_orderkey % 7 > 0 AS format_valid, o_orderkey % 11 < 6 AS execution_success, o_orderkey % 11 < 9 AS event_success, o_orderkey % 4 = 0 AS efficient, o_orderkey % 13 < 8 AS post_valid,
    o_orderkey % 17 < 9 AS terminal_validated, o_orderkey % 19 < 12 AS inspected, o_orderkey % 6 = 1 AS add_column, o_orderkey % 9 AS tool_calls, o_orderkey % 2000 * 10 AS tokens,
    o_orderkey % 3 AS duplicates, o_orderkey % 4 AS repeats, o_orderkey % 2 AS invalid, o_orderkey % 23 = 0 AS timed_out, o_orderkey % 29 = 0 AS turn_limit, o_orderkey % 31 = 0 AS missing_submit, o_orderkey % 37 = 0 AS unsafe"""


@query("a20_first_version_reward", f"""
    WITH m AS (SELECT {_METRICS} FROM orders), terms AS (SELECT o_orderkey, unnest([
        CAST(task_success AS INT) * 1.0, CASE WHEN clarification_matched AND format_valid THEN 0.1 END, CASE WHEN execution_success THEN 0.1 WHEN event_success THEN 0.05 END, CASE WHEN efficient THEN 0.1 END,
        CASE WHEN clarification_required AND clarification_matched THEN 0.25 END, CASE WHEN clarification_required AND clarification_attempted THEN 0.2 END, CASE WHEN clarification_required AND post_valid THEN 0.1 END,
        CASE WHEN terminal_validated THEN 0.2 END, CASE WHEN add_column AND inspected AND terminal_validated THEN 0.2 END,
        -0.01 * tool_calls, -least(0.1, 0.00001 * tokens), -0.08 * duplicates, -0.08 * repeats, -0.1 * invalid, CASE WHEN timed_out THEN -0.25 END, CASE WHEN turn_limit THEN -0.5 END, CASE WHEN missing_submit THEN -0.5 END,
        CASE WHEN unsafe THEN -1.0 END, CASE WHEN clarification_required AND NOT clarification_attempted THEN -0.25 END, CASE WHEN clarification_required AND clarification_attempted AND NOT clarification_matched THEN -0.15 END,
        CASE WHEN clarification_required AND clarification_matched AND NOT post_valid THEN -0.15 END, CASE WHEN add_column AND NOT (inspected AND terminal_validated) THEN -0.15 END]) AS term FROM m)
    SELECT o_orderkey, round(CAST(sum(term) AS DOUBLE), 4) AS score FROM terms GROUP BY 1""")
def first_version(spark: SparkSession, sf: str) -> DataFrame:
    """The first reward version from shared metrics, here made of order numbers."""
    return rollouts.first_version_reward(table(spark, sf, "orders").selectExpr(*_split(_METRICS))).select("o_orderkey", "score")


@query("a21_small_reward", f"""
    WITH m AS (SELECT {_METRICS} FROM orders)
    SELECT o_orderkey, round(CAST(task_success AS INT) + 0.2 * CAST(inspected AS INT) + 0.1 * CAST(terminal_validated AS INT) - 0.1 * greatest(tool_calls - 3, 0) - CAST(unsafe AS INT), 6)::DOUBLE AS reward FROM m""")
def small(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "orders").selectExpr(*_split(_METRICS))
    reward = rollouts.small_reward(F.col("task_success"), F.col("inspected"), F.col("terminal_validated"), (F.col("tool_calls") - 3).cast("double"), F.col("unsafe"))
    return m.select("o_orderkey", F.round(reward, 6).alias("reward"))


@query("a24_latest_result", f"{_E} SELECT rollout, arg_max(sql, pos) AS sql FROM e WHERE tool = 'execute_sql' AND ok GROUP BY 1")
def latest(spark: SparkSession, sf: str) -> DataFrame:
    """The last query of each rollout that ran."""
    from tessella.operators.results import last_success

    return last_success(events(spark, sf), "rollout", ["at"], "tool = 'execute_sql' AND ok", "sql")


_TOKENS = """t AS (SELECT doc_id, i, w, sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(w) - 1 AS s FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(0, len(string_split(text, ' ')))) AS i FROM documents)),
         c AS (SELECT doc_id, k, ['ask_user', 'submit_solution', 'inspect_schema_diff', 'execute_sql', 'get_schema'][1 + (doc_id + k * k) % 5] AS name, (doc_id + k) % 3 = 0 AS masked, length(text) * k // 5 AS a, length(text) * (k + 1) // 5 AS b FROM documents, range(5) r(k))"""


@query("t10_key_action_mask", f"""
    WITH {_TOKENS},
         g AS (SELECT c.*, EXISTS (SELECT 1 FROM c d WHERE d.doc_id = c.doc_id AND d.k < c.k AND d.name = 'inspect_schema_diff' AND NOT d.masked) AS later FROM c),
         n AS (SELECT t.doc_id, t.i, g.k, row_number() OVER (PARTITION BY t.doc_id, g.k ORDER BY t.i DESC) AS back FROM t JOIN g ON g.doc_id = t.doc_id AND t.s < g.b AND t.s + length(t.w) > g.a AND g.a < g.b
               WHERE name IN ('ask_user', 'submit_solution') OR (NOT masked AND (later OR name = 'execute_sql'))),
         kept AS (SELECT DISTINCT doc_id, i FROM n WHERE back <= 12 AND i % 7 <> 3),
         rest AS (SELECT doc_id, i FROM t WHERE i % 7 <> 3 AND doc_id NOT IN (SELECT doc_id FROM kept) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) <= 12)
    SELECT doc_id, i AS place FROM kept UNION ALL SELECT doc_id, i FROM rest""")
def key_action_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens that train: the last twelve of each key action, where documents stand for rollouts of five calls."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    # Dealt ahead of the words: a text is moved once, and not its words with their places for each use.
    words = docs.repartition("doc_id").select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "w"))
    before = F.sum(F.length("w") + 1).over(Window.partitionBy("doc_id").orderBy("i")) - F.length("w") - 1
    tokens = words.select("doc_id", before.alias("start_char"), (before + F.length("w")).alias("end_char"), (F.col("i") % 7 != 3).alias("active"))
    names = F.array(*(F.lit(x) for x in ("ask_user", "submit_solution", "inspect_schema_diff", "execute_sql", "get_schema")))
    each = docs.select("doc_id", F.length("text").cast("long").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    calls = each.select("doc_id", "k", F.get(names, ((F.col("doc_id") + F.col("k") * F.col("k")) % 5).cast("int")).alias("name"), ((F.col("doc_id") + F.col("k")) % 3 == 0).alias("masked"),
                        F.expr("n * k div 5").alias("start_char"), F.expr("n * (k + 1) div 5").alias("end_char"))
    return token_masks.key_action_mask(tokens, calls, "doc_id", "k", 12).where("trains").select("doc_id", "place")
