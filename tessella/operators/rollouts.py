"""Rollouts of an agent with tools: what they owe, where they failed, what would mend them.

An event row has ``rollout``, ``at`` (1, 2, ... in each rollout), ``tool``, ``ok`` (succeeded), ``masked``, ``validated``
(safe to submit), ``contract`` (null: not compared), ``sql``, ``read_only`` and ``matches`` (has the expected
fingerprint). A rollout row has ``rollout``, ``profile``, ``scenario``, ``termination``, ``success`` and ``unsafe``.
Everything is minima and maxima of places, with map-side combining, and windows over one rollout; no list of
events is built. Null flags count as false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The tools, the one right after the diff for each profile, labels by priority.
TOOLS = ("get_schema_version", "inspect_schema_diff", "get_schema", "get_knowledge_definition", "ask_user", "execute_sql", "submit_solution")
ONE_SHOT = ("get_schema_version", "inspect_schema_diff", "ask_user")
AFTER_DIFF = {"must_ask": "ask_user", "knowledge_only": "get_knowledge_definition", "schema_only": "execute_sql"}
AFTER_ASK = ("get_knowledge_definition", "execute_sql")
PRIORITY = (
    "successful_execute_no_submit", "post_diff_wrong_retrieval", "must_ask_error", "compound_recovery",
    "wrong_submit", "invalid_tool_alias", "turn_limit", "execution_failure",
)
#: The actions that solve a task, in order, by profile.
CANONICAL = {
    "direct_clean": ("execute_sql", "submit_solution"),
    "schema_only": ("get_schema_version", "inspect_schema_diff", "execute_sql", "submit_solution"),
    "knowledge_only": ("get_schema_version", "inspect_schema_diff", "get_knowledge_definition", "execute_sql", "submit_solution"),
    "must_ask": ("get_schema_version", "inspect_schema_diff", "ask_user", "execute_sql", "submit_solution"),
}


def _is(tool: str) -> Column:
    return F.col("tool") == tool


def _first(condition: Column) -> Column:
    return F.min(F.when(condition, F.col("at")))


def _last(condition: Column) -> Column:
    return F.max(F.when(condition, F.col("at")))


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def by_case(key: Column, cases: dict[str, Column], other: Column | None = None) -> Column:
    out = None
    for name, value in cases.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out.otherwise(other) if other is not None else out


def _facts(events: DataFrame) -> DataFrame:
    of = Window.partitionBy("rollout").orderBy("at")
    rows = events.withColumn("next_tool", F.lead("tool").over(of))
    ran = _is("execute_sql") & _flag("ok")
    return rows.groupBy("rollout").agg(
        _first(_is("inspect_schema_diff")).alias("diff"),
        F.min_by("next_tool", F.when(_is("inspect_schema_diff"), F.col("at"))).alias("post_diff"),
        _last(ran).alias("ran"),
        F.bool_or(_is("execute_sql")).alias("executed"),
        _last(_is("submit_solution")).alias("submitted"),
        _first(_is("ask_user")).alias("asked"),
        F.count_if(_is("ask_user")).alias("asks"),
        F.bool_or((F.col("tool") != "ask_user") & (F.replace(F.lower("tool"), F.lit("-"), F.lit("_")) == "ask_user")).alias("alias"),
        F.bool_or((F.col("tool") != "") & ~F.col("tool").isin(*TOOLS)).alias("invalid"),
    )


def failure_labels(rollouts: DataFrame, events: DataFrame) -> DataFrame:
    """rollout, labels (all that apply, in order), primary_failure and must_ask (subtypes) of every failed rollout.

    A rollout without events has the labels of its own row alone; null profiles match none.
    """
    rows = rollouts.where(~_flag("success")).join(_facts(events), "rollout", "left")
    must, asked = F.coalesce(F.col("profile") == "must_ask", F.lit(False)), F.col("asked").isNotNull()
    alias, asks = _flag("alias"), F.coalesce("asks", F.lit(0))
    subtypes = F.array_compact(
        F.array(
            F.when(must & ~asked, "required_ask_omitted"),
            F.when(must & alias, "malformed_ask_tool"),
            F.when(must & (F.col("asked") < F.col("diff")), "ask_before_diff"),
            F.when(must & (asks > 1), "repeated_ask"),
            F.when(~must & (asked | alias), "unnecessary_ask"),
        )
    )
    rows = rows.withColumn("must_ask", F.when(must & asked & (F.size(subtypes) == 0), F.array(F.lit("asked_but_recovery_failed"))).otherwise(subtypes))
    applies = {
        "successful_execute_no_submit": F.col("ran") > F.coalesce("submitted", F.lit(0)),
        "post_diff_wrong_retrieval": F.col("post_diff") != by_case(F.col("profile"), {k: F.lit(v) for k, v in AFTER_DIFF.items()}),
        "must_ask_error": F.size("must_ask") > 0,
        "compound_recovery": F.col("scenario") == "compound",
        "wrong_submit": F.col("termination") == "submitted",
        "invalid_tool_alias": _flag("invalid"),
        "turn_limit": F.col("termination") == "turn_limit",
        "execution_failure": _flag("executed") & F.col("ran").isNull(),
        "unsafe": _flag("unsafe"),
    }
    labels = F.array_compact(F.array(*(F.when(condition, name) for name, condition in applies.items())))
    labels = F.when(F.size(labels) == 0, F.array(F.lit("other"))).otherwise(labels)
    ranked = F.filter(F.array(*(F.lit(p) for p in PRIORITY)), lambda p: F.array_contains("labels", p))
    return rows.withColumn("labels", labels).select("rollout", "labels", F.coalesce(F.get(ranked, 0), F.get("labels", 0)).alias("primary_failure"), "must_ask")


def failure_flags(rollouts: DataFrame, events: DataFrame) -> DataFrame:
    """rollout and four flags by which failed rollouts are targeted; all false for successful ones."""
    rows = rollouts.join(_facts(events), "rollout", "left").withColumn("failed", ~_flag("success"))
    of = lambda c: F.col("failed") & F.coalesce(c, F.lit(False))
    return rows.select(
        "rollout",
        of(F.col("ran").isNotNull() & F.col("submitted").isNull()).alias("terminal_no_submit"),
        of(F.col("scenario") == "compound").alias("compound_recovery"),
        of(F.col("profile") == "must_ask").alias("must_ask_decision"),
        of(F.col("post_diff") != by_case(F.col("profile"), {k: F.lit(v) for k, v in AFTER_DIFF.items()})).alias("post_diff_wrong_retrieval"),
    )


def required_recovery(events: DataFrame) -> DataFrame:
    """rollout, required: what is owed after a failed or mismatched execution, ``none`` if nothing is.

    An execution ahead of the first diff that follows a version call isn't recovered. The newest such one asks
    for a version call after it, then for a diff after that; older ones can't ask for more.
    """
    w = Window.partitionBy("rollout")
    rows = events.where(~_flag("masked"))
    bad = _is("execute_sql") & (~F.coalesce("ok", F.lit(True)) | ~F.coalesce("contract", F.lit(True)))
    rows = rows.withColumn("version", _first(_is("get_schema_version")).over(w))
    rows = rows.withColumn("recovered", _first(_is("inspect_schema_diff") & (F.col("at") > F.col("version"))).over(w))
    rows = rows.withColumn("trigger", _last(bad & (F.col("recovered").isNull() | (F.col("at") < F.col("recovered")))).over(w))
    rows = rows.withColumn("after", _first(_is("get_schema_version") & (F.col("at") > F.col("trigger"))).over(w))
    facts = rows.groupBy("rollout").agg(F.max("trigger").alias("trigger"), F.max("after").alias("after"), _last(_is("inspect_schema_diff")).alias("diff"))
    owed = F.when(F.col("trigger").isNull(), "none").when(F.col("after").isNull(), "get_schema_version")
    owed = owed.when(F.coalesce(F.col("diff") > F.col("after"), F.lit(False)), "none").otherwise("inspect_schema_diff")
    return events.select("rollout").distinct().join(facts.select("rollout", owed.alias("required")), "rollout", "left").na.fill("none", ["required"])


def allowed_tools(events: DataFrame, knowledge_first: bool = False, execution_only: bool = False) -> DataFrame:
    """rollout, allowed: the tools that the state lets an agent use next, sorted.

    In order: one-shot tools that were called are gone; an owed recovery stands alone; a validated newest execution leaves
    only the submission; an ask without a follow-up leaves what may follow it. ``execution_only``: the schema first,
    and no submission until the newest execution is validated.
    """
    plain = ~_flag("masked")
    used = {t: F.bool_or(plain & _is(t)) for t in ONE_SHOT}
    newest = F.max_by(_flag("validated"), F.when(plain & _is("execute_sql"), F.col("at")))
    state = events.groupBy("rollout").agg(
        *(c.alias(t) for t, c in used.items()),
        F.coalesce(F.when(F.bool_or(plain & _is("execute_sql")), newest), F.lit(False)).alias("validated"),
        _last(plain & _is("ask_user")).alias("asked"),
        _last(plain & F.col("tool").isin(*AFTER_ASK)).alias("followed"),
        F.bool_or(plain & _is("get_schema") & _flag("ok")).alias("schema"),
    )
    left = F.array_compact(F.array(*(F.when(~F.col(t), t) if t in ONE_SHOT else F.lit(t) for t in TOOLS)))
    only = lambda *names: F.array(*(F.lit(n) for n in names))
    if execution_only:
        hidden = F.array_except(left, only("submit_solution"))
        allowed = F.when(~F.col("schema"), only("get_schema")).when(F.col("validated"), only("submit_solution")).otherwise(hidden)
        return state.select("rollout", F.array_sort(allowed).alias("allowed"))
    after_ask = only("get_knowledge_definition") if knowledge_first else only(*AFTER_ASK)
    open_ask = F.col("asked").isNotNull() & (F.coalesce("followed", F.lit(0)) < F.col("asked"))
    allowed = F.when(F.col("required") != "none", F.array("required")).when(F.col("validated"), only("submit_solution")).when(open_ask, after_ask).otherwise(left)
    return state.join(required_recovery(events), "rollout").select("rollout", F.array_sort(allowed).alias("allowed"))


def after_ask(available: Column, knowledge_first: bool) -> Column:
    """Of the available tools those that may follow a clarification; the definition alone comes first if asked for."""
    allowed = F.array_intersect(available, F.array(*(F.lit(t) for t in AFTER_ASK)))
    if not knowledge_first:
        return allowed
    first = F.array(F.lit("get_knowledge_definition"))
    return F.when(F.array_contains(allowed, "get_knowledge_definition"), first).otherwise(F.array_intersect(allowed, F.array(F.lit("execute_sql"))))


def normal_sql(sql: Column) -> Column:
    """SQL text for comparing: no closing semicolons, no space around, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(sql, r";+$", ""), r"^\s+|\s+$", ""))


def applied_repair(proposals: DataFrame, events: DataFrame) -> DataFrame:
    """``repair`` for each proposal (rollout, proposed, stale): the newest changed candidate of an audited diff, where the
    proposal merely repeats the stale query and the candidate differs from it; else empty. ``candidate``: events' column."""
    found = events.where(_is("inspect_schema_diff") & ~_flag("masked") & (F.trim("candidate") != ""))
    newest = found.groupBy("rollout").agg(F.max_by(F.trim("candidate"), "at").alias("candidate"))
    same = (normal_sql(F.col("proposed")) != "") & (normal_sql(F.col("proposed")) == normal_sql(F.col("stale")))
    rows = proposals.join(newest, "rollout", "left")
    repair = F.when(same & (normal_sql(F.col("candidate")) != normal_sql(F.col("proposed"))), F.col("candidate")).otherwise("")
    return rows.withColumn("repair", repair).drop("candidate")


def canonical(profile: Column) -> Column:
    return by_case(profile, {k: F.array(*(F.lit(t) for t in v)) for k, v in CANONICAL.items()})


def first_divergence(rollouts: DataFrame, events: DataFrame) -> DataFrame:
    """rollout, error_at (from 0; null: none), kind: where a rollout first leaves its profile's canonical actions, names only."""
    rows = events.join(rollouts.select("rollout", canonical(F.col("profile")).alias("expected")), "rollout")
    differs = (F.col("at") <= F.size("expected")) & (F.col("tool") != F.get("expected", F.col("at") - 1))
    met = rows.groupBy("rollout").agg(_first(differs).alias("differs"), F.max("at").alias("n"))
    rows = rollouts.withColumn("m", F.size(canonical(F.col("profile")))).join(met, "rollout", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    kind = F.when(F.col("differs").isNotNull(), "action_name").when(F.col("n") < F.col("m"), "premature_termination").when(F.col("n") > F.col("m"), "extra_action_after_canonical_sequence")
    kind = kind.when(~_flag("success"), "outcome_mismatch").otherwise("none")
    at = F.when(F.col("differs").isNotNull(), F.col("differs") - 1).when(F.col("n") < F.col("m"), F.col("n")).when((F.col("n") > F.col("m")) | ~_flag("success"), F.col("m") - 1)
    return rows.select("rollout", at.cast("int").alias("error_at"), kind.alias("kind"))


def recovery_target(rollouts: DataFrame, events: DataFrame) -> DataFrame:
    """rollout, target (index in the canonical actions, from 0), target_action: the next step from the state that was reached.

    ``matches``: a run query equals the canonical repair. A repair that ran after the diff is submitted; then, in this order,
    version, diff, ask, definition and execution are due, as far as the profile has them.
    """
    w = Window.partitionBy("rollout")
    rows = events.where(~_flag("masked") & (F.col("tool") != ""))
    rows = rows.withColumn("diff", _first(_is("inspect_schema_diff")).over(w))
    rows = rows.withColumn("asked", _first(_is("ask_user") & (F.col("at") > F.col("diff"))).over(w))
    ran = _is("execute_sql") & _flag("ok") & _flag("matches")
    facts = rows.groupBy("rollout").agg(
        F.max("diff").alias("diff"),
        F.max("asked").alias("asked"),
        F.bool_or(_is("get_schema_version")).alias("version"),
        _last(ran).alias("ran"),
        _last(_is("get_knowledge_definition")).alias("defined"),
    )
    rows = rollouts.select("rollout", canonical(F.col("profile")).alias("names")).where("names is not null").join(facts, "rollout", "left")
    has = lambda tool: F.array_contains("names", tool)
    audited = ~has("inspect_schema_diff") | (F.col("ran") > F.col("diff"))
    since = F.coalesce(F.when(has("ask_user"), F.col("asked")), F.col("asked"), F.col("diff"))
    action = (
        F.when(F.col("ran").isNotNull() & F.coalesce(audited, F.lit(False)), "submit_solution")
        .when(~has("inspect_schema_diff"), "execute_sql")
        .when(F.col("diff").isNull() & has("get_schema_version") & ~_flag("version"), "get_schema_version")
        .when(F.col("diff").isNull(), "inspect_schema_diff")
        .when(has("ask_user") & F.col("asked").isNull(), "ask_user")
        .when(has("get_knowledge_definition") & ~F.coalesce(F.col("defined") > since, F.lit(False)), "get_knowledge_definition")
        .otherwise("execute_sql")
    )
    return rows.withColumn("target_action", action).select("rollout", (F.array_position("names", F.col("target_action")) - 1).cast("int").alias("target"), "target_action")


def terminal_recovery(rollouts: DataFrame, events: DataFrame) -> DataFrame:
    """rollout, execute_at (from 0), target: the last verified repair after the first diff that nothing was submitted after."""
    w = Window.partitionBy("rollout")
    rows = events.withColumns({"diff": _first(_is("inspect_schema_diff")).over(w), "submitted": _last(_is("submit_solution")).over(w)})
    fits = _is("execute_sql") & _flag("ok") & _flag("matches") & (F.col("at") > F.col("diff")) & (F.col("at") > F.coalesce("submitted", F.lit(0)))
    found = rows.where(fits).groupBy("rollout").agg((F.max("at") - 1).cast("int").alias("execute_at"))
    names = canonical(F.col("profile"))
    return rollouts.join(found, "rollout").select("rollout", "execute_at", (F.array_position(names, F.lit("submit_solution")) - 1).cast("int").alias("target"))


def recovery_examples(rollouts: DataFrame, events: DataFrame) -> DataFrame:
    """rollout, context, prefix (events shown), target, target_action: examples to learn recovery from.

    ``pre_error`` shows what came before the first divergence and asks for the canonical action there, ``post_error`` shows
    the error too and asks for the state's next action, ``terminal`` asks for the submission of a verified repair. Successful
    rollouts without a divergence give none.
    """
    off = first_divergence(rollouts, events).where("error_at is not null")
    names = rollouts.select("rollout", canonical(F.col("profile")).alias("names"))
    pre = off.join(names, "rollout").select("rollout", F.lit("pre_error").alias("context"), F.col("error_at").alias("prefix"), F.col("error_at").alias("target"), F.get("names", F.col("error_at")).alias("target_action"))
    shown = events.join(off.select("rollout", "error_at"), "rollout").where(F.col("at") <= F.col("error_at") + 1).drop("error_at")
    post = recovery_target(rollouts.join(off.select("rollout"), "rollout", "left_semi"), shown).join(off.select("rollout", "error_at"), "rollout")
    post = post.select("rollout", F.lit("post_error").alias("context"), (F.col("error_at") + 1).alias("prefix"), "target", "target_action")
    end = terminal_recovery(rollouts, events).select("rollout", F.lit("terminal").alias("context"), (F.col("execute_at") + 1).alias("prefix"), "target", F.lit("submit_solution").alias("target_action"))
    return pre.unionByName(post).unionByName(end)


def contract_decisions(events: DataFrame, rollouts: DataFrame) -> DataFrame:
    """rollout, accepted, reason, event_at (from 0): whether a recorded execution after the first diff meets the result contract.

    A query that isn't read-only ahead of the first match closes the case, even if a later one matches.
    """
    w = Window.partitionBy("rollout")
    rows = events.withColumn("diff", _first(_is("inspect_schema_diff") & ~_flag("error")).over(w))
    late = _is("execute_sql") & (F.col("at") > F.col("diff"))
    facts = rows.groupBy("rollout").agg(
        F.max("diff").alias("diff"), _first(late & ~_flag("read_only")).alias("unsafe_at"), _first(late & _flag("read_only") & _flag("ok") & _flag("matches")).alias("match_at")
    )
    facts = rollouts.select("rollout").join(facts, "rollout", "left")
    accepted = F.coalesce(F.col("match_at") < F.coalesce("unsafe_at", F.lit(1 << 40)), F.lit(False))
    reason = F.when(F.col("diff").isNull(), "schema_diff_not_inspected").when(accepted, "contract_validated").when(F.col("unsafe_at").isNotNull(), "unsafe_post_diff_candidate")
    return facts.select("rollout", accepted.alias("accepted"), reason.otherwise("result_contract_mismatch").alias("reason"), F.when(accepted, F.col("match_at") - 1).cast("int").alias("event_at"))


def with_decisions(rollouts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rollouts after the controller: what it accepts is submitted and successful, all else stays as it was."""
    rows = rollouts.join(decisions, "rollout", "left")
    yes = _flag("accepted")
    return rows.withColumns({"termination": F.when(yes, "contract_validated_auto_submit").otherwise(F.col("termination")), "success": F.when(yes, True).otherwise(F.col("success"))}).drop("accepted", "event_at")


def scoring(events: DataFrame) -> DataFrame:
    """rollout and what an episode is scored by: calls, executions, distinct queries, repeated ones, unsafe ones, the last query that ran."""
    run = _is("execute_sql")
    text = normal_sql(F.col("sql"))
    per_query = events.where(run).groupBy("rollout", text.alias("q")).agg(F.count("*").alias("n"))
    again = per_query.groupBy("rollout").agg(F.count("*").alias("queries"), F.sum(F.col("n") - 1).alias("duplicate_executions"))
    facts = events.groupBy("rollout").agg(
        F.count("*").alias("tool_calls"),
        F.count_if(run).alias("executions"),
        F.count_if(run & ~_flag("read_only")).alias("unsafe_executions"),
        F.max_by("sql", F.when(run & _flag("ok") & _flag("read_only"), F.col("at"))).alias("last_sql"),
        F.bool_or(run & _flag("ok") & _flag("read_only")).alias("any_ok"),
    )
    out = facts.join(again, "rollout", "left").na.fill(0, ["queries", "duplicate_executions"])
    return out.withColumn("last_sql", F.when(F.col("any_ok"), F.col("last_sql"))).drop("any_ok")


def oracle_steps(events: DataFrame, condition: Column) -> DataFrame:
    """rollout, first_at, last_at: the first and the last event that meets a condition; rollouts without one are absent."""
    return events.where(condition).groupBy("rollout").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def first_version_reward(m: DataFrame) -> DataFrame:
    """Adds ``score`` of the first reward version from metrics that a later version has verified.

    Columns: task_success, clarification_required, clarification_attempted, clarification_matched, format_valid, execution_success,
    event_success, efficient, post_valid, terminal_validated, inspected, add_column, tool_calls, tokens, duplicates, repeats,
    invalid, timed_out, turn_limit, missing_submit, unsafe.
    """
    yes = lambda c, w: F.when(c, w).otherwise(0.0)
    col, need = F.col, F.col("clarification_required")
    complete = col("add_column") & col("inspected") & col("terminal_validated")
    rewards = (
        yes(col("task_success"), 1.0) + yes(col("clarification_matched") & col("format_valid"), 0.1) + F.when(col("execution_success"), 0.1).when(col("event_success"), 0.05).otherwise(0.0)
        + yes(col("efficient"), 0.1) + yes(need & col("clarification_matched"), 0.25) + yes(need & col("clarification_attempted"), 0.2)
        + yes(need & col("post_valid"), 0.1) + yes(col("terminal_validated"), 0.2) + yes(complete, 0.2)
    )
    penalties = (
        0.01 * col("tool_calls") + F.least(F.lit(0.1), 0.00001 * col("tokens")) + 0.08 * col("duplicates") + 0.08 * col("repeats") + 0.1 * col("invalid")
        + yes(col("timed_out"), 0.25) + yes(col("turn_limit"), 0.5) + yes(col("missing_submit"), 0.5) + yes(col("unsafe"), 1.0)
        + yes(need & ~col("clarification_attempted"), 0.25) + yes(need & col("clarification_attempted") & ~col("clarification_matched"), 0.15)
        + yes(need & col("clarification_matched") & ~col("post_valid"), 0.15) + yes(col("add_column") & ~complete, 0.15)
    )
    return m.withColumn("score", F.round(rewards - penalties, 4))


def small_reward(success: Column, inspected: Column, validated: Column, cost: Column, unsafe: Column) -> Column:
    """The reward of the first product: success, 0.2 for inspecting drift, 0.1 for a validated result, less a tenth of the cost and 1 if unsafe."""
    yes = lambda c, w: F.when(c, w).otherwise(0.0)
    return yes(success, 1.0) + yes(inspected, 0.2) + yes(validated, 0.1) - 0.1 * F.greatest(cost, F.lit(0.0)) - yes(unsafe, 1.0)
