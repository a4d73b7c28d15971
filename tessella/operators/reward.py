"""Shaped rewards of episodes: all terms as column math over facts, so versions share one pass.

An episode row has these facts. Booleans: success, protocol, matched, attempted, format_valid,
executed, event_executed, must_ask, post_valid, terminal_validated, add_column, inspected,
ordered_inspection, semantic_match, complete, first_right, target_set, timed_out, turn_limited,
no_submit, unsafe, premature. Counts: calls, tokens, dup_questions, dup_executions, excess_asks,
excess_retrievals, unknown_tools, invalid_sql.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSIONS = ("default", "v1", "v2", "v3")

# Weights of each term under default, v1, v2 and v3; calls is the most calls of an efficient episode.
WEIGHTS = {
    "success": (1.0, 1.0, 1.0, 1.0),
    "clarify": (0.2, 0.1, 0.0, 0.0),
    "valid": (0.1, 0.1, 0.0, 0.0),
    "efficient": (0.1, 0.1, 0.05, 0.05),
    "calls": (6, 7, 7, 7),
    "required_clarification": (0.0, 0.25, 0.1, 0.2),
    "clarification_attempt": (0.0, 0.2, 0.0, 0.0),
    "post_clarification": (0.0, 0.1, 0.05, 0.1),
    "terminal": (0.0, 0.2, 0.15, 0.15),
    "add_column_inspect": (0.0, 0.0, 0.05, 0.3),
    "semantic_candidate": (0.0, 0.0, 0.15, 0.35),
    "add_column": (0.0, 0.2, 0.15, 0.15),
    "decision_action": (0.0, 0.0, 0.0, 0.3),
    "tool_cost": (0.01, 0.01, 0.01, 0.01),
    "token_cost": (1e-5, 1e-5, 1e-5, 1e-5),
    "duplicate": (0.05, 0.08, 0.08, 0.08),
    "repeated_tool": (0.05, 0.08, 0.08, 0.08),
    "invalid": (0.05, 0.1, 0.1, 0.1),
    "timeout": (0.2, 0.25, 0.25, 0.25),
    "turn_limit": (0.3, 0.5, 0.5, 0.5),
    "missing_submit": (0.2, 0.5, 0.5, 0.3),
    "unsafe": (1.0, 1.0, 1.0, 1.0),
    "missing_clarification": (0.0, 0.25, 0.25, 0.2),
    "unmatched_clarification": (0.0, 0.15, 0.15, 0.1),
    "invalid_post_clarification": (0.0, 0.15, 0.15, 0.1),
    "add_column_protocol": (0.0, 0.15, 0.2, 0.05),
    "premature_stale": (0.0, 0.0, 0.0, 0.5),
}

#: What the protocol asks of an episode, over its facts.
PROTOCOL = "success AND terminal_validated AND (NOT drifted OR ordered_inspection) AND (NOT must_ask OR (matched AND post_valid)) AND (NOT add_column OR complete)"


def weight(term: str, version: str) -> float:
    return WEIGHTS[term][VERSIONS.index(version)]


def gains(version: str) -> dict[str, str]:
    """Each rewarding term's amount as SQL."""
    late, last = version in ("v2", "v3"), version == "v3"
    one = lambda condition: f"CASE WHEN {condition} THEN 1.0D ELSE 0.0D END"
    thrifty = f"success AND calls <= {weight('calls', version)} AND dup_questions + dup_executions = 0" + " AND protocol" * last
    return {
        "success": one("protocol" if last else "success"),
        "clarify": one("matched AND format_valid"),
        "valid": "CASE WHEN executed THEN 1.0D WHEN event_executed THEN 0.5D ELSE 0.0D END",
        "efficient": one(thrifty),
        "required_clarification": one("must_ask AND matched"),
        "clarification_attempt": one("must_ask AND attempted"),
        "post_clarification": one("must_ask AND post_valid" + " AND matched" * late),
        "terminal": one("terminal_validated AND format_valid" + " AND success" * late),
        "add_column_inspect": one("add_column AND " + ("ordered_inspection" if late else "inspected")),
        "semantic_candidate": one("semantic_match" if late else "false"),
        "add_column": one("add_column AND complete"),
        "decision_action": one("target_set AND first_right"),
    }


def losses(version: str) -> dict[str, str]:
    """Each penalty's amount as SQL; token_cost is capped apart."""
    one = lambda condition: f"CASE WHEN {condition} THEN 1.0D ELSE 0.0D END"
    return {
        "tool_cost": "calls",
        "duplicate": "(dup_questions + dup_executions)",
        "repeated_tool": "(excess_asks + excess_retrievals)",
        "invalid": "(unknown_tools + invalid_sql)",
        "timeout": one("timed_out"),
        "turn_limit": one("turn_limited"),
        "missing_submit": one("no_submit"),
        "unsafe": one("unsafe"),
        "missing_clarification": one("must_ask AND NOT attempted"),
        "unmatched_clarification": one("must_ask AND attempted AND NOT matched"),
        "invalid_post_clarification": one("must_ask AND attempted AND NOT post_valid"),
        "add_column_protocol": one("add_column AND NOT complete"),
        "premature_stale": one("add_column AND premature"),
    }


def score(version: str) -> Column:
    """The score of an episode under a version's weights, to four places."""
    up = sum((F.lit(float(weight(t, version))) * F.expr(x) for t, x in gains(version).items()), F.lit(0.0))
    down = sum((F.lit(float(weight(t, version))) * F.expr(x) for t, x in losses(version).items()), F.lit(0.0))
    tokens = F.least(F.lit(0.1), F.lit(weight("token_cost", version)) * F.col("tokens"))
    return F.round(up - down - tokens, 4)
