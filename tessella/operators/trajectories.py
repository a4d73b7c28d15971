"""Chat trajectories: identities, prefixes, repetitions, terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The tools that each interaction profile is expected to call, in order.
PROFILES = {
    "direct_clean": ["execute_sql", "submit_solution"],
    "schema_only": ["get_schema_version", "inspect_schema_diff", "execute_sql", "submit_solution"],
    "knowledge_only": ["get_schema_version", "inspect_schema_diff", "search_knowledge", "execute_sql", "submit_solution"],
    "must_ask": ["get_schema_version", "inspect_schema_diff", "ask_user", "execute_sql", "submit_solution"],
}


def identities(df: DataFrame) -> DataFrame:
    """conv_id, trajectory: a digest of a conversation's roles and texts in order."""
    said = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(":"), F.coalesce("text", F.lit(""))).alias("said"))))
    return df.groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(said, lambda x: x["said"]), "\n"), 256).alias("trajectory"))


def next_actions(df: DataFrame) -> DataFrame:
    """One row for each assistant turn with the size of the prefix it answers.

    The prefix itself is the conversation's rows before it: sizes come from a running window, no lists of lists.
    """
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    sized = df.withColumns({"prefix_turns": F.count("*").over(before), "prefix_chars": F.sum(F.length(F.coalesce("text", F.lit("")))).over(before)})
    return sized.where("role = 'assistant'")


def repeated(df: DataFrame, times: Column) -> DataFrame:
    """Each row as often as ``times`` says, numbered by ``copy`` from 0."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1)))


def expected_tools(profile: Column) -> Column:
    out = None
    for name, tools in PROFILES.items():
        listed = F.array(*(F.lit(t) for t in tools))
        out = F.when(profile == name, listed) if out is None else out.when(profile == name, listed)
    return out


def terms(text: Column, pattern: str = "[a-z]+") -> Column:
    """The distinct terms of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)))


def traces(df: DataFrame, mark: Column) -> DataFrame:
    """conv_id, trace: a mark for each turn in order."""
    marks = F.array_sort(F.collect_list(F.struct("turn", mark.alias("mark"))))
    return df.groupBy("conv_id").agg(F.array_join(F.transform(marks, lambda x: x["mark"]), "").alias("trace"))


def last_json_line(text: Column) -> Column:
    """The last line that is a JSON object; null if none is."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.try_parse_json(x).isNotNull() & F.startswith(F.trim(x), F.lit("{")))
    return F.get(lines, F.size(lines) - 1)
