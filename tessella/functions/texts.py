"""What agents write: tool calls in any wrapper, SQL in any wrapper, and texts made for them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CALL = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


class _Calls:
    """Reads the calls of a text from left to right: whatever opens one is read as far as it goes, and reading goes on behind it.

    An opening is a brace (a JSON object) or ``<function``, whose attributes are read one by one up to ``/>``: a value that is a JSON object
    ends where the object does, whatever quotes it holds, any other at the next quote of its kind.
    """

    openings = re.compile(r"\{|<function(?=\s)", re.IGNORECASE)
    attribute = re.compile(r"\s*([A-Za-z_][\w-]*)\s*=\s*([\"'])")
    closing = re.compile(r"\s*/\s*>")
    json = json.JSONDecoder()

    def __init__(self, text: str):
        self.text, self.found = text, []
        behind = 0
        for opening in self.openings.finditer(text):
            if opening.start() >= behind:
                read = self.object if opening[0] == "{" else self.element
                behind = read(opening) or behind

    def value(self, at: int) -> tuple[dict, int] | None:
        """The JSON object that begins at a place, and its end."""
        try:
            value, end = self.json.raw_decode(self.text, at)
        except (ValueError, RecursionError):
            return None
        return (value, end) if isinstance(value, dict) else None

    def object(self, opening: re.Match) -> int | None:
        if read := self.value(opening.start()):
            outer, end = read
            inner = outer.get("function")
            call = inner if isinstance(inner, dict) else outer
            self.add(call.get("name"), call.get("arguments"), opening.start(), end)
            return end

    def element(self, opening: re.Match) -> int | None:
        at, held = opening.end(), {}
        while attribute := self.attribute.match(self.text, at):
            quote, at = attribute[2], attribute.end()
            read = self.value(at) if self.text[at : at + 1] == "{" else None
            end = read[1] if read else self.text.find(quote, at)
            if end < 0 or self.text[end : end + 1] != quote:
                return None
            held[attribute[1].lower()] = read[0] if read else self.text[at:end]
            at = end + 1
        if closed := self.closing.match(self.text, at):
            if isinstance(held.get("arguments"), dict):
                self.add(held.get("name"), held["arguments"], opening.start(), closed.end())
            return closed.end()

    def add(self, name, arguments, start: int, end: int) -> None:
        """Keeps a call with a name, whose arguments are an object, nothing, or a text that is one."""
        if isinstance(arguments, str):
            read = self.whole(arguments)
            arguments = read if isinstance(read, dict) else 0
        if isinstance(name, str) and name.strip() and isinstance(arguments, dict | None):
            written = json.dumps(arguments or {}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            self.found.append({"name": name.strip(), "arguments": written, "start": start, "end": end})

    @staticmethod
    def whole(text: str):
        try:
            return json.loads(text)
        except (ValueError, RecursionError):
            return None


@F.pandas_udf(CALL)
def tool_calls(texts: pd.Series) -> pd.Series:
    """The tool calls of each text, tagged, fenced, bare or as a function element, by place; null for a null text."""
    return texts.map(lambda text: _Calls(text).found, na_action="ignore").astype(object).where(texts.notna(), None)


def without_calls(text: str, calls: str) -> Column:
    """A text without its calls (places in code points), their tags and the fences they leave empty."""
    rest = F.expr(f"""aggregate({calls}, named_struct('at', 0, 'out', ''), (a, c) -> named_struct('at', c.end, 'out', a.out || substring({text}, a.at + 1, c.start - a.at)),
        a -> a.out || substring({text}, a.at + 1, length({text})))""")
    bare = F.regexp_replace(F.regexp_replace(rest, r"(?i)</?tool_call>", ""), r"(?i)```(?:json)?\s*```", "")
    return F.when(F.size(calls) == 0, F.col(text)).otherwise(_stripped(bare))


def _stripped(c: Column, also: str = "") -> Column:
    return F.regexp_replace(c, rf"^[\s{also}]+|[\s{also}]+$", "")


# What stands about SQL in an answer, the words it begins with, what ends it where it stands bare, and how actions are named.
SOLUTION, SQL_FENCE, ANY_FENCE, SQL_TAG, PLAN_TAG = ("<solution>", "</solution>"), ("```sql", "```"), ("```", "```"), ("<sql>", "</sql>"), ("<plan>", "</plan>")
STATEMENTS = ("select", "with")
BARE_ENDS = ("\n```", "<final>", "</final>", "<answer>", "</answer>")
OPEN_ENDS = ("<plan>", "</plan>", "<answer>", "</answer>", "<final>", "</final>")
ACTIONS, HEADINGS = ("execute_sql", "submit_solution"), ("action", "tool")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _split(text: Column, *marks: str) -> Column:
    """The parts of a text between marks in any case."""
    return F.split(text, "(?i)" + "|".join(map(re.escape, marks)))


def _enclosed(text: Column, marks: tuple[str, str]) -> Column:
    """What stands between an opening and the next closing mark, each time."""
    opening, closing = marks
    if opening == closing:
        parts = _split(text, opening)
        return F.filter(parts, lambda p, i: (i % 2 == 1) & (i < F.size(parts) - 1))
    rest = _split(text, opening)
    pieces = F.transform(F.slice(rest, 2, F.size(rest)), lambda p: _split(p, closing))
    return F.transform(F.filter(pieces, lambda p: F.size(p) > 1), lambda p: p[0])


def _newest(pieces: Column, also: str = "") -> Column:
    return F.when(F.size(pieces) > 0, _stripped(F.element_at(pieces, -1), also))


def candidate_sql(text: str, calls: str) -> Column:
    """The SQL that a message offers: in its last submission (or else execution) call, solution, fence, or from a leading keyword on; else empty."""
    given = lambda c, path: F.nullif(_stripped(F.get_json_object(c["arguments"], path)), F.lit(""))
    of = lambda tool: F.array_compact(F.transform(F.filter(calls, lambda c: c["name"] == tool), lambda c: F.coalesce(given(c, "$.sql"), given(c, "$.sql_list[0]"))))
    submits = F.exists(calls, lambda c: c["name"] == "submit_solution")
    called = F.when(submits, of("submit_solution")).otherwise(of("execute_sql"))
    t = _text(text)
    bare = F.regexp_extract(t, rf"(?is)\b(?:{'|'.join(STATEMENTS)})\b.*", 0)
    return F.coalesce(F.get(called, F.size(called) - 1), _newest(_enclosed(t, SOLUTION)), _newest(_enclosed(t, SQL_FENCE)), _stripped(_split(bare, *BARE_ENDS)[0], "`"))


def reasoning_sql(text: str, calls: str) -> Column:
    """The SQL of a reasoned answer: its last closed sql tag, an open one up to the next part, or ``candidate_sql``."""
    t = _text(text)
    opened = _split(t, SQL_TAG[0])
    left_open = F.when(F.size(opened) > 1, _stripped(_split(F.get(opened, F.lit(1)), *OPEN_ENDS)[0], "`"))
    return F.coalesce(_newest(_enclosed(t, SQL_TAG), "`"), left_open, candidate_sql(text, calls))


def reasoning_format(text: str) -> dict[str, Column]:
    """Whether a text has a plan, closed SQL, and both."""
    plan, sql = (F.size(_enclosed(_text(text), marks)) > 0 for marks in (PLAN_TAG, SQL_TAG))
    return {"plan_tag": plan, "sql_tag": sql, "exact_wrapper": plan & sql}


def fallback_action(text: str, default_tool: str | None = None) -> Column:
    """tool, sql, submits of an action in looser syntax: the first element named after a tool, or a fence with a tool named ahead or beside it; null tool if none."""
    t = _text(text)
    low = F.lower(t)
    elements = F.array(*(F.struct(F.instr(low, f"<{tool}>").alias("at"), F.lit(tool).alias("tool"), F.get(_enclosed(t, (f"<{tool}>", f"</{tool}>")), 0).alias("sql")) for tool in ACTIONS))
    element = F.array_min(F.filter(elements, lambda e: e["sql"].isNotNull()))
    fenced = F.regexp_replace(F.get(_enclosed(t, ANY_FENCE), 0), "^(?i:sql)", "")
    named = F.nullif(F.regexp_extract(low, rf"(?:{'|'.join(HEADINGS)})\s*:\s*({'|'.join(ACTIONS)})", 1), F.lit(""))
    tool = F.coalesce(element["tool"], F.when(fenced.isNotNull(), F.coalesce(named, F.lit(default_tool).cast("string"))))
    sql = F.when(element.isNotNull(), element["sql"]).otherwise(fenced)
    return F.struct(tool.alias("tool"), F.when(tool.isNotNull(), F.nullif(_stripped(sql), F.lit(""))).alias("sql"), F.coalesce(tool == "submit_solution", F.lit(False)).alias("submits"))


def recovery_guidance(op: Column) -> Column:
    """What an agent should keep to after a change (type, table, old_name, new_name, metric_name, old_expression, new_expression, reason, confirm)."""
    text = lambda c, other="": F.coalesce(F.nullif(op[c], F.lit("")), F.lit(other)) if other else op[c]
    table = text("table", "the affected table")
    has = lambda *names: F.array_min(F.array(*(F.coalesce(op[n], F.lit("")) != "" for n in names)).cast("array<boolean>"))
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    added = said("Column '", op["new_name"], "' is new in ", table, ". Keep the old result columns: expand wildcards to the columns before the change and leave '", op["new_name"], "' out unless it is asked for.")
    renamed = said("Replace table '", op["old_name"], "' by '", op["new_name"], "' and keep the rest of the query.")
    column = said("Replace column '", op["old_name"], "' by '", op["new_name"], "' on ", table, " and keep aliases, predicates, grouping and output.")
    ending = F.when(F.coalesce(op["confirm"], F.lit(False)), " once the user has confirmed the version.").otherwise(".")
    metric = said("Metric '", text("metric_name", "the requested metric"), "' changed from '", F.coalesce(op["old_expression"], F.lit("")), "' to '", F.coalesce(op["new_expression"], F.lit("")), "' because ", text("reason", "the definition changed"), ". Use the new one", ending)
    kind = op["type"]
    return (
        F.when((kind == "add_column") & has("new_name"), added).when((kind == "rename_table") & has("old_name", "new_name"), renamed)
        .when(kind.isin("rename_column", "replace_column") & has("old_name", "new_name"), column).when(kind == "metric_definition_change", metric)
    )


def clarification_term(evidence: Column, question: Column, kind: Column, old_name: Column) -> Column:
    """The term that is worth a question: what the evidence says it refers to, else the question's first words; without evidence what the change concerns."""
    parts = F.transform(F.split(evidence, ";"), lambda s: F.regexp_extract(F.trim(s), r"(?is)^(.+?)\s+refers? to\s+.+", 1))
    term = F.nullif(_stripped(F.get(F.filter(parts, lambda x: x != ""), 0), "`\"'"), F.lit(""))
    words = F.array_join(F.slice(F.regexp_extract_all(question, F.lit(r"[A-Za-z0-9_'-]+"), F.lit(0)), 1, 6), " ")
    told = F.coalesce(term, F.nullif(words, F.lit("")), F.lit("requested business rule"))
    changed = F.when(kind.isin("rename_column", "replace_column", "rename_table"), old_name).otherwise("result column contract")
    return F.when(F.coalesce(F.trim(evidence), F.lit("")) != "", told).otherwise(changed)


#: What a translation must not touch, by kind, the earlier kind first where several begin at one place.
PROTECTED = {
    "fence": r"```(?s:.*?)```",
    "code": r"`[^`\n]+`",
    "statement": r"(?i:\b(?:SELECT|WITH|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER)\b)[^，。！？；\n]*",
    "path": r"@[A-Za-z0-9_./-]+",
    "name": r"\b[A-Za-z][A-Za-z0-9]*(?:[_.$/-][A-Za-z0-9_.$/-]+)+\b",
    "number": r"\b\d+(?:\.\d+)?\b",
}


def _once(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value), with ``value`` worked out once a row: inside a lambda an expression is worked out anew for each element."""
    return F.get(F.transform(F.array(value), made), 0)


def masked(text: Column, pattern: str = "|".join(PROTECTED.values())) -> Column:
    """text and kept: protected tokens become <KEEP_0>, <KEEP_1>, ..."""
    mark = lambda parts, i: F.when(i < F.size(parts) - 1, F.concat(F.lit("<KEEP_"), i.cast("string"), F.lit(">"))).otherwise("")
    held = _once(F.split(text, pattern), lambda parts: F.array_join(F.transform(parts, lambda p, i: F.concat(p, mark(parts, i))), ""))
    return F.struct(held.alias("text"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("kept"))


def unmasked(text: Column, kept: Column) -> Column:
    """The tokens back in their places; null if one is missing or came twice."""

    def put(x: Column) -> Column:
        kept, parts, order = x["kept"], x["parts"], x["order"]
        # As many marks as tokens, and each token's among them: every one stands once. Numbers are compared as they are written.
        whole = F.size(F.array_except(F.transform(kept, lambda k, i: i.cast("string")), order)) == 0
        back = F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(kept, F.get(order, i).cast("int")), F.lit(""))))
        return F.when(whole & (F.size(order) == F.size(kept)), F.array_join(back, ""))

    # The text is cut at all marks at once, so that a token that looks like a mark stays as it is.
    parts, order = F.split(text, r"<KEEP_\d+>"), F.regexp_extract_all(text, F.lit(r"<KEEP_(\d+)>"), F.lit(1))
    return _once(F.struct(kept.alias("kept"), parts.alias("parts"), order.alias("order")), put)


def search_terms(text: Column) -> Column:
    """The distinct terms of two and more letters, digits and underscores, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]{2,}"), F.lit(0)), F.lower))
