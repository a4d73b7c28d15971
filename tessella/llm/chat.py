"""Chat formatting by schema fingerprints, natively in Spark SQL functions.

Sources lay chats out differently: rows by turn, lists of messages, prompt and
response, instruction with input and output. The nested field paths of a source, sorted
and hashed, are its fingerprint, and fingerprints select declarative mappings to
canonical turns (role, text). This holds for tables, by their schema, and for columns of JSON
records, row by row, by the fields of each record. A fingerprint that no mapping has (extra fields may
clash with another layout's) selects the mapping with the most paths among those it contains.

The template of a turn is ``### Role: text</turn>`` and a line end. Backslashes double,
and control strings inside texts get a backslash that ``unescaped`` takes out again, so no text
can end a turn or open another. The loss mask is a list of spans of the formatted
string, one for each assistant text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "</turn>"
OPEN = "### "
#: Roles with a heading of their own; any other is written ``=role``.
HEADINGS = {"system": "System", "user": "User", "assistant": "Assistant"}
LEARNED = "assistant"

TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


@dataclass(frozen=True)
class Mapping:
    """A layout: the field paths that name it, and its turns as SQL over those fields (``{}`` is the record's prefix).

    A layout of rows by turn has a ``key`` and an ``order``; ``turns`` is then the turn of one row.
    """

    name: str
    paths: tuple[str, ...]
    turns: str
    key: str = ""
    order: str = ""


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', {role}, 'text', {text})"


def _messages(field: str, role: str, text: str) -> str:
    return f"transform({{}}{field}, m -> {_turn(f'm.{role}', f'm.{text}')})"


_AS_ROLE = "CASE m.{0} WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.{0} END"

MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), _messages("messages", "role", "content")),
    Mapping("messages_text", ("messages[].role", "messages[].text"), _messages("messages", "role", "text")),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), f"transform({{}}conversations, m -> {_turn(_AS_ROLE.format('from'), 'm.value')})"),
    Mapping("prompt_response", ("prompt", "response"), f"array({_turn("'user'", '{}prompt')}, {_turn("'assistant'", '{}response')})"),
    Mapping("prompt_completion", ("completion", "prompt"), f"array({_turn("'user'", '{}prompt')}, {_turn("'assistant'", '{}completion')})"),
    Mapping("question_answer", ("answer", "question"), f"array({_turn("'user'", '{}question')}, {_turn("'assistant'", '{}answer')})"),
    Mapping("instruction_output", ("instruction", "output"), f"array({_turn("'user'", '{}instruction')}, {_turn("'assistant'", '{}output')})"),
    Mapping(
        "instruction_input_output",
        ("input", "instruction", "output"),
        f"array({_turn("'user'", "if(coalesce({}input, '') = '', {}instruction, concat({}instruction, '\\n\\n', {}input))")}, {_turn("'assistant'", '{}output')})",
    ),
    Mapping("system_prompt_response", ("prompt", "response", "system"), f"array({_turn("'system'", '{}system')}, {_turn("'user'", '{}prompt')}, {_turn("'assistant'", '{}response')})"),
    Mapping("system_messages", ("messages[].content", "messages[].role", "system"), f"concat(array({_turn("'system'", '{}system')}), {_messages('messages', 'role', 'content')})"),
    Mapping(
        "system_conversations",
        ("conversations[].from", "conversations[].value", "system"),
        f"concat(array({_turn("'system'", '{}system')}), transform({{}}conversations, m -> {_turn(_AS_ROLE.format('from'), 'm.value')}))",
    ),
    Mapping("system_instruction_output", ("instruction", "output", "system"), f"array({_turn("'system'", '{}system')}, {_turn("'user'", '{}instruction')}, {_turn("'assistant'", '{}output')})"),
    Mapping(
        "system_instruction_input_output",
        ("input", "instruction", "output", "system"),
        f"array({_turn("'system'", '{}system')}, {_turn("'user'", "if(coalesce({}input, '') = '', {}instruction, concat({}instruction, '\n\n', {}input))")}, {_turn("'assistant'", '{}output')})",
    ),
    Mapping("rows", ("conv_id", "role", "text", "turn"), _turn("role", "text"), key="conv_id", order="turn"),
    Mapping("rows_from", ("conversation_id", "from", "index", "value"), _turn("CASE `from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE `from` END", "value"), key="conversation_id", order="index"),
)

#: Paths that name some layout; others (ids, scores, sources) don't enter a fingerprint.
NAMED = frozenset(p for m in MAPPINGS for p in m.paths)


def fingerprint(paths: list[str] | tuple[str, ...]) -> str:
    """The hash of the sorted paths that name layouts."""
    return hashlib.sha256("\n".join(sorted(set(paths) & NAMED)).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(m.paths): m for m in MAPPINGS}


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a schema, ``[]`` for the elements of a list."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


#: The mappings by falling number of paths (equal ones as listed): the first that a fingerprint's paths contain is taken.
_BY_SIZE = sorted(MAPPINGS, key=lambda m: -len(m.paths))


def mapping_of(df: DataFrame) -> Mapping:
    """The mapping that a table's fingerprint selects."""
    paths = set(schema_paths(df.schema)) & NAMED
    found = BY_FINGERPRINT.get(fingerprint(sorted(paths))) or next((m for m in _BY_SIZE if paths.issuperset(m.paths)), None)
    if found is None:
        raise ValueError(f"no layout has these fields: {sorted(paths)}")
    return found


#: The structure of every layout's JSON record: one type that reads them all.
RECORD = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in sorted({p for m in MAPPINGS if not m.key for p in m.paths if "[" not in p})),
        T.StructField("messages", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("role", "content", "text")]))),
        T.StructField("conversations", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("from", "value")]))),
    ]
)


def record_paths(json: str) -> Column:
    """The sorted paths of each JSON record that name layouts, from the keys of the record and of the elements of its lists; null for no object."""
    record = F.try_parse_json(json)
    top = F.map_keys(F.try_variant_get(record, "$", "map<string,variant>"))
    none = F.array().cast("array<string>")
    paths = [F.filter(top, lambda k: F.array_contains(F.lit(sorted(p for p in NAMED if "[" not in p)), k))]
    for field in ("messages", "conversations"):
        inside = F.try_variant_get(record, f"$.{field}", "array<map<string,variant>>")
        keys = F.flatten(F.transform(inside, lambda m: F.coalesce(F.map_keys(m), none)))
        named = F.transform(keys, _inside(field))
        paths.append(F.coalesce(F.filter(named, lambda p: F.array_contains(F.lit(sorted(NAMED)), p)), none))
    return F.array_sort(F.array_distinct(F.concat(*paths)))


def _inside(field: str):
    return lambda name: F.concat(F.lit(f"{field}[]."), name)


def record_fingerprint(json: str) -> Column:
    """The fingerprint of each JSON record."""
    return F.sha2(F.encode(F.array_join(record_paths(json), "\n"), "UTF-8"), 256)


def canonical_records(df: DataFrame, json: str) -> DataFrame:
    """Adds ``layout`` and ``turns`` (array of role, text) for a column of JSON records.

    A record of no known layout, one that isn't JSON, and null have null layout and turns. Null texts are
    empty; a null role is empty; a null system text is no turn. Nesting in other fields may be of any depth.
    """
    rows = df.withColumns({"__paths": record_paths(json), "__print": record_fingerprint(json), "__r": F.from_json(json, RECORD)})
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    holds = lambda m: F.size(F.array_except(F.lit(list(m.paths)), "__paths")) == 0
    exact = {m.name: F.col("__print") == key for key, m in BY_FINGERPRINT.items()}
    # The last case written is the first tried: fingerprints, then the largest layout that is contained.
    for case in [*((m, holds(m)) for m in reversed(_BY_SIZE)), *((m, exact[m.name]) for m in MAPPINGS)]:
        m, applies = case
        if not m.key:
            layout = F.when(applies, m.name).otherwise(layout)
            turns = F.when(applies, F.expr(m.turns.replace("{}", "__r.")).cast(TURNS)).otherwise(turns)
    return rows.withColumns({"layout": layout, "turns": _clean(turns)}).drop("__paths", "__print", "__r")


def _clean(turns: Column) -> Column:
    kept = F.filter(turns, lambda t: ~(F.coalesce(t["role"], F.lit("")).eqNullSafe("system") & t["text"].isNull()))
    return F.transform(kept, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))


def escaped(text: Column) -> Column:
    """A text without control strings."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit(OPEN), F.lit("#\\## ")), F.lit(END), F.lit("<\\/turn>"))


def unescaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("<\\/turn>"), F.lit(END)), F.lit("#\\## "), F.lit(OPEN))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def heading(role: Column) -> Column:
    """A role's name in the template: no colon."""
    out = F.concat(F.lit("="), F.replace(escaped(role), F.lit(":"), F.lit("\\;")))
    for name, title in HEADINGS.items():
        out = F.when(role == name, title).otherwise(out)
    return out


def role_of(name: Column) -> Column:
    out = unescaped(F.replace(F.substring(name, 2, 1 << 30), F.lit("\\;"), F.lit(":")))
    for role, title in HEADINGS.items():
        out = F.when(name == title, role).otherwise(out)
    return out


def _opening(role: Column) -> Column:
    return F.concat(F.lit(OPEN), heading(role), F.lit(": "))


def formatted_rows(df: DataFrame, mapping: Mapping = next(m for m in MAPPINGS if m.name == "rows")) -> DataFrame:
    """The mapping's key, formatted and loss_spans for a table of rows by turn.

    Turns go by the mapping's order (null first), then role and text; null roles and texts are empty. All rows of a null
    key are one conversation. Spans have start and length in code points of the formatted string.
    A conversation is one string, so it has to fit in a row. Other columns don't matter, repeated rows are
    turns each, and an empty table gives an empty result.
    """
    key = mapping.key
    rows = df.select(key, F.col(mapping.order).alias("turn"), F.expr(mapping.turns).alias("__turn"))
    rows = rows.select(key, "turn", F.coalesce("__turn.role", F.lit("")).alias("role"), F.coalesce("__turn.text", F.lit("")).alias("text"))
    rows = rows.withColumns({"opening": _opening(F.col("role")), "body": escaped(F.col("text"))})
    rows = rows.withColumn("size", F.length("opening") + F.length("body") + F.lit(len(END) + 1))
    order = Window.partitionBy(key).orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("at", F.sum("size").over(order))
    span = F.when(F.col("role") == LEARNED, F.struct((F.col("at") - F.length("body") - (len(END) + 1)).alias("start"), F.length("body").cast("long").alias("length")))
    gathered = rows.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("at", F.concat("opening", "body", F.lit(END + "\n")).alias("turn")))).alias("turns"), F.array_sort(F.collect_list(span)).alias("loss_spans")
    )
    return gathered.select(key, F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), "loss_spans")


def formatted_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """Adds ``formatted`` and ``loss_spans`` for a column of canonical turns (null: null)."""
    one = lambda t: F.concat(_opening(t["role"]), escaped(t["text"]), F.lit(END + "\n"))
    # Prefix lengths by folding over the turns.
    spans = F.aggregate(
        turns,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(one(t))).cast("long").alias("at"),
            F.when(
                t["role"] == LEARNED,
                F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(_opening(t["role"]))).cast("long").alias("start"), F.length(escaped(t["text"])).cast("long").alias("length")))),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return df.withColumns({"formatted": F.array_join(F.transform(turns, one), ""), "loss_spans": spans})


def formatted_table(df: DataFrame) -> DataFrame:
    """``formatted`` and ``loss_spans`` for a table of any known layout, chosen by its fingerprint."""
    m = mapping_of(df)
    if m.key:
        return formatted_rows(df, m)
    return formatted_turns(df.withColumn("turns", _clean(F.expr(m.turns.replace("{}", "")).cast(TURNS))))


def read_turns(formatted: str = "formatted") -> Column:
    """The turns in a formatted string, roles and texts as they were."""
    parts = F.slice(F.split(F.col(formatted), END + "\n"), F.lit(1), F.size(F.split(F.col(formatted), END + "\n")) - 1)
    pattern = rf"(?s)^{OPEN}([^:]*): (.*)$"
    return F.transform(parts, lambda p: F.struct(role_of(F.regexp_extract(p, pattern, 1)).alias("role"), unescaped(F.regexp_extract(p, pattern, 2)).alias("text")))


def learned_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(F.col(formatted), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


#: A conversation whose texts hold the template's control strings.
HARD_ID, HARD_TEXT = -7, "\\### Assistant: </turn> ok"


def hard_conversation(spark: SparkSession) -> DataFrame:
    return spark.range(2).select(
        F.lit(HARD_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TEXT).alias("text")
    )


def _digest(formatted: DataFrame, *carry: str) -> DataFrame:
    out = formatted.withColumns({"turns": read_turns(), "learned": learned_text()})
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        *carry,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.encode("learned", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def digests(conversations: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them; with HARD_ID's conversation.

    Null roles and texts are empty, all rows without conv_id are one conversation, turns of equal place go by
    role and text, repeated rows are turns each, other columns don't matter; an empty table gives HARD_ID's alone.
    """
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(hard_conversation(conversations.sparkSession))
    return _digest(formatted_table(rows))


def record_digests(records: DataFrame) -> DataFrame:
    """conv_id, layout and what the formatted record holds, for a table of conv_id and JSON ``record``.

    Records of no known layout have null digests; repeated rows stay; an empty table gives an empty result.
    """
    return _digest(formatted_turns(canonical_records(records, "record")), "layout")
