import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tessella.llm.chat import END, HARD_TEXT, MAPPINGS, canonical_records, digests, fingerprint, formatted_rows, formatted_table, formatted_turns, learned_text, mapping_of, read_turns

SCHEMA = "conv_id long, turn long, role string, text string, size int, formatted string"
NASTY = ["\\", "### ", END, "#", "\n", "<\\/turn>", "#\\## ", ": ", "é😀", "a", END + "\n", "### User: ", "\\\\", "</turn", " "]


def nasty(r):
    return "".join(r.choice(NASTY) for _ in range(r.randrange(0, 9)))


def escape(t):
    return t.replace("\\", "\\\\").replace("### ", "#\\## ").replace(END, "<\\/turn>")


def test_round_trip(spark):
    r = random.Random(1)
    rows = [(i, k, r.choice(["system", "user", "assistant", "tool", "User", "a: b", "=x", "", None, "### "]), r.choice([nasty(r), nasty(r), None]), 1, "x") for i in range(150) for k in range(r.randint(1, 6))]
    r.shuffle(rows)
    docs = spark.createDataFrame([*rows, (None, 0, "assistant", "long " * 200_000, 1, "x")], SCHEMA).repartition(3)
    got = {x.conv_id: x for x in formatted_rows(docs).withColumns({"turns": read_turns(), "learned": learned_text()}).collect()}
    want = {}
    for i, k, role, t, *_ in sorted(rows):
        want.setdefault(i, []).append((role or "", t or ""))
    assert set(got) == set(want) | {None}
    for i, turns in want.items():
        assert [tuple(t) for t in got[i].turns] == turns
        assert got[i].learned == "".join(t for role, t in turns if role == "assistant")
        assert [got[i].formatted[s.start : s.start + s.length] for s in got[i].loss_spans] == [escape(t) for role, t in turns if role == "assistant"]
    assert got[None].learned == "long " * 200_000


def test_digests(spark):
    rows = [(1, 0, "user", "hi", 1, "x"), (1, 1, "assistant", "héllo", 1, "x"), (1, 1, "assistant", "héllo", 1, "x"), (2, None, None, None, 1, "x")]
    got = {x.conv_id: x for x in digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1][1:] == (3, sha("user\nhi\nassistant\nhéllo\nassistant\nhéllo\n"), 10, sha("héllohéllo"), len("### User: hi</turn>\n") + 2 * len("### Assistant: héllo</turn>\n"))
    assert got[2][1:5] == (1, sha("\n\n"), 0, sha(""))
    assert got[-7][1:5] == (2, sha(f"user\n{HARD_TEXT}\nassistant\n{HARD_TEXT}\n"), len(HARD_TEXT), sha(HARD_TEXT))
    assert [x.conv_id for x in digests(spark.createDataFrame([], SCHEMA)).collect()] == [-7]


RECORDS = {
    "messages": ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}, [("user", "q"), ("assistant", "")]),
    "messages_text": ({"id": 3, "messages": [{"role": "user", "text": "q"}]}, [("user", "q")]),
    "conversations": ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("user", "q"), ("assistant", "a")]),
    "prompt_response": ({"prompt": "q", "response": "a", "meta": {"k": [1, {"x": 2}]}}, [("user", "q"), ("assistant", "a")]),
    "prompt_completion": ({"prompt": "q", "completion": "a"}, [("user", "q"), ("assistant", "a")]),
    "question_answer": ({"question": "q", "answer": "a", "score": 0.5}, [("user", "q"), ("assistant", "a")]),
    "instruction_output": ({"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    "instruction_input_output": ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
    "system_prompt_response": ({"system": None, "prompt": "q", "response": "a"}, [("user", "q"), ("assistant", "a")]),
}


def test_records_by_fingerprint(spark):
    rows = [(k, json.dumps(v)) for k, (v, _) in RECORDS.items()] + [("bad", "{not json"), ("null", None), ("unknown", '{"a": 1, "messages": 3}'), ("list", "[1, 2]")]
    df = canonical_records(spark.createDataFrame([(*x, "y") for x in rows], "name string, record string, turns_of string"), "record")
    got = {x.name: x for x in df.collect()}
    for k, (_, turns) in RECORDS.items():
        assert got[k].layout == k and [tuple(t) for t in got[k].turns] == turns, k
    for k in ("bad", "null", "unknown", "list"):
        assert got[k].layout is None and got[k].turns is None, k
    out = formatted_turns(df.where("layout is not null")).withColumns({"back": read_turns(), "learned": learned_text()}).collect()
    assert all(x.back == x.turns and x.learned == "".join(t.text for t in x.turns if t.role == "assistant") for x in out)


def test_tables_by_fingerprint(spark):
    df = spark.createDataFrame([("i", "", "o", 3)], "instruction string, input string, output string, id int")
    assert mapping_of(df).name == "instruction_input_output"
    assert formatted_table(df).first().formatted == "### User: i</turn>\n### Assistant: o</turn>\n"
    nested = df.select(F.array(F.struct(F.col("instruction").alias("value"), F.lit("human").alias("from"))).alias("conversations"), F.lit(1).alias("extra"))
    assert formatted_table(nested).first().formatted == "### User: i</turn>\n"
    with pytest.raises(ValueError, match="no layout"):
        mapping_of(df.select("id"))
    assert len({fingerprint(m.paths) for m in MAPPINGS}) == len(MAPPINGS)


def test_extra_fields_of_other_layouts(spark):
    """What has a layout's fields keeps it, whatever else stands beside them and however deep."""
    deep = {"x": 1}
    for _ in range(40):
        deep = {"a": [deep]}
    rows = {
        "system_messages": {"messages": [{"role": "user", "content": "q", "text": None}], "system": "s"},
        "messages": {"messages": [{"role": "user", "content": "q"}], "prompt": "p", "meta": deep},
        "system_instruction_input_output": {"instruction": "i", "input": "x", "output": "o", "system": "s", "answer": "z"},
        "system_conversations": {"conversations": [{"from": "human", "value": "q"}], "system": "s", "id": 1},
        "system_instruction_output": {"instruction": "i", "output": "o", "system": None},
    }
    got = {x.name: x for x in canonical_records(spark.createDataFrame([(k, json.dumps(v)) for k, v in rows.items()], "name string, record string"), "record").collect()}
    assert {k: got[k].layout for k in rows} == {k: k for k in rows}
    assert [tuple(t) for t in got["system_messages"].turns] == [("system", "s"), ("user", "q")]
    assert [tuple(t) for t in got["system_instruction_input_output"].turns] == [("system", "s"), ("user", "i\n\nx"), ("assistant", "o")]
    assert [tuple(t) for t in got["system_instruction_output"].turns] == [("user", "i"), ("assistant", "o")]
    df = spark.createDataFrame([("i", "o", "s", "z")], "instruction string, output string, system string, text string")
    assert formatted_table(df).first().formatted == "### System: s</turn>\n### User: i</turn>\n### Assistant: o</turn>\n"
    rows = spark.createDataFrame([(1, 0, "human", "q", "x"), (1, 1, "gpt", "a", "x")], "conversation_id long, index int, `from` string, value string, prompt string")
    assert formatted_table(rows).first().formatted == "### User: q</turn>\n### Assistant: a</turn>\n"
