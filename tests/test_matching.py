"""Many patterns in one pass against brute force, and texts with replaced references and protected tokens."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.functions import matching, texts


def brute(text, patterns):
    out, at = [], 0
    by_length = sorted((p for p in patterns if p), key=len, reverse=True)
    while at < len(text):
        found = next((p for p in by_length if text.startswith(p, at)), None)
        if found:
            out.append((at, found))
        at += len(found or "x")
    return out


def rows(seed, n=40):
    r = random.Random(seed)
    patterns = ["".join(r.choice("abcé/") for _ in range(r.randint(1, 7))) for _ in range(120)]
    return [(i, "".join(r.choice("abcé/ ") for _ in range(r.randint(0, 120)))) for i in range(n)], patterns


@pytest.mark.parametrize("chunk", [7, 100_000])
def test_leftmost_longest(spark, monkeypatch, chunk):
    monkeypatch.setattr(matching, "CHUNK", chunk)
    said, patterns = rows(1)
    df = spark.createDataFrame([*said, (100, None), (101, "")], "id long, t string")
    got = matching.finds(df, "id", "t", spark.createDataFrame([(p,) for p in [*patterns, "", None, patterns[0]]], "p string"), "p").collect()
    assert {r.key: [tuple(f) for f in r.finds] for r in got} == {100: [], 101: [], **{i: brute(t, patterns) for i, t in said}}


def test_ten_thousand_markers(spark):
    r = random.Random(2)
    patterns = [f"@db{i % 100}/t{i}" for i in range(10_000)] + [f"@db{i}" for i in range(100)]
    said = [(i, " ".join(r.choice(patterns) + r.choice(["", "0", "/x", "."]) for _ in range(30))) for i in range(20)]
    got = matching.finds(spark.createDataFrame(said, "id long, t string"), "id", "t", spark.createDataFrame([(p,) for p in patterns], "p string"), "p").collect()
    every = re.compile("|".join(map(re.escape, sorted(patterns, key=len, reverse=True))))
    assert {x.key: [tuple(f) for f in x.finds] for x in got} == {i: [(m.start(), m[0]) for m in every.finditer(t)] for i, t in said}


def test_replaced_in_one_pass(spark):
    paths = spark.createDataFrame([("@a/b", "see @a"), ("@a", "X"), ("é", None), (None, "n"), ("", "e")], "p string, by string")
    said = [(1, "@a/b x"), (2, "@a/c @a/bé"), (3, None), (4, ""), (None, "@a")]
    got = matching.replaced(spark.createDataFrame([(*x, "z") for x in said], "id long, t string, put string"), "id", "t", paths, "p", "by").collect()
    assert {r.id: r.t for r in got} == {1: "see @a x", 2: "X/c see @a", 3: None, 4: "", None: "X"}


def test_present(spark):
    said, patterns = rows(3)
    got = matching.present(spark.createDataFrame([*said, (9999, None)], "id long, t string"), "id", "t", spark.createDataFrame([(p,) for p in patterns], "p string"), "p").collect()
    assert sorted(map(tuple, got)) == sorted((i, p) for i, t in said for p in set(patterns) if p in t)
    assert matching.present(spark.createDataFrame(said, "id long, t string"), "id", "t", spark.createDataFrame([], "p string"), "p").collect() == []


def test_masked_and_back(spark):
    said = {
        "fence": "Sieh ```py\nx_1 = 2\n``` und `a b`", "statement": "Zeige SELECT a_b, 1 FROM t。 dann 7", "drop": "drop table x\nweiter", "path": "@a/b-c.d v1.2 a.b/c",
        "plain": "nichts hier", "mark": "`<KEEP_1>` und `x`", "dollar": "`$1 \\\\ $0`", "empty": "",
    }
    df = spark.createDataFrame(list(said.items()), "k string, t string").withColumn("m", texts.masked(F.col("t")))
    got = {r.k: r for r in df.select("k", "t", "m", texts.unmasked(F.col("m.text"), F.col("m.kept")).alias("back")).collect()}
    assert all(r.back == r.t for r in got.values())
    assert {k: list(got[k].m.kept) for k in said} == {
        "fence": ["```py\nx_1 = 2\n```", "`a b`"], "statement": ["SELECT a_b, 1 FROM t", "7"], "drop": ["drop table x"], "path": ["@a/b-c.d", "v1.2", "a.b/c"],
        "plain": [], "mark": ["`<KEEP_1>`", "`x`"], "dollar": ["`$1 \\\\ $0`"], "empty": [],
    }
    bad = spark.createDataFrame([("<KEEP_0> <KEEP_0>",), ("<KEEP_1>",), ("",), ("<KEEP_0> <KEEP_7>",)], "t string")
    assert [r[0] for r in bad.select(texts.unmasked(F.col("t"), F.array(F.lit("x")))).collect()] == [None] * 4


def test_patterns_are_searched_once_a_row(spark):
    """No pattern stands inside a lambda, where each element would search the text anew."""
    df = spark.range(1).select(F.col("id").cast("string").alias("t"))
    plan = df.select(texts.masked(F.col("t"))["text"].alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    back = df.select(texts.unmasked(F.col("t"), F.array(F.lit("x"))).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert back.count("split(") == 1 and back.count("regexp_extract_all(") == 1
