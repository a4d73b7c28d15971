"""Seals of results: unambiguous rows, trees that depend on the rows alone, and where versions differ."""

import hashlib
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessella.functions import seals

SCHEMA = "a string, b string, c double, d long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def written(value):
    if value is None:
        return "-"
    if isinstance(value, str):
        return f"s{len(value.encode())}:{value}"
    if isinstance(value, int):
        return f"i{len(str(value))}:{value}"
    if value != value or value in (float("inf"), float("-inf")):
        text = "nan" if value != value else "inf" if value > 0 else "-inf"
    elif abs(value) < 1e27:
        text = f"{Decimal(repr(value)):.10f}"
        text = text[1:] if float(text) == 0 and text[0] == "-" else text
    else:
        text = f"{value!r}".replace("e+", "E") if "." in repr(value) else f"{value!r}".replace("e+", ".0E")
    return f"f{len(text)}:{text}"


def multiset(rows, wide=4096, digits=3):
    counts = Counter(sha("".join(map(written, r))) for r in rows)
    nodes, d = {h: sha(f"{h}:{n}") for h, n in counts.items()}, 0
    while len(nodes) > wide ** (d // digits + 1):
        d += digits
    while True:
        up = {}
        for at in sorted(nodes):
            up.setdefault(at[:d], []).append(nodes[at])
        nodes = {at: sha("".join(x)) for at, x in up.items()}
        if not d:
            return len(rows), nodes.get("", sha(""))
        d -= digits


ROWS = [("a|b", "c", 1.5, 1), ("a", "b|c", 1.5, 1), (None, "\\N", float("nan"), None), ("\\N", None, None, 0), ("", None, float("inf"), 2), (None, "", float("-inf"), 2),
        ("1", "Ä", 1e30, 1), ("2", "ä", -1e30, 1), ("3", "", 0.0, 1), ("3", "", -0.0, 1), ("s1:x", "-", 1e26, 5), ("a", "b|c", 1.5, 1)]


def test_rows_by_hashlib(spark):
    got = spark.createDataFrame(ROWS, SCHEMA).select(F.sha2(seals.canonical_row(spark.createDataFrame(ROWS, SCHEMA)), 256).alias("h")).collect()
    assert [r.h for r in got] == [sha("".join(map(written, r))) for r in ROWS]
    # Only the row that comes twice and the two zeros have equal texts.
    assert len({r.h for r in got}) == len(ROWS) - 2


def test_kinds_differ(spark):
    texts = spark.range(1).select(F.lit("1").alias("s"), F.lit(1).alias("i"), F.lit(1.0).alias("f"), F.expr("CAST(1 AS DECIMAL(3,0))").alias("n"), F.lit(True).alias("t"), F.lit(b"1").alias("x"))
    row = texts.select(*(seals.canonical_value(f.name, f.dataType).alias(f.name) for f in texts.schema)).first()
    assert row.asDict() == {"s": "s1:1", "i": "i1:1", "f": "f12:1.0000000000", "n": "n1:1", "t": "v4:true", "x": "x2:31"}


@pytest.mark.parametrize("wide", [2, 16, 4096])
def test_multiset_by_hashlib(spark, monkeypatch, wide):
    digits = {2: 1, 16: 1, 4096: 3}[wide]
    monkeypatch.setattr(seals, "WIDE", wide), monkeypatch.setattr(seals, "DIGITS", digits)
    rows = ROWS + [(f"k{i % 40}", None, float(i % 40), i % 40) for i in range(90)]
    expected = multiset(rows, wide, digits)
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        assert tuple(seals.multiset_fingerprint(spark.createDataFrame(rows, SCHEMA).repartition(seed + 1)).first()) == expected
    assert seals.multiset_fingerprint(spark.createDataFrame(rows[1:], SCHEMA)).first().value_hash != expected[1]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert tuple(seals.multiset_fingerprint(none).first()) == tuple(seals.ordered_fingerprint(none, "a").first()) == (0, sha(""))
    assert seals.differing_ranges(none, none, "a").collect() == []


def test_order_counts(spark, monkeypatch):
    monkeypatch.setattr(seals, "WIDE", 4)
    rows = [(i, f"v{i % 7}") for i in range(50)]
    nodes = [sha(written(i) + written(v)) for i, v in rows]
    while True:
        nodes = [sha("".join(nodes[k : k + 4])) for k in range(0, len(nodes), 4)]
        if len(nodes) == 1:
            break
    df = spark.createDataFrame(rows, "i long, v string")
    assert tuple(seals.ordered_fingerprint(df.repartition(5), "i").first()) == (50, nodes[0])
    assert seals.ordered_fingerprint(df, "v").first().value_hash != nodes[0]


@pytest.mark.parametrize("wide", [4, 4096])
def test_changed_keys(spark, monkeypatch, wide):
    monkeypatch.setattr(seals, "WIDE", wide), monkeypatch.setattr(seals, "DIGITS", 1 if wide == 4 else 3)
    old = [(i, "same") for i in range(200)] + [(None, "x"), (500, "twice"), (500, "twice")]
    new = [(i, "other" if i == 17 else "same") for i in range(199)] + [(None, "y"), (500, "twice"), (900, "new")]
    a, b = (spark.createDataFrame(x, "k long, v string") for x in (old, new))
    names = {sha(written(k)): k for k in [*range(200), None, 500, 900]}
    assert {(names[r.key], r.change) for r in seals.changed_keys(a, b, "k").collect()} == {(17, "changed"), (199, "removed"), (None, "changed"), (500, "changed"), (900, "added")}
    found = seals.differing_ranges(a, b, "k").collect()
    assert {r.range for r in found} == {h[: len(found[0].range)] for h, k in names.items() if k in (17, 199, None, 500, 900)}
    assert seals.changed_keys(a, a, "k").collect() == []
