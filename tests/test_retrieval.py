"""Retrieval through the inverted index against plain comparison of every question with every entry."""

import random
import re

import pytest

from tessella.operators import retrieval


def terms(text):
    return {t.lower() for t in re.findall(r"[A-Za-z0-9_]{2,}", text or "")}


def best(questions, base, k):
    out = []
    index = [(name, terms(f"{name or ''} {entry or ''}")) for name, entry in base]
    for key, q in questions:
        q = (q or "").strip().lower()
        if not q:
            continue
        asked, found = terms(q), []
        for name, held in index:
            phrase = bool(name) and (name.lower() in q or q in name.lower())
            if phrase or asked & held:
                found.append((not phrase, -len(asked & held), name))
        out += [(key, name, not p, -o) for p, o, name in sorted(found)[:k]]
    return sorted(out)


def zipf(r, n):
    return f"w{int(n * r.random() ** 4)}"


@pytest.mark.parametrize("budget", [1, 60, 10_000])
def test_best_entries(spark, monkeypatch, budget):
    monkeypatch.setattr(retrieval, "BUDGET", budget)
    r = random.Random(budget)
    base = [(f"{zipf(r, 40)} {i}", " ".join(zipf(r, 60) for _ in range(r.randint(0, 9)))) for i in range(300)] + [("Same name", "w0 w1"), ("Zz", None)]
    questions = [(i, " ".join(zipf(r, 80) for _ in range(r.randint(1, 8)))) for i in range(30)] + [(90, "say SAME NAME w0"), (91, " "), (92, None), (93, "zz"), (94, "nothing_like_it"), (95, "w0")]
    got = retrieval.best_entries(spark.createDataFrame(questions, "id long, q string"), "id", "q", spark.createDataFrame(base, "knowledge string, entry string"), 3)
    assert sorted(map(tuple, got.collect())) == best(questions, base, 3)


def test_fifty_thousand_entries(spark):
    r = random.Random(7)
    base = [(f"name {i}", " ".join(zipf(r, 5000) for _ in range(6))) for i in range(50_000)]
    questions = [(i, " ".join(zipf(r, 5000) for _ in range(5))) for i in range(8)] + [(50, "all about name 4711, please")]
    got = retrieval.best_entries(spark.createDataFrame(questions, "id long, q string"), "id", "q", spark.createDataFrame(base, "knowledge string, entry string"), 5)
    assert sorted(map(tuple, got.collect())) == best(questions, base, 5)


@pytest.mark.parametrize("most", [20, 200])
def test_ranked_blocks(spark, most):
    r = random.Random(3)
    blocks = [(i, f"b{i}", " ".join(zipf(r, 30) for _ in range(r.randint(1, 12)))) for i in range(120)]
    questions = [(i, " ".join(zipf(r, 50) for _ in range(4))) for i in range(20)] + [(90, "none_of_it"), (91, None)]
    got = {x.id: (x.blocks, x.truncated) for x in retrieval.ranked_blocks(spark.createDataFrame(questions, "id long, q string"), "id", "q", spark.createDataFrame(blocks, "place int, name string, block string"), most).collect()}
    expected = {}
    for key, q in questions:
        scored = sorted((-len(terms(q) & terms(b)), place, name, len(b)) for place, name, b in blocks)
        chosen = [x for x in scored if x[0] < 0] or sorted((0, place, name, len(b)) for place, name, b in blocks)
        names, at = [], 0
        for _, _, name, size in chosen:
            names += [name] if at < most else []
            at += size + 2
        expected[key] = (",".join(names), at - 2 > most)
    assert got == expected


def test_a_tiny_block_does_not_widen_the_search(spark, monkeypatch):
    """The blocks that fill the text set the bar, not as many as the smallest one would need: blocks that share only what all have aren't paired."""
    made, overlaps = [], retrieval.overlaps

    def counted(*given):
        made.append(overlaps(*given))
        return made[-1]

    monkeypatch.setattr(retrieval, "overlaps", counted)
    monkeypatch.setattr(retrieval, "BUDGET", 60)
    common = " ".join(f"all{i}" for i in range(10))
    blocks = [(i, f"b{i}", f"{common} r{i % 200}") for i in range(2000)] + [(2000, "tiny", "zz")]
    asked = spark.createDataFrame([(1, f"{common} r5 r7"), (2, "zz")], "id long, q string")
    got = {x.id: (x.blocks, x.truncated) for x in retrieval.ranked_blocks(asked, "id", "q", spark.createDataFrame(blocks, "place int, name string, block string"), 300).collect()}
    assert got == {1: ("b5,b7,b205,b207,b405,b407", True), 2: ("tiny", False)}
    assert made[0].count() == 21


def test_schema_blocks_are_all_named(spark, tmp_path):
    """Blocks behind the cut are named too: a question with terms of all six gets six."""
    import tessella.queries  # noqa: F401
    from tessella.registry import QUERIES

    asked = "of the in re p_partkey is"
    spark.createDataFrame([(1, asked), (2, "Is it at"), (3, "none_of_it"), (4, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.item_id: (x.blocks, x.truncated) for x in QUERIES["t26_schema_blocks"](spark, str(tmp_path)).collect()}
    every = "customer,events,nation,orders,part,region"
    assert got == {1: ("nation,customer,events,orders,part,region", True), 2: ("region,orders", False), 3: (every, True), 4: (every, True)}


def test_quantiles_equal_the_median(spark):
    import statistics

    from tessella.operators.metrics import quantiles

    r = random.Random(1)
    rows = [("hot", float(r.randrange(50))) for _ in range(3001)] + [(f"g{i % 7}", r.random()) for i in range(100)] + [(None, 3.0), ("one", 5.0), ("nulls", None), ("hot", None)]
    got = {x.g: (x.lo, x.mid, x.q) for x in quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), "g", "v", {"lo": 0.0, "mid": 0.5, "q": 0.9}).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, values in groups.items():
        q = sorted(values)[0] if len(values) == 1 else statistics.quantiles(values, n=10, method="inclusive")[8]
        assert got[g] == pytest.approx((min(values), statistics.median(values), q))
