import math
import random

import numpy as np

from tessella.llm import topk
from tessella.llm.topk import statistics, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank int, v int"


def brute(rows, asked, k):
    ok = lambda e: e and all(x is not None and math.isfinite(x) for x in e)
    ints = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e in rows if i is not None and ok(e)]
    out = []
    for q, v in ints:
        if asked(q):
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ints if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "ROWS", 50)
    r = random.Random(1)
    base = [[r.gauss(0, 0.2) for _ in range(24)] for _ in range(20)]
    rows = [(i, [x + r.choice([0, r.gauss(0, 0.02)]) for x in r.choice(base)]) for i in range(400)]
    rows += [(1000, None), (1010, []), (1020, [float("nan")] + [0.1] * 23), (1030, [None] * 24), (1040, [float("inf")] * 24), (1050, [0.5, 0.25, -1.0]), (1060, [0.5, 0.5, 1.0]), (1070, [0.0] * 24), (1080, [-900.0] * 24), (None, [0.1] * 24)]
    docs = spark.createDataFrame([(i, e, 1, 2, 3, 4) for i, e in rows], SCHEMA).repartition(5)
    got = sorted(tuple(x) for x in top_k(docs, docs.where("vec_id % 10 = 0"), 10).collect())
    assert got == brute(rows, lambda q: q % 10 == 0, 10)


def test_large_components(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(24)]) for i in range(200)]
    rows += [(300, [2.0**21] + [0.5] * 23), (301, [-(2.0**22)] * 24), (303, [3.0e6, *[1.0] * 23]), (310, [2.0**20] * 24)]
    rows += [(311, [2.0**43] + [-0.25] * 23), (313, [0.0, -(2.0**42), *[0.0] * 22])]
    docs = spark.createDataFrame([(i, e, 1, 2, 3, 4) for i, e in rows], SCHEMA).repartition(3)
    got = sorted(tuple(x) for x in top_k(docs, docs.where("vec_id < 300 and vec_id % 10 = 0"), 10).collect())
    assert got == brute(rows, lambda q: q < 300 and q % 10 == 0, 10)
    got = sorted(tuple(x) for x in top_k(docs.where("vec_id < 311"), docs.where("vec_id in (300, 310)"), 10).collect())
    assert got == brute(rows[:-2], lambda q: q in (300, 310), 10)
    # Products of the outliers with one another leave 64 bits below the best ten.
    few = [x for x in rows if x[0] < 20 or x[0] in (311, 301)]
    got = sorted(tuple(x) for x in top_k(docs.where("vec_id < 20 or vec_id in (311, 301)"), docs.where("vec_id = 301"), 10).collect())
    assert got == brute(few, lambda q: q == 301, 10)


def test_bounds_hold():
    r = np.random.default_rng(1)
    a, b = r.normal(0, 300, (50, 30)), r.normal(50, 300, (60, 30))
    last = np.full((50, 60), np.inf)
    for x, y in zip(statistics(a), statistics(b), strict=True):
        bound = x @ y.T
        assert (bound >= a @ b.T - 1e-6).all()
        assert bound.mean() <= last.mean()
        last = bound


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert top_k(none, none).collect() == []


def test_bounds_leave_few_pairs_to_compute(monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 200)
    r = np.random.default_rng(3)
    centres = r.normal(0, 300, (30, 64))
    rows = np.floor(centres[r.integers(0, 30, 3000)] + r.normal(0, 40, (3000, 64))).astype(np.int64)
    best = topk.Best(np.arange(50), rows[:50], 10)
    for chunk in topk._chunks([(np.arange(3000), rows)]):
        best.add(chunk)
    # Each level leaves fewer, and what is computed in the end is a small part of all.
    assert best.pairs > best.left[0] > best.left[1] >= best.left[2]
    assert best.left[-1] < 0.2 * best.pairs
    for i in range(50):
        s = rows @ rows[i]
        want = sorted((-int(x), j) for j, x in enumerate(s) if j != i)[:10]
        assert [(-int(x), int(j)) for x, j in zip(best.scores[i], best.found[i], strict=True)] == want


def test_repeated_queries_and_rows(spark):
    rows = [(100, [1.0, 0.5]), (100, [1.0, 0.5]), (100, [-1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.25, 0.0])]
    docs = spark.createDataFrame([(i, e, 1, 2, 3, 4) for i, e in rows], SCHEMA)
    got = sorted(tuple(x) for x in top_k(docs, docs.where("vec_id = 100"), 2).collect())
    near = 512 * 1024 + 512 * 512
    assert got == sorted([(100, 1, 1, near), (100, 2, 1, near)] * 2 + [(100, 1, 2, -256 * 1024), (100, 2, 1, -512 * 1024)])
