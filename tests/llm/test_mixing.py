import random
import re

import numpy as np
import pytest

from tessella.llm import mixing
from tessella.llm.mixing import NONE, PROSE, Targets, mixed, rake, sampled, target_shares

SCHEMA = "doc_id long, text string, lang string, source string, topic string, n_tokens int, selected int, weight int"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    out = []
    for i in range(3000):
        words = [r.choice(["the", "cat", "sat", "down", "Here"]) for _ in range(r.randint(5, 80))]
        text = " ".join(words)
        if i % 7 == 0:
            text = " | ".join(words)
        if i % 11 == 0:
            text = text.upper()
        source = "hot" if r.random() < 0.4 else r.choice(["a", "b", "c"])
        out.append((i, text, r.choice(["en", "en", "fr"]), source, "x", 1, 2, 3))
    return out + [(9000, None, None, None, "x", 1, 2, 3), (9001, "", "en", "a", "x", 1, 2, 3), (5, out[5][1], *out[5][2:]), (None, "some words here", "en", "a", "x", 1, 2, 3)]


def test_rake_is_the_fitting_of_margins():
    r = np.random.default_rng(1)
    have = r.uniform(50, 100, 24)
    levels = [np.arange(24) % 4, np.arange(24) // 4 % 3, np.arange(24) // 12]
    shares = [np.array([0.2, 0.3, 0.3, 0.2]), np.array([0.4, 0.35, 0.25]), np.array([0.45, 0.55])]
    total = 0.3 * have.sum()
    got = rake(have, levels, shares, total, 500)
    want = have.copy()
    for _ in range(2000):
        for level, share in zip(levels, shares, strict=True):
            want *= (share * total / np.bincount(level, want))[level]
    assert np.allclose(got, want, rtol=1e-6) and (got <= have).all()
    for level, share in zip(levels, shares, strict=True):
        assert np.allclose(np.bincount(level, got), share * total, rtol=1e-6)


def test_rake_never_takes_more_than_there_is():
    have = np.array([10.0, 1000.0])
    assert rake(have, [np.array([0, 1])], [np.array([0.5, 0.5])], 505.0, 100) == pytest.approx([10.0, 252.5])
    both = rake(np.array([5.0, 100.0, 100.0]), [np.array([0, 0, 1])], [np.array([0.6, 0.4])], 100.0, 100)
    assert both[0] + both[1] == pytest.approx(60) and both[0] <= 5 and both[2] == pytest.approx(40)


def test_target_shares():
    assert target_shares({"a": 16.0, "b": 81.0, "c": 1.0}, {"c": 0.3, "absent": 9}, 0.5) == pytest.approx({"c": 0.3, "a": 0.7 * 4 / 13, "b": 0.7 * 9 / 13})


def test_margins_and_sample(spark, rows):
    targets = Targets(share=0.4, weights={"lang": {"fr": 0.45}, "source": {"hot": 0.25}, "topic": {PROSE: 0.6}})
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = [x.asDict() for x in mixed(docs, targets).collect()]
    assert len(got) == len(rows)
    total = sum(x["n_tokens"] for x in got)
    assert total == sum(len(re.findall(r"\S+", r[1] or "")) for r in rows)
    taken = lambda **k: sum(x["n_tokens"] * x["probability"] for x in got if all(x[a] == b for a, b in k.items()))
    assert taken() == pytest.approx(0.4 * total, rel=1e-3)
    assert taken(lang="fr") == pytest.approx(0.45 * taken(), rel=1e-3)
    assert taken(source="hot") == pytest.approx(0.25 * taken(), rel=1e-2)
    assert taken(topic=PROSE) == pytest.approx(0.6 * taken(), rel=1e-2)
    chosen = sum(x["n_tokens"] for x in got if x["selected"])
    assert chosen == pytest.approx(taken(), rel=0.1)
    assert [x["source"] for x in got if x["doc_id"] == 9000] == [NONE]
    out = sampled(docs, targets)
    assert out.columns == docs.columns
    key = lambda ids: sorted(ids, key=lambda i: (i is None, i))
    assert key(x.doc_id for x in out.collect()) == key(x["doc_id"] for x in got if x["selected"])


def test_rows_without_doc_id_are_drawn_one_by_one(spark):
    rows = [(None, f"text number {k} of many others in prose " * 4, "en", "s", "x", 1, 2, 3) for k in range(400)]
    got = mixed(spark.createDataFrame(rows, SCHEMA), Targets(share=0.5)).collect()
    assert {round(x.probability, 6) for x in got} == {0.5} and 150 < sum(x.selected for x in got) < 250


def test_every_level_keeps_its_share(spark):
    # 300 sources; the rarest is named, as in a corpus of many domains.
    rows = [(k, "word " * (300 - k // 4 % 300 + 20), "en", f"s{k // 4 % 300}", "x", 1, 2, 3) for k in range(1200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixed(docs, Targets(share=0.3, weights={"source": {"s299": 0.001}})).collect()
    assert {x.source for x in got} == {f"s{k}" for k in range(300)}
    taken = lambda s: sum(x.n_tokens * x.probability for x in got if s in (None, x.source))
    assert taken("s299") == pytest.approx(0.001 * taken(None), rel=1e-6)
    want = target_shares({f"s{k}": 4.0 * (300 - k + 20) for k in range(300)}, {"s299": 0.001}, 0.7)
    assert all(taken(s) == pytest.approx(want[s] * taken(None), rel=1e-6) for s in ("s0", "s205", "s298"))
    with pytest.raises(ValueError, match="absent"):
        mixed(docs, Targets(weights={"source": {"absent": 0.1}}))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixed(none).collect() == [] and sampled(none).collect() == []


def test_brute_force_of_the_query(spark, rows):
    """Cells, probabilities and the draw by plain Python."""
    from tests.llm.test_fingerprints import signed, spark_hash

    def topic(t):
        if len(t or "") < 80:
            return "short"
        for name, pattern, per in mixing.TOPICS:
            if len(re.findall(pattern, t)) * 100 >= per * len(t):
                return name
        return PROSE

    targets = Targets(share=0.4, weights={"lang": {"fr": 0.45}, "topic": {PROSE: 0.6}})
    cell = lambda x: (x[3] or NONE, x[2] or NONE, topic(x[1]))
    have = {}
    for x in rows:
        have[cell(x)] = have.get(cell(x), 0) + len((x[1] or "").split())
    names = sorted(have)
    n = np.array([have[c] for c in names], float)
    levels, shares = [], []
    for m, margin in enumerate(mixing.MARGINS):
        known = sorted({c[m] for c in names})
        levels.append(np.array([known.index(c[m]) for c in names]))
        wanted = target_shares({k: float(sum(have[c] for c in names if c[m] == k)) for k in known}, targets.weights.get(margin, {}), targets.power)
        shares.append(np.array([wanted[k] for k in known]))
    p = dict(zip(names, rake(n, levels, shares, 0.4 * n.sum(), 200) / np.maximum(n, 1), strict=True))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = mixed(docs, targets).collect()
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
    for x in rows:
        # A null changes nothing in a hash of several values.
        draw = (signed(spark_hash("mixing", *(v for v in x[:2] if v is not None))) % (1 << 52)) / (1 << 52)
        assert any((y.source, y.lang, y.topic) == cell(x) and y.probability == pytest.approx(p[cell(x)], rel=1e-9) and y.selected == (draw < p[cell(x)]) for y in by[x[0]])
