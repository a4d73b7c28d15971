import random
import re
from itertools import combinations

import numpy as np
import pytest

from tessella.llm import near_dedup
from tessella.llm.ngram_join import Threshold
from tessella.llm.words import U

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()


def brute(rows, num=80):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= num * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


def result(spark, rows, schema="doc_id long, text string", threshold=None):
    got = near_dedup.near_dedup(spark.createDataFrame(rows, schema), threshold).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}, len(got)


def corpus(seed):
    """Texts with chains of edits, so that many pairs lie close to the threshold on either side."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(3)) for _ in range(400)]
    rows = []
    for _ in range(10):
        text = [r.choice(words) for _ in range(r.choice([1, 2, 3, 5, 6, 9, 30, 120]))]
        for _ in range(r.choice([1, 4, 12])):
            rows.append(" ".join(text))
            if len(text) > 4:
                text = list(text)
                for _ in range(max(1, len(text) // r.choice([9, 14, 30]))):
                    text[r.randrange(len(text))] = r.choice(words)
    r.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    assert result(spark, rows)[0] == brute(rows)


def test_no_link_is_lost_around_a_hub(spark):
    """A chain whose ends are far apart, and members that link with a hub's partners only, among one large group."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows, text = [], list(base)
    for i in range(80):
        rows.append((i, " ".join(text)))
        text = list(base if i % 9 == 0 else text)
        for _ in range(2):
            text[r.randrange(60)] = f"x{r.randrange(500)}"
    assert result(spark, rows)[0] == brute(rows)


def test_left_over_buckets_meet_by_full_sets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "ROUNDS", 1)
    rows = corpus(3)
    assert result(spark, rows)[0] == brute(rows)


def test_parts_of_a_large_hub(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PART", 3)
    rows = [(i, " ".join([*(f"w{k}" for k in range(50)), f"tail{i}"])) for i in range(40)]
    assert {c for _, c, _ in result(spark, rows)[0].values()} == {0}


def test_other_threshold(spark):
    rows = corpus(4)
    assert result(spark, rows, threshold=Threshold(90))[0] == brute(rows, 90)


def test_edge_rows(spark):
    long = " ".join(f"w{i % 7000}" for i in range(60000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Ab"), (5, "aB"), (6, "ab cd"), (7, long), (8, long + " end"), (9, "Ä b"), (10, "ä b"), (None, "ab cd"), (None, None), (6, "ab cd"), (6, "other words here")]
    got = near_dedup.near_dedup(spark.createDataFrame([(i, t, "x", None, 0, "k", 7) for i, t in rows], SCHEMA + ", node string, component long")).collect()
    assert len(got) == len(rows)
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr)
    expected = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (6, 1, 6, True), (6, 2, 6, True), (7, 7000, 7, True), (8, 7001, 7, False), (9, 1, 9, True), (10, 1, 10, True)]
    assert found == sorted([*expected, (None, 1, 6, None), (None, 0, None, None)], key=repr)


def test_empty_table(spark):
    assert near_dedup.near_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("n, changed", [(5, 0), (9, 1), (60, 6), (900, 90)])
def test_bins_agree_with_the_chance_of_the_similarity(n, changed):
    r = np.random.default_rng(n)
    equal, total = 0, 300
    for _ in range(total):
        tokens = r.integers(0, 2**63, n + changed).astype(U)
        a, b = np.sort(tokens[:n]), np.sort(tokens[changed:])
        equal += int(np.count_nonzero(near_dedup.bins(a) == near_dedup.bins(b)))
    assert abs(equal / total / near_dedup.BINS - (n - changed) / (n + changed)) < 0.03


def test_bands_of_small_sets_are_independent():
    """Four of five elements shared: the bands that agree are spread as those of independent bins."""
    r, counts = np.random.default_rng(1), []
    for _ in range(400):
        tokens = r.integers(0, 2**63, 5).astype(U)
        counts.append(int(np.count_nonzero(near_dedup.bands(near_dedup.bins(np.sort(tokens))) == near_dedup.bands(near_dedup.bins(np.sort(tokens[:4]))))))
    assert min(counts) > 0 and abs(np.mean(counts) / near_dedup.BANDS - 0.8**near_dedup.ROWS) < 0.04
