import random
import re
from itertools import combinations

import pyarrow as pa
import pytest

from tessella.llm import ngram_join
from tessella.llm.ngram_join import Threshold, jaccard_components, trie_links
from tessella.llm.words import shingle_set, words

SPACE = re.compile("[^\x20\x09-\x0d]+")


def shingle_sets(text):
    w = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(rows):
    sets = [(i, shingle_sets(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed, n=70):
    r = random.Random(seed)
    base = [[r.choice("abcdefghijklmnopqrstuvwxyz") * r.randint(1, 3) for _ in range(r.choice([3, 4, 5, 6, 7, 9, 20, 60, 150]))] for _ in range(12)]
    passage = [f"p{k}" for k in range(55)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = f"e{r.randrange(50)}"
        if r.random() < 0.3:
            at = r.randrange(len(w))
            w[at:at] = passage
        rows.append((i, r.choice([" ", "\n", "\t "]).join(w).replace("ab", "AB")))
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "a b c d"), (1006, "É a b c"), (1007, "é a b c")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 8)  # so that blocks have several chunks
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, key string, n int, block int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == brute(rows)


def test_hot_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 16)
    r = random.Random(3)
    base = [f"w{r.randrange(9999)}" for _ in range(80)]
    rows = [(i, " ".join(base[:k] + [f"n{i}"] + base[k + 1 :])) for i, k in ((i, r.randrange(80)) for i in range(80))]
    rows += [(i, " ".join(base)) for i in range(200, 260)] + [(300 + i, " ".join(base[:50] + [f"z{r.randrange(9999)}" for _ in range(30)])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_components(docs).collect()}
    assert got == brute(rows)


def test_trie_gives_every_link_to_queries():
    r = random.Random(5)
    texts = [" ".join(r.choice("ab") + str(r.randrange(12)) for _ in range(r.randint(5, 12))) for _ in range(60)]
    sets = [shingle_set(h) for _, _, _, h in words(pa.array(texts))]
    t = Threshold(50, 100)
    want = {(q, i) for q, a in enumerate(texts) for i, b in enumerate(texts) if 100 * len(shingle_sets(a) & shingle_sets(b)) >= 50 * len(shingle_sets(a) | shingle_sets(b))}
    assert set(trie_links(sets, sets, t)) == want


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_texts_and_words():
    long = "x" * 2_500_000
    a = [h.tolist() for _, _, _, h in words(pa.array([long, "a " + long + " b", None, "X" * 2_500_000]))]
    assert a[0] == a[3] and a[1][1] == a[0][0] and a[2] == [] and len(a[1]) == 3
