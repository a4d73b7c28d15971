import random
import re
import zlib
from collections import Counter

import pytest

from tessella.llm import spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def counts(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_near(words):
    near = {w: [] for w in words}
    for i, a in enumerate(words):
        for b in words[:i]:
            if abs(len(a) - len(b)) <= 1 and one_edit(a, b):
                near[a].append(b), near[b].append(a)
    return near


def brute(rows):
    n = counts(rows)
    near = brute_near(list(n))
    form = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: f if f is not None and n[f] >= 2 * n[w] else None for w, f in form.items()}
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def texts(seed, letters="abcà", docs=60):
    """Short words of few letters, so that most have several near words, and chains of forms."""
    r = random.Random(seed)
    words = ["".join(r.choice(letters) for _ in range(r.randint(4, 9))) for _ in range(80)]
    words += [w[:i] + r.choice(letters) + w[i + r.randint(0, 1) :] for w in words for i in range(0, len(w), 2)]
    weights = [2 ** r.randint(0, 6) for _ in words]
    return [(i * 7, " ".join(r.choices(words, weights, k=60)).title() + ".") for i in range(docs)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = texts(seed)
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(brute(rows))


def pairs(spark, words):
    got = [tuple(r) for r in spelling.near_pairs(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")).collect()]
    assert len(got) == len(set(got))  # each pair from one block only
    return sorted((a, b) for a, b, _ in got)


def expected(words):
    return sorted((a, b) for a, near in brute_near(words).items() for b in near)


@pytest.mark.parametrize("weight", [1, 40, 400])
def test_split_blocks(spark, monkeypatch, weight):
    """Whatever a block may hold, each pair comes once; words of repeated letters part in several places."""
    monkeypatch.setattr(spelling, "WEIGHT", weight)
    r = random.Random(3)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(5, 9))) for _ in range(260)} | {"a" * k for k in range(5, 12)} | {"ab" * k for k in range(3, 7)})
    assert pairs(spark, words) == expected(words)


def test_hot_beginnings_and_ends(spark, monkeypatch):
    monkeypatch.setattr(spelling, "WEIGHT", 200)
    r = random.Random(4)
    words = sorted({"prefix" * 4 + "".join(r.choice("xyz") for _ in range(4)) for _ in range(60)} | {"".join(r.choice("xyz") for _ in range(4)) + "suffix" * 4 for _ in range(60)})
    assert pairs(spark, words) == expected(words)


def test_trie_gives_each_pair_once():
    r = random.Random(5)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(0, 6))) for _ in range(300)})
    got = [tuple(sorted((words[i], words[j]))) for i, j in spelling.Trie(words).near(99)]
    assert len(got) == len(set(got))
    assert sorted(got) == sorted({tuple(sorted(p)) for p in expected(words)})


def test_roots_follow_long_chains(spark):
    rows = [(f"w{i:02}", f"w{i + 1:02}") for i in range(40)] + [("x", "w10")]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(rows, "word string, form string")).collect()))
    assert got == {w: "w40" for w, _ in rows}


def test_edge_rows(spark):
    long = "Äb" * 20_000
    rows = [(None, "Hello hello, HELLO"), (1, None), (2, ""), (3, "hallo×hallo hallo-hallo hello_hello"), (3, "hallo hallo ÉCOLE école École"), (3, "hallo hallo ÉCOLE école École"), (4, f"{long} {long}c {long} {long}c {long} {long}c")]
    shown = spark.createDataFrame([(*r, "x", None, 1, "clash", 5) for r in rows], SCHEMA + ", word string, n int")
    assert {tuple(r) for r in spelling.variants(shown).collect()} == brute(rows)


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).collect() == []
