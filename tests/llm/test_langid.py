import random
import zlib

import numpy as np
import pytest

from tessella.llm.langid import Network, Settings, fitted, language_id, sample, spread, train, windows

WORDS = {"aa": ["the", "and", "with", "shing", "ation"], "bb": ["der", "ung", "schei", "ßen", "über"], "cc": ["él", "ción", "que", "ñas", "llos"]}


def text(r, lang, n):
    return " ".join("".join(r.choice(WORDS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    out = []
    for i in range(400):
        lang = r.choice(sorted(WORDS))
        out.append((i, text(r, lang, r.randint(5, 80)), lang, lang, 1))
    return out + [(1000, None, "aa", "x", 1), (1001, "", "aa", "x", 1), (1002, "12 ## 34", "bb", "x", 1), (1003, text(r, "bb", 60_000), None, "x", 1), (None, text(r, "cc", 9), "cc", "x", 1)]


SCHEMA = "doc_id long, text string, lang string, lang_pred string, score int"


def test_held_out_accuracy(spark, rows):
    got = language_id(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = {i: (lang, t) for i, t, lang, _, _ in rows}
    assert len(got) == len(rows)
    for x in got:
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
        assert 0 <= x.score <= 1
        if x.doc_id in (1000, 1001, 1002):
            assert x.lang_pred == "und"
    assert next(x.lang_pred for x in got if x.doc_id == 1003) == "bb"
    out = [x for x in got if x.held_out and x.doc_id < 1000]
    assert len(out) > 50 and np.mean([x.lang_pred == want[x.doc_id][0] for x in out]) > 0.95


def test_gradients_match_differences():
    net = Network(["a", "b"], Settings(window=16, embed=2, widths=(2, 3), filters=3, stride=2))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x, y = r.integers(0, 256, (5, 16)).astype(np.uint8), np.array([0, 1, 0, 1, 1])
    loss = lambda: -np.log(net.probabilities(x)[np.arange(5), y]).mean()
    g = net.gradients(x, y)
    for k in g:
        flat = np.argwhere(np.abs(g[k]) > 1e-3)[:4]
        for at in map(tuple, flat):
            net.p[k][at] += 1e-6
            up = loss()
            net.p[k][at] -= 2e-6
            down = loss()
            net.p[k][at] += 1e-6
            assert abs((up - down) / 2e-6 - g[k][at]) < 1e-4


def test_no_labels_and_empty(spark):
    assert {x.lang_pred for x in language_id(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}
    assert language_id(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
    assert train([], []).languages == []


def test_windows():
    x, held = windows(np.arange(1, 131).astype(np.uint8), 128)
    assert x.shape == (2, 128) and held.tolist() == [128, 2] and x[1, 2:].sum() == 0
    assert windows(np.zeros(0, np.uint8), 128)[1].tolist() == [0]


def test_windows_are_spread_over_the_whole_text():
    s = Settings(window=16, pieces=4)
    x = spread("a" * 160 + "b" * 160, s)
    assert [bytes(w) for w in x] == [b"a" * 16, b"a" * 16, b"b" * 16, b"b" * 16]
    assert len(spread("ab", s)) == 1 and len(spread(" \n", s)) == 1 and len(spread("a" * 17, s)) == 1


def test_sample_is_the_smallest_hashes(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    s = Settings(per_language=20)
    pieces, langs = sample(docs.repartition(5), s)
    again = sample(docs.unionByName(docs).repartition(2), s)
    assert langs == again[1] and all((a == b).all() for a, b in zip(pieces, again[0], strict=True))
    assert {lang: langs.count(lang) for lang in langs} == dict.fromkeys(WORDS, 20)
    # Every label is learned, however many there are and however rare.
    many = spark.createDataFrame([(i, f"{'abcdefghij'[i % 10]}x " * 9 + str(i), f"l{i}", "s", 9) for i in range(230)], docs.schema)
    assert set(sample(many, s)[1]) == {f"l{i}" for i in range(230) if zlib.crc32(str(i).encode()) % 5}


def test_brute_force_of_the_query(spark, rows):
    """Each row's answer against the network applied to its windows alone."""
    docs = spark.createDataFrame(rows, SCHEMA)
    net = fitted(docs)
    for x, (_, t, *_) in zip(sorted(language_id(docs).collect(), key=lambda x: (x.doc_id is None, x.doc_id)), rows, strict=True):
        if not t or not any(map(str.isalpha, t)):
            assert (x.lang_pred, x.score) == ("und", 0.0)
            continue
        w, held = windows(np.frombuffer(t.encode(), np.uint8), net.settings.window)
        p = (net.probabilities(w) * held[:, None]).sum(0) / held.sum()
        assert x.lang_pred == net.languages[p.argmax()] and abs(x.score - p.max()) < 1e-5
