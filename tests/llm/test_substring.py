import random

import numpy as np
import pyarrow as pa

from tessella.llm.substring import _SALTS, REACH, WORDS, anchors, drop_repeats, repeats, spans
from tessella.llm.words import mix, shingles, words

EXTRA = "doc_id long, text string, start string, exact int, n_chars long"


def vocabulary(r):
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(3000)]


def corpus(seed=1):
    r = random.Random(seed)
    v = vocabulary(r)
    passages = [[r.choice(v) for _ in range(r.randint(51, 70))] for _ in range(6)]
    rows, planted = [], {}
    for i in range(60):
        w = [r.choice(v) for _ in range(r.randint(30, 200))]
        if i % 2:
            p = i // 2 % 6
            at = r.randrange(len(w))
            w[at:at] = passages[p]
            planted.setdefault(p, []).append(i)
        rows.append((i, " ".join(w)))
    near = [r.choice(v) for _ in range(300)]
    rows.append((100, " ".join(near)))
    rows.append((101, " ".join(w if k % 60 else "CHANGED" for k, w in enumerate(near))))
    rows += [(200, None), (201, ""), (202, "in " * 400), (203, "in " * 300), (204, "short text")]
    return rows, passages, planted


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, len(t or "")) for i, t in rows], EXTRA).repartition(3)


def test_every_shared_stretch_has_the_same_anchor():
    r = np.random.default_rng(1)
    h = r.integers(0, 50, 400).astype(np.uint64)
    a = set(anchors(h).tolist())
    for at in range(0, 400 - REACH - WORDS + 2):
        assert any(at <= x < at + REACH for x in a)
    other = np.concatenate([r.integers(0, 50, 33).astype(np.uint64), h[100:149]])
    assert {x - 33 for x in anchors(other).tolist() if x >= 33} & {x - 100 for x in a if 100 <= x <= 124}


def test_planted_passages_are_cut_and_others_are_left_alone(spark):
    rows, passages, planted = corpus()
    docs = frame(spark, rows)
    found = spans(docs).collect()
    hit = {x.doc_id for x in found}
    want = {i for ids in planted.values() for i in ids[1:]}
    assert hit == want | {101}
    of = {i: ids[0] for ids in planted.values() for i in ids[1:]} | {101: 100}
    assert all(x.keep_doc_id == of[x.doc_id] and x.n_words >= WORDS for x in found)
    out = {x.doc_id: x for x in drop_repeats(docs).collect()}
    before = dict(rows)
    assert set(out) == set(before) and drop_repeats(docs).columns == docs.columns
    for i, x in out.items():
        if i not in hit:
            assert x.text == before[i]
        else:
            assert x.n_chars == len(x.text) < len(before[i])
            gone = len(before[i].split()) - len(x.text.split())
            assert gone == sum(y.n_words for y in found if y.doc_id == i)
            assert 25 <= gone
    for p, ids in planted.items():
        assert [i for i in ids if " ".join(passages[p]) in out[i].text] == ids[:1]


def test_near_passages(spark):
    r = random.Random(4)
    v = vocabulary(r)
    base = [r.choice(v) for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        w = list(base)
        w[r.randrange(120)] = "edit"
        rows.append((i, " ".join([r.choice(v) for _ in range(100)] + w)))
    assert {x.doc_id for x in spans(frame(spark, rows)).collect()} == set(range(1, 40))


def test_bucket_led_by_an_unrelated_paragraph(spark):
    r = random.Random(5)
    v = vocabulary(r)
    base = [r.choice(v) for _ in range(120)]
    # Earlier documents have each five-word phrase of the passage in other surroundings.
    rows = []
    for at in range(116):
        for _ in range(8):
            rows.append((len(rows), " ".join([r.choice(v) for _ in range(40)] + base[at : at + 5] + [r.choice(v) for _ in range(40)])))
    rows.append((5000, " ".join(base)))
    rows += [(5001 + k, " ".join(w if (i + k) % 40 else f"edit{k}" for i, w in enumerate(base, 1))) for k in range(6)]
    got = {(x.doc_id, x.start) for x in repeats(frame(spark, rows)).collect()}
    assert got == brute_repeats(rows) and {i for i, _ in got} == set(range(5001, 5007))


def brute_repeats(rows):
    """doc_id, start of the removed paragraphs: all pairs that share a MinHash are compared."""
    held, buckets = {}, {}
    for i, _, _, h in words(pa.array([t for _, t in rows])):
        sh = shingles(h)
        for start in anchors(h).tolist():
            row = sh[start : start + WORDS - 4]
            held[rows[i][0], start] = set(row.tolist())
            for salt in _SALTS:
                buckets.setdefault(int(mix(row * salt).min() ^ salt), []).append((rows[i][0], start))
    root = {x: x for x in held}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for members in buckets.values():
        for x in members:
            for y in members:
                if x < y and len(held[x] & held[y]) >= 0.75 * len(held[x] | held[y]):
                    root[max(find(x), find(y))] = min(find(x), find(y))
    return {x for x in held if find(x)[0] != x[0]}


def test_empty(spark):
    assert spans(frame(spark, [])).collect() == []
    assert drop_repeats(frame(spark, [])).collect() == []


def test_short_texts_have_no_paragraph():
    assert all(len(anchors(h)) == 0 for _, _, _, h in words(pa.array(["a b c", None, ""])))


def test_whole_passages_go(spark):
    """A shared passage is cut to its last word, wherever its anchors are."""
    r = random.Random(11)
    v = vocabulary(r)
    rows, passages = [], []
    for p in range(40):
        passage = [f"p{p}w{k}" + r.choice(v) for k in range(r.randint(50, 75))]
        passages.append(passage)
        for _ in range(2):
            rows.append((len(rows), " ".join([*(f"a{len(rows)}x{k}" for k in range(r.randint(0, 40))), *passage, *(f"b{len(rows)}x{k}" for k in range(r.randint(0, 40)))])))
    docs = frame(spark, rows)
    found = spans(docs).collect()
    assert len(found) == 40
    for x in found:
        w = dict(rows)[x.doc_id].split()[x.start_word : x.end_word]
        # A paragraph that holds the passage's end is near another one, with some words of its own.
        assert [y for y in w if y[0] == "p"] == passages[x.doc_id // 2] and len(w) - len(passages[x.doc_id // 2]) <= 12 and x.keep_doc_id == x.doc_id - 1


def test_cycled_lines_repeated_rows_and_long_texts(spark):
    r = random.Random(12)
    v = vocabulary(r)
    line = "one two three four five six "
    own = lambda: " ".join(r.choice(v) for _ in range(60))
    long = " ".join(r.choice(v) for _ in range(200_000))
    rows = [(None, own()), (1, own() + " " + line * 12), (2, own() + " " + line * 12 + own()), (3, long), (4, long), (5, "x y " * 30 + own()), (5, "x y " * 30 + own())]
    got = spans(frame(spark, rows)).collect()
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x.n_words)
    assert set(by) == {2, 4} and by[4] == [200_000] and by[2][0] >= 48
