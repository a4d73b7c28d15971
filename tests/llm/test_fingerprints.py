import hashlib
import random
import re

import pytest
import xxhash

from tessella.llm.fingerprints import K, SKETCHES, SLIDE, TOKEN, edited_fingerprints, fingerprints

PLACE = (1 << 24) - 1
SCHEMA = "doc_id long, text string, sketch int, next_text string, n_chars int"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(*values):
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else (v % (1 << 64)).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def int_hash(a, n):
    """xxhash64 of a long and an int."""
    h = spark_hash(a)
    p = [0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5]
    m = (1 << 64) - 1
    h = (h + p[4] + 4) & m
    h ^= (n * p[0]) & m
    h = (((h << 23 | h >> 41) & m) * p[1] + p[2]) & m
    h ^= h >> 33
    h = h * p[1] & m
    h ^= h >> 29
    h = h * p[2] & m
    return h ^ h >> 32


def tokens(text):
    """Tokens by the definition: at every character up to the end of long runs, there and else one after the other."""
    out = []
    for run in re.findall(r"[^\t\n\x0b\f\r ]+", text or ""):
        at = 0
        while at < len(run):
            out.append(run[at : at + TOKEN])
            at += 1 if len(run) - at > SLIDE else TOKEN
    return out


def brute(text):
    """Sketches by the definition, in order of the signed hash."""
    t = tokens(text)
    mers = [spark_hash(*t[i : i + K]) for i in range(len(t) - K + 1)] or ([spark_hash(" ".join(t))] if t else [])
    seen, elements = {}, []
    for i, h in enumerate(mers):
        h &= ~PLACE
        n = seen[h] = seen.get(h, -1) + 1
        elements.append(((h if n == 0 else int_hash(h, n) & ~PLACE), i))
    order = sorted(elements, key=lambda e: (signed(e[0]), e[1]))
    words, tops = [], set()
    for k, (h, i) in enumerate(order):
        top = h >> 59
        if top not in tops:
            tops.add(top)
            after = order[(k + 1) % len(order)]
            pair = [x for x, _ in sorted([(h, i), after], key=lambda e: e[1])] if len(order) > 1 else [h]
            words.append(top << 59 | spark_hash(*pair) >> 5)
    return words


def like(a, b):
    present = {x >> 59 for x in a} | {x >> 59 for x in b}
    return len(set(a) & set(b)) / len(present) if present else 1.0


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    v = ["".join(r.choice("abcdeéß的😀") for _ in range(r.randint(1, 20))) for _ in range(60)]
    rows = [(i, r.choice([" ", "\n", "  "]).join(r.choice(v) for _ in range(r.choice([0, 1, 2, 3, 5, 40, 300])))) for i in range(80)]
    rows += [(600 + n, "".join(r.choice("abcdeéß的😀") for _ in range(n)) + r.choice(["", " end", "\nab cd"])) for n in (24, 25, 36, 48, 49, 50, 97, 400)]
    return rows + [(500, None), (501, ""), (502, rows[7][1]), (503, "in " * 500), (504, "word " * 3000 + "end"), (7, "repeated id")]


@pytest.mark.parametrize("parts", ["1", "3"])
def test_against_the_definition(spark, rows, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA).repartition(4)
    got = edited_fingerprints(docs).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(rows, key=lambda x: -x[0])
    # Two rows share doc_id 7; they follow in the order of their hashes.
    order.sort(key=lambda x: (-x[0], signed(spark_hash(x[1] or ""))))
    want = {}
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        t, n = t or "", n or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + n[:cut]
        a, b, c = brute(t), brute(edited), brute(n)
        text = lambda s: "".join(f"{x:016x}" for x in s)
        want[i, len(t)] = (hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), like(a, b), like(a, c))
    assert len(got) == len(rows)
    for x in got:
        assert tuple(x)[2:] == want[x.doc_id, x.n_chars], x.doc_id


def test_likeness_follows_edits_and_order(spark):
    r = random.Random(2)
    w = [f"w{r.randrange(9999)}" for _ in range(900)]
    moved = w[450:] + w[:450]
    other = [f"w{r.randrange(9999)}" for _ in range(900)]
    texts = [w, moved, w[:850] + other[:50], other]
    f = {x.doc_id: [x.fingerprint[k : k + 16] for k in range(0, len(x.fingerprint), 16)] for x in fingerprints(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    near = lambda i: len(set(f[0]) & set(f[i])) / SKETCHES
    assert near(2) > 0.7 > near(1) > near(3) and near(3) < 0.1


def test_empty_and_alone(spark):
    assert edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    x = edited_fingerprints(spark.createDataFrame([(5, "abc def ghi")], "doc_id long, text string")).first()
    assert x.near_next == 1.0 and x.n_chars == 11
    assert len(edited_fingerprints(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")).collect()) == 2


def sketch_sets(spark, texts):
    got = fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {x.doc_id: {x.fingerprint[k : k + 16] for k in range(0, len(x.fingerprint), 16)} for x in got}


def test_texts_without_spaces_survive_an_insertion(spark):
    r = random.Random(3)
    text = "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(3000))
    f = sketch_sets(spark, [text, "的" + text, text[:1500] + "的" + text[1500:], text[1500:] + text[:1500], "".join(reversed(text))])
    near = lambda i: len(f[0] & f[i]) / SKETCHES
    assert near(1) > 0.85 and near(2) > 0.85 and near(3) < near(2) - 0.2 and near(4) == 0


def test_short_texts_see_their_order(spark):
    r = random.Random(4)
    low = []
    for _ in range(30):
        w = [f"w{r.randrange(99999)}" for _ in range(24)]
        f = sketch_sets(spark, [" ".join(w), " ".join(w[12:] + w[:12])]) if len(low) < 3 else None
        if f is None:
            break
        low.append(len(f[0] & f[1]) / len(f[0] | f[1]))
    # The same k-mers but two in another order: plain MinHash would see 0.8 and more in common.
    assert max(low) < 0.75
