import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessella.llm.token_binary import Words, frequency_ranks, pack, read, token_ids, unpack, write, written_and_read

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts(seed, n):
    r = random.Random(seed)
    letters = "abc \n\té'sÀÉ12<|>endoftext.,'tThe 'RE ĲŁſŸ×÷ßİΣş́ _"
    return ["".join(r.choice(letters) for _ in range(r.randrange(0, 40))) + r.choice(["", "<|endoftext|>", "it's we'LL"]) for _ in range(n)]


def test_coding_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (r.integers(0, 2**32, n) >> r.integers(0, 32, n)).astype(np.uint32)
        control, data = pack(v)
        assert unpack(control, data, n).tolist() == v.tolist()
        assert len(control) == -(-n // 4) and len(data) == sum(max(1, -(-int(x).bit_length() // 8)) for x in v)


def test_words_equal_the_library():
    words, library = Words(PATH), Tokenizer.from_file(PATH)
    some = texts(1, 4000)
    for text, ids in zip(some, words.encode(some), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    other = Words(public_tokenizers.path("byte_bpe_50k.json"))
    assert other.pattern is None and np.frombuffer(other.encode(["Hello you"])[0], "<u4").tolist() == other.library.encode("Hello you").ids


def test_files(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts(2, 150))] + [(500, None, 1, "x"), (501, "", 1, "x"), (7, "again", 1, "x"), (None, "no id", 1, "x"), (502, "long " * 90_000, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, ids string").repartition(4)
    library = Tokenizer.from_file(PATH)
    want = {}
    for i, t, *_ in rows:
        want.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    folder = write(docs, PATH, 2)
    got = read(spark, folder).orderBy("start").collect()
    assert [x.doc_id for x in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    start = 0
    for x in got:
        ids = np.frombuffer(x.ids, "<u4").tolist()
        assert x.start == start and x.n_tokens == len(ids) and ids in want[x.doc_id]
        start += x.n_tokens
    crc = {(x.doc_id, x.start): x.ids_crc32 for x in written_and_read(docs, PATH, 2).collect()}
    assert all(crc[x.doc_id, x.start] == zlib.crc32(x.ids) for x in got if x.doc_id != 7)
    ranks = frequency_ranks(token_ids(docs, PATH, 2), "<u2")
    counts = np.bincount([i for v in want.values() for ids in v for i in ids])
    assert ranks.tolist() == sorted(np.flatnonzero(counts).tolist(), key=lambda i: (-counts[i], i))


def test_empty(spark):
    assert written_and_read(spark.createDataFrame([], "doc_id long, text string"), PATH, 2).collect() == []
