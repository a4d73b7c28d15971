import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tessella.llm.pieces import Pieces, checked, digests, encode

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return Pieces(PATH)


def texts(seed, n=3000):
    r = random.Random(seed)
    letters = "abc ▁\n\t\x00<>s/é😀的.,the ing12"
    return ["".join(r.choice(letters) for _ in range(r.randrange(0, 40))) for _ in range(n)]


def test_ids_and_decoding_equal_the_library(model):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in ["", " ", "  a", "a" * 500, "▁", *texts(1)]:
        ids = sp.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(model.encode(text), "<u4").tolist() == ids
        assert model.decode(model.encode(text)) == sp.decode(ids)


def test_decoding_of_any_ids_equals_the_library(model):
    r = random.Random(2)
    for _ in range(4000):
        ids = [r.choice([r.randrange(3, 259), r.randrange(259, 32000), r.choice([0, 1, 2, 259, 264, 28705])]) for _ in range(r.randrange(0, 8))]
        assert model.decode(np.array(ids, "<u4").tobytes()) == model.library.decode(ids), ids


def test_tables(spark):
    rows = [(i, t, "x", 3) for i, t in enumerate([*texts(3, 200), None, "", "z " * 50_000])] + [(0, "again", "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)
    got = checked(docs, PATH).collect()
    assert len(got) == len(rows) and all(x.agrees for x in got)
    assert sorted(digests(docs, PATH).collect()) == sorted(x[:4] for x in got)
    assert {x.doc_id: x.decoded for x in encode(docs, PATH).where("doc_id > 199").collect()} == {200: "", 201: "", 202: "z " * 50_000}
    assert digests(docs.limit(0), PATH).collect() == []
