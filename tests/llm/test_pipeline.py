import hashlib
import random

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from tessella.llm import langid
from tessella.llm.mixing import mixed
from tessella.llm.queries import MIXTURE, tokenizer
from tessella.llm.substring import spans
from tests.llm.test_langid import text
from tests.llm.test_ngram_join import shingle_sets
from tests.llm.test_substring import brute_repeats


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents: three languages, copies, near copies, a passage in several, junk without letters."""
    r = random.Random(1)
    rows = []
    for i in range(240):
        lang = r.choice(["aa", "bb", "cc"])
        # The mixture's targets name English.
        rows.append([i, text(r, lang, r.randint(60, 160)), lang.replace("aa", "en"), r.choice(["hot", "hot", "s1", "s2"])])
    passage = text(r, "aa", 70)
    for i in (3, 50, 90):
        rows[i][1] = rows[i][1][:100] + " " + passage + " " + rows[i][1][100:]
    rows += [[300, rows[7][1], "en", "s1"], [301, rows[7][1] + " end", "en", "s1"], [302, "1 2 3 ###", "en", "s1"], [303, None, "en", "s1"], [304, "", "en", "s1"]]
    where = tmp_path_factory.mktemp("data")
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{where}/documents.parquet")
    return str(where)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {x.doc_id: x for x in docs.collect()}
        out = stage(spark, docs, folder)
        rows = {x.doc_id: x for x in out.collect()}
        assert len(rows) == out.count()
        if name == "language":
            assert out.columns == columns and set(before) - set(rows) == {302, 303, 304}
        elif name == "near_copies":
            assert out.columns == columns and set(before) - set(rows) == {300, 301}
            sets = [shingle_sets(x.text) for x in rows.values()]
            assert not any(100 * len(a & b) >= 75 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
        elif name == "passages":
            assert out.columns == columns and set(before) == set(rows)
            # By brute force over all pairs of paragraphs: the same documents lose something.
            texts = sorted((i, x.text) for i, x in before.items())
            assert {i for i, _ in brute_repeats(texts)} == {i for i in rows if rows[i].text != before[i].text}
            cut = {x.doc_id for x in spans(docs).collect()}
            assert cut == {50, 90} == {i for i in rows if rows[i].text != before[i].text}
            assert all(x.n_chars == len(x.text) for x in rows.values())
        elif name == "mixture":
            assert out.columns == columns and set(rows) == {x.doc_id for x in mixed(docs, MIXTURE).where("selected").collect()}
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
            assert set(before) == set(rows)
            for i, x in rows.items():
                ids = sp.encode(before[i].text, add_bos=True, add_eos=True)
                assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
            seen = rows
        docs = out if name == "tokens" else spark.createDataFrame(list(rows.values()), out.schema)
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, folder).collect()}
    assert got == seen


def test_every_language_survives(spark, folder):
    assert {x.lang for x in corpus_pipeline.language(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()} == {"en", "bb", "cc"}
    assert langid.UNKNOWN == "und"


def test_nulls_and_repeated_ids(spark, tmp_path):
    """Rows without id, text, language or source, ids and rows that repeat, and a column that clashes, go through every stage."""
    r = random.Random(2)
    rows = [(i, text(r, "aa", 80), r.choice(["en", "bb", None]), r.choice(["s", None])) for i in range(40)]
    rows += [(None, text(r, "bb", 40), "bb", "s"), (None, text(r, "cc", 40), None, None), (3, text(r, "aa", 50), "en", "s"), rows[5], (60, None, None, None)]
    docs = spark.createDataFrame([(*x, len(x[1] or ""), 1.5) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, score double")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "tokens":
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
        else:
            assert out.count() == docs.count()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
