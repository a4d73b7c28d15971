"""Substring dedup: repeated passages found by paragraph MinHash banding.

A passage may start and end anywhere in its host, so paragraphs are cut by content:
a paragraph is the WORDS words from an anchor on, and anchors are the words with the
smallest hash within some stretch of REACH words (winnowing). Every stretch of
``REACH + WORDS - 1`` words that two texts share holds an anchor with its whole
paragraph inside it, at the same words in both, so passages of 50 words and more
are always cut alike. Steps:

1. Each paragraph has an exact hash and ``BANDS`` MinHashes of its five-word shingles. Documents that
   equal an earlier one word for word are set aside here: each loses all its words.
2. Bands of one row: paragraphs that share a MinHash collide. Two paragraphs of
   Jaccard 0.75 collide in one of three bands with a chance of 1 - 0.25**3 = 98.4 %, and a
   passage has several paragraphs. Buckets of one document are left.
3. Equal paragraphs are verified by their hash. The distinct ones of all buckets that hold
   several are joined by exact Jaccard over their shingles, read again from the texts: by
   the rare-first prefixes, chunks and tries of ``ngram_join``, so a bucket of any size, made
   by a common phrase, needs no leader and gives no pairs of unrelated surroundings.
4. Components of the verified links are clusters; a cluster keeps its paragraphs in its
   first document and loses them elsewhere. Overlapping removals join to spans.
5. Both ends of a span move outwards, word by word, as long as the words agree with those about a like
   paragraph of an earlier document: REACH - 1 words at most, since a longer agreement would hold another paragraph.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, drop_keys, keep_keys, sized, split_join, staged, tune, with_totals
from .graph import components
from .ngram_join import Threshold, block_links, finer_blocks
from .words import U, mix, shingles, words

#: Words of a paragraph, and the stretch in which one anchor is chosen at least.
WORDS, REACH = 25, 25
#: MinHash bands of one row each, and the Jaccard similarity that counts as a repeat.
BANDS, SIMILARITY = 3, 0.75
#: Paragraphs of fewer distinct shingles (one word over and over) aren't passages.
LEAST = 2
#: Words on either side that are compared with those about the earlier paragraph.
AROUND = REACH - 1

_SALTS = [U(int(mix(np.array([0xB5 + 9 * k], U))[0]) | 1) for k in range(BANDS)]


def anchors(h: np.ndarray) -> np.ndarray:
    """Words at which paragraphs start: the minimum of each stretch, the last of equal ones."""
    n = len(h)
    if n < WORDS:
        return np.zeros(0, np.int64)
    if n < REACH:
        return np.array([0])
    # Window minima by doubling: each step covers stretches twice as long.
    at = np.arange(n)
    value, width = mix(h), 1
    best = at
    while width < REACH:
        step = min(width, REACH - width)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(value[b] <= value[a], b, a)
        width += step
    found = np.unique(best)
    return found[found <= n - WORDS]


def exact_hash(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of shingles in order."""
    return mix(np.add.reduce(rows * (2 * np.arange(rows.shape[1], dtype=U) + U(1)), axis=1))


def _distinct(window: np.ndarray) -> np.ndarray:
    """Distinct values in each row."""
    s = np.sort(window, axis=1)
    return 1 + np.count_nonzero(s[:, 1:] != s[:, :-1], axis=1)


def _paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        found: list[list[np.ndarray]] = [[] for _ in range(5 + BANDS)]
        ahead: list[np.ndarray] = []
        for i, _, _, h in words(batch.column(1)):
            a = anchors(h)
            if not len(a) or ids[i] is None:
                continue
            rows = np.lib.stride_tricks.sliding_window_view(shingles(h), WORDS - 4)[a]
            keep = _distinct(rows) >= LEAST
            a, rows = a[keep], rows[keep]
            # A hash of all words in order.
            whole = mix(np.add.reduce(h * (2 * np.arange(len(h), dtype=U) + U(1)), keepdims=True) + U(len(h))).view(np.int64)
            lows = [(mix(rows * salt).min(axis=1) ^ salt).view(np.int64) for salt in _SALTS]
            for column, value in zip(found, (exact_hash(rows).view(np.int64), np.full(len(a), ids[i]), a, np.full(len(a), whole[0]), np.full(len(a), len(h)), *lows), strict=True):
                column.append(value)
            ahead.append(np.arange(len(a)) > 0)
        later = np.concatenate([*ahead, np.zeros(0, bool)])
        columns = [pa.array(np.concatenate([*c, np.zeros(0, np.int64)]).astype(np.int64), mask=later if k in (3, 4) else None) for k, c in enumerate(found)]
        yield pa.RecordBatch.from_arrays(columns, ["exact", "doc_id", "start", "whole", "n_words", *(f"low{k}" for k in range(BANDS))])


def paragraphs(docs: DataFrame) -> DataFrame:
    """exact hash, doc_id, start (word), the hash and number of all the document's words (with its first paragraph; null elsewhere), and the MinHashes low0, ... of the paragraphs of documents."""
    tune(docs.sparkSession)
    schema = "exact long, doc_id long, start long, whole long, n_words long" + "".join(f", low{k} long" for k in range(BANDS))
    return docs.select("doc_id", "text").mapInArrow(_paragraphs, schema)


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wanted = batch.column(1).to_pylist()
        exact, rows = [], []
        for i, _, _, h in words(batch.column(2)):
            sh = shingles(h)
            for start, key in zip(wanted[i][::2], wanted[i][1::2], strict=True):
                row = sh[start : start + WORDS - 4]
                # Rows that share a doc_id: only the text that holds the paragraph counts.
                if len(row) == WORDS - 4 and int(exact_hash(row[None]).view(np.int64)[0]) == key:
                    exact.append(key), rows.append(np.unique(row).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(exact, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], ["exact", "shingles"])


def repeats(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, start, exact, cluster, keep_doc_id, like_doc_id, like_start, like_exact: every paragraph to remove, who keeps its cluster, and an earlier paragraph like it."""
    return _repeats(docs, staged(paragraphs(docs), "paragraphs"), similarity)


def _copies(offered: DataFrame) -> DataFrame:
    """doc_id, first_doc_id, n_words, cluster of the documents whose words all equal an earlier one's, among those with paragraphs; a doc_id with several texts is none."""
    each = offered.where("whole is not null").groupBy("doc_id").agg(F.min("whole").alias("whole"), F.max("whole").alias("other"), F.max("n_words").alias("n_words"), F.min("exact").alias("cluster"))
    each = staged(each, "wholes")
    first = staged(each.groupBy("whole").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    return each.join(sized(first), "whole").where("doc_id <> first_doc_id and whole = other").select("doc_id", "first_doc_id", "n_words", "cluster")


def _repeats(docs: DataFrame, rows: DataFrame, similarity: float, apart: DataFrame | None = None) -> DataFrame:
    """What ``repeats`` says by the staged paragraphs ``rows``, without those of the documents ``apart``."""
    kept = rows if apart is None else drop_keys(rows, apart, "doc_id")
    offered = kept.select("doc_id", "start", "exact", F.explode(F.array(*(f"low{k}" for k in range(BANDS)))).alias("low"))
    ends = {"d0": F.min("doc_id"), "d1": F.max("doc_id"), "e0": F.min("exact"), "e1": F.max("exact")}
    met = with_totals(offered, "low", "doc_id", ends).where("d0 < d1").groupBy("doc_id", "start", "exact").agg(F.max(F.expr("e0 < e1")).alias("near"))
    met = staged(met, "met")
    discard(rows)
    # Where the shingles of each paragraph that meets different ones stand: one place each.
    place = met.where("near").groupBy("exact").agg(F.min(F.struct("doc_id", "start")).alias("at"))
    wanted = place.groupBy(F.col("at.doc_id").alias("doc_id")).agg(F.flatten(F.collect_list(F.array("at.start", "exact"))).alias("wanted"))
    texts = keep_keys(docs.select("doc_id", "text"), staged(wanted, "wanted"), "doc_id")
    schema = T.StructType([T.StructField("exact", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
    sets = texts.select("doc_id", "wanted", "text").mapInArrow(_shingle_rows, schema)
    # A paragraph that comes twice, from rows that share a doc_id, meets itself without effect.
    sets = staged(sets.select(F.col("exact").alias("rep"), F.col("exact").alias("key"), F.col("shingles").alias("tokens")), "sets")
    share = Fraction(similarity).limit_denominator(10**6)
    threshold = Threshold(share.numerator, share.denominator)
    blocked = staged(finer_blocks(sets, threshold).select("block", F.col("key").alias("rep")), "blocks")
    labels = components(block_links(sets, blocked, threshold)).withColumnRenamed("node", "exact")
    # Labels and firsts stand with the distinct paragraphs; only the last join meets copies of a paragraph, which may be many.
    first = F.min(F.struct("doc_id", "start", "exact"))
    each = met.groupBy("exact").agg(first.alias("same"), F.max("doc_id").alias("last"))
    each = staged(each.join(sized(staged(labels, "labels")), "exact", "left").select("exact", "same", "last", F.coalesce("component", "exact").alias("cluster")), "each")
    kept = staged(each.groupBy("cluster").agg(F.min("same").alias("k"), F.max("last").alias("last")).where("k.doc_id < last").drop("last"), "kept")
    of = staged(split_join(each.drop("last"), kept, "cluster", "exact"), "of")
    found = split_join(met.drop("near"), of, "exact", "doc_id").where("doc_id <> k.doc_id")
    # What stands about a paragraph is compared with what stands about an equal one, where an earlier document has it.
    like = F.when(F.col("same.doc_id") < F.col("doc_id"), F.col("same")).otherwise(F.col("k"))
    kept = {"keep_doc_id": F.col("k.doc_id"), "like_doc_id": like["doc_id"], "like_start": like["start"], "like_exact": like["exact"]}
    return found.withColumns(kept).drop("k", "same")


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, wanted = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: list[tuple] = []
        for i, _, _, h in words(batch.column(2)):
            short = (h >> U(33)).astype(np.int32)
            for start, key in zip(wanted[i][::2], wanted[i][1::2], strict=True):
                row = shingles(h[start : start + WORDS])
                # Rows that share a doc_id: only the text that holds the paragraph counts.
                if len(row) == WORDS - 4 and int(exact_hash(row[None]).view(np.int64)[0]) == key:
                    out.append((ids[i], start, short[max(0, start - AROUND) : start][::-1], short[start + WORDS : start + WORDS + AROUND]))
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "ahead", "after"])


def _agreeing(mine: str, theirs: str) -> Column:
    """How many words agree from the first on."""
    n = F.least(F.size(mine), F.size(theirs))
    differ = F.expr(f"array_position(zip_with({mine}, {theirs}, (x, y) -> coalesce(x <=> y, false)), false)")
    return F.when(n <= 0, F.lit(0)).when(differ == 0, n).otherwise(F.least(n, differ.cast("int") - 1))


def _joined(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans of a document become one."""
    of_doc = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    before = F.max("end_word").over(of_doc.rowsBetween(Window.unboundedPreceding, -1))
    return (
        spans.withColumn("new", (F.col("start_word") > F.coalesce(before, F.lit(-1))).cast("int"))
        .withColumn("span", F.sum("new").over(of_doc))
        .groupBy("doc_id", "span")
        .agg(
            F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("keep_doc_id").alias("keep_doc_id"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("keep_doc_ids")))).alias("keep_doc_ids"), F.min("cluster").alias("cluster"),
            F.min("first").alias("first"), F.max("last").alias("last"),
        )
    )


def spans(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per removed span: doc_id, start_word, end_word (exclusive), n_words, keep_doc_id, keep_doc_ids, cluster.

    ``keep_doc_id`` is the smallest document that keeps a part of it, ``keep_doc_ids``
    are all of them. Null texts, empty ones and those of fewer than WORDS words have
    no paragraphs; rows without doc_id are left alone; repeats inside one document
    (and rows that repeat a doc_id) are not repeats across documents.
    Other columns don't matter; an empty table gives no spans.
    """
    rows = staged(paragraphs(docs), "paragraphs")
    copies = staged(_copies(rows), "copies")
    found = _repeats(docs, rows, similarity, copies.select("doc_id"))
    # Ends are found from the outermost paragraphs with an equal one in an earlier document, or else a near one.
    equal, place = F.col("like_exact") == F.col("exact"), ["start", "exact", "like_doc_id", "like_start", "like_exact"]
    ends = {"first": F.struct((~equal).alias("rank"), *place), "last": F.struct(equal.alias("rank"), *place)}
    found = found.withColumns({"start_word": F.col("start"), "end_word": F.col("start") + WORDS, "keep_doc_ids": F.array("keep_doc_id"), **ends})
    raw = staged(_joined(found), "spans")
    # The words about those paragraphs, and about the earlier ones like them.
    mine = [raw.select("doc_id", f"{e}.start", f"{e}.exact") for e in ("first", "last")]
    like = [raw.select(F.col(f"{e}.like_doc_id").alias("doc_id"), F.col(f"{e}.like_start").alias("start"), F.col(f"{e}.like_exact").alias("exact")) for e in ("first", "last")]
    wanted = mine[0].unionByName(mine[1]).unionByName(like[0]).unionByName(like[1]).distinct()
    wanted = staged(wanted.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array("start", "exact"))).alias("wanted")), "wanted")
    texts = keep_keys(docs.select("doc_id", "text"), wanted, "doc_id").select("doc_id", "wanted", "text")
    near = texts.mapInArrow(_surroundings, "doc_id long, start long, ahead array<int>, after array<int>")
    near = staged(near.groupBy("doc_id", "start").agg(F.min("ahead").alias("ahead"), F.min("after").alias("after")), "surroundings")
    out = raw
    for end, side in (("first", "ahead"), ("last", "after")):
        here = near.select("doc_id", F.col("start").alias(f"{end}_start"), F.col(side).alias(f"{end}_mine"))
        there = near.select(F.col("doc_id").alias(f"{end}_like"), F.col("start").alias(f"{end}_like_start"), F.col(side).alias(f"{end}_theirs"))
        out = out.withColumns({f"{end}_start": F.col(f"{end}.start"), f"{end}_like": F.col(f"{end}.like_doc_id"), f"{end}_like_start": F.col(f"{end}.like_start")})
        out = out.join(here, ["doc_id", f"{end}_start"], "left").join(there, [f"{end}_like", f"{end}_like_start"], "left")
    moved = out.withColumns({
        "start_word": F.least("start_word", F.col("first_start") - F.coalesce(_agreeing("first_mine", "first_theirs"), F.lit(0))),
        "end_word": F.greatest("end_word", F.col("last_start") + WORDS + F.coalesce(_agreeing("last_mine", "last_theirs"), F.lit(0))),
    })
    out = staged(_joined(moved).drop("first", "last", "span"), "spans")
    # A copy goes as a whole; those who keep its words are its first document and those who keep parts of that.
    parts = out.groupBy(F.col("doc_id").alias("first_doc_id")).agg(F.array_distinct(F.flatten(F.collect_list("keep_doc_ids"))).alias("__parts"))
    parts = staged(parts.join(sized(copies.select("first_doc_id").distinct()), "first_doc_id"), "parts")
    whole = copies.join(sized(parts), "first_doc_id", "left")
    keepers = F.array_sort(F.array_union(F.array("first_doc_id"), F.coalesce("__parts", F.array().cast("array<bigint>"))))
    whole = whole.select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n_words").alias("end_word"), F.array_min(keepers).alias("keep_doc_id"), keepers.alias("keep_doc_ids"), "cluster")
    return out.select(whole.columns).unionByName(whole).select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "keep_doc_id", "keep_doc_ids", "cluster")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, cuts = batch.column(0), batch.column(1).to_pylist()
        out: list[str | None] = texts.to_pylist()
        if any(cuts):
            for i, s, e, _ in words(texts):
                if cuts[i]:
                    raw, at, parts = out[i].encode(), 0, []
                    for a, b in sorted(cuts[i]):
                        if b <= len(s):
                            parts.append(raw[at : s[a]])
                            at = s[b] if b < len(s) else len(raw)
                    out[i] = b"".join([*parts, raw[at:]]).decode()
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]], ["text", *batch.schema.names[2:]])


def drop_repeats(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the removed spans cut out of ``text`` and ``n_chars`` set anew; same columns, same rows."""
    cuts = spans(docs, similarity).groupBy("doc_id").agg(F.collect_list(F.array("start_word", "end_word")).alias("__cuts"))
    cuts = staged(cuts, "cuts")
    rest = [c for c in docs.columns if c != "text"]
    schema = T.StructType([T.StructField("text", T.StringType()), *(docs.schema[c] for c in rest)])
    changed = keep_keys(docs, cuts, "doc_id").select("text", "__cuts", *rest).mapInArrow(_cut, schema)
    if "n_chars" in rest:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return drop_keys(docs, cuts.select("doc_id"), "doc_id").select(docs.columns).unionByName(changed.select(docs.columns))
