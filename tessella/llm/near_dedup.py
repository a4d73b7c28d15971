"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidate edges.

Two documents link when ``den * |x & y| >= num * |x | y|`` for their sets of distinct word shingles
(two words, 80 of 100 by default). Steps:

1. One hash deals a set's shingles to ``BINS`` bins and orders them inside; a bin's smallest is its value. An empty
   bin takes the value of the first bin that isn't, in a random order of its own (optimal densification), so
   bins of short texts agree with the chance of the Jaccard similarity too, independently of each other. Documents of equal
   sets are one class; a class keeps a byte of each bin (its sketch) and the hashes of ``BANDS`` bands of ``ROWS`` bins.
2. Classes with an equal band are a bucket. Each member is a candidate of the bucket's smallest class only, its hub: a bucket of
   m classes has m - 1 edges. Two linked classes share no band with a chance of (1 - 0.8**5)**35 = 1e-6.
3. The sketches of both ends decide what an edge can mean. From ``LINK`` equal bytes on it may be a link. Members below that are
   a bucket of their own with its own hub, and so on. Between are members that can't link with the
   hub, but, by the triangle inequality of Jaccard distances, with its partners: from ``RING`` equal bytes on.
4. Edges that may be links are confirmed on the full sets.
5. Where a hub's surroundings still lie in several components, all of them meet on the full sets by
   the chunked prefix trees of ``ngram_join``. So the stars lose no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep_keys, sized, split_join, staged, tune, with_totals
from .graph import components
from .ngram_join import SEEN, Threshold, block_links, set_key
from .words import U, mix, shingle_set, words

#: Words of a shingle; bands and bins of a band.
WORDS, BANDS, ROWS = 2, 35, 5
BINS = BANDS * ROWS
#: Rounds of stars, after which a bucket's rest meets by its full sets, and members of a hub that one task confirms.
ROUNDS, PART = 2, 256

_DEAL = U(0xD6E8FEB86659FD93)
_COEF = mix(np.arange(1, ROWS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_BAND = mix(np.arange(BANDS, dtype=U) + U(0x1F3D5B79))
#: _TRIES[e, f]: when bin e, being empty, tries bin f.
_TRIES = np.argsort(np.argsort(mix(np.arange(BINS * BINS, dtype=U) + U(0xA24BAED4)).reshape(BINS, BINS), axis=1), axis=1)


def least_equal(similarity: float) -> int:
    """The fewest equal bins of two sets this similar: five and a half deviations below the mean."""
    return int(BINS * similarity - 5.5 * (BINS * similarity * (1 - similarity)) ** 0.5)


def bins(tokens: np.ndarray) -> np.ndarray:
    """The value of each bin of a set (sorted, not empty), densified."""
    held, at = np.unique(mix(tokens ^ _DEAL) % U(BINS), return_index=True)
    held, out = held.astype(np.int64), np.empty(BINS, U)
    out[held] = tokens[at]  # the tokens ascend: the first of a bin is its smallest
    empty = np.setdiff1d(np.arange(BINS), held, assume_unique=True)
    if len(empty):
        out[empty] = out[held[_TRIES[empty[:, None], held].argmin(axis=1)]]
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """The hash of each band of bins."""
    return mix((values.reshape(BANDS, ROWS) * _COEF).sum(axis=1, dtype=U) ^ _BAND).view(np.int64)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        n, keys, sketches, hashes = [], [], [], []
        for _, _, _, h in words(batch.column(1)):
            tokens = shingle_set(h, WORDS)
            n.append(len(tokens))
            key = set_key(tokens) if len(tokens) else None
            keys.append(key)
            if key is None or key in seen:
                sketches.append(None), hashes.append(None)
                continue
            if len(seen) < SEEN:
                seen.add(key)
            values = bins(tokens)
            sketches.append(values.astype(np.uint8).tobytes()), hashes.append(bands(values))
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(sketches, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "node", "sketch", "bands"])


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (a key of the set; null if empty), sketch and bands (null for a copy seen in the same task)."""
    tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_profiles, "doc_id long, n_shingles long, node long, sketch binary, bands array<long>")


def _equal_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        mine, hubs = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in (2, 3))
        equal = pa.array(np.count_nonzero(mine == hubs, axis=1), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), equal, batch.column(4)], ["node", "hub", "equal", "fits"])


def stars(classes: DataFrame, threshold: Threshold) -> tuple[DataFrame, DataFrame]:
    """Edges from the members of buckets to their hubs (node, hub, equal, may_link), and what is left of buckets after all rounds (block, node).

    classes: node, n, sketch, bands.
    """
    sure, near = least_equal(threshold.num / threshold.den), least_equal(max(0.0, 2 * threshold.num / threshold.den - 1))
    offers = staged(classes.select("node", F.explode("bands").alias("band")), "offers")
    sides = classes.select("node", "n", "sketch")
    edges: DataFrame | None = None
    for _ in range(ROUNDS):
        met = with_totals(offers, "band", "node", {"hub": F.min("node"), "last": F.max("node")})
        met = staged(met.where("hub < last and node > hub").select("band", "node", "hub"), "met")
        discard(offers)
        pairs = staged(met.select("node", "hub").distinct(), "pairs")
        both = split_join(pairs, sides.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("sketch").alias("hub_sketch")), "hub", "node").join(sides, "node")
        fits = F.least("n", "hub_n") * threshold.den >= F.greatest("n", "hub_n") * threshold.num
        told = both.select("node", "hub", "sketch", "hub_sketch", fits.alias("fits")).mapInArrow(_equal_bytes, "node long, hub long, equal int, fits boolean")
        told = staged(told, "told")
        found = told.where(F.col("equal") >= near).select("node", "hub", "equal", (F.col("fits") & (F.col("equal") >= sure)).alias("may_link"))
        edges = found if edges is None else edges.unionByName(found)
        # Whoever isn't near enough to the hub to be its partner meets the others like that.
        rest = met.join(told.where(F.col("equal") < sure).select("node", "hub"), ["node", "hub"]).select("band", "node")
        offers = staged(rest, "offers")
        discard(pairs, met)
        if offers.isEmpty():
            break
    left = with_totals(offers, "band", "node", {"low": F.min("node"), "high": F.max("node")}).where("low < high")
    return edges, left.select(F.col("band").alias("block"), "node")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(h, WORDS) for _, _, _, h in words(batch.column(1))]
        # Of rows that share a doc_id only those with the class's text count.
        own = [i for i, (key, s) in enumerate(zip(batch.column(0).to_pylist(), sets, strict=True)) if len(s) and set_key(s) == key]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64()))], ["node", "tokens"])


def _confirm(threshold: Threshold):
    """Rows sorted by (hub, part), the hub's own first: hub, part, node, own, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, U)
        for batch in batches:
            a, b = [], []
            lists = batch.column(4)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False).view(U), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for i, (of, node, own) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True)):
                tokens = flat[at[i] : at[i + 1]]
                if own:
                    hub = tokens.copy()
                    continue
                place = np.minimum(np.searchsorted(hub, tokens), len(hub) - 1)
                if np.count_nonzero(hub[place] == tokens) >= threshold.overlap(len(hub), len(tokens)):
                    a.append(node), b.append(of)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def confirmed(edges: DataFrame, sets: DataFrame, threshold: Threshold) -> DataFrame:
    """The edges (node, hub) whose full sets link: columns a, b. A hub's set goes to each part of its members once."""
    parts = edges.groupBy("hub").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = staged(split_join(edges, parts, "hub", "node").select("hub", F.pmod(F.xxhash64("node", "hub"), F.col("parts")).cast("int").alias("part"), "node", F.lit(False).alias("own")), "dealt")
    hubs = dealt.select("hub", "part").distinct().select("hub", "part", F.col("hub").alias("node"), F.lit(True).alias("own"))
    # A class has at most one row for each of its bands, and as a hub one for each PART members.
    rows = dealt.unionByName(hubs).join(sets, "node").select("hub", "part", "node", "own", "tokens").repartition("hub", "part").sortWithinPartitions("hub", "part", F.desc("own"))
    return rows.mapInArrow(_confirm(threshold), "a long, b long")


def linked(docs: DataFrame, classes: DataFrame, threshold: Threshold) -> DataFrame:
    """node, component of every class that has links. classes: node, rep, n, sketch, bands."""
    edges, left = stars(classes, threshold)
    edges, left = staged(edges.groupBy("node", "hub").agg(F.max("equal").alias("equal"), F.max("may_link").alias("may_link")), "edges"), staged(left, "left")
    wanted = edges.select("node").union(edges.select("hub")).union(left.select("node")).distinct()
    wanted = staged(wanted.join(classes.select("node", "rep"), "node").select(F.col("rep").alias("doc_id"), "node"), "wanted")
    sets = keep_keys(docs.select("doc_id", "text"), wanted, "doc_id").select("node", "text").mapInArrow(_sets, "node long, tokens array<long>")
    sets = staged(sets.dropDuplicates(["node"]), "sets")
    found = staged(confirmed(edges.where("may_link").select("node", "hub"), sets, threshold), "links")
    labels = staged(components(found), "labels")
    # Surroundings of a hub in several components, and what the stars left over, meet as blocks.
    around = edges.select(F.col("hub").alias("block"), "node").unionByName(edges.select(F.col("hub").alias("block"), F.col("hub").alias("node")).distinct()).unionByName(left)
    ends = _labelled(around, labels).groupBy("block").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
    ends = ends.where("low < high and size > 2").select("block")
    blocked = staged(around.join(sized(staged(ends, "several")), "block").select("block", F.col("node").alias("rep")), "blocked")
    if blocked.isEmpty():
        return labels
    new = block_links(sets.select(F.col("node").alias("rep"), "tokens"), blocked, threshold)
    # Of these links only those between components are new.
    mine = staged(_labelled(new.withColumnRenamed("a", "node"), labels).select(F.col("component").alias("x"), F.col("b").alias("node")), "mine")
    new = staged(_labelled(mine, labels).select("x", F.col("component").alias("y")).where("x <> y").distinct(), "new")
    if new.isEmpty():
        return labels
    top = staged(components(new, "x", "y").select(F.col("node").alias("component"), F.col("component").alias("top")), "top")
    # Both ends of a new link may be classes that had none.
    labels = labels.unionByName(top.join(labels, top.component == labels.node, "left_anti").select(F.col("component").alias("node"), "component"))
    return labels.join(sized(top), "component", "left").select("node", F.coalesce("top", "component").alias("component"))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(sized(labels), "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_dedup(docs: DataFrame, threshold: Threshold | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept (doc_id = component_id) for every row.

    Null and empty texts have no shingles and stand alone; texts of fewer than WORDS words have one, their whole
    word sequence; equal texts are one class, and of repeated rows each is kept or none. Rows without doc_id keep a null
    component_id unless they link with a row that has one; their ``kept`` is null. Rows that share a doc_id with different texts are documents
    of their own. Other columns are ignored; an empty table gives an empty result.
    """
    threshold = threshold or Threshold(80)
    rows = staged(profiles(docs), "profiles")
    each = rows.where("node is not null").groupBy("node")
    classes = each.agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"), F.first("bands", ignorenulls=True).alias("bands"))
    classes = staged(classes.where("rep is not null"), "classes")
    labels = linked(docs, classes, threshold).join(classes.select("node", "rep"), "node")
    # A component goes by the smallest doc_id of its classes.
    named = with_totals(staged(labels, "labels"), "component", "node", {"low": F.min("rep")}).select("node", "low")
    of = staged(classes.select("node", "rep").join(named, "node", "left").select("node", F.coalesce("low", "rep").alias("component_id")), "of")
    out = split_join(rows.select("doc_id", "n_shingles", "node"), of, "node", "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
