"""Exact top-k inner products with multi-resolution segment statistics.

Vectors are integers, floor(1024 * x). For two vectors cut into segments of l
components with means m and deviations s, squared distance is at least
``sum l * ((m_q - m_x)**2 + (s_q - s_x)**2)``; with the norms known that bounds the inner
product from above by ``sum l * (m_q * m_x + s_q * s_x)``. Bounds go from coarse segments
to fine ones, each for the pairs that the one before left; a pair that can't reach its query's k-th score so
far is dropped, and only what remains after the finest is computed exactly.

Each query starts from a score that is known to be reached: its k-th best among a bounded
sample of the rows, which are candidates all. Rows are dealt to parts of bounded size, and the queries,
a Spark table like any other, go to every part in blocks; a part keeps the best k of its rows for
each query, and a window, which takes the best of each task ahead of its shuffle, merges these lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, tune

#: Queries that meet a chunk of rows at once, rows of a chunk, and components of the rows of a part (a task holds about 12 bytes for each).
QUERIES, ROWS, PART = 1024, 2048, 16_000_000
#: Rows of the sample from which queries take their first bound.
SAMPLE = 2048
#: Components in a segment at each resolution, coarse to fine.
LEVELS = (16, 4, 2)
#: Above this share of survivors one product of matrices over their rows and columns beats picking them.
DENSE = 0.1


def _whole(floor: Column, v: Column) -> Column:
    return F.when(F.abs(v.cast("double")) < F.lit(2.0**53), floor.cast("long")).otherwise(F.raise_error(F.lit("a component of 2**53 or more is beyond 64-bit integers")))


def integers(embedding: str = "embedding") -> Column:
    """floor(1024 * x) of each component; null for a null or empty vector and any with a null or non-finite component."""
    x = F.col(embedding)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    return F.when((F.size(x) > 0) & ~bad, F.transform(x, lambda v: _whole(F.floor(v.cast("double") * 1024), v)))


def statistics(v: np.ndarray) -> list[np.ndarray]:
    """For each level the rows' sqrt(l) * (means, deviations); a product of two is the bound."""
    out, n = [], v.shape[1]
    for length in LEVELS:
        cuts = np.arange(0, n, min(length, n))
        size = np.diff(np.append(cuts, n))
        mean = np.add.reduceat(v, cuts, axis=1) / size
        spread = np.sqrt(np.add.reduceat((v - np.repeat(mean, size, axis=1)) ** 2, cuts, axis=1) / size)
        out.append(np.concatenate((mean, spread), 1) * np.sqrt(np.concatenate((size, size))))
    return out


class Chunk:
    """Rows with their statistics. Whole numbers below 2**53 are doubles exactly."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, x = ids, vectors.astype(np.float64)
        self.v = vectors.astype(np.int32) if np.abs(x).max(initial=0) < 2.0**31 else vectors
        self.stats = [s.astype(np.float32) for s in statistics(x)]
        self.norm = np.linalg.norm(x, axis=1)
        self.largest = float(np.abs(x).max(initial=1))


def _dots(a: np.ndarray, b: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a[q] . b[r] for pairs of indices: one product where these fill their rows and columns, else pair by pair."""
    rows, columns = np.unique(q), np.unique(r)
    if len(q) > DENSE * len(rows) * len(columns):
        return (a[rows] @ b[columns].T)[np.searchsorted(rows, q), np.searchsorted(columns, r)]
    return np.concatenate([np.einsum("ij,ij->i", a[q[k : k + 16384]], b[r[k : k + 16384]]) for k in range(0, len(q), 16384)] or [np.zeros(0, a.dtype)])


class Best:
    """The k best rows of each query among the chunks given so far; ``floor``: a score that its k-th best reaches in any case."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.k, self.asked = ids, k, Chunk(ids, vectors)
        self.scores = [np.zeros(0, np.int64)] * len(ids)
        self.found = [np.zeros(0, np.int64)] * len(ids)
        self.least = np.full(len(ids), -np.inf) if floor is None else floor.astype(np.float64)
        #: Pairs met, pairs left after each level.
        self.pairs, self.left = 0, np.zeros(len(LEVELS), np.int64)

    def add(self, rows: Chunk) -> None:
        mine, n = self.asked, rows.v.shape[1]
        # Exact in doubles as long as no product can leave 53 bits; else in whole numbers of any size.
        exact = rows.largest * mine.largest * n < 2.0**53
        # Rounding of the bounds, in single precision, is far below this.
        slack = 4e-5 * (rows.norm.max(initial=0) * mine.norm + 1)
        least = self.least - slack
        self.pairs += len(self.ids) * len(rows.ids)
        q, r = np.nonzero(mine.stats[0] @ rows.stats[0].T >= least[:, None])
        self.left[0] += len(q)
        for level in range(1, len(LEVELS)):
            keep = _dots(mine.stats[level], rows.stats[level], q, r) >= least[q]
            q, r = q[keep], r[keep]
            self.left[level] += len(q)
        keep = rows.ids[r] != self.ids[q]
        q, r = q[keep], r[keep]
        if exact:
            score = _dots(mine.v.astype(np.float64), rows.v.astype(np.float64), q, r)
        else:
            score = (mine.v[q].astype(object) * rows.v[r].astype(object)).sum(axis=1) if len(q) else np.zeros(0)
        keep = (score >= self.least[q]).astype(bool) if exact else np.array([s >= f for s, f in zip(score, self.least[q].tolist(), strict=True)], bool)
        q, r, score = q[keep], r[keep], score[keep]
        score = score.astype(np.int64) if exact else score
        first = np.searchsorted(q, np.arange(len(self.ids) + 1))
        for i in np.flatnonzero(np.diff(first)):
            a, b = first[i], first[i + 1]
            scores, found = np.concatenate((self.scores[i], score[a:b])), np.concatenate((self.found[i], rows.ids[r[a:b]]))
            top = np.lexsort((found, -scores))[: self.k]
            self.scores[i], self.found[i] = scores[top], found[top]
            if len(top) == self.k:
                # A double may be above the whole number it stands for.
                self.least[i] = max(self.least[i], float(np.nextafter(float(self.scores[i][-1]), -np.inf)))


def _chunks(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[Chunk]:
    ids, v = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
    for at in range(0, len(ids), ROWS):
        yield Chunk(ids[at : at + ROWS], v[at : at + ROWS])


def _vectors(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of the rows of each length: the length, which rows, their vectors."""
    lists = batch.column(name)
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    at = np.cumsum(size) - size
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        yield d, rows, flat[at[rows][:, None] + np.arange(d)].astype(np.int64)


def _first_bounds(sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Adds ``floor`` to queries: the k-th best score among the sample, -inf if that has fewer than k candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {d: list(_chunks([x])) for d, x in sample.items()}
        for batch in batches:
            floor = np.full(batch.num_rows, -np.inf)
            for d, rows, v in _vectors(batch, "v"):
                best = Best(batch.column("vec_id").to_numpy()[rows], v, k)
                for chunk in held.get(d, ()):
                    best.add(chunk)
                floor[rows] = best.least
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor, pa.float64())], [*batch.schema.names, "floor"])

    return run


def _search(k: int):
    """Rows sorted by (part, asks): the rows of a part are held, then its queries meet them in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, chunks = None, {}, {}
        held: dict[int, list] = {}

        def answers(d: int) -> Iterator[pa.RecordBatch]:
            if rows.get(d):
                chunks[d] = list(_chunks(rows.pop(d)))
            number, ids, floor, v = (np.concatenate([x[j] for x in held[d]]) for j in range(4))
            held[d] = []
            best = Best(ids, v, k, floor)
            for chunk in chunks.get(d, ()):
                best.add(chunk)
            times = [len(x) for x in best.found]
            score = np.concatenate([*best.scores, np.zeros(0, np.int64)])
            # In two longs; the high part is clipped only where the score is far beyond 64 bits, an error if it ranks.
            high, low = np.clip(score >> 62, -(1 << 60), 1 << 60), score & ((1 << 62) - 1)
            columns = [np.repeat(number, times), np.repeat(ids, times), np.concatenate([*best.found, np.zeros(0, np.int64)]), high, low]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["number", "query_id", "vec_id", "high", "low"])

        for batch in batches:
            part = batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if part[a] != now:
                    for d in [d for d, x in held.items() if x]:
                        yield from answers(d)
                    now, rows, chunks = part[a], {}, {}
                piece = batch.slice(a, b - a)
                number = piece.column("number").to_numpy(zero_copy_only=False)
                ids, floor = piece.column("vec_id").to_numpy(), piece.column("floor").to_numpy(zero_copy_only=False)
                asks = ~np.isnan(floor)
                for d, at, v in _vectors(piece, "v"):
                    q = asks[at]
                    if not q.all():
                        rows.setdefault(d, []).append((ids[at[~q]], v[~q]))
                    if q.any():
                        held.setdefault(d, []).append((number[at[q]], ids[at[q]], floor[at[q]], v[q]))
                        if sum(len(x[0]) for x in held[d]) >= QUERIES:
                            yield from answers(d)
        for d in [d for d, x in held.items() if x]:
            yield from answers(d)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest inner product to each query, ties to the smaller vec_id.

    Both tables have vec_id and embedding. A row is no candidate for its own vec_id. Vectors that are null
    or empty or hold null or non-finite components take no part, nor do rows
    without vec_id. Components of 2**53 and more, and scores of the result beyond 64 bits, are errors. Products join vectors of one length only. Rows that repeat a vec_id
    count once each; a query given twice is answered once for each. Other columns
    don't matter; empty tables give an empty result.
    """
    spark = vectors.sparkSession
    tune(spark)
    rows = vectors.select("vec_id", integers().alias("v")).where("v is not null and vec_id is not null")
    asked = queries.select("vec_id", integers().alias("v")).where("v is not null and vec_id is not null").withColumn("number", F.monotonically_increasing_id())
    sample: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    # SAMPLE rows at most, by the hash of their vec_id.
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect():
        ids, v = sample.setdefault(len(r.v), ([], []))
        ids.append(r.vec_id), v.append(r.v)
    sample = {d: (np.array(ids, np.int64), np.array(v, np.int64)) for d, (ids, v) in sample.items()}
    asked = staged(asked.mapInArrow(_first_bounds(sample, k), "vec_id long, v array<long>, number long, floor double"), "queries")
    total = rows.agg(F.sum(F.size("v").cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))
    nan = F.lit(float("nan"))
    here = rows.select(F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int").alias("part"), "vec_id", "v", F.lit(0).cast("long").alias("number"), nan.alias("floor"))
    there = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "vec_id", "v", "number", "floor")
    dealt = here.unionByName(there).repartition(parts, "part").sortWithinPartitions("part", F.isnan("floor").desc())
    lists = dealt.mapInArrow(_search(k), "number long, query_id long, vec_id long, high long, low long")
    order = Window.partitionBy("number").orderBy(F.desc("high"), F.desc("low"), "vec_id")
    score = F.when(F.col("high").between(-2, 1), F.shiftleft("high", 62) + F.col("low")).otherwise(F.raise_error(F.lit("a score among the best is beyond 64 bits")))
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.cast("long").alias("score"))
