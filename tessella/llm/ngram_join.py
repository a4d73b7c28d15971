"""N-gram Jaccard self-join of documents by prefix trees.

Two documents link when ``den * |x & y| >= num * |x | y|`` for their sets of distinct
word shingles (five words, 75 of 100 by default). The join is exact:

1. Documents with equal sets become one class (a 64-bit key of the set).
2. Each class offers the shingles with its smallest hashes, so many that any two
   linked classes share at least ``need`` of the offers of either. Each shingle's count and first
   class are added to its offers (hot shingles apart); classes that share too few drop out.
3. The others meet by their whole sets in the same way: what a class shares has to be three
   quarters of its set then, which no passage of unrelated documents is.
   In a rare-first order of the shared shingles all but the ``need - 1`` most common
   are enough to meet every partner (prefix filter). Classes that meet under a shingle
   belong to the block named after its first class.
4. Each block is cut into chunks of at most about CHUNK sets. A chunk stores its
   sets, globally ordered, in a path-compressed trie; every set walks it, sharing the
   overlap of common paths and leaving subtrees that their remaining length cannot
   lift to the threshold. A chunk gives its components as stars.
5. Blocks of several chunks: the first class of each component meets the others, as long as that
   halves their number; then every class outside its block's largest component walks the tries of
   all its block's chunks. So no link between components is lost, and no pairs within
   a large group of near copies are spelled out.

Links join class representatives; ``graph.components`` makes components of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_keys, sized, staged, tune, with_totals
from .graph import components
from .words import U, mix, shingle_set, words

#: Sets that one trie holds, on average; blocks above it are split.
CHUNK = 256
#: Sets a Python worker remembers, so that copies within a task offer their shingles once.
SEEN = 200_000


class Threshold:
    """``den * |x & y| >= num * |x | y|`` and the bounds that follow from it."""

    def __init__(self, num: int = 75, den: int = 100):
        if not 0 < num <= den:
            raise ValueError("the threshold lies above 0 and at most at 1")
        self.num, self.den = num, den

    def least(self, n):
        """The fewest shingles shared by a set of n and any partner; also the partner's least size."""
        return -(-n * self.num // self.den)

    def overlap(self, n, m):
        """The fewest shared shingles of linked sets of n and m."""
        return -(-(n + m) * self.num // (self.num + self.den))

    def extra(self, n):
        """Offers beyond the plain prefix: a third of the slack, 1 at least."""
        return np.maximum(1, (n - self.least(n)) // 3)

    def offers(self, n):
        return np.minimum(n, n - self.least(n) + self.extra(n))

    def need(self, n):
        """Offers that a set of n shares with any partner's, at least."""
        return self.extra(self.least(n))


def set_key(tokens: np.ndarray) -> int:
    """A 64-bit key of a set, independent of order."""
    return int(mix(np.array([np.add.reduce(mix(tokens ^ U(0x5851F42D4C957F2D))) + U(len(tokens))], U))[0].view(np.int64))


def _profiles(threshold: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            n, keys, offers = [], [], []
            for _, _, _, h in words(batch.column(1)):
                tokens = shingle_set(h)
                n.append(len(tokens))
                if not len(tokens):
                    keys.append(None), offers.append(None)
                    continue
                key = set_key(tokens)
                keys.append(key)
                if key in seen:
                    offers.append(None)
                    continue
                if len(seen) < SEEN:
                    seen.add(key)
                offers.append(tokens[: int(threshold.offers(len(tokens)))].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(offers, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "key", "offers"]
            )

    return run


def profiles(docs: DataFrame, threshold: Threshold) -> DataFrame:
    """doc_id, n_shingles, key of the set (null if empty), offers (null for a copy seen in the same task)."""
    tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_profiles(threshold), "doc_id long, n_shingles long, key long, offers array<long>")


def blocks(offered: DataFrame, need: Column, plain: bool = False) -> DataFrame:
    """node, block: the blocks in which each class can meet partners.

    ``offered`` has node, n (size of the whole set) and token. Linked classes share at least ``need`` (over n)
    of the tokens that either offers. ``plain``: hardly a node offers a token twice, so they are listed as they come;
    one that does comes to more blocks.
    """
    each = F.struct("df", "token", "low")
    shared = (
        with_totals(offered, "token", "node", {"df": F.count("*"), "low": F.min("node"), "high": F.max("node")})
        .where("low < high")
        .groupBy("node")
        .agg(F.max("n").alias("n"), (F.collect_list(each) if plain else F.collect_set(each)).alias("shared"))
        .withColumn("need", need)
        .where(F.size("shared") >= F.col("need"))
    )
    few = F.slice(F.array_sort("shared"), F.lit(1), F.size("shared") - F.col("need") + 1)
    return shared.select("node", F.explode(F.array_distinct(F.transform(few, lambda x: x["low"]))).alias("block"))


def first_blocks(prof: DataFrame, threshold: Threshold) -> DataFrame:
    """Blocks by the offers of all classes."""
    offered = prof.where("offers is not null").select(F.col("key").alias("node"), F.col("n_shingles").cast("int").alias("n"), F.explode("offers").alias("token"))
    least = F.ceil(F.col("n") * threshold.num / threshold.den)
    need = F.greatest(F.lit(1), ((least - F.ceil(least * threshold.num / threshold.den)) / 3).cast("int"))
    return blocks(offered, need).withColumnRenamed("node", "key")


def finer_blocks(sets: DataFrame, threshold: Threshold) -> DataFrame:
    """key, block: blocks by whole sets, so that a passage that many classes hold makes none."""
    offered = sets.select(F.col("key").alias("node"), F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    return blocks(offered, F.ceil(F.col("n") * threshold.num / threshold.den).cast("int"), plain=True).withColumnRenamed("node", "key")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(h) for _, _, _, h in words(batch.column(2))]
        # Of rows that share a doc_id only those with the class's text count.
        own = [i for i, (key, s) in enumerate(zip(batch.column(1).to_pylist(), sets, strict=True)) if len(s) and set_key(s) == key]
        at = pa.array(own, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64()))], ["rep", "key", "tokens"])


class Trie:
    """Sets over local token ranks in one global order, common paths merged.

    A node is a run of ranks; children start with different ranks. ``leaves[node]``
    are the sets that end there.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.runs, self.kids, self.leaves = [np.zeros(0, np.int64)], [[]], [[]]
        order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        # Each open node: its number and the depth at which it ends.
        path, last = [(0, 0)], np.zeros(0, np.int64)
        for i in order:
            s = sets[i]
            m = min(len(s), len(last))
            differ = np.flatnonzero(s[:m] != last[:m])
            common = int(differ[0]) if len(differ) else m
            lower = None
            while path[-1][1] > common:
                lower = path.pop()
            node, depth = path[-1]
            if depth < common:  # split the run below: its first part becomes the branching node
                below = lower[0]
                top = len(self.runs)
                cut = common - depth
                self.runs.append(self.runs[below][:cut])
                self.runs[below] = self.runs[below][cut:]
                self.kids[node][self.kids[node].index(below)] = top
                self.kids.append([below])
                self.leaves.append([])
                node = top
                path.append((top, common))
            if len(s) > common:
                new = len(self.runs)
                self.runs.append(s[common:])
                self.kids.append([])
                self.leaves.append([])
                self.kids[node].append(new)
                node = new
                path.append((new, len(s)))
            self.leaves[node].append(i)
            last = s
        # Longest rest below each node and size bounds of its sets.
        count = len(self.runs)
        self.rest, self.small, self.large = [0] * count, [1 << 60] * count, [0] * count
        for node in self._bottom_up():
            own = [sizes[i] for i in self.leaves[node]]
            for kid in self.kids[node]:
                self.rest[node] = max(self.rest[node], len(self.runs[kid]) + self.rest[kid])
                own += (self.small[kid], self.large[kid])
            self.small[node], self.large[node] = min(own, default=1 << 60), max(own, default=0)

    def _bottom_up(self) -> list[int]:
        out, stack = [], [0]
        while stack:
            out.append(node := stack.pop())
            stack += self.kids[node]
        return out[::-1]

    def search(self, query: np.ndarray, size: int, held: np.ndarray, sizes: list[int], threshold: Threshold) -> Iterator[int]:
        """The sets linked with a query: its ranks, its whole size, and a mask of its ranks."""
        least, left = threshold.least(size), len(query)
        stack = [(0, 0)]
        while stack:
            node, shared = stack.pop()
            for i in self.leaves[node]:
                if shared >= threshold.overlap(size, sizes[i]):
                    yield i
            for kid in self.kids[node]:
                if self.large[kid] < least or threshold.least(self.small[kid]) > size:
                    continue
                run = self.runs[kid]
                now = shared + int(np.count_nonzero(held[run]))
                # What can still be added: the longest rest of the subtree, and the query's later ranks.
                more = min(self.rest[kid], left - int(np.searchsorted(query, run[-1], "right"))) if self.rest[kid] else 0
                if now + more >= threshold.overlap(size, max(self.small[kid], least)):
                    stack.append((kid, now))


def _find(root: list[int], i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def trie_links(index: list[np.ndarray], queries: list[np.ndarray] | None, threshold: Threshold) -> Iterator[tuple[int, int]]:
    """Links (query, index set) of one chunk, found by walking the trie of ``index``.

    Without ``queries`` the index joins itself, and only links that unite components
    are given: as many as make the chunk's components, not all pairs.
    """
    every = np.concatenate([*index, *(queries or [])]) if index else np.zeros(0, U)
    vocabulary, inverse, df = np.unique(every, return_inverse=True, return_counts=True)
    # Frequent shingles first, so that near copies share long paths; those of one set alone never match.
    order = np.lexsort((vocabulary, -df))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    live = int(np.count_nonzero(df > 1))
    ranks, at = [], 0
    for s in [*index, *(queries or [])]:
        r = np.sort(rank[inverse[at : at + len(s)]])
        ranks.append(r[: np.searchsorted(r, live)])
        at += len(s)
    sizes = [len(s) for s in index]
    trie = Trie(ranks[: len(index)], sizes)
    held = np.zeros(live + 1, bool)
    if queries is not None:
        for q, s in enumerate(queries):
            r = ranks[len(index) + q]
            held[r] = True
            for i in trie.search(r, len(s), held, sizes, threshold):
                yield q, i
            held[r] = False
        return
    root, parts = list(range(len(index))), len(index)
    for q, s in enumerate(index):
        if parts == 1:
            return
        r = ranks[q]
        held[r] = True
        for i in trie.search(r, len(s), held, sizes, threshold):
            x, y = _find(root, q), _find(root, i)
            if x != y:
                root[x] = y
                parts -= 1
                yield q, i
        held[r] = False


def _chunks(threshold: Threshold):
    """Rows sorted by (block, part): rep, tokens, asks. Gives the components of each chunk's links as stars: block, a, b."""

    def stars(reps: list[int], sets: list[np.ndarray], asks: list[bool]) -> Iterator[tuple[int, int]]:
        index, query = [i for i, q in enumerate(asks) if not q], [i for i, q in enumerate(asks) if q]
        if query:
            pairs = ((query[q], index[i]) for q, i in trie_links([sets[i] for i in index], [sets[q] for q in query], threshold)) if index else ()
        else:
            pairs = trie_links(sets, None, threshold) if len(sets) > 1 else ()
        root = list(range(len(reps)))
        for q, i in pairs:
            root[_find(root, q)] = _find(root, i)
        low: dict[int, int] = {}
        for i, rep in enumerate(reps):
            low[_find(root, i)] = min(rep, low.get(_find(root, i), rep))
        for i, rep in enumerate(reps):
            if rep != low[_find(root, i)]:
                yield rep, low[_find(root, i)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reps, sets, asks = (None, None), [], [], []
        found: list[tuple[int, int, int]] = []

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], ["block", "a", "b"])
            found.clear()
            return out

        for batch in batches:
            lists = batch.column(3)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False).view(U), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for i, (block, part, rep, ask) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True)):
                if (block, part) != now:
                    found += [(now[0], *x) for x in stars(reps, sets, asks)]
                    now, reps, sets, asks = (block, part), [], [], []
                reps.append(rep), sets.append(flat[at[i] : at[i + 1]]), asks.append(ask)
            yield given()
        found += [(now[0], *x) for x in stars(reps, sets, asks)]
        yield given()

    return run


def _chunk_links(sets: DataFrame, members: DataFrame, threshold: Threshold) -> DataFrame:
    """block, a, b: the stars of each chunk. members: block, part, rep, asks."""
    dealt = sets.join(sized(members), "rep").select("block", "part", "rep", "tokens", "asks").repartition("block", "part").sortWithinPartitions("block", "part")
    return dealt.mapInArrow(_chunks(threshold), "block long, a long, b long")


def links(docs: DataFrame, prof: DataFrame, classes: DataFrame, threshold: Threshold) -> DataFrame:
    """Links a, b between class representatives that make the components of all links."""
    met = staged(first_blocks(prof, threshold).join(classes.select("key", "rep"), "key"), "blocks")
    wanted = staged(_sized_blocks(met).select(F.col("rep").alias("doc_id"), "key").distinct(), "wanted")
    texts = keep_keys(docs.select("doc_id", "text"), wanted, "doc_id")
    sets = staged(texts.select(F.col("doc_id").alias("rep"), "key", "text").mapInArrow(_sets, "rep long, key long, tokens array<long>"), "sets")
    blocked = staged(finer_blocks(sets, threshold).join(sized(wanted.withColumnRenamed("doc_id", "rep")), "key"), "blocks")
    return block_links(sets, blocked, threshold)


def block_links(sets: DataFrame, blocked: DataFrame, threshold: Threshold) -> DataFrame:
    """Links a, b that make the components of all links within blocks. sets: rep, tokens; blocked: block, rep."""
    parts = F.ceil(F.col("size") / CHUNK).cast("int")
    member = _sized_blocks(blocked).withColumn("part", F.pmod(F.xxhash64("block", "rep"), parts).cast("int")).withColumn("asks", F.lit(False))
    member = staged(member.select("block", "size", "part", "rep", "asks"), "members")
    found = staged(_chunk_links(sets, member, threshold), "links")
    large = member.where(F.col("size") > CHUNK)
    if large.isEmpty():
        return found.select("a", "b")
    level = staged(_led(large.select("block", "size", "rep", F.col("rep").alias("root")), found), "level")
    was = None
    while True:
        top = staged(level.select("block", "root").distinct(), "top")
        left = top.groupBy("block").agg(F.count("*").alias("n")).where("n > 1")
        if was is not None:
            left = left.join(sized(was), "block").where("was > n * 2").select("block", "n")
        left = staged(left, "left")
        if left.isEmpty():
            break
        some = top.join(sized(left), "block").select("block", F.col("root").alias("rep"), F.pmod(F.xxhash64("root", "n"), F.ceil(F.col("n") / CHUNK)).cast("int").alias("part"), F.lit(False).alias("asks"))
        new = staged(_chunk_links(sets, some, threshold), "links")
        found, level = found.unionByName(new), staged(_led(level, new), "level")
        # A block whose components met in one chunk is done.
        was = left.where(F.col("n") > CHUNK).select("block", F.col("n").alias("was"))
    # Whatever is outside its block's largest component asks every chunk of the block.
    share = level.groupBy("block", "root").agg(F.count("*").alias("n"))
    main = staged(share.groupBy("block").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("k")).where("k > 1"), "main")
    if main.isEmpty():
        return found.select("a", "b")
    asking = level.join(sized(main), "block").where("root <> main").select("block", "rep", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(True).alias("asks"))
    index = large.join(sized(main.select("block")), "block", "left_semi").select("block", "rep", "part", "asks")
    return found.unionByName(_chunk_links(sets, index.unionByName(asking), threshold)).select("a", "b")


def _sized_blocks(member: DataFrame) -> DataFrame:
    """Members of blocks of two and more, with the block's ``size``; the members stay where they are if the blocks are few."""
    return member.join(sized(member.groupBy("block").agg(F.count("*").alias("size")).where("size > 1")), "block")


def _led(level: DataFrame, found: DataFrame) -> DataFrame:
    """``level`` with the root of each member's root."""
    above = found.select("block", F.col("a").alias("root"), F.col("b").alias("above"))
    return level.join(sized(above), ["block", "root"], "left").withColumn("root", F.coalesce("above", "root")).drop("above")


def jaccard_components(docs: DataFrame, threshold: Threshold | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) for every row.

    Null and empty texts have no shingles and stand alone; texts of fewer than five
    words have one, their whole word sequence; equal texts (repeated rows too) are one
    class. Rows with a null doc_id are kept with their doc_id as component and never
    become a representative of others. Rows that share a doc_id with different texts
    count as one node. Other columns are ignored; an empty table gives an empty result.
    """
    threshold = threshold or Threshold()
    prof = staged(profiles(docs, threshold), "profiles")
    classes = staged(prof.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep")), "classes")
    labels = components(links(docs, prof, classes, threshold))
    of = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    return prof.join(of, "key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
