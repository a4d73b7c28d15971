"""Spelling variants: words one edit apart, found by merging subtrees of an errata trie, and grouped under their frequent forms.

Words are counted over all documents. Two words are near if they differ by exactly one inserted, deleted or replaced
code point. Pairs are found within blocks:

1. Let m be the length of the shorter word of a pair. The two agree in their first m // 2 code points or in their last
   m - m // 2. So each word stands in four blocks: by its beginning and by its end, as a word of m and of m + 1 code points.
2. A block with more than ``WEIGHT`` code points is split in the same way, by more of the beginning or more of the end of what
   its words don't share yet, until it is small enough or nothing is left to split.
3. A block's words make a trie of what they don't share. At each node the heavy child (most words) stays, and the light
   subtrees are merged, each node of them a bounded number of times, so n words cost O(n log n) steps:
   with their first character skipped into the node itself, with it replaced by the heavy child's into the heavy subtree, with it
   ignored among each other, small to large; and the heavy child with its character skipped into each light one.
   Terminals that coincide are near. Both words leave each other at this node, so each pair is found there and nowhere else in the block.

Of the blocks that a pair shares only one reports it: that of its shorter length m and of their beginning, if they agree in all of
that, or else that of their end. Blocks go by 64-bit hashes of what they share.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import split_join, staged, tune, with_totals

#: Code points and occurrences of a word, at least; a form is FORM times as frequent as its variants.
LENGTH, TIMES, FORM = 5, 3, 2
#: One occurrence in MISPRINT loses a code point.
MISPRINT = 97
#: Code points that a block's words have beside what they share, at most, as long as it can be split.
WEIGHT = 1 << 17

LETTERS = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counted(docs: DataFrame) -> DataFrame:
    """word, n of the words of all documents, misprints included, with LENGTH code points and TIMES occurrences at least."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(LETTERS), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    found = hashed.select(F.when(F.col("h") % MISPRINT == 0, cut).otherwise(F.col("run")).alias("word"))
    return found.where(F.char_length("word") >= LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= TIMES)


class Trie:
    """Words by their characters; ``words[node]`` is the number of the word that ends there, or -1."""

    def __init__(self, words: list[str]):
        self.kids: list[dict[str, int]] = [{}]
        self.words, self.depth = [-1], [0]
        for i, word in enumerate(words):
            node = 0
            for c in word:
                below = self.kids[node].get(c)
                if below is None:
                    below = self.kids[node][c] = len(self.kids)
                    self.kids.append({}), self.words.append(-1), self.depth.append(self.depth[node] + 1)
                node = below
            self.words[node] = i
        # Children are numbered after their parents.
        self.size = [int(w >= 0) for w in self.words]
        for node in range(len(self.kids) - 1, -1, -1):
            self.size[node] += sum(self.size[k] for k in self.kids[node].values())

    def _meet(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """Words of the subtrees a and b with the same rest."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if self.words[a] >= 0 and self.words[b] >= 0:
                yield self.words[a], self.words[b]
            few, many = (self.kids[a], self.kids[b]) if len(self.kids[a]) <= len(self.kids[b]) else (self.kids[b], self.kids[a])
            stack += [(self.kids[a][c], self.kids[b][c]) for c in few if c in many]

    def _merge(self, roots: list[int]) -> Iterator[tuple[int, int]]:
        """Words of different ones of the subtrees with the same rest: each is merged into an errata trie, the largest first."""
        kids: list[dict[str, int]] = [{}]
        ends: list[list[int]] = [[]]
        for root in sorted(roots, key=lambda r: -self.size[r]):
            stack = [(root, 0)]
            while stack:
                node, at = stack.pop()
                word = self.words[node]
                if word >= 0:
                    yield from ((word, other) for other in ends[at])
                    ends[at].append(word)
                for c, kid in self.kids[node].items():
                    below = kids[at].get(c)
                    if below is None:
                        below = kids[at][c] = len(kids)
                        kids.append({}), ends.append([])
                    stack.append((kid, below))

    def near(self, below: int) -> Iterator[tuple[int, int]]:
        """Pairs of words one edit apart that leave each other at a node of a depth under ``below``."""
        for node, kids in enumerate(self.kids):
            if self.depth[node] >= below or self.size[node] < 2:
                continue
            heavy = max(kids, key=lambda c: self.size[kids[c]])
            top, light = kids[heavy], [c for c in kids if c != heavy]
            # The heavy child's character skipped: what follows it, against the light children and the word that ends here.
            if self.words[node] >= 0:
                yield from ((self.words[node], self.words[k]) for k in kids.values() if self.words[k] >= 0)
            for c in light:
                if c in self.kids[top]:
                    yield from self._meet(kids[c], self.kids[top][c])
                # The light child's character replaced by the heavy one's, or skipped.
                yield from self._meet(kids[c], top)
                for d, lower in self.kids[kids[c]].items():
                    if d != c and d in kids:
                        yield from self._meet(lower, kids[d])
            if len(light) > 1:
                yield from self._merge([kids[c] for c in light])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: block, m, front, back, below, word, n. Gives word, near, near_n of each pair, both ways."""

    def found(key: tuple, words: list[str], counts: list[int], out: list[tuple]) -> None:
        _, m, front, back, below = key
        trie = Trie([w[front : len(w) - back] for w in words])
        for i, j in trie.near(below - front):
            if min(len(words[i]), len(words[j])) == m:
                out.append((words[i], words[j], counts[j]))
                out.append((words[j], words[i], counts[i]))

    now: tuple | None = None
    words: list[str] = []
    counts: list[int] = []
    for batch in batches:
        out: list[tuple] = []
        *keys, word, n = (c.to_pylist() for c in batch.columns)
        for *key, w, k in zip(*keys, word, n, strict=True):
            if now is None or key[0] != now[0]:
                if len(words) > 1:
                    found(now, words, counts, out)
                now, words, counts = tuple(key), [], []
            words.append(w), counts.append(k)
        yield _found(out)
    out = []
    if len(words) > 1:
        found(now, words, counts, out)
    yield _found(out)


def _found(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["word", "near", "near_n"])


def _in_blocks(rows: DataFrame) -> DataFrame:
    """The two halves of each row's block: one by more of the beginning, one by more of the end.

    rows: word, n, m, front, back (code points shared so far at either end), below (where the words have to part). Of the m - front - back
    code points that aren't shared yet, all but one agree: half of them after the front, or the others before the back.
    """
    rest = F.col("m") - F.col("front") - F.col("back")
    more = F.expr("cast((m - front - back) div 2 as int)")
    first = rows.where(F.col("below") > F.col("front") + more).select("word", "n", "m", (F.col("front") + more).alias("front"), "back", "below")
    last = rows.select("word", "n", "m", "front", (F.col("back") + rest - more).alias("back"), F.least(F.col("below"), F.col("front") + more).alias("below"))
    return first.unionByName(last)


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with block, a 64-bit name of what the block's words share, and weight, the code points beside that."""
    shared: list[Column] = ["m", "front", "back", "below", F.substring("word", F.lit(1), F.col("front")), F.expr("right(word, back)")]
    return rows.withColumns({"block": F.xxhash64(*shared), "weight": F.char_length("word").cast("long") - F.col("front") - F.col("back")})


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near, near_n: for each word of ``words`` (word, n; distinct) those one edit apart, with their n."""
    tune(words.sparkSession)
    length = F.char_length("word")
    todo = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).withColumns({"front": F.lit(0), "back": F.lit(0), "below": F.col("m") + 1})
    out: DataFrame | None = None
    while True:
        rows = staged(_keyed(_in_blocks(todo)), "blocks")
        sums = with_totals(rows, "block", "word", {"members": F.count("*"), "all": F.sum("weight"), "short": F.min(F.char_length("word"))})
        met = staged(sums.where("members > 1 and short = m"), "met")
        large = (F.col("all") > WEIGHT) & (F.col("m") - F.col("front") - F.col("back") > 1)
        fit = met.where(~large).select("block", "m", "front", "back", "below", "word", "n").repartition("block").sortWithinPartitions("block")
        pairs = staged(fit.mapInArrow(_pairs, "word string, near string, near_n long"), "near")
        out = pairs if out is None else out.unionByName(pairs)
        todo = met.where(large).select("word", "n", "m", "front", "back", "below")
        if todo.isEmpty():
            return out


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following ``form`` ends; forms: word, form, of the words that have one. Each round doubles the steps."""
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        above = now.select(F.col("word").alias("root"), F.col("root").alias("above"))
        new = staged(split_join(now, above, "root", "word", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        now = new.drop("moved")
        if new.where("moved").isEmpty():
            return now


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word.

    ``form`` is the near word of largest n (ties: the smallest in code-point order), if that is at least FORM times the word's n, else
    null, as is form_n; ``root`` is where forms lead to, the word itself without one. Null and empty texts have no words. Rows without doc_id count
    with an empty id; rows that repeat a doc_id or a text count each. Words of any length stand whole. Other columns don't matter; an empty
    table has no words.
    """
    words = staged(counted(docs), "words")
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), "near"))
    each = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    each = staged(words.join(each, "word", "left").withColumn("form", F.when(F.col("best.near_n") >= FORM * F.col("n"), F.col("best"))), "near")
    ends = roots(each.where("form is not null").select("word", F.col("form.near").alias("form")))
    out = each.join(ends, "word", "left")
    return out.select("word", F.col("form.near").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("form.near_n").alias("form_n"))
