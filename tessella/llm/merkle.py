"""Merkle manifest of a dataset: a tree of digests for each group of rows, and a tree of the groups' roots.

Leaves of a group stand in the order of their ids; while several nodes remain, every FANOUT consecutive ones become the
SHA-256 of their hex digests. What remains is the group's root; the roots, in the order of the groups, give the root
of all. Steps:

1. Leaves are sorted by range into an RDD, so that a large group lies in several partitions. One pair of counts for each partition (its
   first and last group) tells how many rows of its first group lie ahead, and so each leaf's position in its group.
2. Each partition builds the complete, aligned subtrees of what it holds. Nodes whose siblings lie in another partition, at most
   ``FANOUT - 1`` at either end of a level, are shuffled by their coordinate (group, level, parent), level by level.
3. A second pass over the same sorted partitions (their shuffle files serve again) takes the finished nodes about its ends and folds
   each leaf along its siblings up to the root.

A lost executor costs its ranges: the leaves are a written table, and the order has no ties.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import groupby

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Children of a node.
FANOUT = 8
#: Leaves of a partition, which a task holds at once.
LEAVES = 50_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: list[str]) -> str:
    """Lowercase hex SHA-256 of the concatenated texts."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """The digest of values: each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


#: A node's children and the place of one of them, for each level from the leaf up.
Path = Sequence[tuple[int, list[str]]]


def siblings(path: Path) -> list[str]:
    """The children beside one's own, level by level, left to right."""
    return [s for at, children in path for i, s in enumerate(children) if i != at]


def fold(node: str, path: Path) -> str:
    """The root that follows from a node and the siblings on its path."""
    for at, children in path:
        node = digest([*children[:at], node, *children[at + 1 :]])
    return node


class Run:
    """Consecutive leaves of one group in one partition, the complete nodes above them, and ``outside``, the children of nodes finished elsewhere."""

    def __init__(self, start: int, leaves: list[str], outside: dict[tuple[int, int], list[str]] | None = None):
        self.outside = outside or {}
        #: For each level the number of the first complete node, and the complete nodes.
        self.levels: list[tuple[int, list[str]]] = [(start, leaves)]
        while True:
            first, nodes = self.levels[-1]
            skip = -first % FANOUT
            parents = [digest(nodes[i : i + FANOUT]) for i in range(skip, len(nodes) - FANOUT + 1, FANOUT)]
            if not parents:
                break
            self.levels.append(((first + skip) // FANOUT, parents))
        self.height = 1 + max((level for level, _ in self.outside), default=len(self.levels) - 2)

    def ragged(self) -> Iterator[tuple[int, int, str]]:
        """level, number and digest of complete nodes whose parent isn't complete here."""
        for level, (first, nodes) in enumerate(self.levels):
            above, parents = self.levels[level + 1] if level + 1 < len(self.levels) else (0, [])
            low, high = above * FANOUT, (above + len(parents)) * FANOUT
            for i, node in enumerate(nodes, first):
                if not low <= i < high:
                    yield level, i, node

    def path(self, number: int) -> list[tuple[int, list[str]]]:
        """The path of a leaf to its group's root."""
        out = []
        for level in range(self.height):
            number, at = divmod(number, FANOUT)
            children = self.outside.get((level, number))
            if children is None:
                first, nodes = self.levels[level]
                children = nodes[number * FANOUT - first : (number + 1) * FANOUT - first]
            out.append((at, children))
        return out


def _order(row: tuple) -> tuple:
    """Group and id with nulls first, the leaf, and the row's number where all that is equal."""
    group, key, node, _, number = row
    return (group, key is not None, 0 if key is None else key, node, number)


def _runs(rows: list[tuple], ahead: int) -> Iterator[tuple[str, int, list[tuple]]]:
    """Group, start and rows of each run of a partition."""
    for k, (group, members) in enumerate(groupby(rows, key=lambda r: r[0])):
        yield group, 0 if k else ahead, list(members)


def _ahead(ranges: RDD) -> list[int]:
    """For each partition how many rows of its first group lie ahead, from two counts for each partition."""

    def ends(lists: Iterator[list[tuple]]) -> Iterator[tuple | None]:
        for rows in lists:
            runs = [(group, len(members)) for group, _, members in _runs(rows, 0)]
            yield (runs[0][0], *runs[-1], len(runs) == 1) if runs else None

    out, last, held = [], None, 0
    for found in ranges.mapPartitions(ends).collect():
        out.append(held if found and found[0] == last else 0)
        if found:
            _, last, n, single = found
            held = n + (out[-1] if single else 0)
    return out


def _boundaries(ahead: list[int]):
    """kind, group, level, number, digest: complete nodes without a complete parent (kind 0), and runs (kind 1: their partition, start and rows)."""

    def run(index: int, lists: Iterator[list[tuple]]) -> Iterator[tuple]:
        for rows in lists:
            for group, start, members in _runs(rows, ahead[index]):
                yield (1, group, index, start, str(len(members)))
                for node in Run(start, [m[2] for m in members]).ragged():
                    yield (0, group, *node)

    return run


def _finished(nodes: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Children of the nodes that are put together across partitions (group, level of the children, parent, children), and group, root.

    nodes: group, level, number, digest; sizes: group, n.
    """
    height = F.expr(f"filter(sequence(0, 21), h -> pow({FANOUT}, h) >= n)[0]")
    nodes = staged(nodes.join(sizes.select("group", height.alias("height")), "group"), "nodes")
    kept, roots, now = [], [], None
    for level in range(1 + nodes.agg(F.max("height")).first()[0]):
        here = nodes.where(F.col("level") == level).select("group", "height", "number", "digest")
        here = here if now is None else here.unionByName(now)
        roots.append(here.where(F.col("height") == level).select("group", F.col("digest").alias("root")))
        of = here.where(F.col("height") > level).groupBy("group", "height", F.expr(f"number div {FANOUT}").alias("parent"))
        # At most FANOUT children of each parent.
        of = of.agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "digest"))), lambda x: x["digest"]).alias("children"))
        of = staged(of, "parents")
        kept.append(of.select("group", F.lit(level).alias("level"), "parent", "children"))
        now = of.select("group", "height", F.col("parent").alias("number"), F.sha2(F.concat_ws("", "children"), 256).alias("digest"))
    return reduce(DataFrame.unionByName, kept), reduce(DataFrame.unionByName, roots)


def tree(leaves: DataFrame, made: Callable, schema: str, tails: Callable[[DataFrame], DataFrame], least: int = 1) -> DataFrame:
    """A tree for each group of ``leaves`` and what ``made`` makes of each leaf in it.

    leaves: group (not null), id, leaf, shown, number; read several times, so a written table. tails: from a table of group, root
    to one of group, tail (strings). made(row, path, tail) gives a row of ``schema`` for a leaf's row, its path and its group's tail.
    ``least``: partitions at least; each holds about LEAVES leaves at most.
    """
    spark, n = leaves.sparkSession, leaves.count()
    if not n:
        return spark.createDataFrame([], schema)
    rows = leaves.select("group", "id", "leaf", "shown", "number").rdd.map(tuple)
    ranges = rows.keyBy(_order).sortByKey(numPartitions=max(least, -(-n // LEAVES))).values().glom()
    parts, ahead = ranges.getNumPartitions(), _ahead(ranges)
    found = spark.createDataFrame(ranges.mapPartitionsWithIndex(_boundaries(ahead)), "kind int, group string, level long, number long, digest string")
    found = staged(found, "boundaries")
    runs = found.where("kind = 1").select("group", F.col("level").alias("partition"), F.col("number").alias("start"), F.col("digest").cast("long").alias("n"))
    finished, roots = _finished(found.where("kind = 0").drop("kind"), runs.groupBy("group").agg(F.sum("n").alias("n")))
    # What each run needs from elsewhere: its group's tail, and the children of finished nodes at both of its ends.
    ends = runs.join(finished.groupBy("group").agg(F.max("level").alias("top")), "group")
    ends = ends.select("group", "partition", F.explode(F.array("start", F.col("start") + F.col("n") - 1)).alias("end"), "top")
    at = ends.select("group", "partition", "end", F.explode(F.sequence(F.lit(0), "top")).alias("level"))
    at = at.select("group", "partition", "level", F.expr(f"end div cast(pow({FANOUT}, level + 1) as bigint)").alias("parent")).distinct()
    pieces = at.join(finished, ["group", "level", "parent"]).select("partition", "group", "level", "parent", F.col("children").alias("value"))
    tail = runs.join(tails(roots), "group").select("partition", "group", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("parent"), F.col("tail").alias("value"))
    pieces = staged(pieces.unionByName(tail), "pieces").rdd.map(lambda r: (r[0], tuple(r[1:])))
    pieces = pieces.coalesce(1) if parts == 1 else pieces.partitionBy(parts, int)

    def run(index: int, pairs: Iterator[tuple[list[tuple], list[tuple]]]) -> Iterator[tuple]:
        for members, outside in pairs:
            of: dict[str, dict[tuple[int, int], list[str]]] = {}
            for _, (group, level, parent, value) in outside:
                of.setdefault(group, {})[level, parent] = value
            for group, start, own in _runs(members, ahead[index]):
                tail = of[group].pop((-1, 0))
                built = Run(start, [m[2] for m in own], of[group])
                for number, row in enumerate(own, start):
                    yield made(row, built.path(number), tail)

    # The sorted ranges are shuffle files already; each is read once more beside its pieces.
    return spark.createDataFrame(ranges.zip(pieces.glom()).mapPartitionsWithIndex(run), schema)


def _packed(path: Path) -> list[str]:
    return [x for at, children in path for x in (str(at), str(len(children)), *children)]


def _unpacked(flat: list[str]) -> list[tuple[int, list[str]]]:
    out, i = [], 0
    while i < len(flat):
        n = int(flat[i + 1])
        out.append((int(flat[i]), flat[i + 2 : i + 2 + n]))
        i += 2 + n
    return out


def _tails(roots: DataFrame) -> DataFrame:
    """group, tail: the group's root, the root of all, and the path between them."""
    leaves = staged(roots.select(F.lit("").alias("group"), F.col("group").alias("id"), F.col("root").alias("leaf"), F.lit(None).cast("string").alias("shown"), F.lit(0).alias("number")), "subroots")
    top = lambda found: found.select("group", F.array("root").alias("tail"))
    return staged(tree(leaves, lambda row, path, tail: (row[1], [row[2], *tail, *_packed(path)]), "group string, tail array<string>", top), "tails")


def leaves(docs: DataFrame) -> DataFrame:
    """group (lang, told from null), id, leaf, shown (the digest of the tampered row, else null) and number of each document."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    rows = docs.select(*fields)
    changed = leaf(*(F.col(f) for f in fields[:-1]), F.translate("text", _UPPER, _LOWER))
    shown = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, changed)
    group = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))
    return rows.select(group.alias("group"), F.col("doc_id").alias("id"), leaf(*(F.col(f) for f in fields)).alias("leaf"), shown.alias("shown"), F.monotonically_increasing_id().alias("number"))


def _manifest(docs: DataFrame, made: Callable, schema: str) -> DataFrame:
    return tree(staged(leaves(docs), "leaves"), made, schema, _tails, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root and proof of every row: for each level the row's place ``at`` and all ``siblings`` with the row's own node left out.

    A null field counts as ``-``, an empty one as ``0:``; null languages are a group of their own, the first; rows without doc_id come first in their group; rows that
    repeat a doc_id stand in the order of their leaves, and equal rows next to each other, each with a proof of its own. Other columns don't matter; an empty table gives no rows.
    """

    def made(row, path, tail):
        whole = [*path, *_unpacked(tail[2:])]
        return (row[1], row[2], tail[0], tail[1], [(at, [*children[:at], *children[at + 1 :]]) for at, children in whole])

    return _manifest(docs, made, "doc_id long, leaf string, subroot string, root string, proof array<struct<at: int, siblings: array<string>>>")


def checked(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 of every row, and folded_root and verified of the row as shown: tampered with or not.

    Every third doc_id by its checksum has its text's A-Z in lower case when it is shown; rows without doc_id are shown as they are. For all else see proofs.
    """

    def made(row, path, tail):
        whole = [*path, *_unpacked(tail[2:])]
        folded = fold(row[3] or row[2], whole)
        return (row[1], row[2], tail[0], tail[1], digest(siblings(whole)), folded, folded == tail[1])

    return _manifest(docs, made, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
