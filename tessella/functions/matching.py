"""Many literal patterns at once: an Aho-Corasick automaton finds them in one pass, leftmost first, the longest of those.

Patterns come in chunks of CHUNK, each one automaton in each worker, so memory is bounded for any number of them; the finds of all chunks
meet by text, where overlaps are settled. Texts stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.staging import staged

#: Patterns of one automaton.
CHUNK = 100_000


def automaton(patterns: list[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for p in patterns:
        made.add_word(p, p)
    made.make_automaton()
    return made


def longest(text: str, made: ahocorasick.Automaton) -> list[tuple[int, str]]:
    """Start and longest pattern of every place where one begins."""
    out: dict[int, str] = {}
    for end, pattern in made.iter(text):
        start = end - len(pattern) + 1
        if len(pattern) > len(out.get(start, "")):
            out[start] = pattern
    return sorted(out.items())


def standing(finds: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Of finds in order of their start, one for each start, those that don't begin inside an earlier one."""
    out, behind = [], 0
    for start, pattern in finds:
        if start >= behind:
            out.append((start, pattern))
            behind = start + len(pattern)
    return out


def _chunks(patterns: DataFrame, column: str) -> Iterator[list[str]]:
    """The distinct patterns, a chunk at a time; null and empty ones match nothing."""
    held: list[str] = []
    for row in patterns.select(column).where(F.col(column) != "").distinct().toLocalIterator():
        held.append(row[0])
        if len(held) == CHUNK:
            yield held
            held = []
    if held:
        yield held


def finds(texts: DataFrame, key: str, text: str, patterns: DataFrame, column: str) -> DataFrame:
    """key, finds (start in code points, pattern; leftmost, then longest, none overlapping) of every row; ``key`` tells rows apart.

    A null text, and any without a pattern, has an empty list. With several chunks each gives the longest find of every place, and the
    finds of a text are settled together.
    """
    spark = texts.sparkSession
    schema = f"key {texts.schema[key].dataType.simpleString()}, finds array<struct<start: bigint, pattern: string>>"
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    parts = [spark.sparkContext.broadcast(chunk) for chunk in _chunks(patterns, column)]
    if len(parts) <= 1:
        return rows.mapInArrow(_searched(parts[0] if parts else None, standing), schema)
    every = [rows.mapInArrow(_searched(part, list), schema) for part in parts]
    return reduce(DataFrame.unionByName, every).groupBy("key").agg(F.flatten(F.collect_list("finds")).alias("finds")).mapInArrow(_settled, schema)


def present(texts: DataFrame, key: str, text: str, patterns: DataFrame, column: str) -> DataFrame:
    """key, pattern of every pattern that a row's text holds, also inside others, once each."""
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))

    def held(part):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = automaton(part.value)
            for batch in batches:
                each = [{p for _, p in made.iter(t)} for t in batch.column(1).to_pylist()]
                at = pa.array([i for i, ps in enumerate(each) for _ in ps], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([p for ps in each for p in ps], pa.string())], ["key", "pattern"])

        return run

    parts = [texts.sparkSession.sparkContext.broadcast(chunk) for chunk in _chunks(patterns, column)]
    none = rows.limit(0).select("key", F.col("text").alias("pattern"))
    return reduce(DataFrame.unionByName, [rows.mapInArrow(held(p), f"key {kind}, pattern string") for p in parts] or [none])


def _searched(patterns, kept: Callable[[list], list]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = automaton(patterns.value) if patterns else None
        for batch in batches:
            yield _rows(batch.column(0), [kept(longest(t, made)) if made and t is not None else [] for t in batch.column(1).to_pylist()])

    return run


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for each in batch.column(1).to_pylist():
            best: dict[int, str] = {}
            for f in sorted(each, key=lambda f: len(f["pattern"])):
                best[f["start"]] = f["pattern"]
            out.append(standing(sorted(best.items())))
        yield _rows(batch.column(0), out)


def _rows(keys: pa.Array, found: list[list[tuple[int, str]]]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("pattern", pa.string())]))
    return pa.RecordBatch.from_arrays([keys, pa.array([[{"start": s, "pattern": p} for s, p in f] for f in found], kind)], ["key", "finds"])


def replaced(texts: DataFrame, key: str, text: str, patterns: DataFrame, column: str, by: str) -> DataFrame:
    """key and text with every find replaced by its pattern's ``by``, in one pass: what was put in is not looked at again. A null text stays null.

    The finds meet their replacements in a join, so the table of patterns may be of any size; a pattern that comes twice counts with its smallest ``by``.
    """
    found = staged(finds(texts, key, text, patterns, column), "finds")
    each = found.select("key", F.explode("finds").alias("f")).select("key", "f.start", "f.pattern")
    said = patterns.groupBy(F.col(column).alias("pattern")).agg(F.min(by).alias("by"))
    put = F.array_sort(F.collect_list(F.struct("start", F.char_length("pattern").alias("n"), F.coalesce("by", F.lit("")).alias("by"))))
    put = each.join(said, "pattern").groupBy(F.col("key").alias("__key")).agg(put.alias("__put"))
    rows = texts.select(key, text).join(put, F.col(key).eqNullSafe(F.col("__key")), "left")
    told = F.expr(f"""aggregate(__put, named_struct('at', 0L, 'out', ''), (a, f) -> named_struct('at', f.start + f.n, 'out', a.out || substring({text}, int(a.at) + 1, int(f.start - a.at)) || f.by),
        a -> a.out || substring({text}, int(a.at) + 1, length({text})))""")
    return rows.select(key, F.when(F.col("__put").isNull(), F.col(text)).otherwise(told).alias(text))
