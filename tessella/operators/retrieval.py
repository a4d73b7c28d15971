"""Retrieval by shared terms from a base of any size: an inverted index, joined, with bounds on what common terms can add.

A question first meets the entries under its rarest terms, as many as BUDGET postings allow. The best of those, as many as are wanted, set a bar: an entry with
none of these terms has at most the others, so it matters only if they are as many as the bar is high. Questions
where they are meet all entries but those that share only so few of the commonest terms that they stay below the bar, and keep those that reach it. Nothing else is
looked at, no question meets the base as a whole, and the result is that of comparing all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.matching import present
from tessella.functions.texts import search_terms
from tessella.sources.staging import few, staged

#: Postings under a question's rare terms that are looked at first; the rarest term always is.
BUDGET = 500


def _entries(base: DataFrame, text: Column, fill: Column) -> DataFrame:
    """The base with ``__entry``, a number for each row, ``__terms``, and ``__fill``, how much of what is wanted an entry makes up."""
    return staged(base.withColumns({"__entry": F.monotonically_increasing_id(), "__terms": search_terms(F.coalesce(text, F.lit(""))), "__fill": fill.cast("long")}), "entries")


def overlaps(questions: DataFrame, entries: DataFrame, want: int) -> DataFrame:
    """__question, __entry, overlap (shared distinct terms, 1 at least): for each question all pairs that can be among its best ones, up to the one with which their ``__fill`` is ``want``, ties included.

    questions: __question, __asked (terms); entries: __entry, __terms, __fill.
    """
    terms = questions.select("__question", F.explode("__asked").alias("term"))
    # Terms by number: of the entries only those that some question has.
    words = few(terms.select("term").distinct().withColumn("word", F.monotonically_increasing_id()), "words")
    held = entries.select("__entry", "__fill", F.explode("__terms").alias("term")).join(words, "term")
    held = staged(held.groupBy("__entry", "__fill").agg(F.collect_list("word").alias("__held")), "held")
    length = held.select(F.explode("__held").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    asked = terms.join(words, "term").join(length, "word")
    rare_first = Window.partitionBy("__question").orderBy("df", "word")
    asked = asked.withColumns({"place": F.row_number().over(rare_first), "so_far": F.sum("df").over(rare_first.rowsBetween(Window.unboundedPreceding, 0)), "m": F.count("*").over(Window.partitionBy("__question"))})
    asked = staged(asked.withColumn("early", (F.col("place") == 1) | (F.col("so_far") <= BUDGET)).drop("term"), "asked")
    wanted = few(asked.groupBy("__question").agg(F.collect_list("word").alias("__wanted")), "wanted")
    first = staged(_scored(asked.where("early"), wanted, held), "first")
    # What the last of the best so far shares; where they don't fill what is wanted, every shared term counts.
    order = Window.partitionBy("__question").orderBy(F.desc("overlap"), "__entry").rowsBetween(Window.unboundedPreceding, 0)
    bar = first.withColumn("filled", F.sum("__fill").over(order)).where(F.col("filled") >= want).groupBy("__question").agg(F.max("overlap").alias("bar"))
    late = asked.groupBy("__question").agg(F.count_if(~F.col("early")).alias("late")).join(bar, "__question", "left").fillna(1, ["bar"]).where("late >= bar")
    late = few(late.select("__question", "bar"), "late")
    again = asked.join(late, "__question").where("place <= m - bar + 1")
    more = _scored(again, wanted, held).join(late, "__question").where("overlap >= bar").drop("bar")
    return first.join(late.select("__question"), "__question", "left_anti").unionByName(more).drop("__fill")


def _scored(chosen: DataFrame, wanted: DataFrame, held: DataFrame) -> DataFrame:
    """__question, __entry, overlap, __fill of the pairs that share one of the chosen terms; all shared terms count."""
    met = held.select("__entry", F.explode("__held").alias("word")).join(few(chosen.select("__question", "word"), "chosen"), "word")
    # Dealt by entry once: for the pairs and for the entries' terms.
    pairs = met.select("__question", "__entry").repartition("__entry").distinct()
    both = pairs.join(held, "__entry").join(wanted, "__question")
    return both.select("__question", "__entry", F.array_size(F.array_intersect("__wanted", "__held")).alias("overlap"), "__fill")


def best_entries(questions: DataFrame, key: str, text: str, base: DataFrame, k: int) -> DataFrame:
    """key, knowledge, phrase, overlap: the k entries of a knowledge base (knowledge, entry) that fit each question best.

    Whole phrases first (the name in the question or the question in the name, in any case), then by shared terms, then by name;
    entries that share nothing are left out. A null or blank question has no entries, an entry without a name no phrase.
    """
    entries = _entries(base.select("knowledge", "entry"), F.concat_ws(" ", "knowledge", "entry"), F.lit(1))
    rows = questions.select(F.col(key).alias("__question"), F.lower(F.trim(text)).alias("q"), search_terms(F.col(text)).alias("__asked")).where("q <> ''")
    rows = staged(rows, "questions")
    names = entries.select("__entry", F.lower("knowledge").alias("name"))
    held = present(rows, "__question", "q", names, "name").select(F.col("key").alias("__question"), F.col("pattern").alias("name")).join(names, "name").select("__question", "__entry")
    holds = present(names, "__entry", "name", rows, "q").select(F.col("key").alias("__entry"), F.col("pattern").alias("q")).join(rows.select("__question", "q"), "q").select("__question", "__entry")
    phrases = staged(held.unionByName(holds).distinct().withColumn("phrase", F.lit(True)), "phrases")
    # Of the phrases' entries the shared terms are counted too.
    asked = rows.select("__question", "__asked")
    counted = phrases.join(asked, "__question").join(entries.select("__entry", "__terms"), "__entry")
    counted = counted.select("__question", "__entry", F.array_size(F.array_intersect("__asked", "__terms")).alias("overlap"), "phrase")
    others = overlaps(asked, entries, k).join(phrases, ["__question", "__entry"], "left_anti").withColumn("phrase", F.lit(False))
    every = counted.unionByName(others).join(entries.select("__entry", "knowledge"), "__entry")
    order = Window.partitionBy("__question").orderBy(F.desc("phrase"), F.desc("overlap"), "knowledge", "__entry")
    best = every.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k)
    return best.select(F.col("__question").alias(key), "knowledge", "phrase", "overlap")


def ranked_blocks(questions: DataFrame, key: str, query: str, blocks: DataFrame, most_chars: int) -> DataFrame:
    """key, blocks (names in order, as text), truncated: the schema blocks (place, name, block) that share terms with each question, most first, as far as ``most_chars`` reach.

    Blocks are joined by blank lines and cut at ``most_chars``; those that begin behind the cut aren't named. A question that shares no term, or is
    null, gets all in their order. Blocks aren't empty.
    """
    entries = _entries(blocks.select("place", "name", F.length("block").alias("size"), "block"), F.col("block"), F.col("size") + 2)
    least = entries.agg(F.min("size")).first()[0] or 0
    # So many blocks fill the text, whichever they are.
    k = most_chars // (least + 2) + 2
    rows = staged(questions.select(F.col(key).alias("__question"), search_terms(F.coalesce(F.col(query), F.lit(""))).alias("__asked")), "questions")
    sizes = entries.select("__entry", "place", "name", "size")
    # Filled by them, the text is longer than ``most_chars``: what comes behind is neither named nor seen.
    shared = overlaps(rows, entries, most_chars + 3).join(sizes, "__entry")
    order = Window.partitionBy("__question").orderBy(F.desc("overlap"), "place", "__entry")
    shared = shared.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k)
    found = staged(_cut(shared, "__question", "__r", most_chars), "blocks")
    start = sizes.orderBy("place", "__entry").limit(k).withColumns({"__question": F.lit(0), "__r": F.row_number().over(Window.orderBy("place", "__entry"))})
    whole = _cut(start, "__question", "__r", most_chars).drop("__question")
    rest = rows.join(found, "__question", "left_anti").select("__question").crossJoin(F.broadcast(whole))
    return found.unionByName(rest).select(F.col("__question").alias(key), "blocks", "truncated")


def _cut(rows: DataFrame, key: str, rank: str, most_chars: int) -> DataFrame:
    so_far = F.sum(F.col("size") + 2).over(Window.partitionBy(key).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", so_far - 2)
    named = F.array_sort(F.collect_list(F.when(F.col("end") - F.col("size") < most_chars, F.struct(rank, "name"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(named, lambda x: x["name"]), ",").alias("blocks"), (F.max("end") > most_chars).alias("truncated"))
