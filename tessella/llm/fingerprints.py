"""Order MinHash fingerprints, natively in Spark SQL functions.

A text is cut into tokens (runs of up to TOKEN characters without white space; in long runs, as in texts
without spaces, a token starts at every character that more than SLIDE of its run are left at), and its
k-mers are K tokens in a row, numbered by occurrence: the second time a k-mer comes it
is another element. Each element has a hash of 40 bits. The SKETCHES ranges of that hash
are one-permutation sketches: each range with an element selects its smallest and the next one in the order
of hashes (of a later range if its own has no other, after the last the first), puts the two back in the order of
the text, and hashes the pair. Two texts agree
in a sketch only if they select the same elements in the same order, so the share of
agreeing sketches falls with edit distance, moves of passages included, where plain MinHash
sees the same set.

A fingerprint is the text of its sketches, 16 hex digits each: 5 bits name the sketch,
59 its hash. Sketches without any element are absent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a token at most, tokens of a k-mer, and sketches (a power of two).
TOKEN, K, SKETCHES = 12, 3, 32
#: A token starts at every character of a run up to its last so many.
SLIDE = 24
#: Captures a token and moves on by one character inside long runs, else by the token.
PATTERN = rf"(?=(\S{{1,{TOKEN}}}))(?:(?=\S{{{SLIDE + 1}}})\S|\S{{1,{TOKEN}}})"

_BITS = SKETCHES.bit_length() - 1
#: An element is one long: 40 bits of hash, 24 of the place in the text (modulo 2**24).
_PLACE = (1 << 24) - 1


def _top(x: str) -> str:
    return f"shiftrightunsigned({x}, {64 - _BITS})"


def sketches(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the column ``name``, array<bigint>: the sketches of ``text`` (null: empty)."""
    t, h, e = f"__{name}_t", f"__{name}_h", f"__{name}_e"
    picks = ", ".join(f"{t}[i + {k}]" for k in range(K))
    hashes = f"""CASE WHEN size({t}) >= {K} THEN transform(sequence(0, size({t}) - {K}), i -> xxhash64({picks}) & {~_PLACE}L)
        WHEN size({t}) > 0 THEN array(xxhash64(array_join({t}, ' ')) & {~_PLACE}L) ELSE array() END"""
    packed = f"sort_array(transform({h}, (x, i) -> x | (i & {_PLACE}L)))"
    # Only texts that repeat a k-mer number the members of each run of equal hashes.
    starts = f"filter(sequence(0, size(s) - 1), i -> i = 0 OR (s[i] & {~_PLACE}L) <> (s[i - 1] & {~_PLACE}L))"
    run = f"""if(coalesce(get(r, k + 1), size(s)) = a + 1, array(s[a]),
        transform(slice(s, a + 1, coalesce(get(r, k + 1), size(s)) - a), (x, n) -> if(n = 0, x, (xxhash64(x & {~_PLACE}L, n) & {~_PLACE}L) | (x & {_PLACE}L))))"""
    numbered = f"sort_array(flatten(transform(array({packed}), s -> flatten(transform(array({starts}), r -> flatten(transform(r, (a, k) -> {run})))))))"
    elements = f"CASE WHEN size(array_distinct({h})) = size({h}) THEN {packed} ELSE {numbered} END"
    # Sorted, a sketch is a stretch of one top-bits value; its first element and the next one are selected.
    following = "s[(i + 1) % size(s)]"
    mine, other = f"x & {~_PLACE}L", f"{following} & {~_PLACE}L"
    mixed = f"""if(size(s) = 1, xxhash64({mine}), if((x & {_PLACE}L) <= ({following} & {_PLACE}L), xxhash64({mine}, {other}), xxhash64({other}, {mine})))"""
    word = f"if(i = 0 OR {_top('s[i - 1]')} <> {_top('x')}, shiftleft({_top('x')}, {64 - _BITS}) | shiftrightunsigned({mixed}, {_BITS}), NULL)"
    return (
        df.withColumn(t, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PATTERN), F.lit(1)))
        .withColumn(h, F.expr(hashes).cast("array<bigint>"))
        .withColumn(e, F.expr(elements))
        .withColumn(name, F.expr(f"flatten(transform(array({e}), s -> array_compact(transform(s, (x, i) -> {word}))))"))
        .drop(t, h, e)
    )


def likeness(a: str, b: str) -> Column:
    """The share of sketches present in either text that agree; 1 for two empty ones."""
    present = F.expr(f"size(array_union(transform({a}, x -> {_top('x')}), transform({b}, x -> {_top('x')})))")
    agree = F.size(F.array_intersect(a, b))
    return F.when(present == 0, F.lit(1.0)).otherwise(agree / present)


def shown(sketch: str) -> Column:
    """The fingerprint as text."""
    return F.lower(F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row. Null and empty texts have the empty fingerprint."""
    return sketches(docs.select("doc_id", "text"), "text", "sketch").select("doc_id", shown("sketch").alias("fingerprint"))


def _bucket(bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most doc_id, in two steps of about sqrt(n)."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*(F.lit(g[0]) for g in groups))
    inner = F.array(*(F.array(*(F.lit(b) for b in g)) for g in groups))
    at_most = lambda x: x <= F.col("doc_id")
    outer = F.size(F.filter(heads, at_most))
    found = F.when(outer == 0, F.lit(0)).otherwise((outer - 1) * step + F.size(F.filter(F.get(inner, outer - 1), at_most)))
    return F.coalesce(F.when(F.col("doc_id").isNotNull(), found), F.lit(0))


def with_next(docs: DataFrame, prepare: Callable[[DataFrame], DataFrame], carry: list[str]) -> DataFrame:
    """``docs`` (doc_id, text) after ``prepare``, which adds columns, with ``next_<column>`` of the next row in descending doc_id.

    After the last comes the first. Rows of one doc_id follow in the order of their texts' hashes,
    null doc_ids come last. Buckets of doc_ids, cut at quantiles, are sorted on their own; each
    gets as a guest the first row of the next bucket, so no order over all rows is built.
    """
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = docs.select("doc_id").where("doc_id is not null").approxQuantile("doc_id", [k / parts for k in range(1, parts)], 1 / (4 * parts))
    bounds = sorted({int(x) for x in found})
    rows = docs.withColumn("__bucket", _bucket(bounds)).withColumn("__tie", F.xxhash64("text"))
    # The first row of each bucket: one row for each bucket reaches the driver.
    key = F.struct(F.col("doc_id").isNull().alias("n"), (-F.col("doc_id")).alias("d"), F.col("__tie").alias("t"))
    heads = sorted(rows.groupBy("__bucket").agg(F.min(key).alias("k")).collect(), key=lambda r: -r["__bucket"])
    if not heads:
        return prepare(rows.drop("__bucket", "__tie")).withColumns({f"next_{c}": F.col(c) for c in carry})
    before = [heads[-1], *heads[:-1]]
    guests = docs.sparkSession.createDataFrame(
        [(h["__bucket"], None if h.k.n else -h.k.d, h.k.t, b["__bucket"]) for h, b in zip(heads, before, strict=True)], "hb int, hd long, ht long, into int"
    )
    match = (F.col("__bucket") == F.col("hb")) & F.col("doc_id").eqNullSafe(F.col("hd")) & (F.col("__tie") == F.col("ht"))
    guest = rows.join(F.broadcast(guests), match).withColumn("__bucket", F.col("into")).drop("hb", "hd", "ht", "into").withColumn("__guest", F.lit(1))
    order = Window.partitionBy("__bucket").orderBy("__guest", F.col("doc_id").desc_nulls_last(), "__tie")
    # Prepared once the guests, few as they are, have been picked.
    both = prepare(rows.withColumn("__guest", F.lit(0)).unionByName(guest))
    return both.withColumns({f"next_{c}": F.lead(c).over(order) for c in carry}).where("__guest = 0").drop("__bucket", "__tie", "__guest")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint beside that of an edited text and of the next document.

    The edited text has the last third of the code points replaced by the first as
    many (or all) of the next document. A null text is empty: no characters, the empty
    fingerprint, like another empty one (1.0) and unlike any other (0.0). Equal texts
    have equal fingerprints. One document alone is its own next. Repeated rows stay,
    other columns don't matter, an empty table gives an empty result.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(base, lambda df: sketches(df, "text", "sketch"), ["text", "sketch"]).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), F.col("n_chars").cast("int") - cut), F.col("next_text").substr(F.lit(1), cut)))
    rows = rows.select("doc_id", "n_chars", "edited", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "sketch", "next_sketch")
    return sketches(rows, "edited", "edited_sketch").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown("sketch").alias("fingerprint"),
        shown("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
    )
