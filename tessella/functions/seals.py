"""Seals: one SHA-256 for a result of any size, as the root of a tree of row digests, and where two versions differ.

A node has WIDE children or so. Rows of a multiset are dealt by the first hex digits of their digest, rows of a list by their
place, so the tree depends on the rows alone: not on partitions, runs or the order in which they come. No task holds more than
a node's children; equal rows are one leaf with their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.sources.staging import staged

#: Hex digits that tell the children of a node apart, and so how many there are.
DIGITS = 3
WIDE = 16**DIGITS

#: Doubles from here on are written as they print, smaller ones to ten places.
LARGE = 1e27


def canonical_value(name: str, kind: T.DataType) -> Column:
    """A value as text that tells its kind and its bytes' number: ``s3:abc``; a null is ``-``.

    Kinds: i whole numbers, n decimals in their scale, f floats to ten places (``nan``, ``inf``, ``-inf``; no negative zero), s text, x binary in hex, v all else as
    it prints. So different rows never have one text.
    """
    c = F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c, tag = c.cast("double"), "f"
        plain = F.when(F.abs(c) < LARGE, F.round(F.when(F.abs(c) < LARGE, c), 10).cast("decimal(38,10)").cast("string")).otherwise(c.cast("string"))
        text = F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(plain)
    elif isinstance(kind, T.IntegralType):
        text, tag = c.cast("string"), "i"
    elif isinstance(kind, T.BinaryType):
        text, tag = F.hex(c), "x"
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        text, tag = F.to_json(c), "v"
    else:
        text, tag = c.cast("string"), "n" if isinstance(kind, T.DecimalType) else "s" if isinstance(kind, T.StringType) else "v"
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit(tag), F.octet_length(text).cast("string"), F.lit(":"), text))


def canonical_row(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row's values in column order; names don't enter."""
    fields = [f for f in df.schema if columns is None or f.name in columns]
    return F.concat(*(canonical_value(f.name, f.dataType) for f in fields)) if fields else F.lit("")


def _digits(n: int) -> int:
    """Hex digits by which n leaves are dealt to nodes of about WIDE."""
    d = 0
    while n > WIDE ** (d // DIGITS + 1):
        d += DIGITS
    return d


def _leaves(df: DataFrame, key: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """at (where a leaf stands: its row's digest, or its key's ahead of it), leaf, n."""
    row = F.sha2(canonical_row(df, columns), 256)
    at = row if key is None else F.concat(F.sha2(key, 256), row)
    rows = df.select(at.alias("at")).groupBy("at").agg(F.count("*").alias("n"))
    return rows.select("at", F.sha2(F.concat_ws(":", "at", F.col("n").cast("string")), 256).alias("leaf"), "n")


def _joined(rows: DataFrame, by: str, order: str, leaf: str) -> DataFrame:
    """by, leaf, n: the digest of each group's leaves in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, leaf))), lambda x: x[leaf])
    return rows.groupBy(by).agg(F.sha2(F.concat_ws("", listed), 256).alias("leaf"), F.sum("n").alias("n"))


def multiset_fingerprint(df: DataFrame) -> DataFrame:
    """row_count and value_hash: rows count as often as they come, in any order. Without rows the hash is that of the empty text."""
    rows = staged(_leaves(df), "leaves")
    digits = _digits(rows.count())
    rows = _joined(rows.withColumn("up", F.substring("at", 1, digits)), "up", "at", "leaf")
    while digits:
        digits -= DIGITS
        rows = _joined(rows.select(F.col("up").alias("at"), F.substring("up", 1, digits).alias("up"), "leaf", "n"), "up", "at", "leaf")
    return _root(rows)


def ordered_fingerprint(df: DataFrame, *order: str) -> DataFrame:
    """row_count and value_hash where order counts: WIDE consecutive rows are a node, and so on (ties in the order of their rows)."""
    from tessella.operators.positions import numbered

    keys = [f"__o{i}" for i in range(len(order))]
    # Rows are hashed first, so that only digests are dealt out and written.
    rows = df.select(F.sha2(canonical_row(df), 256).alias("leaf"), *(F.col(c).alias(k) for c, k in zip(order, keys, strict=True)), F.lit(1).cast("long").alias("n"))
    rows = staged(numbered(rows, [*keys, "leaf"], "at").select("at", "leaf", "n"), "leaves")
    left = rows.count()
    while True:
        rows = _joined(rows.withColumn("up", F.expr(f"at div {WIDE}")), "up", "at", "leaf").withColumnRenamed("up", "at")
        left = -(-left // WIDE)
        if left <= 1:
            return _root(rows)


def _root(rows: DataFrame) -> DataFrame:
    none = F.sha2(F.lit("").cast("binary"), 256)
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("row_count"), F.coalesce(F.max("leaf"), none).alias("value_hash"))


def differing_ranges(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """range (the first hex digits of the key's digest), old_rows, new_rows: the ranges of keys whose rows differ.

    Both versions have the same columns. One pass over each; only digests of ranges meet. Rows without a key have one of their own.
    """
    return _ranges(*_both(old, new, key))


def changed_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key (its digest) and change (added, removed, changed) of the keys whose rows differ: looked for in the differing ranges only."""
    a, b, digits = _both(old, new, key)
    ranges = staged(_ranges(a, b, digits).select("range"), "ranges")
    narrow = [_joined(rows.join(ranges, F.substring("at", 1, digits) == F.col("range"), "left_semi").withColumn("key", F.substring("at", 1, 64)), "key", "at", "leaf") for rows in (a, b)]
    both = narrow[0].select("key", F.col("leaf").alias("was")).join(narrow[1].select("key", F.col("leaf").alias("now")), "key", "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))
    return both.select("key", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("change"))


def _both(old: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame, int]:
    name = lambda df: canonical_value(key, df.schema[key].dataType)
    a, b = staged(_leaves(old, name(old)), "old"), staged(_leaves(new, name(new)), "new")
    return a, b, _digits(max(a.count(), b.count())) + DIGITS


def _ranges(a: DataFrame, b: DataFrame, digits: int) -> DataFrame:
    sides = [_joined(rows.withColumn("range", F.substring("at", 1, digits)), "range", "at", "leaf") for rows in (a, b)]
    both = sides[0].select("range", F.col("leaf").alias("was"), F.col("n").alias("old_rows")).join(sides[1].select("range", F.col("leaf").alias("now"), F.col("n").alias("new_rows")), "range", "full_outer")
    both = both.where(~F.col("was").eqNullSafe(F.col("now")))
    return both.select("range", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("old_rows", "new_rows")))
