"""Stable hashes: orders, choices, ids and result fingerprints that don't depend on a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hex_digest(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by ``:``, in lower-case hex."""
    return F.sha2(F.concat_ws(":", *(F.col(p) if isinstance(p, str) else p for p in parts)), 256)


def stable_order(key: str, seed: str = "") -> Column:
    """A fixed pseudo-random order of keys: by the SHA-256 of the key, or of seed and key joined by ``:``."""
    text = F.col(key).cast("string")
    return F.sha2(F.concat_ws(":", F.lit(seed), text) if seed else text, 256)


def stable_choice(key: Column, n: int) -> Column:
    """A number below n: the first four bytes of the key's SHA-256, big end first, modulo n."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % n


def digest_mod5(key: Column) -> Column:
    """The SHA-256 as one integer modulo 5: 16 is 1 modulo 5, so the digits' sum does."""
    digits = F.split(F.sha2(key, 256), "")
    total = F.aggregate(digits, F.lit(0), lambda a, d: a + F.coalesce(F.conv(F.when(d != "", d), 16, 10).cast("int"), F.lit(0)))
    return total % 5


def short_id(prefix: str, *parts: str) -> Column:
    """``prefix`` and the first 16 hex digits of the digest of a JSON list of the parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(F.array(*(F.col(p).cast("string") for p in parts))), 256), 1, 16))


def normalized(df: DataFrame) -> DataFrame:
    """Values for comparing results: numbers as doubles to 10 places, text trimmed in lower case; distinct rows."""
    out = []
    for i, f in enumerate(df.schema):
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
        elif isinstance(f.dataType, T.NumericType):
            c = F.round(c.cast("double"), 10)
        out.append(c.alias(f"c{i}"))
    return df.select(*out).distinct()


def same_result(a: DataFrame, b: DataFrame) -> DataFrame:
    """equal, only_a, only_b: whether two results hold the same set of normalised rows (nulls are equal)."""
    left, right = normalized(a), normalized(b)
    only_a = left.subtract(right).agg(F.count("*").alias("only_a"))
    only_b = right.subtract(left).agg(F.count("*").alias("only_b"))
    return only_a.crossJoin(only_b).select(((F.col("only_a") == 0) & (F.col("only_b") == 0)).alias("equal"), "only_a", "only_b")
