"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The tokens of each cell are
raked: in turn each margin's weights are scaled so that its levels reach their target
shares, with no cell above the tokens it has, until all margins fit (or can't fit
better, as a level may hold too little). A document is kept with the calibrated probability
of its cell, the raked tokens over those there are, by a hash of doc_id and text, so the draw
is reproducible and needs no shuffle.

Every source and language is a level of its own, with its own target. Raking happens on
the driver, on the cells that occur: columns of one number for each.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized, staged

#: The level of rows without a source or language.
NONE = "(none)"
MARGINS = ("source", "lang", "topic")

#: Topics by the look of a text, the first that applies: name, pattern, and the least matches among 100 characters.
TOPICS = (("marked", r"[#$%&*]", 3), ("table", r"\|", 2), ("loud", r"[A-Z]", 20))
PROSE, SHORT = "prose", "short"


@dataclass(frozen=True)
class Targets:
    """``share``: wanted part of all tokens. ``weights``: wanted shares of a margin's levels; levels not
    named share what is left by their tokens to the power ``power``, as do all of a margin not named."""

    share: float = 0.5
    power: float = 0.7
    weights: dict[str, dict[str, float]] = field(default_factory=dict)
    rounds: int = 200


def topic(text: str = "text") -> Column:
    """A topic from a text's look: short, marked, table, loud or prose."""
    n = F.length(text)
    out = F.when(F.coalesce(n, F.lit(0)) < 80, SHORT)
    for name, pattern, per in TOPICS:
        out = out.when(F.regexp_count(text, F.lit(pattern)) * 100 >= per * n, name)
    return out.otherwise(PROSE)


def tokens(text: str = "text") -> Column:
    """The words of a text: runs without white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")).cast("long"), F.lit(0).cast("long"))


def target_shares(have: dict[str, float], wanted: dict[str, float], power: float) -> dict[str, float]:
    """Shares of a margin's levels that add up to 1."""
    named = {k: float(v) for k, v in wanted.items() if k in have}
    left = max(0.0, 1.0 - sum(named.values()))
    free = {k: v**power for k, v in have.items() if k not in named}
    total = sum(free.values())
    out = named | {k: left * v / total if total else 0.0 for k, v in free.items()}
    whole = sum(out.values())
    return {k: v / whole if whole else 0.0 for k, v in out.items()}


def rake(have: np.ndarray, levels: list[np.ndarray], shares: list[np.ndarray], total: float, rounds: int) -> np.ndarray:
    """Tokens to take of each cell: margins at their shares of ``total`` as near as the tokens allow.

    ``levels[m]``: each cell's level in margin m. ``shares[m]``: the levels' target shares.
    """
    take = have * min(1.0, total / have.sum()) if have.sum() else have.copy()
    for _ in range(rounds):
        before = take.copy()
        for level, share in zip(levels, shares, strict=True):
            want = share * total
            # A level scales up by its cells that aren't taken whole yet, a few passes to fill.
            for _ in range(20):
                now = np.bincount(level, take, len(share))
                full = take >= have
                fixed = np.bincount(level, np.where(full, take, 0), len(share))
                up = want > now
                rest = np.where(up, now - fixed, now)
                goal = np.where(up, want - fixed, want)
                factor = np.divide(goal, rest, out=np.ones_like(goal), where=rest > 0)
                scaled = np.minimum(have, np.where(up[level] & full, take, take * factor[level]))
                if np.allclose(scaled, take, rtol=1e-12, atol=0):
                    break
                take = scaled
        if np.allclose(before, take, rtol=1e-9, atol=1e-9):
            break
    return take


def draw() -> Column:
    """A fixed number from 0 to 1 for each document: by doc_id and text, so rows without doc_id are drawn one by one."""
    return F.pmod(F.xxhash64(F.lit("mixing"), "doc_id", "text"), F.lit(1 << 52)) / float(1 << 52)


def _calibrated(docs: DataFrame, targets: Targets) -> DataFrame:
    """``docs``, which have __topic, __tokens and __draw, with __source and __lang (levels), __weight, __p and __take."""
    rows = docs.withColumns({"__source": F.coalesce(F.col("source").cast("string"), F.lit(NONE)), "__lang": F.coalesce(F.col("lang").cast("string"), F.lit(NONE))})
    # Written, so that levels and cells are counted without reading the texts again.
    counted = staged(rows.groupBy("__source", "__lang", "__topic").agg(F.sum("__tokens").alias("__tokens")), "counted")
    names = [f"__{m}" for m in MARGINS]
    cells = counted.groupBy(*names).agg(F.sum("__tokens").alias("n")).orderBy(*names).toArrow()
    have = cells["n"].to_numpy().astype(np.float64)
    levels, shares = [], []
    for m in MARGINS:
        coded = cells[f"__{m}"].combine_chunks().dictionary_encode()
        level, ordered = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        named = targets.weights.get(m, {})
        absent = sorted(k for k, v in named.items() if v > 0 and k not in set(ordered))
        if absent and len(have):
            raise ValueError(f"the targets name a {m} that no document has: {', '.join(absent)}")
        wanted = target_shares(dict(zip(ordered, np.bincount(level, have, len(ordered)).tolist(), strict=True)), named, targets.power)
        levels.append(level)
        shares.append(np.array([wanted[k] for k in ordered]))
    take = rake(have, levels, shares, targets.share * have.sum(), targets.rounds) if len(have) else have
    probability = np.divide(take, have, out=np.zeros_like(have), where=have > 0)
    weight = probability / (take.sum() / have.sum() if take.sum() else 1.0)
    table = docs.sparkSession.createDataFrame(cells.drop_columns(["n"]).append_column("__weight", pa.array(weight)).append_column("__p", pa.array(probability)))
    return rows.join(sized(table), names).withColumn("__take", F.col("__draw") < F.col("__p"))


def mixed(docs: DataFrame, targets: Targets | None = None) -> DataFrame:
    """doc_id, source, lang, topic (levels), n_tokens, weight, probability, selected for every row.

    ``weight`` is the cell's share of the mixture over its share of the corpus. Null sources and
    languages are the level (none); a null or empty text has no tokens, topic short and the probability of its
    cell (0 where the cell has no tokens). Rows that repeat a doc_id and its text share their fate if they share
    a cell; rows without doc_id are drawn by their texts. Other columns don't matter; an empty table gives
    an empty result.
    """
    looked = staged(docs.select("doc_id", "source", "lang", topic().alias("__topic"), tokens().alias("__tokens"), draw().alias("__draw")), "looked")
    rows = _calibrated(looked, targets or Targets())
    names = [F.col(f"__{m}").alias(m) for m in MARGINS]
    return rows.select("doc_id", *names, F.col("__tokens").alias("n_tokens"), F.col("__weight").alias("weight"), F.col("__p").alias("probability"), F.col("__take").alias("selected"))


def sampled(docs: DataFrame, targets: Targets | None = None) -> DataFrame:
    """The selected rows of ``docs``, with its columns."""
    return _calibrated(docs.withColumns({"__topic": topic(), "__tokens": tokens(), "__draw": draw()}), targets or Targets()).where("__take").select(docs.columns)
