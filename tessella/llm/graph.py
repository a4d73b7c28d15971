"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, hot_keys, staged, with_totals


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """The smallest node that each linked node reaches: columns ``node``, ``component``.

    Links are long ids in either direction; self links and repeated links are
    harmless, null ends are ignored, and nodes without links are absent. Each round
    every node points its larger neighbours at the smallest node it knows (large
    star), then its smaller ones (small star). The minimum of a hot node's neighbours is combined
    where they are, so no large neighbourhood is gathered in one place. Every
    round is written to the shared folder; a round that leaves the count and the
    64-bit digest of the links as they were is the last.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    links, was = _written(links)
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A node has no more rows among the large stars than it has neighbours.
        hot = hot_keys(both, "u", "v")
        led = with_totals(both, "u", "v", {"m": F.min("v")}, hot).where("v > u")
        large = led.select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        stars = staged(large, "stars") if hot else None
        small = with_totals(stars if hot else large, "u", "v", {"m": F.min("v")}, hot).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        old, (links, now) = links, _written(small.select("x.*").where("u > v").distinct())
        discard(old, *([stars] if hot else []))
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _written(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links, staged, and their count and digest, which are taken as they are written."""
    seen = Observation()
    out = staged(links.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("digest")), "links")
    return out, (seen.get["n"], seen.get["digest"])
