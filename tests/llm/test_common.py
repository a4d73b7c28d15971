import random

from pyspark.sql import functions as F

from tessella.llm.common import discard, hot_keys, staged, with_totals
from tessella.llm.graph import components


def test_hot_keys_are_found_and_change_nothing(spark):
    r = random.Random(1)
    rows = [(7 if r.random() < 0.4 else r.randrange(1000), i) for i in range(6000)] + [(None, 1)]
    df = staged(spark.createDataFrame(rows, "k long, v long").repartition(5), "rows")
    assert hot_keys(df, "k", "v") == [7]
    totals = {"n": F.count("*"), "low": F.min("v"), "high": F.max(F.struct("v", "k"))}
    plain = sorted(map(repr, with_totals(df, "k", "v", totals, []).collect()))
    for hot in ([7], [7, 1, 2], None):
        assert sorted(map(repr, with_totals(df, "k", "v", totals, hot).collect())) == plain
    assert hot_keys(df.limit(0), "k", "v") == [] and with_totals(df.limit(0), "k", "v", totals).collect() == []


def test_discarded_tables_are_gone(spark):
    df = staged(spark.range(5), "five")
    assert df.count() == 5
    path = df.staged_path.removeprefix("file://")
    discard(df)
    import os

    assert not os.path.exists(path)


def test_components_of_a_hot_star_and_chains(spark):
    edges = [(1, i) for i in range(2, 3000)] + [(i, i + 1) for i in range(5000, 5040)] + [(8, 8), (None, 3), (9000, 9001), (9001, 9000), (2500, 5020)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in [*range(1, 3000), *range(5000, 5041)]} | {9000: 9000, 9001: 9000}
