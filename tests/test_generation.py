"""Generation that is broken off: any cut gives the rows of a run in one go."""

import itertools

import pytest
from pyspark.sql import functions as F

from tessella.operators.generation import Exhausted, Store, grow


def plain(groups, right, target, repeats):
    """The rules, one attempt after the other: every group until it has a row, then rounds."""
    rows, at = [], dict.fromkeys(groups, 0)
    for g in groups:
        while not right(g, at[g]):
            at[g] += 1
        rows.append((g, at[g]))
        at[g] += 1
    while len(rows) < target:
        for g in (g for g in groups if g in repeats):
            if len(rows) < target and right(g, at[g]):
                rows.append((g, at[g]))
            at[g] += 1
    return sorted(rows)


def right(g, v):
    return (ord(g) * 7 + v * 5) % 4 == 0


def attempts(fail_at=None):
    calls = itertools.count()

    def attempt(tries):
        if next(calls) == fail_at:
            raise RuntimeError("broken off")
        ok = (F.ascii("group") * 7 + F.col("variant") * 5) % 4 == 0
        return tries.select("group", "variant", "turn", ok.alias("ok"), F.when(~ok, "odd").alias("error"), F.when(ok, F.concat("group", F.col("variant").cast("string"))).alias("made"))

    return attempt


def groups_of(spark, names="abcdef", repeats="abcde"):
    return spark.createDataFrame([(g, g in repeats) for g in names], "group string, repeats boolean")


def found(rows):
    return sorted((r.group, r.variant) for r in rows.collect())


@pytest.mark.parametrize("rounds", [1, 3, 12])
def test_rounds_in_a_batch_change_nothing(spark, tmp_path, rounds):
    rows = grow(Store(spark, f"file://{tmp_path}/s"), groups_of(spark), attempts(), 17, rounds=rounds)
    assert found(rows) == plain("abcdef", right, 17, "abcde")


def test_broken_off_anywhere(spark, tmp_path):
    """An attempt that fails, a batch without its commit and a smaller target in between leave the rows of one run."""
    to, want = f"file://{tmp_path}/s", plain("abcdef", right, 23, "abcde")
    for fail_at in (0, 1, 2):
        with pytest.raises(RuntimeError, match="broken off"):
            grow(Store(spark, to), groups_of(spark), attempts(fail_at), 23, rounds=2)
    half = Store(spark, to)
    half.spark.createDataFrame([("a", 99, 99, True, None, "x")], half.schema).write.parquet(f"{to}/attempts/batch={half.next}")
    grow(Store(spark, to), groups_of(spark), attempts(), 14, rounds=2)
    rows = grow(Store(spark, to), groups_of(spark), attempts(), 23, rounds=5)
    assert found(rows) == want
    assert found(grow(Store(spark, to), groups_of(spark), attempts(0), 23)) == want  # nothing is left to attempt


def test_limits(spark, tmp_path):
    never = lambda tries: attempts()(tries).withColumn("ok", F.lit(False))
    with pytest.raises(Exhausted, match="no row after 5"):
        grow(Store(spark, f"file://{tmp_path}/a"), groups_of(spark), never, 3, most_covering=5)
    once = lambda tries: attempts()(tries).withColumn("ok", F.col("turn").isNull() & (F.col("variant") == 1)).withColumn("error", F.lit("late"))
    with pytest.raises(Exhausted, match="6 of 9 rows; late"):
        grow(Store(spark, f"file://{tmp_path}/b"), groups_of(spark), once, 9, rounds=2, dry=3)
    assert Store(spark, f"file://{tmp_path}/b").rows().agg(F.max("turn")).first()[0] == 2
    with pytest.raises(Exhausted, match="of 99 rows"):
        grow(Store(spark, f"file://{tmp_path}/c"), groups_of(spark), attempts(), 99, most=6, rounds=4)
    empty = grow(Store(spark, f"file://{tmp_path}/d"), groups_of(spark, ""), attempts(), 0)
    assert empty.count() == 0


def test_batches_grow_with_the_rounds(spark, tmp_path):
    """Some fifty rounds are a few batches, and give what single rounds give; groups that are a round ahead make no round twice."""
    calls = []

    def counted(tries):
        calls.append(1)
        return attempts()(tries)

    to, want = f"file://{tmp_path}/s", plain("abcdef", right, 131, "abcde")
    grow(Store(spark, to), groups_of(spark), counted, 12, rounds=1, most=200)
    assert found(grow(Store(spark, to), groups_of(spark), counted, 131, rounds=1, most=200)) == want
    assert len(calls) < 20  # of some fifty rounds
    assert Store(spark, to).rows().groupBy("group", "variant").count().where("count > 1").count() == 0


def test_a_dry_stretch_inside_a_batch(spark, tmp_path):
    """Rounds behind a dry stretch count for nothing, however many a batch makes; one that is a round shorter is passed."""

    def until(gap):
        def attempt(tries):
            ok = F.col("turn").isNull() | (F.col("turn") < 9) | (F.col("turn") >= 9 + gap)
            return tries.select("group", "variant", "turn", ok.alias("ok"), F.when(~ok, "late").alias("error"), F.lit("x").alias("made"))

        return attempt

    for rounds in (1, 40):
        to = f"file://{tmp_path}/{rounds}"
        with pytest.raises(Exhausted, match="51 of 99 rows; late"):
            grow(Store(spark, to), groups_of(spark), until(5), 99, rounds=rounds, dry=5)
        assert Store(spark, to).rows().agg(F.max("turn")).first()[0] == 13
        assert grow(Store(spark, f"{to}-passed"), groups_of(spark), until(4), 99, rounds=rounds, dry=5).count() == 99
