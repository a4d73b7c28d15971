"""Generation that can be broken off anywhere: attempts by group and variant, with all state in a store.

Folders ``attempts/batch=N`` hold what was tried, ``commits/batch=N`` that batch N is whole. A run reads the committed batches, works out
where every group stands, and goes on; a batch that broke off has no commit and is overwritten. So runs that were interrupted and a run
that was not give the same rows, whatever number of rounds a batch makes at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.positions import ranked
from tessella.sources.staging import staged

#: Rounds of a group that one row stands for until they are dealt to tasks.
STRETCH = 1000

#: From (group, variant, turn) to the same rows with ``ok``, ``error`` (null where ok) and ``made``, a string.
Attempt = Callable[[DataFrame], DataFrame]


class Exhausted(RuntimeError):
    """The target can't be reached within the limits."""


class Store:
    """Batches of attempts in a folder: group, variant, turn (null while groups are being covered), ok, error, made."""

    def __init__(self, spark: SparkSession, to: str, kind: str = "string") -> None:
        self.spark, self.to = spark, to
        self.schema = f"group {kind}, variant long, turn long, ok boolean, error string, made string"
        self.next = 0
        # The first commit is made here, so that there is always a folder to read.
        spark.createDataFrame([(-1,)], "number int").write.mode("overwrite").parquet(f"{to}/commits/batch=-1")
        self.next = spark.read.schema("number int, batch int").parquet(f"{to}/commits").agg(F.max("number")).first()[0] + 1

    def rows(self) -> DataFrame:
        """All attempts of committed batches."""
        if self.next == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.to}/attempts/batch={i}" for i in range(self.next)))

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.to}/attempts/batch={self.next}")
        self.spark.createDataFrame([(self.next,)], "number int").coalesce(1).write.mode("overwrite").parquet(f"{self.to}/commits/batch={self.next}")
        self.next += 1


def _covered(store: Store, open_groups: DataFrame, attempt: Attempt, rounds: int, most: int) -> None:
    """Tries the next variants of groups that have no row yet, up to the first that is right."""
    tries = open_groups.select("group", F.explode(F.sequence("next", F.least(F.col("next") + rounds, F.lit(most)) - 1)).alias("variant"))
    made = staged(attempt(tries.withColumn("turn", F.lit(None).cast("long"))), "covering")
    first = made.where("ok").groupBy(F.col("group").alias("g")).agg(F.min("variant").alias("first"))
    kept = made.join(first, F.col("group") == F.col("g"), "left").where("first is null or variant <= first")
    store.add(kept.select("group", "variant", "turn", "ok", "error", "made"))


def _dry(made: DataFrame, base: int, upto: int, dry: int) -> int | None:
    """The turn that ends the first ``dry`` rounds in a row without a right row, up to ``upto``, if there are such; ``base`` is the last turn known to have one.

    Turns go by blocks of ``dry``: only the last right turn of a block can be followed by so many dry ones, and what ends them stands in the next block.
    """
    turns = made.where("ok").select("turn").unionByName(made.sparkSession.createDataFrame([(base,)], "turn long"))
    blocks = turns.groupBy(F.floor(F.col("turn") / dry).alias("block")).agg(F.min("turn").alias("low"), F.max("turn").alias("high"))
    ahead = blocks.select((F.col("block") - 1).alias("block"), F.col("low").alias("after"))
    ends = F.col("high") + dry
    alone = (ends <= upto) & (F.col("after").isNull() | (F.col("after") > ends))
    return blocks.join(ahead, "block", "left").where(alone).agg(F.min(ends)).first()[0]


def _filled(store: Store, per: DataFrame, attempt: Attempt, turn: int, upto: int, left: int, base: int, dry: int) -> None:
    """Makes the rounds ``turn`` to ``upto``, each one attempt of every group, and keeps what lies up to the row that reaches the target, or to the end of ``dry`` rounds in a row without one."""
    last = F.lit(upto).cast("long")
    # Many rounds of few groups would all stand in one task, so they are dealt by stretches.
    stretches = per.where(F.col("turn") <= upto).select("group", "next", "turn", F.explode(F.sequence("turn", last, F.lit(STRETCH).cast("long"))).alias("from"))
    if upto - turn >= STRETCH:
        stretches = stretches.repartition("group", "from")
    turns = stretches.select("group", "next", "turn", F.explode(F.sequence("from", F.least(F.col("from") + (STRETCH - 1), last))).alias("at"))
    made = staged(attempt(turns.select("group", (F.col("next") + F.col("at") - F.col("turn")).alias("variant"), F.col("at").alias("turn"))), "filling")
    rows = made.select("group", "variant", "turn", "ok", "error", "made")
    # As many rounds as can't hold a dry stretch need no look at them.
    stop = _dry(made, base, upto, dry) if upto - base >= dry else None
    if stop is not None:
        rows = rows.where(F.col("turn") <= stop)
    right = rows.where("ok").select("turn", "group")
    if right.count() >= left:
        end = ranked(right, [], ["turn", "group"], "rank").where(F.col("rank") == left).first()
        rows = rows.where((F.col("turn") < end["turn"]) | ((F.col("turn") == end["turn"]) & (F.col("group") <= end["group"])))
    store.add(rows)


def grow(store: Store, groups: DataFrame, attempt: Attempt, target: int, rounds: int = 8, most_covering: int = 80, most: int = 160, dry: int = 12) -> DataFrame:
    """The right rows of the store, once there are ``target`` of them.

    groups: ``group`` (distinct, not null) and ``repeats``. First every group gets a row: its variants 0, 1, ... are tried until one is
    right. Then come rounds over the groups that repeat, in the order of ``group``, until the target is reached; covering may go beyond it.
    Rejections stay in the store with their errors. ``Exhausted``: a group without a right row after ``most_covering`` variants, ``dry``
    rounds in a row without one, or a group past ``most`` variants. ``attempt`` has to give the same answer for the same variant.
    ``rounds`` is how many go into the first batch; a later one has as many as the target seems to need, at most as many as have been
    made so far, so the number of batches grows with the logarithm of the rounds. It changes nothing else.
    """
    while True:
        done = store.rows()
        stand = done.groupBy(F.col("group").alias("g")).agg((F.max("variant") + 1).alias("n"), F.count_if("ok").alias("have"), (F.max("turn") + 1).alias("t"))
        zero = F.lit(0).cast("long")
        per = groups.join(stand, F.col("group") == F.col("g"), "left").select("group", "repeats", F.coalesce("n", zero).alias("next"), F.coalesce("have", zero).alias("have"), F.coalesce("t", zero).alias("turn"))
        per = staged(per, "standing")
        bare = per.where("have = 0")
        stuck = bare.agg(F.count("*"), F.max("next")).first()
        if stuck[0]:
            if stuck[1] >= most_covering:
                raise Exhausted(f"a group has no row after {most_covering} variants")
            _covered(store, bare, attempt, rounds, most_covering)
            continue
        found, right, rate = done.agg(F.count_if("ok"), F.max(F.when(F.col("ok"), F.col("turn"))), F.avg(F.when(F.col("turn").isNotNull(), F.col("ok").cast("int")))).first()
        if found >= target:
            return done.where("ok")
        pool = per.where("repeats")
        members, turn, far = pool.agg(F.count("*"), F.min("turn"), F.max("next")).first()
        base = -1 if right is None else right
        idle = max(0, turn - 1 - base) if turn is not None else dry
        if idle >= dry or far > most:
            errors = ", ".join(f"{r.error}: {r['count']}" for r in done.where("not ok").groupBy("error").count().orderBy(F.desc("count")).limit(5).collect())
            raise Exhausted(f"{found} of {target} rows; {errors}")
        # As many rounds as the share of right rows so far lets expect, and some more.
        wanted = math.ceil(1.05 * (target - found) / (members * rate)) + 1 if rate else rounds
        now = min(max(rounds, min(turn, wanted)), most + 1 - far)
        _filled(store, pool, attempt, turn, turn + now - 1, target - found, base, dry)
