"""Which tokens of a rollout train: the ends of its key actions, found by sweeps over offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Names of tools.
ALWAYS = ("ask_user", "submit_solution")
DIFF = "inspect_schema_diff"
RUN = "execute_sql"


def key_actions(calls: DataFrame, rollout: str, place: str) -> DataFrame:
    """Calls (name, masked) that decide something: questions and answers, whatever isn't masked once an unmasked diff has been seen,
    and unmasked executions. A null ``masked`` is false; a call without a name decides nothing."""
    open_call = ~F.coalesce("masked", F.lit(False))
    seen = F.max((F.col("name") == DIFF) & open_call).over(Window.partitionBy(rollout).orderBy(place).rowsBetween(Window.unboundedPreceding, -1))
    later = F.coalesce(seen, F.lit(False))
    return calls.withColumn("__later", later).where(F.col("name").isin(*ALWAYS) | (open_call & ((F.col("name") == RUN) | (F.col("name").isNotNull() & F.col("__later"))))).drop("__later")


def token_ranges(tokens: DataFrame, spans: DataFrame, rollout: str, span: str) -> DataFrame:
    """rollout, span, first, last: the tokens (0, 1, ..., ``last`` excluded) that share a character with each span.

    tokens: start_char, end_char (excluded), in order and apart; spans the same, of any number and overlap, empty ones and those with a null end meeting nothing. One sweep over all ends in the order
    of their characters counts the tokens begun and ended so far: no token meets a span by a join on ranges.
    """
    mark = lambda df, at, kind, of: df.select(F.col(rollout).alias("r"), of.alias("span"), F.col(at).cast("long").alias("at"), F.lit(kind).alias("kind"))
    spans = spans.where("start_char < end_char")
    none = F.lit(None).cast(spans.schema[span].dataType)
    # At one character: spans end ahead of tokens that begin there, and begin after tokens that end there.
    marks = mark(spans, "end_char", 0, F.col(span)).unionByName(mark(tokens, "end_char", 1, none)).unionByName(mark(spans, "start_char", 2, F.col(span))).unionByName(mark(tokens, "start_char", 3, none))
    over = Window.partitionBy("r").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = marks.withColumns({"ended": F.count_if(F.col("kind") == 1).over(over), "begun": F.count_if(F.col("kind") == 3).over(over)})
    each = swept.where("kind in (0, 2)").groupBy("r", "span").agg(F.max(F.when(F.col("kind") == 2, F.col("ended"))).alias("first"), F.max(F.when(F.col("kind") == 0, F.col("begun"))).alias("last"))
    return each.where("first < last").withColumnsRenamed({"r": rollout, "span": span})


def key_action_mask(tokens: DataFrame, calls: DataFrame, rollout: str, place: str, suffix: int = 96) -> DataFrame:
    """``tokens`` with ``place`` (0, 1, ... in a rollout) and ``trains``: of each key action the last ``suffix`` tokens that are active.

    tokens: rollout, start_char, end_char, active; calls: rollout, place, name, masked, start_char, end_char. A rollout whose key actions hold no active
    token trains on its last ``suffix`` active ones. Null ``active`` is false. Rollouts without tokens are absent, and calls of unknown rollouts mean nothing.
    """
    if suffix <= 0:
        raise ValueError("suffix is one token at least")
    active = F.coalesce("active", F.lit(False))
    rows = tokens.withColumn("place", (F.row_number().over(Window.partitionBy(rollout).orderBy("start_char", "end_char")) - 1).cast("long"))
    ranges = token_ranges(tokens, key_actions(calls, rollout, place), rollout, place)
    start = F.greatest("first", F.col("last") - suffix)
    turns = F.explode(F.array(F.struct(start.alias("at"), F.lit(1).alias("step")), F.struct(F.col("last").alias("at"), F.lit(-1).alias("step"))))
    steps = ranges.select(F.col(rollout).alias("r"), turns.alias("x")).groupBy("r", "x.at").agg(F.sum("x.step").alias("step"))
    met = rows.join(steps, (F.col(rollout) == F.col("r")) & (F.col("place") == F.col("at")), "left").drop("r", "at")
    so_far = Window.partitionBy(rollout).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("__kept", active & (F.coalesce(F.sum("step").over(so_far), F.lit(0)) > 0))
    from_end = Window.partitionBy(rollout).orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    some = F.max("__kept").over(Window.partitionBy(rollout))
    return met.withColumn("trains", F.when(some, F.col("__kept")).otherwise(active & (F.count_if(active).over(from_end) <= suffix))).drop("__kept", "step")
