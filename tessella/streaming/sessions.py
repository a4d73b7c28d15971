"""Sessions as keyed streams: a state for each session, timers for silence, results that don't depend on how a stream is cut.

A fold takes a session's events in the order of their arrival and keeps what it knows in a small tuple. Runs of a stream
over any cuts of the same events, restarts between them included, give the rows of one pass over all.
Sessions are dealt over SHARDS keys of the stream: a call for every session costs milliseconds, however few events it has, so a call
takes all sessions of a shard. A shard's state is read and written whole, once a batch, and it has one timer, for the first of its sessions that is due.
Within a micro-batch a session's events are put in order; a session's events of later batches come later. A batch is
bounded by the source (``maxFilesPerTrigger``, ``maxBytesPerTrigger``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tessella.operators.rollouts import AFTER_ASK, ONE_SHOT, TOOLS
from tessella.sources.staging import shared_dir

#: Keys that all sessions are dealt over. A stream that goes on from a checkpoint needs the number it began with.
SHARDS = 512

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Fold:
    """What is kept of a session (``state``: DDL, ``start``), what events add to it and what time does."""

    state, start, rows = "", (), ""
    #: Whether time alone changes it. Where it doesn't, there is no watermark, and no event is too late.
    timed = False

    def step(self, state: tuple, event) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def batch(self, state: tuple) -> list[tuple]:
        """Rows given once after each batch of a session's events."""
        return []

    def due(self, state: tuple) -> int | None:
        """When time alone changes the state next, in microseconds."""
        return None

    def expire(self, state: tuple, now: int) -> tuple[tuple, list[tuple]]:
        return state, []


class Follow(Fold):
    """What a reader of a session gets: its events, a sign of life after each ``silence`` (microseconds) without one, and an end after a terminal event.

    Nothing follows the end. Rows: kind (event, keepalive, end), sequence (of the event, or of the last one), at (microseconds), event_type.
    """

    state, start = "sequence long, last long, beats long, closed boolean", (0, 0, 0, False)
    rows = "kind string, sequence long, at long, event_type string"
    timed = True

    def __init__(self, silence: int, terminal: Sequence[str]):
        self.silence, self.terminal = silence, tuple(terminal)

    def _beats(self, state: tuple, until: int) -> tuple[tuple, list[tuple]]:
        sequence, last, beats, closed = state
        out = []
        while sequence and not closed and last + self.silence * (beats + 1) < until:
            beats += 1
            out.append(("keepalive", sequence, last + self.silence * beats, None))
        return (sequence, last, beats, closed), out

    def step(self, state, event):
        if state[3]:
            return state, []
        (sequence, last, _, _), out = self._beats(state, event.at)
        closed = event.event_type in self.terminal
        out.append(("event", sequence + 1, event.at, event.event_type))
        if closed:
            out.append(("end", sequence + 1, event.at, None))
        return (sequence + 1, max(last, event.at), 0, closed), out

    def due(self, state):
        return None if state[3] else state[1] + self.silence * (state[2] + 1)

    def expire(self, state, now):
        return self._beats(state, now)


class Ending(Fold):
    """How a session ends: the first of a submission and the budgets of calls and executions. Rows: calls, reason, after each batch."""

    state, start = "calls long, runs long, reason string", (0, 0, "running")
    rows = "calls long, reason string"

    def __init__(self, most_calls: int, most_runs: int, run: str = "purchase", submission: str = "error"):
        self.most_calls, self.most_runs, self.run, self.submission = most_calls, most_runs, run, submission

    def step(self, state, event):
        calls, runs, reason = state[0] + 1, state[1] + (event.event_type == self.run), state[2]
        if reason == "running":
            reason = "submitted" if event.event_type == self.submission else "sql_budget" if runs > self.most_runs else "turn_limit" if calls > self.most_calls else reason
        return (calls, runs, reason), []

    def batch(self, state):
        return [(state[0], state[2])]


class Tools(Fold):
    """Which tools a rollout may use next (``rollouts.allowed_tools``), after each batch. Rows: at (events so far), allowed (sorted, by commas).

    Places are 1, 2, ... in the rollout; 0 stands for never. Events have tool, masked, ok, validated and contract.
    """

    state = "at long, version long, recovered long, trigger long, after long, diff long, asked long, followed long, used long, validated boolean"
    start, rows = (0, 0, 0, 0, 0, 0, 0, 0, 0, False), "at long, allowed string"

    def step(self, state, event):
        at, version, recovered, trigger, after, diff, asked, followed, used, validated = state
        at += 1
        if not _true(event.masked):
            tool = event.tool
            if tool in ONE_SHOT:
                used |= 1 << ONE_SHOT.index(tool)
            if tool == "get_schema_version":
                version, after = version or at, after or (at if trigger else 0)
            elif tool == "inspect_schema_diff":
                recovered, diff = recovered or (at if version else 0), at
            elif tool == "ask_user":
                asked = at
            elif tool == "execute_sql":
                validated = _true(event.validated)
                if not recovered and (_false(event.ok) or _false(event.contract)):
                    trigger, after = at, 0
            if tool in AFTER_ASK:
                followed = at
        return (at, version, recovered, trigger, after, diff, asked, followed, used, validated), []

    def batch(self, state):
        at, _, _, trigger, after, diff, asked, followed, used, validated = state
        if trigger and not after:
            allowed = ["get_schema_version"]
        elif trigger and diff <= after:
            allowed = ["inspect_schema_diff"]
        elif validated:
            allowed = ["submit_solution"]
        elif asked > followed:
            allowed = list(AFTER_ASK)
        else:
            allowed = [t for t in TOOLS if t not in ONE_SHOT or not used >> ONE_SHOT.index(t) & 1]
        return [(at, ",".join(sorted(allowed)))]


def _true(flag) -> bool:
    return not pd.isna(flag) and bool(flag)


def _false(flag) -> bool:
    return not pd.isna(flag) and not flag


class _Shard(StatefulProcessor):
    """The sessions of one shard: ``held`` has the state of each, with its key as text, since pandas has no whole numbers beside nulls."""

    def __init__(self, fold: Fold, order: list[str]):
        self.fold, self.order = fold, order
        self.columns = ["session", *(c.split()[0] for c in fold.rows.split(", "))]

    def init(self, handle) -> None:
        fields = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in self.fold.state.split(", "))
        self.handle, self.held = handle, handle.getValueState("held", f"sessions array<struct<key: string, {fields}>>")

    def _states(self) -> dict:
        held = self.held.get()
        return {s[0]: tuple(s[1:]) for s in held[0]} if held else {}

    def _given(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=self.columns)

    def _keep(self, states: dict) -> None:
        self.held.update(([(k, *s) for k, s in states.items()],))
        if not self.fold.timed:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = min((d for s in states.values() if (d := self.fold.due(s)) is not None), default=None)
        if due is not None:
            self.handle.registerTimer(-(-due // 1000))

    def handleInputRows(self, key, rows, timerValues):
        states, seen, out = self._states(), {}, []
        events = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        step, start = self.fold.step, self.fold.start
        for session, event in zip(events["session"], events.itertuples(index=False)):
            states[session], found = step(states.get(session, start), event)
            seen[session] = None
            out += [(session, *r) for r in found]
        for session in seen:
            out += [(session, *r) for r in self.fold.batch(states[session])]
        self._keep(states)
        yield from self._given(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        states, out, now = self._states(), [], timerValues.getCurrentWatermarkInMs() * 1000
        for session, state in states.items():
            states[session], found = self.fold.expire(state, now)
            out += [(session, *r) for r in found]
        self._keep(states)
        yield from self._given(out)

    def close(self) -> None:
        pass


def folded(events: DataFrame, key: str, fold: Fold, order: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """The rows that ``fold`` gives for each ``key`` (long) of a stream; state and timers survive restarts. A fold with timers needs a timestamp ``ts``, and
    takes no event that is later than ``late``. Columns ``shard`` and ``session`` are the stream's own: underscores ahead of a name are lost on the way to Python."""
    if fold.timed:
        events = events.withWatermark("ts", late)
    rows = events.withColumns({"shard": F.pmod(F.xxhash64(key), F.lit(SHARDS)), "session": F.col(key).cast("string")})
    made = rows.groupBy("shard").transformWithStateInPandas(_Shard(fold, list(order)), f"session string, {fold.rows}", "Append", "EventTime" if fold.timed else "None")
    return made.select(F.col("session").cast("long").alias(key), *(c.split()[0] for c in fold.rows.split(", ")))


def run(rows: DataFrame, to: str, checkpoint: str) -> None:
    """Takes what a stream has and appends its rows to the files in ``to``, each batch once."""
    spark = rows.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    # State with timers needs this store.
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def in_cuts(events: DataFrame, at: str, cuts: int, made) -> DataFrame:
    """Rows of a stream over ``events`` that arrive in ``cuts`` parts, by ranges of the long column ``at``; each part is a run of its own, with
    what the run before has left in the checkpoint; rows without ``at`` come last. made(stream): the rows."""
    spark = events.sparkSession
    to = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    ends = events.agg(F.min(at), F.max(at)).first()
    low, width = ends[0] or 0, (ends[1] or 0) - (ends[0] or 0) + 1
    out = None
    for k in range(cuts):
        inside = (F.col(at) >= low + width * k // cuts) & (F.col(at) < low + width * (k + 1) // cuts)
        part = events.where(inside | F.col(at).isNull() if k == cuts - 1 else inside)
        part.write.parquet(f"{to}/store/cut={k}")
        stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{to}/store")
        out = made(stream)
        run(out, f"{to}/rows", f"{to}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{to}/rows")


def following(rows: DataFrame, sequence: int) -> DataFrame:
    """What a reader still gets who has seen a session up to ``sequence``: the rest of the stored events first, then what comes."""
    return rows.where(F.when(F.col("kind") == "event", F.col("sequence") > sequence).otherwise(F.col("sequence") >= sequence))


def events_with_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table with timestamps, and ``at`` in microseconds."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("at", F.unix_micros("ts"))
