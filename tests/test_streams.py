"""Keyed streams and the growing store: any cuts, restarts and repeats give what one pass gives."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.streaming import sessions as live
from tessella.streaming import store

HOUR = 3600 * 10**6


def arrivals(seed, n=60):
    r, at, rows = random.Random(seed), 0, []
    for i in range(n):
        at += r.choice([0, 1, 5, 30]) * HOUR // 10
        rows.append((i, r.randrange(4), r.choice(["view", "click", "purchase", "purchase", "error" if r.random() < 0.3 else "view"]), at))
    return rows


def followed(rows, silence, terminal, until):
    out, state = [], {}
    for _, user, kind, at in sorted(rows, key=lambda r: (r[3], r[0])):
        n, last, closed = state.get(user, (0, 0, False))
        if closed:
            continue
        out += [(user, "keepalive", n, t, None) for t in range(last + silence, at, silence)] if n else []
        out.append((user, "event", n + 1, at, kind))
        if kind in terminal:
            out.append((user, "end", n + 1, at, None))
        state[user] = (n + 1, at, kind in terminal)
    for user, (n, last, closed) in state.items():
        out += [] if closed else [(user, "keepalive", n, t, None) for t in range(last + silence, until, silence)]
    return sorted(out, key=repr)


def table(spark, rows):
    made = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, at long")
    return made.withColumn("ts", F.timestamp_micros("at"))


@pytest.mark.parametrize("cuts", [1, 4])
def test_followed_sessions(spark, cuts):
    rows = arrivals(1)
    fold = live.Follow(HOUR, ["error"])
    got = live.in_cuts(table(spark, rows), "event_id", cuts, lambda s: live.folded(s, "user_id", fold, ["at", "event_id"], "0 seconds"))
    got = got.select("user_id", "kind", "sequence", "at", "event_type")
    expected = followed(rows, HOUR, ["error"], max(r[3] for r in rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected
    seen = [r for r in expected if (r[2] > 3 if r[1] == "event" else r[2] >= 3)]
    assert sorted((tuple(r) for r in live.following(got, 3).collect()), key=repr) == seen


@pytest.mark.parametrize("cuts", [1, 5])
def test_endings(spark, cuts):
    rows = arrivals(2)
    got = live.in_cuts(table(spark, rows), "event_id", cuts, lambda s: live.folded(s, "user_id", live.Ending(9, 3), ["at", "event_id"]))
    found = {r.user_id: r.reason for r in got.groupBy("user_id").agg(F.max_by("reason", "calls").alias("reason")).collect()}
    expected = {}
    for user in {r[1] for r in rows}:
        runs, reason = 0, "running"
        for calls, (_, _, kind, _) in enumerate((r for r in rows if r[1] == user), 1):
            runs += kind == "purchase"
            if reason == "running":
                reason = "submitted" if kind == "error" else "sql_budget" if runs > 3 else "turn_limit" if calls > 9 else reason
        expected[user] = reason
    assert found == expected


def test_fold_by_hand():
    fold, state, out = live.Follow(10, ["done"]), live.Follow.start, []
    event = type("Event", (), {})
    for at, kind in ((5, "a"), (31, "b")):
        e = event()
        e.at, e.event_type = at, kind
        state, found = fold.step(state, e)
        out += found
    assert out == [("event", 1, 5, "a"), ("keepalive", 1, 15, None), ("keepalive", 1, 25, None), ("event", 2, 31, "b")]
    assert fold.due(state) == 41
    state, found = fold.expire(state, 42)
    assert found == [("keepalive", 2, 41, None)] and fold.due(state) == 51
    assert fold.expire(state, 42)[1] == []


def test_store_numbers_without_gaps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "SNAPSHOT", 2)
    r, to, rows = random.Random(3), f"file://{tmp_path}/store", []
    batches = [[(r.choice(["a", "b", None, "hot", "hot"]), n * 100 + i) for i in range(r.randint(0, 12))] for n in range(6)]
    for number, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "session string, at long")
        for _ in range(1 + number % 2):  # every second batch comes twice
            store.append(to, df, number, "session", ["at"])
        rows += batch
    # A batch that broke off between its two writes is run again.
    store.append(to, spark.createDataFrame(batches[3], "session string, at long"), 3, "session", ["at"])
    places, expected = {}, []
    for session, at in rows:
        places[session] = places.get(session, 0) + 1
        expected.append((session, at, places[session]))
    got = [tuple(x) for x in store.stored(spark, to, "session string, at long, sequence long").collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_store_as_a_stream(spark, tmp_path):
    to, source = f"file://{tmp_path}/store", f"file://{tmp_path}/in"
    for k in range(3):
        spark.createDataFrame([(i % 2, k * 10 + i) for i in range(5)], "session long, at long").write.parquet(f"{source}/part={k}")
        stream = spark.readStream.schema("session long, at long").option("recursiveFileLookup", "true").parquet(source)
        store.append_stream(stream, to, f"file://{tmp_path}/checkpoint", "session", ["at"])
    got = store.stored(spark, to, "session long, at long, sequence long").orderBy("session", "sequence").collect()
    assert [r.sequence for r in got] == [*range(1, 10), *range(1, 7)]
    assert [r["at"] for r in got] == sorted(r["at"] for r in got if r.session == 0) + sorted(r["at"] for r in got if r.session == 1)


def test_no_event_is_too_late_without_timers(spark):
    """A stream whose later parts hold older events, of null sessions too, and events without a time: all are counted."""
    rows = [(i, None if i % 5 == 0 else 2**60 + i % 5, "view", None if i == 39 else (40 - i) * HOUR) for i in range(40)]
    got = live.in_cuts(table(spark, rows), "event_id", 2, lambda s: live.folded(s, "user_id", live.Ending(99, 9), ["at", "event_id"]))
    found = {r.user_id: r.calls for r in got.groupBy("user_id").agg(F.max("calls").alias("calls")).collect()}
    assert found == {u: 8 for u in (None, *(2**60 + k for k in range(1, 5)))}
    # By time, rows without it come last.
    got = live.in_cuts(table(spark, rows), "at", 3, lambda s: live.folded(s, "user_id", live.Ending(99, 9), ["at", "event_id"]))
    assert got.groupBy("user_id").agg(F.max("calls").alias("calls")).where("calls = 8").count() == 5
