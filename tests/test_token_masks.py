"""Masks of key actions against the rules spelled out token by token."""

import random

import pytest

from tessella.operators.token_masks import key_action_mask, token_ranges

NAMES = ["ask_user", "submit_solution", "inspect_schema_diff", "execute_sql", "get_schema", None]


def plain(tokens, calls, suffix):
    out, diff = [False] * len(tokens), False
    for _, name, masked, a, b in calls:
        key = name in ("ask_user", "submit_solution") or (name and not masked and (diff or name == "execute_sql"))
        diff |= name == "inspect_schema_diff" and not masked
        inside = [i for i, (s, e, _) in enumerate(tokens) if a < b and s < b and e > a]
        for i in inside[-suffix:] if key else ():
            out[i] |= tokens[i][2]
    if not any(out):
        for i in [i for i, t in enumerate(tokens) if t[2]][-suffix:]:
            out[i] = True
    return out


@pytest.mark.parametrize("suffix", [1, 3, 96])
def test_mask(spark, suffix):
    r = random.Random(suffix)
    tokens, calls, want = [], [], []
    for k in range(60):
        at, mine = 0, []
        for _ in range(r.randrange(1, 40)):
            at += r.randrange(3)
            mine.append((at, at + r.randrange(1, 5), r.random() < 0.7))
            at = mine[-1][1]
        own = [(i, r.choice(NAMES), r.choice([True, False, None]), a := r.randrange(at + 3), a + r.randrange(12)) for i in range(r.randrange(6))]
        tokens += [(k, *t) for t in mine]
        calls += [(k, *c) for c in own]
        want += [(k, i, x) for i, x in enumerate(plain(mine, own, suffix))]
    t = spark.createDataFrame(tokens, "rollout long, start_char long, end_char long, active boolean")
    c = spark.createDataFrame([*calls, (999, 0, "ask_user", False, 0, 9)], "rollout long, call int, name string, masked boolean, start_char long, end_char long")
    got = key_action_mask(t, c, "rollout", "call", suffix)
    assert sorted((x.rollout, x.place, x.trains) for x in got.collect()) == want


def test_edges(spark):
    t = spark.createDataFrame([(1, 0, 2, True), (1, 2, 4, None), (1, 5, 6, True)], "rollout long, start_char long, end_char long, active boolean")
    s = spark.createDataFrame([(1, "a", 2, 4), (1, "b", 4, 5), (1, "c", 0, 99), (1, "d", 3, 3), (1, "e", None, None)], "rollout long, k string, start_char long, end_char long")
    assert sorted((x.k, x["first"], x["last"]) for x in token_ranges(t, s, "rollout", "k").collect()) == [("a", 1, 2), ("c", 0, 3)]
    none = spark.createDataFrame([], "rollout long, call int, name string, masked boolean, start_char long, end_char long")
    assert [x.trains for x in key_action_mask(t, none, "rollout", "call", 1).orderBy("place").collect()] == [False, False, True]
    assert key_action_mask(t.limit(0), none, "rollout", "call").count() == 0
    with pytest.raises(ValueError, match="one token"):
        key_action_mask(t, none, "rollout", "call", 0)


def test_texts_move_ahead_of_their_words(spark, tmp_path):
    """t10_key_action_mask deals texts, not words: each list of words stands on a text that has been dealt."""
    import tessella.queries  # noqa: F401
    from tessella.registry import QUERIES

    spark.createDataFrame([(1, "a b c"), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES["t10_key_action_mask"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("Generate posexplode") == plan.count("RepartitionByExpression [doc_id")
