"""Operators on small fixtures, and every query against DuckDB on the smallest tables."""

import hashlib
import json
import os
import random

import duckdb
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import tessella.queries  # noqa: F401
from tessella import registry
from tessella.functions.hashing import digest_mod5, same_result, stable_choice
from tessella.functions.seals import multiset_fingerprint, ordered_fingerprint
from tessella.operators import corpus, metrics, rollouts, splits
from tessella.operators.positions import numbered
from tessella.plans import drift
from tessella.sources import files, ranges

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 9) + 0.0
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else str(x)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(registry.SQL[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    want = sorted(repr(plain([r[i] for i in at])) for r in found.fetchall())
    assert len(found.description) == len(columns)
    assert sorted(repr(plain(tuple(r))) for r in df.select(*columns).collect()) == want


def orders(spark):
    return spark.createDataFrame([(1, 12.5), (2, 7.0)], "order_id long, total_amount double")


def test_stale_query_fails_and_repaired_one_agrees(spark):
    known = drift.Versions(spark)
    known.create("shop", "v1", {"orders": orders(spark)})
    known.evolve("shop", "v1", "v2", [{"type": "rename_column", "table": "ORDERS", "old_name": "Total_Amount", "new_name": "gross"}])
    with pytest.raises(AnalysisException, match="UNRESOLVED_COLUMN"):
        known.query("shop", "v2", "SELECT total_amount FROM {orders}").collect()
    old, new = known.query("shop", "v1", "SELECT total_amount FROM {orders}"), known.query("shop", "v2", "SELECT gross FROM {orders}")
    assert multiset_fingerprint(old).collect() == multiset_fingerprint(new).collect()


def test_added_and_replaced_columns(spark):
    added = drift.add_column(orders(spark), "audit_flag", "int", 0)
    assert [tuple(r) for r in added.orderBy("order_id").collect()] == [(1, 12.5, 0), (2, 7.0, 0)]
    kept = spark.createDataFrame([(5, "kept")], "old_value long, marker string")
    assert drift.replace_column(kept, "old_value", "new_value", "string").columns == ["marker", "new_value"]
    assert drift.replace_column(kept, "old_value", "new_value", "bigint").columns == ["new_value", "marker"]
    change = [{"type": "replace_column", "old_name": "old_value", "new_name": "new_value", "declared_type": "string"}]
    assert drift.schema_after(kept.schema, change).names == ["marker", "new_value"]
    with pytest.raises(ValueError, match="taken"):
        drift.rename_column(kept, "marker", "OLD_VALUE")
    with pytest.raises(KeyError):
        drift.rename_column(kept, "absent", "x")
    with pytest.raises(ValueError, match="names hold"):
        drift.Versions(spark).create("../x", "v1", {})


def test_quota_goldens(spark):
    rows = spark.createDataFrame([("a", i) for i in range(20)], "family string, task_id long")
    got = corpus.quotas(rows, "family", "task_id", {"must_ask": 0.30, "knowledge_only": 0.25}, "schema_only").groupBy("profile").count().collect()
    assert {r[0]: r[1] for r in got} == {"must_ask": 6, "knowledge_only": 5, "schema_only": 9}


def test_hashes_equal_python(spark):
    import hashlib

    rows = spark.createDataFrame([(f"k{i}",) for i in range(300)], "k string").select("k", stable_choice(F.col("k"), 7).alias("c"), digest_mod5(F.col("k")).alias("m")).collect()
    for r in rows:
        d = hashlib.sha256(r.k.encode()).digest()
        assert (r.c, r.m) == (int.from_bytes(d[:4], "big") % 7, int.from_bytes(d, "big") % 5)


def test_fingerprints(spark):
    a = orders(spark)
    assert multiset_fingerprint(a).collect() == multiset_fingerprint(a.orderBy(F.desc("order_id"))).collect()
    assert ordered_fingerprint(a, "order_id").collect() != ordered_fingerprint(a.withColumn("r", -F.col("order_id")).select("order_id", "total_amount", "r").drop("r"), "total_amount").collect()
    none = ordered_fingerprint(a.limit(0), "order_id").first()
    assert (none.row_count, none.value_hash) == (0, hashlib.sha256(b"").hexdigest())
    assert same_result(a, a.select("order_id", F.col("total_amount")).unionByName(a)).first().equal
    assert not same_result(a, a.limit(1)).first().equal


def test_numbered(spark):
    r = random.Random(1)
    values = [r.randrange(500) for _ in range(2000)]
    got = sorted((x.k, x.v) for x in numbered(spark.createDataFrame([(v,) for v in values], "v long").repartition(5), ["v"], "k").collect())
    assert [k for k, _ in got] == list(range(2000)) and [v for _, v in got] == sorted(values)
    assert numbered(spark.createDataFrame([], "v long"), ["v"], "k").collect() == []


def test_group_split_keeps_groups_whole(spark):
    r = random.Random(2)
    rows = [(i, f"g{r.randrange(40)}", r.choice("ab")) for i in range(2000)]
    split = {x.g: x.split for x in splits.group_split(spark.createDataFrame(rows, "id long, g string, label string"), "g", ["label"], {"train": 0.6, "tune": 0.2, "test": 0.2}).collect()}
    sizes = {s: sum(split[g] == s for _, g, _ in rows) / 2000 for s in ("train", "tune", "test")}
    assert set(split) == {g for _, g, _ in rows} and abs(sizes["train"] - 0.6) < 0.03 and abs(sizes["tune"] - 0.2) < 0.03


def test_completeness_and_wilson(spark):
    whole = spark.createDataFrame([(i,) for i in range(5)], "id long")
    parts = spark.createDataFrame([(0,), (1,), (1,), (9,)], "id long")
    assert tuple(corpus.complete(parts, whole, "id").first()) == (3, 1, 1)
    low, high = spark.range(1).select(*metrics.wilson(F.lit(246), F.lit(500))).first()
    assert (round(low, 3), round(high, 3)) == (0.448, 0.536)


def call_rows(kinds):
    """Event rows from short notations: tool names, ``!`` marks a failed and ``~`` a mismatched execution, ``_`` a masked call."""
    full = {"v": "get_schema_version", "d": "inspect_schema_diff", "k": "get_knowledge_definition", "a": "ask_user", "e": "execute_sql", "s": "submit_solution", "g": "get_schema"}
    rows = []
    for r, calls in kinds.items():
        for at, c in enumerate(calls.split(), 1):
            rows.append((r, at, full.get(c[0], c), "!" not in c, "_" in c, "+" in c, False if "~" in c else None, f"SELECT {c}", "u" not in c[1:], "=" in c, False))
    return rows


def calls(spark, kinds):
    return spark.createDataFrame(call_rows(kinds), "rollout long, at long, tool string, ok boolean, masked boolean, validated boolean, contract boolean, sql string, read_only boolean, matches boolean, error boolean")


def test_required_recovery(spark):
    kinds = {1: "e!", 2: "e! v", 3: "v e! v d", 4: "e! d v", 5: "v", 6: "v d e!", 7: "e~ v d e~", 8: "e!_ v", 9: "e e~", 10: "e! v d v d e!"}
    want = {1: "get_schema_version", 2: "inspect_schema_diff", 4: "inspect_schema_diff", 9: "get_schema_version"}
    assert {x.rollout: x.required for x in rollouts.required_recovery(calls(spark, kinds)).collect()} == {k: want.get(k, "none") for k in kinds}


def test_allowed_tools(spark):
    got = {x.rollout: set(x.allowed) for x in rollouts.allowed_tools(calls(spark, {1: "v d e+", 2: "v d a", 3: "v d a k", 4: "e!", 5: "v d e+ e", 6: "v_ d"})).collect()}
    every = set(rollouts.TOOLS)
    assert got == {1: {"submit_solution"}, 2: {"get_knowledge_definition", "execute_sql"}, 3: every - {"get_schema_version", "inspect_schema_diff", "ask_user"}, 4: {"get_schema_version"}, 5: every - {"get_schema_version", "inspect_schema_diff"}, 6: every - {"inspect_schema_diff"}}
    got = {x.rollout: set(x.allowed) for x in rollouts.allowed_tools(calls(spark, {1: "e+", 2: "g e+", 3: "g v"}), execution_only=True).collect()}
    assert got == {1: {"get_schema"}, 2: {"submit_solution"}, 3: every - {"get_schema_version", "submit_solution"}}


def test_failures_divergence_and_recovery(spark):
    kinds = {1: "v d a e s", 2: "v d e", 3: "v d k e s", 4: "e! e!", 5: "v a d a e!", 6: "v d Ask-User e! s", 7: "v d e="}
    rows = [(1, "must_ask", "atomic", "submitted", False, False), (2, "schema_only", "compound", "turn_limit", False, False), (3, "schema_only", "atomic", "submitted", False, True)]
    rows += [(4, "direct_clean", "atomic", "error", False, False), (5, "must_ask", "atomic", "error", False, False), (6, "must_ask", "atomic", None, False, None), (7, "schema_only", None, None, True, None), (8, "knowledge_only", None, None, False, True), (9, None, None, None, None, None)]
    runs = spark.createDataFrame(rows, "rollout long, profile string, scenario string, termination string, success boolean, unsafe boolean")
    got = {x.rollout: (x.labels, x.primary_failure, x.must_ask) for x in rollouts.failure_labels(runs, calls(spark, kinds)).collect()}
    assert got == {
        1: (["must_ask_error", "wrong_submit"], "must_ask_error", ["asked_but_recovery_failed"]),
        2: (["successful_execute_no_submit", "compound_recovery", "turn_limit"], "successful_execute_no_submit", []),
        3: (["post_diff_wrong_retrieval", "wrong_submit", "unsafe"], "post_diff_wrong_retrieval", []),
        4: (["execution_failure"], "execution_failure", []),
        5: (["must_ask_error", "execution_failure"], "must_ask_error", ["ask_before_diff", "repeated_ask"]),
        6: (["post_diff_wrong_retrieval", "must_ask_error", "invalid_tool_alias", "execution_failure"], "post_diff_wrong_retrieval", ["required_ask_omitted", "malformed_ask_tool"]),
        8: (["unsafe"], "unsafe", []),
        9: (["other"], "other", []),
    }
    runs = runs.where("profile is not null")
    assert {x.rollout: (x.error_at, x.kind) for x in rollouts.first_divergence(runs, calls(spark, kinds)).collect()} == {
        1: (4, "outcome_mismatch"), 2: (3, "premature_termination"), 3: (2, "action_name"), 4: (1, "action_name"), 5: (1, "action_name"), 6: (2, "action_name"), 7: (3, "premature_termination"), 8: (0, "premature_termination"),
    }
    target = {x.rollout: (x.target, x.target_action) for x in rollouts.recovery_target(runs, calls(spark, kinds)).collect()}
    assert target == {1: (3, "execute_sql"), 2: (2, "execute_sql"), 3: (2, "execute_sql"), 4: (0, "execute_sql"), 5: (3, "execute_sql"), 6: (2, "ask_user"), 7: (3, "submit_solution"), 8: (0, "get_schema_version")}
    assert [tuple(x) for x in rollouts.terminal_recovery(runs, calls(spark, kinds)).collect()] == [(7, 2, 3)]


def test_recorded_decisions(spark):
    kinds = {1: "e=", 2: "d e=", 3: "d eu e=", 4: "d e= eu", 5: "d e!= e", 6: "e= d"}
    runs = spark.createDataFrame([(k,) for k in [*kinds, 7]], "rollout long")
    got = {x.rollout: (x.accepted, x.reason, x.event_at) for x in rollouts.contract_decisions(calls(spark, kinds), runs).collect()}
    assert got == {
        1: (False, "schema_diff_not_inspected", None), 2: (True, "contract_validated", 1), 3: (False, "unsafe_post_diff_candidate", None), 4: (True, "contract_validated", 1),
        5: (False, "result_contract_mismatch", None), 6: (False, "result_contract_mismatch", None), 7: (False, "schema_diff_not_inspected", None),
    }


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n\n{broken\n{"id": 2, "t": "y"}\n')
    good, bad = files.read_with_errors(spark, str(tmp_path / "a.jsonl"), "id long, t string")
    assert sorted(r.id for r in good.collect()) == [1, 2] and [r.text for r in bad.collect()] == ["{broken"]
    (tmp_path / "b.json").write_text(json.dumps([{"id": 3, "t": "z"}]))
    assert files.read_records(spark, str(tmp_path / "b.json"), "id long, t string").first().id == 3
    files.write_parquet(good, str(tmp_path / "out"))
    with pytest.raises(AnalysisException, match="already exists"):
        files.write_parquet(good, str(tmp_path / "out"))
    assert files.not_yet(good, files.read_parquet(spark, str(tmp_path / "out")).where("id = 1"), ["id"]).first().id == 2
    files.append_jsonl(good, str(tmp_path / "cache"), "t")
    files.append_jsonl(good, str(tmp_path / "cache"), "t")
    assert files.read_jsonl(spark, str(tmp_path / "cache"), "id long").count() == 4
    (tmp_path / "steps").mkdir()
    (tmp_path / "steps" / "12.jsonl").write_text('{"id": 1}\n')
    assert ranges.read_numbered(spark, str(tmp_path / "steps"), "id long").first().step == 12
    sealed = files.seal(spark, str(tmp_path), "b.json").first()
    import hashlib

    assert sealed.sha256 == hashlib.sha256((tmp_path / "b.json").read_bytes()).hexdigest()
    assert files.list_files(spark, str(tmp_path), "b.json", 10).count() == 0
    (tmp_path / "csv" / "db1").mkdir(parents=True)
    (tmp_path / "csv" / "db1" / "t1.csv").write_text("column,meaning\na,b\n")
    row = files.read_meanings(spark, str(tmp_path / "csv")).first()
    assert (row.db_id, row.table_name, row.meaning) == ("db1", "t1", "b")
    assert files.ddl("o", orders(spark)) == "CREATE TABLE `o` (`order_id` BIGINT, `total_amount` DOUBLE)"
    assert files.ddl_with_samples("o", orders(spark), ["order_id"], 1).endswith("1 | 12.5")
    assert files.healthy({"a": orders(spark), "b": orders(spark).limit(0)}) == {"a": True, "b": False}
    assert files.schema_of("a int").names == ["a"]


def test_entry(spark):
    import __spark_entry__

    row = __spark_entry__.entry(spark).first()
    assert row.stale_error == "UNRESOLVED_COLUMN" and row.equal
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_hash_split_always_has_a_dev_group(spark):
    import hashlib

    five = [g for g in (f"g{i}" for i in range(200)) if int(hashlib.sha256(g.encode()).hexdigest(), 16) % 5]
    rows = spark.createDataFrame([(g,) for g in five[:9]], "g string")
    got = {x.g: x.split for x in corpus.hash_split(rows, "g").collect()}
    assert [g for g, s in got.items() if s == "dev"] == [max(five[:9])]
    assert corpus.hash_split(rows.limit(0), "g").collect() == []


def test_quota_order_is_the_digest_of_the_id(spark):
    import hashlib

    rows = spark.createDataFrame([("a" if i % 3 else "b", f"t{i}") for i in range(50)], "family string, task_id string")
    got = {x.task_id: x.profile for x in corpus.quotas(rows, "family", "task_id", {"must_ask": 0.30, "knowledge_only": 0.25}, "schema_only").collect()}
    for family in "ab":
        ids = sorted((f"t{i}" for i in range(50) if ("a" if i % 3 else "b") == family), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
        ask, know = round(0.30 * len(ids)), round(0.25 * len(ids))
        assert [got[t] for t in ids] == ["must_ask"] * ask + ["knowledge_only"] * know + ["schema_only"] * (len(ids) - ask - know)


def test_splits_and_residual_quotas(spark):
    r = random.Random(3)
    rows = [(i, f"g{r.randrange(20):02}", r.choice("ab")) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, g string, label string")
    shares = {"train": 0.6, "tune": 0.2, "test": 0.2}
    frozen = {x.g: x.split for x in splits.group_split(df, "g", ["label"], shares, {"g03": "test", "g07": "test"}, trials=10).collect()}
    assert frozen["g03"] == frozen["g07"] == "test" and set(frozen) == {g for _, g, _ in rows}
    def cost(deal, weight):
        n, c = len(rows), 0.0
        for s, share in shares.items():
            c += weight * ((sum(deal[g] == s for _, g, _ in rows) - n * share) / (n * share)) ** 2
            for v in "ab":
                want = share * sum(x == v for *_, x in rows)
                c += ((sum(x == v and deal[g] == s for _, g, x in rows) - want) / max(want, 3)) ** 2
        return c

    # The best of ten trials isn't worse than the first, and no random deal of this many is as good as the greedy one.
    alone = {x.g: x.split for x in splits.group_split(df, "g", ["label"], shares, {"g03": "test", "g07": "test"}, trials=1).collect()}
    assert cost(frozen, 4) <= cost(alone, 4) + 1e-9
    dealt = {x.g: x.split for x in splits.exact_split(df, "g", ["label"], shares, trials=50, seed=3).collect()}
    found = []
    for trial in range(50):
        order = sorted(dealt, key=lambda g: (hashlib.sha256(f"3:{trial}:{g}".encode()).hexdigest(), g))
        deal = dict(zip(order, ["train"] * 12 + ["tune"] * 4 + ["test"] * 4, strict=True))
        found.append((round(cost(deal, 8), 9), trial, deal))
    assert dealt == min(found, key=lambda x: x[:2])[2]
    exact = [x.split for x in splits.exact_split(df, "g", ["label"], shares, trials=50).collect()]
    assert {s: exact.count(s) for s in shares} == {"train": 12, "tune": 4, "test": 4}
    old = df.withColumn("legacy", F.when(F.col("id") < 700, "x"))
    with pytest.raises(Exception, match="legacy profiles exceed"):
        corpus.residual_quotas(old, "label", "id", "legacy", {"x": 0.3}, "y").collect()


def test_tool_calls(spark):
    from tessella.functions.texts import tool_calls, without_calls

    said = {
        "tag": '<think>Look.</think><tool_call>{"name": "inspect_schema_diff", "arguments": {}}</tool_call>',
        "fence": 'Plan.\n```json\n{\n  "name": "get_schema_version",\n  "arguments": {}\n}\n```',
        "quote": "<function name=\"ask_user\" arguments='{\"question\": \"Is 'net' the sum less tax?\"}' />",
        "inner": "<function name=\"get_knowledge_definition\" arguments='{\"name\": \"net revenue\"}' />",
        "mixed": '{"name":"a","arguments":{}}\n{"db_id": "x"}\n{"operations":[{"kind":"y"}]} {"name": "b", "arguments": "{\\"k\\": [1]}"} {"name": "", "arguments": {}} {"name": "c", "arguments": 3}',
        "broken": "<function name='a' arguments='{oops' /> <function name=\"b\" arguments='{\"x\": \"/>\"}' > <FUNCTION arguments='{}' name='c d'/>",
        "none": "{{{{", "empty": "",
    }
    df = spark.createDataFrame([*said.items(), ("null", None)], "k string, t string").withColumn("calls", tool_calls("t"))
    got = {x.k: x for x in df.withColumn("rest", without_calls("t", "calls")).collect()}
    assert {k: [(c.name, c.arguments) for c in x.calls] for k, x in got.items() if k != "null"} == {
        "tag": [("inspect_schema_diff", "{}")], "fence": [("get_schema_version", "{}")], "quote": [("ask_user", '{"question":"Is \'net\' the sum less tax?"}')],
        "inner": [("get_knowledge_definition", '{"name":"net revenue"}')], "mixed": [("a", "{}"), ("b", '{"k":[1]}')], "none": [], "empty": [],
        "broken": [("c d", "{}")],
    }
    assert got["null"].calls is None and got["tag"].rest == "<think>Look.</think>" and got["fence"].rest == "Plan." and got["quote"].rest == ""


def test_splits_of_odd_tables(spark):
    shares = {"a": 0.5, "b": 0.5}
    empty = spark.createDataFrame([], "g string, label string")
    assert splits.group_split(empty, "g", ["label"], shares).count() == 0
    with pytest.raises(ValueError, match="fewer groups"):
        splits.exact_split(empty, "g", ["label"], shares)
    odd = spark.createDataFrame([(None, None), (None, "x"), (1, None), (2, "x"), (2, None)], "g long, label string")
    got = {x.g: x.split for x in splits.group_split(odd, "g", ["label", "g"], shares, {None: "b"}, trials=3).collect()}
    assert set(got) == {None, 1, 2} and got[None] == "b"
    assert splits.exact_split(odd, "g", ["label"], shares, trials=4).where("split = 'a'").count() in (1, 2)


def test_splits_of_many_groups(spark):
    """50,000 groups stream through the trials; shares come out to a hair."""
    rows = spark.range(200_000).select((F.col("id") % 50_000).alias("g"), (F.col("id") % 7).cast("string").alias("label"))
    got = splits.group_split(rows, "g", ["label"], {"train": 0.7, "test": 0.3}, trials=2)
    assert got.count() == 50_000 and got.where("split = 'test'").count() == 15_000


def test_copies_and_epochs_of_odd_rows(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (5, None), (4, "b")], "id long, t string")
    got = {(x.t, x.representative, x.copies, x.place, x.id) for x in corpus.copies_with_ids(df, ["t"], "id").collect()}
    assert got == {("a", 1, 2, 1, 1), ("a", 1, 2, 2, 3), (None, 2, 2, 1, 2), (None, 2, 2, 2, 5), ("b", 4, 1, 1, 4)}
    order = [(x.repeat, x.id) for x in corpus.epoch_order(df, "t", "id").orderBy("position").collect()]
    assert {i for r, i in order[:3]} == {1, 2, 4} and {i for r, i in order[3:]} == {3, 5} and [r for r, _ in order] == [0, 0, 0, 1, 1]
    assert corpus.epoch_order(df.limit(0), "t", "id").count() == 0 and corpus.copies_with_ids(df.limit(0), ["t"], "id").count() == 0
