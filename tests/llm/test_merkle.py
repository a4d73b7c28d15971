import hashlib
import random
import zlib

import pytest

from tessella.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, low=False):
    doc_id, text, lang, source, n_chars = row
    if low and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text))


def brute_tree(nodes):
    """The root, and for each node the runs above it with its place in each."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            path.append((at[i] % 8, nodes[at[i] // 8 * 8 : at[i] // 8 * 8 + 8]))
            at[i] //= 8
        nodes = [h(nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g, members in groups.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = brute_tree([leaf(r) for r in members])
    root, tops = brute_tree([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops, strict=True):
        for row, path in zip(groups[g], trees[g][1], strict=True):
            x = leaf(row, row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0)
            for at, run in path + top:
                x = h([*run[:at], x, *run[at + 1 :]])
            proof = h(s for at, run in path + top for i, s in enumerate(run) if i != at)
            out.append((row[0], leaf(row), trees[g][0], root, proof, x, x == root))
    return sorted(out, key=repr)


def documents(sizes, seed=1):
    r, rows = random.Random(seed), []
    ids = r.sample(range(10**6), sum(sizes.values()))
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((ids.pop(), r.choice([None, "", "Große Welt", "plain", "MORE " * r.randint(1, 40)]), lang, r.choice([None, "", "web"]), r.choice([None, 0, 7])))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, "de": 9}, {None: 3, "": 1, "en": 64, "Z": 65, "é": 7}, {"en": 700, "fr": 50, "xx": 1}])
def test_equals_brute_force(spark, sizes):
    rows = documents(sizes)
    assert sorted(map(tuple, merkle.checked(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == brute(rows)


def test_many_partitions_of_few_leaves(spark, monkeypatch):
    """Ranges shorter than a run of siblings, so that nearly every node is put together across partitions."""
    monkeypatch.setattr(merkle, "LEAVES", 5)
    rows = documents({"en": 150, "de": 12}, 2)
    assert sorted(map(tuple, merkle.checked(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=repr) == brute(rows)


def test_many_groups(spark):
    rows = documents({f"g{i}": 1 + i % 3 for i in range(90)}, 3)
    assert sorted(map(tuple, merkle.checked(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == brute(rows)


def test_proofs_verify_and_reveal_changes(spark):
    rows = documents({"en": 100, "de": 20, None: 5}, 4)
    for r in merkle.proofs(spark.createDataFrame(rows, SCHEMA)).collect():
        path = [(p.at, [*p.siblings[: p.at], "", *p.siblings[p.at :]]) for p in r.proof]
        assert merkle.fold(r.leaf, path) == r.root
        assert merkle.fold(merkle.digest([r.leaf]), path) != r.root


def test_edge_rows(spark):
    long = "Wort " * 100_000
    rows = [(None, None, None, None, None), (None, "a", "en", "s", 1), (1, long, "en", None, None), (2, "", "en", "", 0)]
    rows += [(5, "Same", "en", "s", 4)] * 30 + [(5, "other", "en", "s", 5), (5, None, "de", None, None)]
    shown = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA + ", leaf string, number int, root string")
    assert sorted(map(tuple, merkle.checked(shown).collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert merkle.checked(spark.createDataFrame([], SCHEMA)).collect() == []
    assert merkle.proofs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_group_in_every_place(spark):
    """A group's rows ahead are counted over partitions that hold nothing else."""
    rows = [(i, f"Text {i}", "en", "s", i) for i in range(300)]
    leaves = merkle.leaves(spark.createDataFrame(rows, SCHEMA))
    ranges = leaves.select("group", "id", "leaf", "shown", "number").rdd.map(tuple).keyBy(merkle._order).sortByKey(numPartitions=7).values().glom()
    sizes = [len(x) for x in ranges.collect()]
    assert merkle._ahead(ranges) == [sum(sizes[:i]) for i in range(7)]
