"""Files by byte ranges: digests of blocks, lines across the ends of ranges, files that appear at once."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessella.sources import ranges


def test_digests_of_blocks(spark, tmp_path):
    data = random.Random(1).randbytes(9_500)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/big.bin").write_bytes(data)
    (tmp_path / "in/empty.bin").write_bytes(b"")
    (tmp_path / "_hidden.bin").write_bytes(b"x")
    blocks = ranges.file_digests(spark, str(tmp_path), "*.bin", 1_000)
    got = sorted((r.file.rsplit("/", 1)[-1], r.start, r.length, r.sha256) for r in blocks.collect())
    parts = [data[i : i + 1_000] for i in range(0, 9_500, 1_000)]
    assert got == [("big.bin", 1_000 * i, len(p), hashlib.sha256(p).hexdigest()) for i, p in enumerate(parts)] + [("empty.bin", 0, 0, hashlib.sha256(b"").hexdigest())]
    seals = {r.file.rsplit("/", 1)[-1]: r for r in ranges.block_seals(blocks).collect()}
    assert (seals["big.bin"].length, seals["big.bin"].blocks) == (9_500, 10)
    assert seals["big.bin"].root == hashlib.sha256("".join(hashlib.sha256(p).hexdigest() for p in parts).encode()).hexdigest()
    whole = {r.file.rsplit("/", 1)[-1]: r.sha256 for r in ranges.file_digests(spark, f"file://{tmp_path}", "*.bin").collect()}
    assert whole == {"big.bin": hashlib.sha256(data).hexdigest(), "empty.bin": hashlib.sha256(b"").hexdigest()}
    before = spark.createDataFrame(blocks.collect(), blocks.schema)
    (tmp_path / "in/big.bin").write_bytes(data[:4_321] + b"!" + data[4_322:] + b"more" * 200)
    assert sorted(r.start for r in ranges.changed_blocks(before, ranges.file_digests(spark, str(tmp_path), "*.bin", 1_000)).collect()) == [4_000, 9_000, 10_000]
    assert ranges.file_digests(spark, str(tmp_path), "*.none").count() == 0


@pytest.mark.parametrize("size", [1, 2, 7, 64, 10_000])
def test_lines_across_ranges(spark, tmp_path, size):
    files = {"2.jsonl": "a\n\nbb\r\nccc ü\n", "10.jsonl": "\n\nlast without end", "007.jsonl": "", "x.jsonl": "no number", "3.json": "no line"}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    lines = ranges.with_line(ranges.read_numbered(spark, str(tmp_path), range_bytes=size))
    got = sorted((r.step, r.line, r.value) for r in lines.collect())
    assert got == [(2, 1, "a"), (2, 2, ""), (2, 3, "bb"), (2, 4, "ccc ü"), (10, 1, ""), (10, 2, ""), (10, 3, "last without end")]


def test_files_in_the_order_of_their_numbers(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") % 12).alias("n"), "id")
    to = str(tmp_path / "steps")
    value = F.to_json(F.struct("id"))
    ranges.write_numbered(rows, F.col("n"), value, to, ["id"])
    assert sorted(p.name for p in (tmp_path / "steps").iterdir()) == sorted(f"{i}.jsonl" for i in range(12))
    assert (tmp_path / "steps/3.jsonl").read_text() == "".join(f'{{"id":{i}}}\n' for i in range(3, 500, 12))
    # Partitions come by number, 2 ahead of 10.
    steps = [r.step for r in ranges.read_numbered(spark, to, "id long", 100).collect()]
    assert steps == sorted(steps) and len(steps) == 500
    with pytest.raises(Exception, match="there already"):
        ranges.write_numbered(rows.where("n = 3"), F.col("n"), value, to, ["id"])
    ranges.write_numbered(rows.where("id = 3"), F.col("n"), value, to, ["id"], overwrite=True)
    assert (tmp_path / "steps/3.jsonl").read_text() == '{"id":3}\n' and len(list((tmp_path / "steps").iterdir())) == 12
    with pytest.raises(Exception, match="a line needs"):
        ranges.write_numbered(rows, F.lit(99), F.lit("two\nlines"), to, ["id"])
    assert not (tmp_path / "steps/99.jsonl").exists() and len(list((tmp_path / "steps").iterdir())) == 12


def test_small_ranges_share_tasks(spark, tmp_path, monkeypatch):
    """A task reads many ranges, so tasks don't grow with a file by its small ranges; the numbers of lines are those of single ranges."""
    r = random.Random(5)
    texts = {n: ["x" * r.choice([0, 3, 40, 700]) for _ in range(900)] for n in (1, 2, 10)}
    for n, lines in texts.items():
        (tmp_path / f"{n}.jsonl").write_text("".join(f"{x}\n" for x in lines))
    read = ranges.read_numbered(spark, str(tmp_path), range_bytes=150)
    assert 3_000 < sum(p.stat().st_size for p in tmp_path.iterdir()) // 150
    assert read.rdd.getNumPartitions() < 40
    got = sorted((x.step, x.line, x.value) for x in ranges.with_line(read).collect())
    assert got == [(n, i + 1, x) for n, lines in texts.items() for i, x in enumerate(lines)]
    places = [(x.step, x.range, x.at) for x in read.collect()]
    assert places == sorted(places) and len(set(places)) == 2_700
    # Read a few bytes at a time, a range goes on over many batches.
    monkeypatch.setattr(ranges, "BUFFER", 64)
    reader = ranges._Lines({"path": str(tmp_path), "rangeBytes": "150"})
    assert [(x["step"], x["range"], x["at"]) for p in reader.partitions() for batch in reader.read(p) for x in batch.to_pylist()] == places
