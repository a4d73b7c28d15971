"""Data sources that read files by byte ranges: digests of files of any size, and lines of files that are named by numbers.

Paths are those that ``pyarrow.fs`` knows (local and mounted folders, ``file:``, ``hdfs:``, ``s3:``, ``gs:``), seen by all executors.
"""

from __future__ import annotations

import fnmatch
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tessella.sources.staging import few

#: Bytes that are read at a time.
BUFFER = 1 << 20
#: Bytes of a range where the caller doesn't say.
RANGE = 128 << 20
#: Ranges that one task reads at most.
PACK = 256


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _files(path: str, glob: str) -> list[fs.FileInfo]:
    """Files of a folder by pattern, with subfolders; names that begin with ``_`` or ``.`` are hidden."""
    where, root = _place(path)
    found = where.get_file_info(fs.FileSelector(root, recursive=True))
    shown = (f for f in found if f.type == fs.FileType.File and not re.search(r"(^|/)[._]", f.path[len(root) :]))
    return sorted((f for f in shown if fnmatch.fnmatch(f.base_name, glob)), key=lambda f: f.path)


@dataclass
class _Range(InputPartition):
    file: str
    number: int
    start: int
    length: int


def _ranges(file: fs.FileInfo, number: int, most: int) -> Iterator[_Range]:
    for start in range(0, max(1, file.size), most):
        yield _Range(file.path, number, start, min(most, file.size - start))


@dataclass
class _Pack(InputPartition):
    ranges: list[_Range]


def _packed(ranges: Iterator[_Range]) -> list[_Pack]:
    """Neighbouring ranges together, up to PACK of them or RANGE bytes."""
    packs: list[_Pack] = []
    size = 0
    for r in ranges:
        if not packs or size + r.length > RANGE or len(packs[-1].ranges) == PACK:
            packs.append(_Pack([]))
            size = 0
        packs[-1].ranges.append(r)
        size += r.length
    return packs


class _Digests(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.most = int(options.get("blockBytes", 0))

    def partitions(self) -> list[_Pack]:
        return _packed(r for f in _files(self.path, self.glob) for r in _ranges(f, 0, self.most or max(1, f.size)))

    def read(self, partition: _Pack | None) -> Iterator[tuple]:
        if partition is None:  # there are no files
            return
        where = _place(self.path)[0]
        for r in partition.ranges:
            digest, left = hashlib.sha256(), r.length
            with where.open_input_file(r.file) as f:
                f.seek(r.start)
                while left and (data := f.read(min(BUFFER, left))):
                    digest.update(data)
                    left -= len(data)
            if left:
                raise OSError(f"{r.file} has become shorter")
            yield r.file, r.start, r.length, digest.hexdigest()


class DigestSource(DataSource):
    """file, start, length, sha256: of each block of ``blockBytes``, or, without that option, of each file, read as a stream."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "file string, start long, length long, sha256 string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Digests(self.options)


def _number(name: str) -> int | None:
    found = re.match(r"(\d+)\.jsonl$", name, re.ASCII)
    return int(found[1]) if found else None


class _Lines(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.most = options["path"], int(options.get("rangeBytes", RANGE))

    def partitions(self) -> list[_Pack]:
        """Ranges in the order of the files' numbers, so partitions come in it too."""
        files = sorted(((n, f) for f in _files(self.path, "*.jsonl") if (n := _number(f.base_name)) is not None), key=lambda x: (x[0], x[1].path))
        return _packed(r for n, f in files for r in _ranges(f, n, self.most))

    def read(self, partition: _Pack | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no files
            return
        where = _place(self.path)[0]
        for _, ranges in groupby(partition.ranges, lambda r: r.file):
            yield from self._lines(where, list(ranges))

    def _lines(self, where: fs.FileSystem, ranges: list[_Range]) -> Iterator[pa.RecordBatch]:
        """Lines of neighbouring ranges. A line belongs to the range in which it begins; the last one may reach beyond it."""
        file, number, begin, end = ranges[0].file, ranges[0].number, ranges[0].start, ranges[-1].start + ranges[-1].length
        with where.open_input_file(file) as raw:
            place = max(0, begin - 1)
            raw.seek(place)
            lines = io.BufferedReader(raw, BUFFER)
            if begin:
                place += len(lines.readline())
            last, held = -1, 0
            while place < end and (read := lines.readlines(BUFFER)):
                sizes = np.fromiter(map(len, read), np.int64, len(read))
                starts = place + np.cumsum(sizes) - sizes
                place = int(starts[-1] + sizes[-1])
                starts = starts[starts < end]
                of = starts // self.most
                _, first, which = np.unique(of, return_index=True, return_inverse=True)
                at = np.arange(len(of)) - first[which]
                at[of == last] += held  # the range goes on
                last, held = int(of[-1]), int(at[-1]) + 1
                values = [line.rstrip(b"\r\n").decode() for line in read[: len(of)]]
                columns = [pa.array(np.full(len(of), number)), pa.array([file] * len(of)), pa.array(of * self.most), pa.array(at), pa.array(values, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["step", "file", "range", "at", "value"])


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _NumberedWriter(DataSourceArrowWriter):
    """Files are written aside and moved to their names once all tasks are done, so a task that is run again leaves nothing twice."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.aside = f"_aside-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        where, root = _place(self.path)
        where.create_dir(f"{root}/{self.aside}", recursive=True)
        files, number, out = [], None, None
        try:
            for batch in iterator:
                steps, values = batch.column("step"), batch.column("value")
                if steps.null_count or values.null_count or pc.any(pc.less(steps, 0)).as_py() or pc.any(pc.match_substring(values, "\n")).as_py():
                    raise ValueError("a line needs a number of 0 or more and a text without line feeds")
                for step, run in groupby(zip(steps.to_pylist(), values.to_pylist()), lambda x: x[0]):
                    if step != number:
                        if out:
                            out.close()
                        number, name = step, f"{root}/{self.aside}/{uuid.uuid4().hex}"
                        out = io.BufferedWriter(where.open_output_stream(name), BUFFER)
                        files.append((name, f"{root}/{number}.jsonl"))
                    out.write("".join(f"{line}\n" for _, line in run).encode())
        finally:
            if out:
                out.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        where, root = _place(self.path)
        pairs = [p for m in messages if m for p in m.files]
        targets = [to for _, to in pairs]
        taken = [to for to in targets if where.get_file_info(to).type != fs.FileType.NotFound]
        if len(set(targets)) < len(targets) or (taken and not self.overwrite):
            self.abort(messages)
            raise ValueError(f"{len(taken)} files are there already" if taken else "rows of a number stand in several tasks: use write_numbered")
        for name, to in pairs:
            where.move(name, to)
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        where, root = _place(self.path)
        if where.get_file_info(f"{root}/{self.aside}").type == fs.FileType.Directory:
            where.delete_dir(f"{root}/{self.aside}")


class NumberedSource(DataSource):
    """Lines of the files ``<number>.jsonl`` of a folder by byte ranges; and their writer, for rows (step, value) that are together by step."""

    @classmethod
    def name(cls) -> str:
        return "numbered_lines"

    def schema(self) -> str:
        return "step long, file string, range long, at long, value string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Lines(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _NumberedWriter(self.options, overwrite)


def file_digests(spark: SparkSession, path: str, glob: str = "*", block_bytes: int | None = None) -> DataFrame:
    """file, start, length, sha256 of files, or of their blocks; a task reads one of them through a small buffer. No files: no rows."""
    spark.dataSource.register(DigestSource)
    read = spark.read.format("file_digests").option("path", path).option("glob", glob)
    return (read.option("blockBytes", str(block_bytes)) if block_bytes else read).load()


def block_seals(blocks: DataFrame) -> DataFrame:
    """file, length, blocks, root: the SHA-256 of a file's block digests in order, as hex text. A file gives 64 characters a block."""
    each = blocks.groupBy("file").agg(F.sum("length").alias("length"), F.count("*").alias("blocks"), F.array_sort(F.collect_list(F.struct("start", "sha256"))).alias("x"))
    return each.select("file", "length", "blocks", F.sha2(F.array_join(F.col("x.sha256"), ""), 256).alias("root"))


def changed_blocks(before: DataFrame, after: DataFrame) -> DataFrame:
    """file, start: blocks that differ, or stand in one of the two only."""
    same = F.col("a.file").eqNullSafe(F.col("b.file")) & (F.col("a.start") == F.col("b.start"))
    both = before.alias("a").join(after.alias("b"), same, "full")
    return both.where(~F.col("a.sha256").eqNullSafe(F.col("b.sha256"))).select(F.coalesce("a.file", "b.file").alias("file"), F.coalesce("a.start", "b.start").alias("start"))


def read_numbered(spark: SparkSession, path: str, schema: T.StructType | str | None = None, range_bytes: int = RANGE) -> DataFrame:
    """step and the columns of ``schema`` from the JSON lines of files named by numbers; without schema, step, file, range, at, value."""
    spark.dataSource.register(NumberedSource)
    lines = spark.read.format("numbered_lines").option("path", path).option("rangeBytes", str(range_bytes)).load()
    if schema is None:
        return lines
    return lines.where(F.trim("value") != "").select("step", F.from_json("value", schema).alias("row")).select("step", "row.*")


def with_line(lines: DataFrame) -> DataFrame:
    """``line``: each line's number in its file, from 1; one row for each range tells how many lines lie ahead."""
    counts = lines.groupBy(F.col("file").alias("f"), F.col("range").alias("r")).agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("f").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Where the ranges are few, the lines stay where they are.
    counts = few(counts.withColumn("ahead", ahead).drop("n"), "counts")
    return lines.join(counts, (F.col("file") == F.col("f")) & (F.col("range") == F.col("r"))).withColumn("line", F.col("ahead") + F.col("at") + 1).drop("f", "r", "ahead")


def write_numbered(df: DataFrame, step: Column, value: Column, path: str, order: list[str], overwrite: bool = False) -> None:
    """A file ``<step>.jsonl`` of each step's values in ``order``. A file that is there already is an error, or is replaced."""
    df.sparkSession.dataSource.register(NumberedSource)
    rows = df.select(step.cast("long").alias("step"), value.alias("value"), *(F.col(c).alias(f"__{i}") for i, c in enumerate(order)))
    rows = rows.repartition("step").sortWithinPartitions("step", *(f"__{i}" for i in range(len(order)))).select("step", "value")
    rows.write.format("numbered_lines").mode("overwrite" if overwrite else "append").option("path", path).save()
