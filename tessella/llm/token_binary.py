"""Token ids in a binary file format: frequency ranks in byte-aligned variable-length code.

Ids are replaced by their rank in the whole corpus (most frequent first), so most take
one byte. A value takes 1 to 4 bytes; its length less one is two bits of a control
byte, and the control bytes stand apart from the data bytes. A reader turns the
control bytes into lengths and offsets by a numpy table lookup, without branches.

Files are Parquet rows, one for each block of consecutive documents, so Spark's
committer makes each file appear once and any store that Spark writes to will do.
A block row holds: ``shard`` (place of its file in the order of doc_ids), ``block``,
``before`` (ids of the shard ahead of it), doc_ids, counts (ids of each document),
``control`` and ``data``. A second small table holds the rank table.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, shared_dir, staged, tune

#: Ids in a block, about; a longer document makes a longer block.
BLOCK = 1 << 16
#: Words that a worker remembers before it starts afresh.
CACHE = 1_200_000

_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    length = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = length - 1
    control = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    raw = v.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) < length[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of pack()."""
    length = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(length, dtype=np.int64) - length
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)))
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class Words:
    """A tokenizer of the ``tokenizers`` library that encodes each distinct word once.

    Where its pre-tokenizer keeps the matches of one pattern, words are independent.
    Texts of plain Latin characters, whose case and classes are beyond doubt, are cut by that pattern;
    their words are encoded by the library and remembered. All other texts, and all
    texts under other kinds of tokenizer, go to the library as they are.
    """

    PLAIN = regex.compile("[\t\n\r -~À-įı-ž]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.pattern = self._pattern(spec)
        # Of the plain characters: 0 space, 1 letter, 2 digit, 3 other; 4 is not plain.
        self.classes = np.full(0x180, 4, np.uint8)
        for c in map(chr, range(0x180)):
            if self.PLAIN.match(c):
                self.classes[ord(c)] = 0 if c.isspace() else 1 if regex.match(r"\p{L}", c) else 2 if regex.match(r"\p{N}", c) else 3
        self.memory: dict[str, bytes] = {}
        self.size = self.library.get_vocab_size()
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.last = self._last(spec)

    def _last(self, spec: dict) -> np.ndarray | None:
        """Which ids end a word, where every word has one at its end and nowhere else: then words can be encoded joined by spaces."""
        suffix, vocabulary = (spec.get("model") or {}).get("end_of_word_suffix"), self.library.get_vocab()
        if self.pattern is None or not suffix or self.pattern.fullmatch(suffix):
            return None
        from tokenizers.pre_tokenizers import ByteLevel

        if any(c + x not in vocabulary for c in ByteLevel.alphabet() for x in ("", suffix)):
            return None
        last = np.zeros(self.size, bool)
        last[[i for word, i in vocabulary.items() if word.endswith(suffix)]] = True
        return last

    @staticmethod
    def _pattern(spec: dict):
        """The pattern whose matches are the words of lower-cased text, if the tokenizer works so."""
        steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if steps != ["NFC", "Replace", "Lowercase"] or spec["normalizer"]["normalizers"][1] != {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}:
            return None
        if [s["type"] for s in pre] != ["Split", "ByteLevel"] or not pre[0].get("invert") or pre[0]["behavior"] != "Removed" or pre[1].get("use_regex", True) or pre[1].get("add_prefix_space", True):
            return None
        if (spec.get("post_processor") or {}).get("type") not in (None, "RobertaProcessing", "TemplateProcessing", "ByteLevel"):
            return None
        return regex.compile(pre[0]["pattern"]["Regex"])

    def cut(self, text: str) -> list[str] | None:
        """The words of a plain text; None for any other."""
        if self.pattern is None or any(s in text for s in self.special):
            return None
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        if code.max() >= len(self.classes) or (kind := self.classes[code]).max() == 4:
            return None
        text = text.lower()
        if "'" in text:  # may be a contraction
            return self.pattern.findall(text)
        # A word is a run of one kind; digits stand alone.
        first = np.flatnonzero(np.concatenate(([True], (kind[1:] != kind[:-1]) | (kind[1:] == 2))))
        word = kind[first] > 0
        last = np.append(first[1:], len(kind))
        return [text[a:b] for a, b in zip(first[word].tolist(), last[word].tolist(), strict=True)]

    def _encoded(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        if self.last is not None:
            ids = np.array(self.library.encode(" ".join(words), add_special_tokens=False).ids, self.kind)
            stop = np.flatnonzero(self.last[ids]) + 1
            if len(stop) == len(words) and stop[-1] == len(ids):
                raw, size = ids.tobytes(), ids.itemsize
                stops = (stop * size).tolist()
                return [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch(words, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without special tokens added; null is empty."""
        return [np.frombuffer(x, self.kind).astype("<u4").tobytes() for x in self.packed(texts)]

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """What ``encode`` gives, in ids of type ``kind``."""
        out: list[bytes] = [b""] * len(texts)
        memory, new, later = self.memory, {}, {}
        for i, text in enumerate(texts):
            if not text:
                continue
            if (words := self.cut(text)) is None:
                out[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
                continue
            ids = list(map(memory.get, words))
            if None in ids:
                later[i] = words
                new.update((w, b"") for w, x in zip(words, ids, strict=True) if x is None)
            else:
                out[i] = b"".join(ids)
        names = list(new)
        for at in range(0, len(names), 4096):
            part = names[at : at + 4096]
            new.update(zip(part, self._encoded(part), strict=True))
        for i, words in later.items():
            out[i] = b"".join([new[w] if (x := memory.get(w)) is None else x for w in words])
        if len(memory) + len(new) > CACHE:
            memory.clear()
        memory.update(x for x in new.items() if len(x[0]) <= 64)
        return out


@lru_cache(maxsize=2)
def load(path: str) -> Words:
    return Words(path)


def _kind(path: str, end: int) -> str:
    """The type that ids are kept as: unsigned 16-bit integers where the vocabulary allows, else 32-bit."""
    return "<u4" if end >= 1 << 16 else load(path).kind


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, kind, total = load(path), _kind(path, end), np.zeros(0, np.int64)
        tail = np.array([end], kind).tobytes()
        for batch in batches:
            texts = words.packed(batch.column(1).to_pylist())
            if kind != words.kind:
                texts = [np.frombuffer(x, words.kind).astype(kind).tobytes() for x in texts]
            ids = [x + tail for x in texts]
            n = np.bincount(np.frombuffer(b"".join(ids), kind), minlength=len(total))
            n[: len(total)] += total
            total = n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.list_(pa.int64()))], ["doc_id", "ids", "tally"])
        row = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(row, ["doc_id", "ids", "tally"])

    return run


def token_ids(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id and ids with the end id of every row, and one more row for each task: ``tally``, how often each id came."""
    tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_encode(path, end), "doc_id long, ids binary, tally array<long>")


def frequency_ranks(ids: DataFrame, kind: str = "") -> np.ndarray:
    """Ids by falling count over all documents (ties: smaller id first); as many as the vocabulary at most.

    The tallies of the tasks are added up, whatever ``kind`` the ids are of.
    """
    counts = ids.select(F.posexplode("tally").alias("id", "n")).groupBy("id").agg(F.sum("n").alias("n")).where("n > 0").collect()
    return np.array([r.id for r in sorted(counts, key=lambda r: (-r.n, r.id))], np.int64)


def _blocks(kind: str, rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, before = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        parts: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            nonlocal number, before
            values = np.concatenate(parts)
            control, data = pack(rank[values])
            row = [[shard], [number], [before], [list(docs)], [[len(p) for p in parts]], [control], [data]]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            number, before = number + 1, before + len(values)
            docs.clear(), parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["shard", "block", "before", "doc_ids", "counts", "control", "data"])

        held = 0
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs.append(doc), parts.append(np.frombuffer(ids, kind))
                held += len(parts[-1])
                if held >= BLOCK:
                    yield block()
                    held = 0
        if docs:
            yield block()

    return run


def write(docs: DataFrame, path: str, end: int, to: str | None = None) -> str:
    """Writes the ids of every text in ascending doc_id order (null doc_ids first) and gives the folder.

    A null or empty text has the end id only. Rows that share a doc_id stand in the
    order of their ids. Other columns don't matter; an empty table gives empty files.
    """
    spark = docs.sparkSession
    to = to or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    ids = staged(token_ids(docs, path, end), "token-ids")
    by_rank = frequency_ranks(ids)
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.int64)
    rank[by_rank] = np.arange(len(by_rank))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = ids.where("ids is not null").select("doc_id", "ids").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    schema = "shard long, block long, before long, doc_ids array<long>, counts array<long>, control binary, data binary"
    ordered.mapInArrow(_blocks(_kind(path, end), rank), schema).write.option("compression", "zstd").parquet(f"{to}/blocks")
    discard(ids)
    spark.createDataFrame([(by_rank.tolist(), end)], "ids array<long>, end long").coalesce(1).write.parquet(f"{to}/ranks")
    return to


def _read(by_rank: np.ndarray, base: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for shard, before, docs, counts, control, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = by_rank[unpack(control, data, sum(counts))].astype("<u4")
                stops = np.cumsum(counts)
                for doc, n, stop in zip(docs, counts, stops.tolist(), strict=True):
                    out.append((doc, base[shard] + before + stop - n, n, ids[stop - n : stop].tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "start", "n_tokens", "ids"])

    return run


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) from the files."""
    tune(spark)
    blocks = spark.read.parquet(f"{folder}/blocks")
    by_rank = np.array(spark.read.parquet(f"{folder}/ranks").first().ids, np.int64)
    base, total = {}, 0
    # One row for each file of the writer.
    for r in sorted(blocks.groupBy("shard").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()):
        base[r.shard], total = total, total + r.n
    return blocks.select("shard", "before", "doc_ids", "counts", "control", "data").mapInArrow(_read(by_rank, base), "doc_id long, start long, n_tokens long, ids binary")


def written_and_read(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, read back from the files."""
    return read(docs.sparkSession, write(docs, path, end)).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
