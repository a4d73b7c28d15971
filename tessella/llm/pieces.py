"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The symbols of a normalised text are its characters; an agenda holds every adjacent
pair whose join is a piece, the highest score first and the leftmost of equal ones; each
entry taken joins its pair and offers the new neighbours. No join crosses two
adjacent characters that no piece of the vocabulary has side by side, so a text falls
into independent chunks (mostly words), and each worker remembers the ids of chunks it
has met. Characters without a piece go to byte pieces, or to the unknown id.

``checked`` compares every text of a table with the sentencepiece library, batch by batch.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tune

SPACE = "▁"
#: Chunks that a worker remembers before it starts afresh.
CACHE = 600_000


class Pieces:
    """A merge-type vocabulary: pieces with scores, encode and decode."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = len(sp)
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("vocabularies with unused pieces are not supported")
        self.id = {p: i for i, p in enumerate(self.piece) if not special[i]}
        # Rank by score: the highest is 0, equal scores share one.
        order = {v: k for k, v in enumerate(sorted({sp.get_score(i) for i in self.id.values()}, reverse=True))}
        self.rank = {p: order[sp.get_score(i)] for p, i in self.id.items()}
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        # Bytes that each id decodes to; control ids to nothing.
        self.raw = [p.replace(SPACE, " ").encode() for p in self.piece]
        for i in range(n):
            if sp.is_control(i):
                self.raw[i] = b""
            elif sp.is_byte(i):
                self.raw[i] = bytes([int(self.piece[i][3:5], 16)])
            elif sp.is_unknown(i):
                self.raw[i] = " ⁇ ".encode()
        self.size = np.array([len(x) for x in self.raw])
        self.at = np.cumsum(self.size) - self.size
        self.table = np.frombuffer(b"".join(self.raw), np.uint8)
        # Pieces that lose their space at the start of a text.
        self.spaced = np.array([not s and p.startswith(SPACE) for p, s in zip(self.piece, special, strict=True)])
        # Which characters stand side by side in some piece.
        chars = sorted({c for p in self.id if len(p) > 1 for c in p})
        number = {c: k + 1 for k, c in enumerate(chars)}
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joins = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in self.id:
            for a, b in zip(p, p[1:], strict=False):
                self.joins[number[a], number[b]] = True
        self.memory: dict[str, bytes] = {}
        # Whether the library's normaliser only marks spaces and adds one in front.
        probe = " Aééﬁ　\t\n Ａ  x "
        self.plain = sp.normalize(probe) == SPACE + probe.replace(" ", SPACE)

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        return SPACE + text.replace(" ", SPACE) if self.plain else self.library.normalize(text)

    def merge(self, chunk: str) -> list[str]:
        """The pieces of a chunk by the agenda: entries are rank and left position in one integer."""
        rank, symbol = self.rank, list(chunk)
        n = len(symbol)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [r << 32 | i for i in range(n - 1) if (r := rank.get(chunk[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            entry = heapq.heappop(agenda)
            i = entry & 0xFFFFFFFF
            j = after[i]
            # An entry whose sides have been joined otherwise meanwhile is void.
            if j >= n or not symbol[i] or rank.get(joined := symbol[i] + symbol[j]) != entry >> 32:
                continue
            symbol[i], symbol[j] = joined, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(joined + symbol[k])) is not None:
                    heapq.heappush(agenda, r << 32 | i)
            k = before[i]
            if k >= 0 and (r := rank.get(symbol[k] + joined)) is not None:
                heapq.heappush(agenda, r << 32 | k)
        return [s for s in symbol if s]

    def chunk_ids(self, chunk: str) -> bytes:
        ids = []
        for p in self.merge(chunk):
            if (i := self.id.get(p)) is not None:
                ids.append(i)
            elif self.byte:
                ids += [self.byte[b] for b in p.encode()]
            else:
                ids.append(self.unk)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, with begin and end id, as little-endian unsigned 32-bit integers."""
        ends = [np.array([i], "<u4").tobytes() for i in (self.bos, self.eos)]
        text = self.normalise(text or "")
        if not text:
            return b"".join(ends)
        number = self.number[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        cuts = (np.flatnonzero(~self.joins[number[:-1], number[1:]]) + 1).tolist()
        memory = self.memory
        chunks = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        out = list(map(memory.get, chunks))
        if None in out:
            if len(memory) >= CACHE:
                memory.clear()
            for k, ids in enumerate(out):
                if ids is None:
                    chunk = chunks[k]
                    out[k] = ids = memory.get(chunk) or self.chunk_ids(chunk)
                    if len(chunk) <= 64:
                        memory[chunk] = ids
        joined = b"".join([ends[0], *out, ends[1]])
        # Without byte pieces the library gives one unknown id for a run of unknown characters.
        return joined if self.byte else self._one_unknown(joined)

    def _one_unknown(self, joined: bytes) -> bytes:
        ids = np.frombuffer(joined, "<u4")
        unknown = ids == self.unk
        return ids[~(unknown & np.concatenate(([False], unknown[:-1])))].tobytes()

    def decode(self, ids: bytes) -> str:
        """The text of ids: one leading space dropped, bytes that aren't UTF-8 replaced one by one."""
        listed = np.frombuffer(ids, "<u4")
        size = self.size[listed]
        shown = np.flatnonzero(size)
        if not len(shown):
            return ""
        if shown[-1] - shown[0] >= len(shown):  # control ids inside part byte runs
            return self._lenient(listed.tolist())
        # Positions in the table of all pieces' bytes, piece after piece.
        listed, size = listed[shown], size[shown]
        end = np.cumsum(size)
        raw = self.table[np.repeat(self.at[listed] - (end - size), size) + np.arange(end[-1])].tobytes()
        try:
            return raw[int(self.spaced[listed[0]]) :].decode()
        except UnicodeDecodeError:
            return self._lenient(listed.tolist())

    def _lenient(self, listed: list[int]) -> str:
        single, out, run, first = set(self.byte.values()), [], b"", True
        for i in [*listed, None]:
            if i in single:
                run, first = run + self.raw[i], False
                continue
            while run:  # a broken byte becomes one replacement character
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[:size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("\ufffd")
                    size = 1
                run = run[size:]
            if i is not None:
                out.append(self.raw[i][int(first and self.spaced[i]) :].decode())
                first = first and not self.raw[i]
        return "".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """The vocabulary of a model file, kept by each Python worker."""
    return Pieces(path)


def _digests(path: str, compare: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            n, ids_hash, text_hash, same = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = model.encode(text)
                decoded = model.decode(ids)
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
                if compare:
                    want = model.library.encode(text or "", add_bos=True, add_eos=True)
                    same.append(np.frombuffer(ids, "<u4").tolist() == want and model.library.decode(want) == decoded)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if compare:
                columns, names = [*columns, pa.array(same, pa.bool_())], [*names, "agrees"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            ids = [np.frombuffer(model.encode(t), "<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            back = [model.decode(x.astype("<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], ["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (with begin and end id) and decoded text of every row.

    A null or empty text has the begin and end id only and decodes to ''. Texts of any
    length are encoded whole. Repeated rows are encoded each, other columns don't
    matter, and an empty table gives an empty result.
    """
    tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_encoded(path), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, as by ``encode``."""
    tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_digests(path, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def checked(docs: DataFrame, path: str) -> DataFrame:
    """``digests`` with ``agrees``: whether ids and decoded text are the library's own."""
    tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_digests(path, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean")
