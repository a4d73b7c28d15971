"""Language identification by a byte convolutional network.

The network embeds the bytes of a fixed-length window, applies filters of several
widths, takes each filter's maximum over the window, and ends in a softmax over the
languages seen in training. Everything is numpy. Training uses a bounded sample of
labelled rows (``Settings.per_language``) and of windows spread over their whole texts, with Adam; prediction cuts every whole text
into consecutive windows and averages their probabilities, weighted by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tune
from .words import buffers

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``per_language``: training texts of each language at most, those with the smallest hashes; ``pieces``: windows of
    each, spread evenly over the whole text; every language that has a label is learned. ``stride``: step of the filters along a window."""

    window: int = 128
    embed: int = 4
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8
    stride: int = 2
    per_language: int = 300
    pieces: int = 10
    epochs: int = 6
    batch: int = 64
    rate: float = 0.01
    seed: int = 9


def windows(raw: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive windows of a text's bytes, the last padded with zeros, and the bytes in each."""
    n = max(1, -(-len(raw) // size))
    out = np.zeros(n * size, np.uint8)
    out[: len(raw)] = raw
    held = np.full(n, size)
    held[-1] = len(raw) - (n - 1) * size
    return out.reshape(n, size), held


def spread(text: str, settings: Settings) -> np.ndarray:
    """Windows for training, evenly spread over a whole text; a last one of few bytes only if it is alone."""
    x, held = windows(np.frombuffer(text.strip().encode("utf-8", "replace"), np.uint8), settings.window)
    x = x[held >= min(16, held[0])]
    return x[np.unique(np.linspace(0, len(x) - 1, min(len(x), settings.pieces)).round().astype(int))]


class Network:
    """Parameters and the forward pass."""

    def __init__(self, languages: list[str], settings: Settings):
        self.languages, self.settings = languages, settings
        r, s = np.random.default_rng(settings.seed), settings
        self.p = {"embed": r.normal(0, 0.5, (256, s.embed))}
        for w in s.widths:
            self.p[f"filter{w}"] = r.normal(0, 1 / np.sqrt(w * s.embed), (w * s.embed, s.filters))
            self.p[f"bias{w}"] = np.zeros(s.filters)
        self.p["out"] = r.normal(0, 0.1, (len(s.widths) * s.filters, max(1, len(languages))))
        self.p["out_bias"] = np.zeros(max(1, len(languages)))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _patches(self, embedded: np.ndarray, w: int) -> np.ndarray:
        n, size, e = embedded.shape
        steps = (size - w) // self.settings.stride + 1
        a, b, c = embedded.strides
        view = np.lib.stride_tricks.as_strided(embedded, (n, steps, w * e), (a, b * self.settings.stride, c))
        return view.reshape(n * steps, w * e)

    def features(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        embedded = self.p["embed"][x]
        out = []
        for w in self.settings.widths:
            patches = self._patches(embedded, w)
            y = (patches @ self.p[f"filter{w}"]).reshape(len(x), -1, self.settings.filters)
            if keep is not None:
                keep[w] = (patches, y.argmax(1))
            out.append(y.max(1) + self.p[f"bias{w}"])
        return np.maximum(np.concatenate(out, 1), 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.features(x) @ self.p["out"] + self.p["out_bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy."""
        s, keep = self.settings, {}
        hidden = self.features(x, keep)
        z = hidden @ self.p["out"] + self.p["out_bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        z[np.arange(len(y)), y] -= 1
        z /= len(y)
        g = {"out": hidden.T @ z, "out_bias": z.sum(0), "embed": np.zeros_like(self.p["embed"])}
        back = (z @ self.p["out"].T) * (hidden > 0)
        rows = np.arange(len(x))[:, None]
        for k, w in enumerate(s.widths):
            d = back[:, k * s.filters : (k + 1) * s.filters]
            patches, top = keep[w]
            steps = len(patches) // len(x)
            chosen = patches.reshape(len(x), steps, -1)[rows, top]  # the patch that won, for each filter
            g[f"filter{w}"] = np.einsum("nfp,nf->pf", chosen, d)
            g[f"bias{w}"] = d.sum(0)
            into = d[:, :, None] * self.p[f"filter{w}"].T[None]
            at = top[:, :, None] * s.stride + np.arange(w)
            np.add.at(g["embed"], x[rows[:, :, None], at].ravel(), into.reshape(-1, s.embed))
        return g


def train(texts: list[str], langs: list[str], settings: Settings | None = None) -> Network:
    """A network fitted to labelled texts; without any it knows no language."""
    s = settings or Settings()
    return fit([spread(t, s) for t in texts], langs, s)


def fit(pieces: list[np.ndarray], langs: list[str], settings: Settings | None = None) -> Network:
    """A network fitted to the windows of labelled texts."""
    s = settings or Settings()
    net = Network(sorted(set(langs)), s)
    xs, ys = pieces, [np.full(len(x), net.languages.index(lang)) for x, lang in zip(pieces, langs, strict=True)]
    if len(net.languages) < 2:
        return net
    x, y = np.concatenate(xs), np.concatenate(ys)
    r = np.random.default_rng(s.seed)
    # The same weight for each language: windows of rarer ones are repeated.
    count = np.bincount(y, minlength=len(net.languages))
    pool = [np.flatnonzero(y == k) for k in range(len(count))]
    each = int(min(count.max(), 8 * np.median(count)))
    first, second, t = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    for epoch in range(s.epochs):
        order = r.permutation(np.concatenate([r.choice(q, each, replace=len(q) < each) for q in pool]))
        rate = s.rate * (1 - epoch / s.epochs) + s.rate / 20
        for at in range(0, len(order), s.batch):
            t += 1
            for k, g in net.gradients(x[b := order[at : at + s.batch]], y[b]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                net.p[k] -= (rate * first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _spread(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [spread(t, settings).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], ["lang", "place", "windows"])

    return run


def sample(docs: DataFrame, settings: Settings) -> tuple[list[np.ndarray], list[str]]:
    """Windows of the ``per_language`` texts of each language with the smallest hashes, and their languages; copies of a text count once."""
    rows = docs.where(~held_out()).where("lang is not null and text is not null and length(text) > 0").select("lang", "text")
    count = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()}
    if not count:
        return [], []
    # Half as many again as are wanted, since hashes vary; then the smallest.
    spread_to = 1 << 30
    limit = F.create_map(*(F.lit(v) for k, n in count.items() for v in (k, min(spread_to, int(spread_to * (1.5 * settings.per_language + 30) / n) + 1))))
    place = F.xxhash64("text")
    some = rows.withColumn("place", place).where(F.pmod("place", F.lit(spread_to)) < limit[F.col("lang")]).groupBy("lang", "place").agg(F.min("text").alias("text"))
    got = some.select("lang", "place", "text").mapInArrow(_spread(settings), "lang string, place long, windows binary").collect()
    pieces, langs, taken = [], [], dict.fromkeys(count, 0)
    for r in sorted(got, key=lambda r: (r.lang, r.place % spread_to, r.place)):
        if taken[r.lang] < settings.per_language:
            taken[r.lang] += 1
            pieces.append(np.frombuffer(r.windows, np.uint8).reshape(-1, settings.window)), langs.append(r.lang)
    return pieces, langs


def _predict(net: Network):
    size, k = net.settings.window, len(net.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column(1))
            texts = batch.column(1).to_pylist()
            total = np.zeros((len(texts), max(1, k)))
            todo: list[tuple[int, np.ndarray, np.ndarray]] = []
            held_windows = 0

            def score() -> None:
                if todo:
                    x = np.concatenate([t[1] for t in todo])
                    weight = np.concatenate([t[2] for t in todo]).astype(np.float64)
                    of = np.concatenate([np.full(len(t[1]), t[0]) for t in todo])
                    np.add.at(total, of, net.probabilities(x) * weight[:, None])
                    todo.clear()

            for i, text in enumerate(texts):
                # Windows of a long text go through the network in pieces of bounded size.
                for a in range(off[i], max(off[i + 1], off[i] + 1), 1024 * size):
                    x, held = windows(data[a : min(off[i + 1], a + 1024 * size)], size)
                    todo.append((i, x, np.maximum(held, 1)))
                    held_windows += len(x)
                    if held_windows >= 512:
                        score()
                        held_windows = 0
            score()
            share = total / np.maximum(total.sum(1, keepdims=True), 1e-30)
            letters = [bool(text) and any(map(str.isalpha, text)) for text in texts]
            best = share.argmax(1)
            lang = [net.languages[b] if ok and k else UNKNOWN for b, ok in zip(best, letters, strict=True)]
            value = [float(share[i, b]) if ok and k else 0.0 for i, (b, ok) in enumerate(zip(best, letters, strict=True))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(value, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, net: Network, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, text, lang_pred and score (the mean probability of that language) for every row.

    Only ``text`` enters. A null text, one without a letter, and any text where nothing
    was learned get ``und`` with score 0. Texts of any length are read whole; repeated
    rows are scored each; an empty table gives an empty result.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(carry[0]), "text", *carry[1:])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", lang_pred string, score double"
    return rows.mapInArrow(_predict(net), schema)


def fitted(docs: DataFrame, settings: Settings | None = None) -> Network:
    """A network fitted to the labelled, not held out rows of ``docs``."""
    settings = settings or Settings()
    return fit(*sample(docs, settings), settings)


def language_id(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; see ``identify``."""
    return identify(docs, fitted(docs, settings)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
