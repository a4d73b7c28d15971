"""Toxicity by a weighted finite-state pattern grammar.

Words map to symbols (insult, slur, hint, threat, target, negation, report, ...) by a lexicon of four
languages. Small weighted transducers over these symbols are composed: the *reading* transducer
turns a clause into marked symbols (after a negation or a verb of report, what follows
is marked, up to the end of its scope); the *match* transducer accepts clauses
with an insult or a threat, with or without a target beside it. An arc that completes a piece of
harm gives the piece's name out and has a weight, and composing adds weights. A document's log-odds are
a bias plus the weights of the arcs that its clauses take; the n-th arc of one name counts log2((n + 1) / n)
of its weight, so a long text isn't toxic by length. Words that no clause combines don't score.

Seed words are fixed. Further insults, as words (slurs) or as stems (hints), are learned from a bounded
sample of labelled rows (``Settings.per_class``), and so are the arcs' weights, by logistic
regression over how often each kind of arc was taken.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tune

WORD = re.compile(r"[^\W\d_]+|[.!?;:\n]+")

#: Seed lexicon: symbols and their words, English, French, German, Spanish.
SEEDS = {
    "insult": """
        idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown clowns dumb fool imbecile garbage vermin
        idiote imbécile imbéciles stupide crétin crétins abruti débile ordure ordures pathétique minable
        dummkopf depp trottel abschaum erbärmlich wertlos dumm versager idioten ekelhaft
        idiota idiotas estúpido estúpida imbécil basura patético patética inútil payaso tonto tonta escoria""",
    "threat": """
        kill hurt beat destroy shoot stab punch crush burn hunt
        tuer tue tuerai frapper frapperai détruire détruirai brûler
        töten töte umbringen schlagen vernichten verbrennen erschießen
        matar mataré mato golpear golpearé destruir quemar""",
    "target": """
        you your yours youre they them he she him her these those people everyone
        tu te toi vous ils elles eux
        du dich dir ihr euch sie ihn bist
        tú ti usted ustedes ellos vosotros eres""",
    "negation": """
        not no never neither nor isnt arent wasnt dont doesnt didnt isn aren wasn don doesn didn won wouldn
        ne n pas jamais aucun aucune
        nicht kein keine keinen niemals nie
        nunca jamás tampoco""",
    "report": """
        said says told called wrote claimed reported quoted according
        dit disait déclaré écrit affirme selon
        sagte sagt schrieb behauptete laut berichtete meinte
        dijo dice escribió afirmó según""",
    "intent": """
        will gonna shall should must deserve deserves
        vais va vas dois devrait mérites
        werde wird sollte muss verdienst
        voy debo debería mereces""",
}

#: Words after a negation that it covers, and after a verb of report.
SCOPE = {"negation": 3, "report": 12}


@dataclass(frozen=True)
class Settings:
    """``per_class``: labelled rows of each class used to learn, at most. A word or stem is an insult if it stands between at
    least ``least`` different pairs of neighbours in toxic texts, and in as many as ``often`` of all toxic
    texts (copies of a text repeat their neighbours and don't count), and if at most ``impure`` of its rate is clean."""

    per_class: int = 3000
    least: int = 4
    often: float = 0.015
    impure: float = 0.03
    stem: int = 5
    cut: float = 0.7


@dataclass
class Transducer:
    """Deterministic, with weights: (state, symbol) to (state, output, weight); ``"*"`` is any other symbol."""

    arcs: dict[tuple[str, str], tuple[str, str, float]]
    start: str = "0"
    final: dict[str, float] = field(default_factory=dict)

    def step(self, state: str, symbol: str) -> tuple[str, str, float]:
        """Where the symbol's arc leads, what it gives out, and its weight."""
        arc = self.arcs.get((state, symbol)) or self.arcs.get((state, "*"))
        to, out, weight = arc or (state, symbol, 0.0)
        return to, symbol if out == "=" else out, weight


#: Symbols of harm.
HARM = ("insult", "slur", "hint", "threat")


def reading() -> Transducer:
    """Marks harm under negation (``not:``) and report (``told:``)."""
    arcs: dict[tuple[str, str], tuple[str, str, float]] = {}
    mark = {"0": ""} | {f"n{k}": "not:" for k in range(1, SCOPE["negation"] + 1)} | {f"r{k}": "told:" for k in range(1, SCOPE["report"] + 1)}
    for state, prefix in mark.items():
        after = "0" if state in ("0", "n1", "r1") else f"{state[0]}{int(state[1:]) - 1}"
        for symbol in HARM:
            arcs[state, symbol] = (after, prefix + symbol, 0.0)
        arcs[state, "negation"] = (f"n{SCOPE['negation']}", "=", 0.0)
        arcs[state, "report"] = (f"r{SCOPE['report']}", "=", 0.0)
        arcs[state, "*"] = (after, "=", 0.0)
    return Transducer(arcs)


#: What an arc of harm may give out, with the log-odds that it starts from: bare, beside a target or an intent, marked.
PIECES = {
    "insult": 4.0, "insult target": 5.0, "target of insult": 1.0,
    "slur": 3.0, "slur target": 3.5, "target of slur": 0.5,
    "hint": 2.0, "hint target": 2.5, "target of hint": 0.5,
    "threat": 1.5, "intent threat": 3.0, "threat target": 5.0, "target of threat": 3.0,
    "not:insult": 0.3, "not:slur": 0.3, "not:hint": 0.3, "not:threat": 0.2, "told:insult": 0.3, "told:slur": 0.3, "told:hint": 0.3, "told:threat": 0.2,
}


#: Names of a clause by its strongest piece, the strongest last.
PATTERNS = (
    *(mark + harm for harm in ("threat", "hint", "slur", "insult") for mark in ("told:", "not:")),
    *("threat", "hint", "slur", "intent threat", "insult", "hint target", "slur target", "insult target", "threat target"),
)


def matching(weights: dict[str, float] = PIECES) -> Transducer:
    """Weighs the pieces of harm of a clause.

    A state has the harm that awaits a target, and what has come: t a target, i an intent, ti both in this order,
    it a target after the intent (whom it is meant for).
    """
    arcs: dict[tuple[str, str], tuple[str, str, float]] = {}

    def arc(piece: str, to: str) -> tuple[str, str, float]:
        return to, piece, weights[piece]

    with_target = {"": "t", "t": "t", "i": "it", "ti": "it", "it": "it"}
    with_intent = {"": "i", "t": "ti", "i": "i", "ti": "ti", "it": "it"}
    for bare in ("", *HARM):
        for has in with_target:
            state = f"{bare}|{has}"
            for symbol in HARM:
                if symbol == "threat":
                    intent = "threat target" if has == "it" else "intent threat"
                    arcs[state, symbol] = arc(intent, f"threat|{has}") if "i" in has else arc(symbol, state)
                elif "t" in has:
                    arcs[state, symbol] = arc(f"{symbol} target", state)
                else:
                    arcs[state, symbol] = arc(symbol, f"{symbol}|{has}")
                for mark in ("not:", "told:"):
                    arcs[state, mark + symbol] = arc(mark + symbol, state)
            arcs[state, "target"] = arc(f"target of {bare}", f"|{with_target[has]}") if bare else (f"|{with_target[has]}", "=", 0.0)
            arcs[state, "intent"] = (f"{bare}|{with_intent[has]}", "=", 0.0)
    return Transducer(arcs, start="|")


def compose(first: Transducer, second: Transducer) -> Transducer:
    """What ``second`` makes of the output of ``first``, as one transducer; built from its start on."""
    symbols = {s for t in (first, second) for _, s in t.arcs}
    arcs: dict[tuple[str, str], tuple[str, str, float]] = {}
    pairs = {(first.start, second.start)}
    todo = list(pairs)
    while todo:
        a, b = todo.pop()
        for s in symbols:
            if ":" in s:
                continue
            to, out, w = first.step(a, s)
            then, final, v = second.step(b, out)
            arcs[f"{a}/{b}", s] = (f"{to}/{then}", final, w + v)
            if (to, then) not in pairs:
                pairs.add((to, then))
                todo.append((to, then))
    return Transducer(arcs, start=f"{first.start}/{second.start}")


@dataclass
class Grammar:
    """A lexicon (words and stems to symbols), the composed transducer with weighted arcs, and the bias."""

    words: dict[str, str]
    stems: set[str]
    stem: int
    weights: dict[str, float] = field(default_factory=lambda: dict(PIECES))
    bias: float = -3.0

    def __post_init__(self) -> None:
        self.machine = compose(reading(), matching(self.weights))
        self.harmful = {w for w, s in self.words.items() if s in HARM}

    def symbol(self, word: str) -> str:
        return self.words.get(word) or ("hint" if len(word) > self.stem and word[: self.stem] in self.stems else "other")

    def pieces(self, text: str) -> Iterator[tuple[str, float, int]]:
        """The pieces of harm that the text's clauses give out, in order, with their arcs' weights and the number of the clause."""
        listed = WORD.findall(text.lower())
        found = set(listed)
        # Without an insult or a threat no clause matches.
        if self.harmful.isdisjoint(found) and self.stems.isdisjoint({w[: self.stem] for w in found}):
            return
        state, step, clause = self.machine.start, self.machine.step, 0
        for token in listed:
            if token[0] in ".!?;:\n":
                state, clause = self.machine.start, clause + 1
                continue
            state, out, weight = step(state, self.symbol(token))
            if out in PIECES:
                yield out, weight, clause

    def clauses(self, text: str) -> Counter:
        """How many clauses match each of PATTERNS as their strongest."""
        best: dict[int, str] = {}
        for piece, _, clause in self.pieces(text):
            name = f"{piece[10:]} target" if piece.startswith("target of ") else piece
            best[clause] = max(name, best.get(clause, PATTERNS[0]), key=PATTERNS.index)
        return Counter(best.values())

    def score(self, text: str | None) -> float:
        """The probability that a text is toxic; that of no match for an empty one."""
        z, times = self.bias, Counter()
        for piece, weight, _ in self.pieces(text) if text else ():
            times[piece] += 1
            z += weight * np.log2((times[piece] + 1) / times[piece])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def seeds() -> dict[str, str]:
    return {w: s for s, ws in SEEDS.items() for w in ws.split()}


def learn(texts: list[str], toxic: list[int], settings: Settings | None = None) -> Grammar:
    """A grammar with insults and weights learned from labelled texts; without both classes the seeds alone."""
    s = settings or Settings()
    words, bad, good, bad_stem, good_stem = seeds(), {}, Counter(), {}, Counter()
    for text, label in zip(texts, toxic, strict=True):
        listed = ["", *(w for w in WORD.findall(text.lower()) if w[0].isalpha()), ""]
        if label:
            for a, w, b in zip(listed, listed[1:], listed[2:], strict=False):
                bad.setdefault(w, set()).add((a, b))
                if len(w) > s.stem:
                    bad_stem.setdefault(w[: s.stem], set()).add((a, b))
        else:
            good.update(found := set(listed))
            good_stem.update({w[: s.stem] for w in found if len(w) > s.stem})
    n_bad, n_good = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    # Rates, since the classes are sampled to like sizes.
    pure = lambda b, g: len(b) >= max(s.least, s.often * n_bad) and g / n_good <= s.impure * len(b) / n_bad
    words |= {w: "slur" for w, near in bad.items() if w not in words and pure(near, good[w])}
    # Seeds that the labels contradict aren't insults here.
    for w in list(words):
        if words[w] in HARM and good[w] >= s.least and good[w] / n_good > 0.5 * len(bad.get(w, ())) / n_bad:
            del words[w]
    stems = {w for w, near in bad_stem.items() if pure(near, good_stem[w])}
    grammar = Grammar(words, stems, s.stem)
    weights, bias = _fitted(grammar, texts, np.array(toxic, float))
    # An insult to someone and an announced threat to someone are toxic by the grammar, however rare in the sample.
    need = float(np.log((s.cut + 0.05) / (0.95 - s.cut))) - bias
    weights["insult target"] = max(weights["insult target"], need)
    weights["target of insult"] = max(weights["target of insult"], need - weights["insult"])
    weights["intent threat"] = max(weights["intent threat"], 0.6 * need)
    weights["threat target"] = max(weights["threat target"], need)
    weights["target of threat"] = max(weights["target of threat"], need - weights["intent threat"])
    return Grammar(words, stems, s.stem, weights, bias)


def _fitted(grammar: Grammar, texts: list[str], y: np.ndarray) -> tuple[dict[str, float], float]:
    """Weights of the pieces, none below 0, and the bias: logistic regression, drawn to PIECES; PIECES itself without both classes."""
    names, prior, bias = list(PIECES), np.array(list(PIECES.values())), grammar.bias
    w = prior.copy()
    if not 0 < y.sum() < len(y):
        return dict(PIECES), bias
    times = [Counter(piece for piece, *_ in grammar.pieces(t)) for t in texts]
    x = np.array([[np.log2(1 + c[n]) for n in names] for c in times])
    # Seeds that are marked as negated or reported keep close to their prior: words meant so are rare in a sample.
    pull = np.array([8.0 if n.endswith((":insult", ":threat")) else 0.1 for n in names])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30)))
        h = np.append(((x * x) * (p * (1 - p))[:, None]).sum(0) + pull, (p * (1 - p)).sum() + 0.1)
        g = np.append(x.T @ (p - y) + pull * (w - prior), (p - y).sum() + 0.1 * (bias + 3.0))
        step = 0.4 * g / h
        w, bias = np.maximum(w - step[:-1], 0.0), bias - step[-1]
    return dict(zip(names, w.tolist(), strict=True)), float(bias)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[list[str], list[int]]:
    """The ``per_class`` labelled, not held out rows of each class with the smallest hashes of doc_id: whole texts."""
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    drawn = known.where("toxic = 0").orderBy(*order).limit(settings.per_class).unionByName(known.where("toxic = 1").orderBy(*order).limit(settings.per_class))
    # At most 2 * per_class keys: a bounded broadcast. Of rows that share a doc_id one text counts.
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), "doc_id")
    got = sorted(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect(), key=lambda x: x.doc_id)
    return [x.text for x in got], [x.toxic for x in got]


def _scored(grammar: Grammar, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [grammar.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array([int(s >= cut) for s in score], pa.int32())], ["doc_id", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Only ``text`` enters a score. Null and empty texts score like texts without a
    match. Labels other than 0 and 1, of unknown documents or without doc_id are ignored;
    contradicting ones count as toxic. Texts of any length are scored whole; repeated rows are
    scored each, other columns don't matter, and an empty table gives an empty result.
    """
    settings = settings or Settings()
    tune(docs.sparkSession)
    grammar = learn(*sample(docs, labels, settings), settings)
    scored = docs.select("doc_id", "text").mapInArrow(_scored(grammar, settings.cut), "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
