import random
import zlib

import pytest

from tessella.llm.toxicity import PATTERNS, Grammar, compose, learn, matching, reading, seeds, toxicity


def words(r, n):
    return ["".join(r.choice(["an", "the", "re", "tion", "ou", "st"]) for _ in range(r.randint(1, 4))) for _ in range(n)]


def corpus(seed=1, n=600):
    """Clean texts, and toxic ones with seed insults or with words of an unknown stem."""
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w, toxic = words(r, r.randint(20, 120)), r.random() < 0.3
        for _ in range(3 if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(["idiot", "scum", "moron", *("zogwu" + x for x in ("ling", "lar", "ten", "mi"))]))
        rows.append((i, " ".join(w) + "."))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def grammar():
    g = Grammar(seeds(), set(), 5)
    g.weights = dict.fromkeys(PATTERNS, 1.0)
    return g


@pytest.mark.parametrize(
    ("text", "pattern"),
    [
        ("you idiot", "insult target"),
        ("the idiot left", "insult"),
        ("an idiot, you", "insult target"),
        ("he is not an idiot", "not:insult"),
        ("she said he is an idiot", "told:insult"),
        ("i will kill you", "threat target"),
        ("i will kill time", "intent threat"),
        ("never hurt", "not:threat"),
        ("not a b c d idiot", "insult"),
        ("you. idiot", "insult"),
    ],
)
def test_clauses(grammar, text, pattern):
    assert dict(grammar.clauses(text)) == {pattern: 1}


def test_composition_is_one_after_the_other():
    r = random.Random(3)
    a, b, both = reading(), matching(), compose(reading(), matching())
    symbols = ["insult", "threat", "target", "negation", "report", "intent", "other"]
    for _ in range(300):
        x, y, z = a.start, b.start, both.start
        for s in (r.choice(symbols) for _ in range(12)):
            x, out, _ = a.step(x, s)
            y, _, _ = b.step(y, out)
            z, _, _ = both.step(z, s)
            assert z == f"{x}/{y}"


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, 0, 1.0, "x") for i, t in [*rows, (9001, None), (9002, ""), (9003, "clean the " * 60_000), (9003, "you idiot"), (None, "scum")]], "doc_id long, text string, toxic int, score double, predicted string").repartition(3)
    known = spark.createDataFrame([*labels, (1, 1, 7), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity(docs, known).collect()
    want = {i: t for i, _, t in labels}
    assert len(got) == len(rows) + 5
    out = [x for x in got if x.held_out and x.doc_id in want]
    assert len(out) > 150
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got)
    assert sum(x.predicted == want[x.doc_id] for x in out) / len(out) > 0.98
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got)
    assert [x.predicted for x in got if x.doc_id in (9001, 9002)] == [0, 0]
    assert sorted(x.predicted for x in got if x.doc_id == 9003) == [0, 1]


def test_copies_teach_no_words():
    r = random.Random(5)
    copy = " ".join(["uniqueword", *words(r, 50), "idiot"])
    g = learn([copy] * 40 + [" ".join(words(r, 60)) for _ in range(40)], [1] * 40 + [0] * 40)
    assert "uniqueword" not in g.words


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "fine")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {x.doc_id: x.predicted for x in toxicity(docs, none).collect()} == {1: 1, 2: 0}
    assert toxicity(docs.limit(0), none).collect() == []


@pytest.mark.parametrize(
    "text",
    ["You are an idiot.", "I will kill you", "Du bist ein Idiot.", "Ich werde dich töten!", "Tu es un imbécile.", "Je vais te tuer", "Eres un idiota.", "Ok. You are an idiot! Bye."],
)
def test_directed_harm_is_toxic_in_each_language(text):
    rows, labels = corpus()
    g = learn([t for _, t in rows], [y for _, _, y in labels])
    assert g.score(text) >= 0.7


@pytest.mark.parametrize("text", ["You are not an idiot.", "Du bist kein Idiot.", "Tu n'es pas un imbécile.", "No eres un idiota, dijo.", "She said he is an idiot.", "Er sagte, du bist ein Idiot.", "We beat the eggs.", ""])
def test_negated_and_reported_harm_is_not(text):
    rows, labels = corpus()
    g = learn([t for _, t in rows], [y for _, _, y in labels])
    assert g.score(text) < 0.7


def test_weights_stand_on_the_arcs():
    rows, labels = corpus()
    g = learn([t for _, t in rows], [y for _, _, y in labels])
    fitted = {out: w for _, out, w in g.machine.arcs.values() if w}
    assert set(fitted) == {p for p, w in g.weights.items() if w} and fitted == {p: w for p, w in g.weights.items() if w}
    assert fitted["insult"] > fitted.get("not:insult", 0) and len(set(fitted.values())) > 5
    # A score is the bias and the weights of the arcs taken.
    z = g.bias + fitted["insult"]
    assert abs(g.score("the idiot left") - 1 / (1 + 2.718281828459045**-z)) < 1e-9


def test_brute_force_of_the_query(spark):
    """Every row of the query against the grammar applied to each text on its own."""
    from tessella.llm.toxicity import Settings, sample

    rows, labels = corpus(seed=8, n=200)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    keep = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    texts, y = sample(docs, known, Settings())
    assert (texts, y) == ([t for i, t in rows if i in keep], [keep[i] for i, _ in rows if i in keep])
    g = learn(texts, y)
    assert {x.doc_id: x.score for x in toxicity(docs, known).collect()} == {i: g.score(t) for i, t in rows}
