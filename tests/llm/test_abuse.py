import random
import re

import numpy as np
import pytest

from strandloom.llm import abuse
from strandloom.llm.abuse import bags, features, fit, normalise, scan, score, train, worst_sentences
from strandloom.llm.q_abuse import model
from strandloom.llm.words import Words


def by_text(texts):
    """The sentences of each text, by the scan."""
    words, of, text = scan(texts)
    parts = [[] for _ in text]
    for s, w in zip(of, words.split(" ")):
        parts[s].append(w)
    out = [[] for _ in texts]
    for p, t in zip(parts, text):
        out[t].append(" ".join(p))
    return out


def plainly(text):
    """The same, a sentence at a time with regular expressions."""
    found = (" ".join(abuse._TOKEN.findall(s)) for s in re.split(r"(?<=[.!?…])[\"'”’»)\]]*\s+|\n\s*\n", normalise(text)))
    return [s for s in found if s]


def test_disguises_are_undone():
    for text, word in (("you are a v3rm1n", "vermin"), ("this p i g of a man", "pig"), ("b.a.s.t.a.r.d", "bastard"), ("shiiiit", "shit"), ("nu​de", "nude"), ("pl@g@", "plaga"), ("U***r", "xmaskx"), ("s****d", "xmaskx"), ("caf&eacute;", "café"), ("va-\nn", "van"), ("gagnÃ©", "gagné")):
        assert word in normalise(text).split(), text
        assert word in by_text(["Before. ", text, "After."])[1][0].split(), text
    assert normalise("**bold** text in 1999!") == "**bold** text in 0!"
    assert by_text(["", " .!? ", "A b. C d!", "\n\n", "e"]) == [[], [], ["a b", "c d"], [], ["e"]]


def test_scan_equals_the_expressions():
    rng = random.Random(3)
    pieces = ["The", "clock", "of 1999", "b.a.d", "shiiit", "n0w", "*", "s***d", "It’s", "(so.)", "«yes.» ", "!", "?", "...", ". ", "\n", "\n \n", " ", "\t", "É", "ﬁn", "日本", "²", "x_y", "va-\nn", "1st", "12", "-"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts = [t for t in texts if not re.search(r"[.!?…]\S*\*", t)]  # undoing a mask there would open a sentence
    assert len(texts) > 100
    assert by_text(texts) == [plainly(t) for t in texts]


def test_features_stay_in_their_sentence():
    words, of, text = scan(["Aa bb cc dd. Xx. Aa bb cc dd."])
    found = list(features(words, of))
    part, slot = np.concatenate([s for s, _ in found]), np.concatenate([x for _, x in found])
    assert set(slot[part == 0]) == set(slot[part == 2]) and (part == 1).sum() == 1
    assert (part == 0).sum() == 4 + 3 + 2 + 2 + 1
    assert [[len(b) for b in x] for x in bags(["Aa bb cc dd. Xx.", "", "xx"])] == [[12, 1], [], [1]]
    assert len(Words("a b c d")) == 4


@pytest.fixture(scope="module")
def data():
    rng = random.Random(4)
    bad = ["you are a filthy {} and should leave", "shut up you stupid {}", "i will break your {} tomorrow"]
    good = ["the {} opens on sunday at noon", "visitors may see the {} in the hall", "a storm broke the {} of the pier"]
    nouns = [f"noun{i}" for i in range(40)]
    rows = []
    for _ in range(1200):
        y = rng.random() < 0.4
        parts = [rng.choice(good).format(rng.choice(nouns)) + "." for _ in range(rng.randint(0 if y else 1, 2))]
        if y:
            parts.insert(rng.randint(0, len(parts)), rng.choice(bad).format(rng.choice(nouns)) + ".")
        rows.append((" ".join(parts), y != (rng.random() < 0.05), y))
    return rows


def test_held_out_accuracy_with_noisy_labels(data):
    m = fit([t for t, _, _ in data[:800]], [y for _, y, _ in data[:800]])
    top, _, _ = worst_sentences([t for t, _, _ in data[800:]], m.dense(), m.bias)
    assert np.mean((top >= 0.5) == [y for _, _, y in data[800:]]) > 0.97
    assert len(m.slots) < 20_000  # L1 keeps it compact
    assert worst_sentences(["Qwerty asdf."], m.dense(), m.bias)[0][0] < 0.5  # unknown words are no evidence


def test_operator(spark, data):
    labels = spark.createDataFrame([(t, "abusive" if y else "none", 1) for t, y, _ in data] + [(None, "none", 1), ("x", None, 1), ("bad " * 5000, "abusive", 1)], "excerpt string, label string, score int")
    m = train(labels, "excerpt", "label")
    long = "the hall opens on sunday. " * 60000
    docs = spark.createDataFrame([(1, "You are a F1lthy noun3 and should leave!", 0), (2, "The noun1 opens on sunday at noon.", 0), (3, None, 0), (4, "", 0), (5, long + "shut up you s t u p i d noun2.", 0), (6, long, 0), (2, "The noun1 opens on sunday at noon.", 0)], "id long, text string, score int")
    got = score(docs, "id", "text", m).toPandas().sort_values("id")
    assert list(got.id) == [1, 2, 2, 3, 4, 5, 6]
    assert [x >= 0.5 for x in got.score] == [True, False, False, False, False, True, False]
    assert list(got.sentences) == [1, 1, 1, 0, 0, 60001, 60000] and got.flagged.iloc[5] == 1
    assert score(docs.limit(0), "id", "text", m).count() == 0
    assert train(labels.limit(0), "excerpt", "label").weights.size == 0


def test_documents_do_not_train(spark, data, tmp_path):
    found = []
    for n, text in ((1, "The hall opens on sunday."), (40, "You are a filthy noun1 and should leave, noun2 said. Visitors may see the pier.")):
        sf = f"{tmp_path}/{n}"
        spark.createDataFrame([(t, "abusive" if y else "none") for t, y, _ in data[:200]], "excerpt string, label string").write.parquet(f"{sf}/review_labels.parquet")
        spark.createDataFrame([(i, f"{text} {i}") for i in range(n)], "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
        found.append(model(spark, sf))
    a, b = found
    assert np.array_equal(a.slots, b.slots) and np.array_equal(a.weights, b.weights) and a.bias == b.bias
