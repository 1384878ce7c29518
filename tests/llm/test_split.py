import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm.split import cut, joined_sentences, split_oversized


def check(text, limit, overlap):
    spans = cut(text, limit, overlap)
    if not text:
        assert spans == []
        return spans
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (s, e), (t, f) in zip(spans, spans[1:]):
        assert t == e - overlap and f > e
    assert all(0 < e - s <= limit for s, e in spans)
    joined = text[: spans[0][1]] + "".join(text[e - (e - s - overlap) : e] for s, e in spans[1:])
    assert joined == text  # exact round trip
    return spans


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n,é́\U0001f600", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_round_trip(text, limit, overlap):
    check(text, limit, overlap)


def test_cuts_at_sentences_when_possible():
    rng = random.Random(3)
    for _ in range(100):
        text = "".join("w" * rng.randint(20, 300) + ". " for _ in range(rng.randint(5, 40)))
        for _, e in check(text, 1000, 100)[:-1]:
            assert text[e - 2 : e] == ". "


def test_long_sentence_falls_back_to_words_then_hard():
    spans = check("word " * 500, 1000, 100)
    assert all(("word " * 500)[e - 1] == " " for _, e in spans[:-1])
    assert len(check("x" * 1901, 1000, 100)) == 3 and len(check("x" * 1900, 1000, 100)) == 2


def test_balanced_targets():
    lengths = [e - s for s, e in check("abcdefgh. " * 200, 1000, 100)]
    assert max(lengths) - min(lengths) <= 20


def test_sentences_value():
    assert joined_sentences('["a", " b\\u00e9"]') == "a bé"
    for bad in (None, "", "null", '["a"', '["a", 1]', '{"a": "b"}', "x", '["a", null]'):
        assert joined_sentences(bad) is None
    assert joined_sentences("[]") == ""
    assert joined_sentences('["\\ud800"]') == "�"


def test_operator(spark):
    long = "A sentence here. " * 100
    rows = [("p", "k1", json.dumps([long]), True), ("p", "k1", json.dumps([long]), True), ("p", "k2", "[broken " + long, True), ("m", "k1", long, False), ("m", None, long, False), ("m", "s", "short", False), ("m", "n", None, False), ("m", "e", "", False)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "item_table string, item_key string, raw string, is_json boolean, piece string")
    got = split_oversized(df).collect()
    assert {(r.item_table, r.item_key) for r in got} == {("p", "k1"), ("m", "k1"), ("m", None)}
    assert len(got) == 3 * got[0].n_pieces and max(len(r.piece) for r in got) <= 1000
    assert split_oversized(df.limit(0)).count() == 0
