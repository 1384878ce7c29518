import random

import numpy as np
import pytest

from strandloom.llm.pairs import NO, NONE, YES, em, grams_of, label_pairs, language, look_up, unwrap, votes


@pytest.mark.parametrize("answer", [None, "", " \t", "—", "**", "...", "Answer: ", '{"answer": ""}', "[]", "{}", "<answer></answer>", "```json\n{}\n```", "​", '""', "null"])
def test_nothing_inside(answer):
    assert unwrap(answer) == ""
    assert votes("Who?", "c", answer)["empty"] == [YES, NONE]


def test_unwrap_and_language():
    assert unwrap('{"answer": "Ulm"}') == "Ulm" and unwrap("Final answer: 1901") == "1901" and unwrap("```\nUlm\n```") == "Ulm"
    assert unwrap('{"answer": "The clock was ma') == "The clock was ma"
    assert language("Das Stück gehört dem Museum und steht in Ulm.")[0] == "de"
    assert language("La pièce est au musée de la ville.")[0] == "fr"
    assert language("Эта вещь в музее.")[0] == "ru"
    assert language("Stoar Woabas (musée Ulm)")[0] is None and language("1901")[0] is None


def test_em_recovers_rates():
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.1
    v = np.stack([np.where(rng.random(20000) < a, np.where(y, YES, NO), np.where(y, NO, YES)) for a in (0.95, 0.9, 0.85)], axis=1)
    v[rng.random(v.shape) < 0.2] = NONE
    pats, inverse, n = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    post, info = em(pats.tolist(), n.tolist())
    assert np.mean((post[inverse.ravel()] > 0.5) == y) > 0.95
    assert em([], [])[0].size == 0


@pytest.fixture(scope="module")
def planted():
    """Pairs with a known defect: what the cutoffs are validated on."""
    rng = random.Random(1)
    first, last = ["Arno", "Berta", "Celio", "Dorin", "Elisa", "Fabro"], ["Kestel", "Lomanik", "Marwold", "Norgrem", "Ostrand", "Pelwick"]
    town = ["Astford", "Belmoor", "Cornhaven", "Dunquay", "Eastholm", "Farwick"]
    rows = []
    for i in range(1500):
        who, where, thing = f"{rng.choice(first)} {rng.choice(last)}", rng.choice(town), rng.choice(["clock", "map", "bell", "lamp"])
        q = f"Who made the {thing} that is kept in the town hall of {where}?"
        c = f"The {thing} of {where} was made by {who} in {rng.randint(1700, 1990)}. The hall of {where} keeps it."
        good = [who, f"The {thing} was made by {who}.", f"It was made by {who}", f"Answer: {who}", '{"answer": "%s"}' % who, f"I do not know the year, but the maker was {who}.", f"{q} {who}"]
        bad = {
            "empty": ["", None, "Answer:", "{}", "-"],
            "refusal": ["I am sorry, but the context does not mention it.", "The answer cannot be determined from the passages.", "I do not know."],
            "copied_question": [q, q.lower(), f"You asked «{q}».", q.rstrip("?")],
            "other_language": [f"Elle a été fabriquée par {who} dans la ville de {where}.", f"Es wurde von {who} für die Stadt {where} gefertigt.", f"La pieza fue hecha por {who} y está en la ciudad."],
            "truncated": [f"The {thing} was made by", f"The {thing} was made by {who[: rng.randint(1, 3)]}", '{"answer": "The ' + thing + " was ma", f"It was made by {who}, who is the", f"The {thing} was made ("],
        }
        d = rng.choice([*bad]) if rng.random() < 0.25 else None
        rows.append((i, q, c, rng.choice(bad[d] if d else good), d))
    return rows


def test_operator_on_planted_defects(spark, planted):
    df = spark.createDataFrame([(*r[:4], "x") for r in planted], "id long, query string, context string, answer string, defect string")
    got = label_pairs(df, ["id"]).toPandas()
    best = got.sort_values("posterior").drop_duplicates("id", keep="last").set_index("id").defect.to_dict()
    for d in ("empty", "refusal", "copied_question", "other_language", "truncated"):
        want = {r[0] for r in planted if r[4] == d}
        have = {i for i, x in best.items() if x == d}
        assert len(want & have) >= 0.85 * len(want), d
        assert len(want & have) >= 0.9 * len(have), d


def test_edge_cases(spark):
    rows = [(1, None, None, None), (2, "", "", ""), (3, "Who?", "c", "word " * 20000), (3, "Who?", "c", "word " * 20000)]
    df = spark.createDataFrame(rows, "id long, query string, context string, answer string")
    got = {(r.id, r.defect) for r in label_pairs(df, ["id"]).collect()}
    assert {(1, "empty"), (2, "empty")} <= got
    assert label_pairs(df.limit(0), ["id"]).count() == 0


def test_keys_do_not_depend_on_the_length_of_a_word():
    keys, ends, gram, word, numeral = grams_of("It is " + "x" * 30_000)
    assert len(keys) == len(ends) == 5 and gram == keys[2] and ends[2] and not numeral
    assert word not in keys  # the last word is not among the words that answers go on from
    assert grams_of(None) == ([], [], None, None, False) and grams_of("Ulm 1901")[4]


def test_look_up_with_a_key_of_a_third_of_all_rows(spark):
    rows = [(i, None if i % 3 == 0 else 7 if i % 3 == 1 else i) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, key_ long")
    stats = spark.createDataFrame([(7, 5000, 3)] + [(k, 1, 0) for k in range(100, 800)], "key long, n long, ends long")
    got = {r.id: (r.n, r.ends) for r in look_up(df, "key_", stats, "n", ["id"]).collect()}
    assert got == {i: (None, None) if k is None else (5000, 3) if k == 7 else (1, 0) if 100 <= k < 800 else (None, None) for i, k in rows}
    assert look_up(df, "key_", stats.limit(0), "n", ["id"]).count() == 900


def test_query_language_of_questions():
    assert language("En quelle année Arno a-t-il terminé la lampe ?")[0] == "fr"
    assert language("Wohin muss man reisen, um die Uhr zu sehen?")[0] == "de"
