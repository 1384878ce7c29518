import random
import re

import numpy as np

from strandloom.llm.leak import _minima, _windows, band_count, contained, leaks, minhashes, size_class
from strandloom.llm.words import Words, blocks, spaced


def words_of(t):
    return [w for w in re.split(r"[\W_]+", t.casefold()) if w]


def brute(docs, passages, run):
    found = set()
    for i, p in passages:
        pw = words_of(p or "")
        runs = {tuple(pw[k : k + run]) for k in range(len(pw) - run + 1)}
        for d, t in docs:
            dw = words_of(t or "")
            if any(tuple(dw[k : k + run]) in runs for k in range(len(dw) - run + 1)):
                found.add((d, i))
    return found


def test_hashes_depend_on_words_only():
    a, b = Words(spaced("The, Old_pier — at  É1 Ulm")), Words(spaced("xx the old pier at É1 ulm!"))
    assert list(a.spans(3)) == list(b.spans(3))[1:] and a.text(1, 3) == "old pier at"
    assert len(Words("")) == 0 and len(Words("").spans(1)) == 0 and len(minhashes(Words("a b"), 10, 5)) == 0
    assert len(set(Words(" ".join(f"w{i}" for i in range(5000))).spans(5).tolist())) == 4996


def test_blocks_lose_no_run():
    text = " ".join(f"w{i}" for i in range(1000))
    runs = {w.text(i, 10) for part in blocks(text, 9, 97) for w in [Words(part)] for i in range(len(w) - 9)}
    whole = Words(text)
    assert runs == {whole.text(i, 10) for i in range(991)}


def test_blocks_with_a_word_longer_than_a_block():
    for before in (0, 3, 8, 20):
        for long in (1, 2, 12):
            text = " ".join([f"a{i}" for i in range(before)] + ["x" * 120] * long + [f"w{i}" for i in range(500)])
            whole = Words(text)
            for overlap in (0, 9):
                runs = {w.text(i, overlap + 1) for part in blocks(text, overlap, 100) for w in [Words(part)] for i in range(len(w) - overlap)}
                assert runs == {whole.text(i, overlap + 1) for i in range(len(whole) - overlap)}


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(30)]
    passages = [(f"i{k}", " ".join(rng.choices(vocab, k=rng.randint(5, 40)))) for k in range(30)] + [("n", None), ("e", ""), ("short", "one two"), ("i0", "shared passage " * 8), ("i1", "shared passage " * 8)]
    docs = []
    for d in range(300):
        t = rng.choices(vocab, k=rng.randint(0, 60))
        p = words_of(rng.choice(passages)[1] or "")
        cut = rng.randint(8, 12)
        at = rng.randint(0, len(t))
        docs.append((d, rng.choice([" ", "-", ",\n"]).join(x.upper() if rng.random() < 0.2 else x for x in t[:at] + p[:cut] + t[at:])))
    docs += [(1000, None), (1001, ""), (1002, "SHARED passage, " * 5000), (1002, "SHARED passage, " * 5000)]
    dd = spark.createDataFrame([(*r, "x") for r in docs], "id long, text string, item string")
    pp = spark.createDataFrame([(*r, 1) for r in passages], "item string, passage string, doc int")
    want = brute(docs, passages, 10)
    assert len(want) > 50
    for bits in (1 << 26, 1 << 12):  # a filter with room, and one that is full and lets most windows through
        got = {(r.doc, r.item) for r in leaks(dd, "id", "text", pp, "item", "passage", filter_bits=bits).collect()}
        assert got == want
    assert leaks(dd.limit(0), "id", "text", pp, "item", "passage").count() == 0
    assert leaks(dd, "id", "text", pp.limit(0), "item", "passage").count() == 0


def test_minhash_is_one_of_the_window(spark):
    w = Words(" ".join(f"w{i}" for i in range(40)))
    m, s = minhashes(w, 10, 5), w.spans(5)
    assert all(m[i] == s[i : i + 6].min() for i in range(len(m))) and m.dtype == np.uint64


def test_windows_hold_every_run_of_their_class():
    g = np.arange(1000, dtype=np.uint64)[::-1].copy()
    of = np.repeat([0, 3, 4], [497, 3, 500])
    for size in (4, 16, 64):
        start, second, third, text = _windows(of, size)
        m = _minima(g, start, second, third)
        assert list(of[start]) == list(text)
        for i in range(1000):
            e = min(i + size, np.searchsorted(of, of[i], "right"))  # a run of the class's size, or to the end of its text
            k = np.flatnonzero((start <= i) & (text == of[i]))[-1]
            assert m[k] <= g[i:e].min() and m[k] >= g[of == of[i]].min()
    assert band_count(0.8) == 19 and [size_class(n) for n in (1, 4, 5, 8, 9, 100)] == [4, 4, 8, 8, 16, 128]


def shares(docs, passages, at, n=5):
    sets = lambda t: {tuple(w[i : i + n]) for w in [words_of(t or "")] for i in range(len(w) - n + 1)}
    out = {}
    for d, t in docs:
        s = sets(t)
        for i, p in passages:
            q = sets(p)
            if q and len(q & s) / len(q) >= at:
                out[d, i] = max(out.get((d, i), 0), len(q & s) / len(q))
    return out


def test_contained_with_changed_words(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    passages = [(f"i{k}", " ".join(word() for _ in range(rng.choice([5, 7, 12, 20, 45, 150, 300])))) for k in range(60)] + [("n", None), ("e", ""), ("s", "one two three four")]
    docs = []
    for d in range(400):
        p = words_of(rng.choice(passages)[1] or "")
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            if p:
                p[rng.randrange(len(p))] = word()
        before = [word() for _ in range(rng.choice([0, 3, 400]))]
        docs.append((d, " ".join([*before, *p, *(word() for _ in range(rng.choice([0, 50])))])))
    docs += [(900, None), (901, ""), (902, " ".join(word() for _ in range(200_000)) + " " + passages[0][1])]
    dd = spark.createDataFrame([(*r, "x") for r in docs + docs[:3]], "id long, text string, item string")
    pp = spark.createDataFrame([(*r, 1) for r in passages], "item string, passage string, doc int")
    want = shares(docs, passages, 0.8)
    assert any(x < 1 for x in want.values()) and len(want) > 150
    got = {(r.doc, r.item): r.containment for r in contained(dd, "id", "text", pp, "item", "passage").collect()}
    assert set(got) <= set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert len(got) >= 0.995 * len(want)
    assert contained(dd.limit(0), "id", "text", pp, "item", "passage").count() == 0
    assert contained(dd, "id", "text", pp.limit(0), "item", "passage").count() == 0
