"""Scores for abusive, hateful and sexual language by FTRL-proximal logistic regression over hashed word n-grams.

Texts are normalised (entities, invisible characters, look-alike digits, spelled-out and stretched words, masked letters),
cut into sentences, and each sentence is its words' 1- to 3-grams and skip-grams, hashed. The model is trained on a bounded
sample of labelled excerpts and on nothing else; L1 keeps the weights few, and they are broadcast as two short arrays. A
document scores as its worst sentence, so length does not dilute it.

A score above one half says that a sentence holds evidence: the intercept, which only tells how many excerpts were labelled,
is replaced by ``-EVIDENCE``, so a sentence of unknown words scores just below. Features are dropped at random in training,
up to half of them where the label is bad and up to all where it is not, so that no single wording carries the decision.

Texts are scanned in numpy, many at a time; only sentences that look disguised go through regular expressions.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.words import Words, mix

BITS = 22
#: The labelled sample: at most so many rows, those with the smallest hash of their text, of excerpts of at most so many characters.
TRAIN_ROWS, EXCERPT_CHARS = 20_000, 2_000
#: Log-odds that a sentence needs from its words before it scores one half.
EVIDENCE = 0.1
#: Characters that are scanned at once.
CHUNK = 1 << 20

_INVISIBLE = re.compile("[\\u00ad\\u200b-\\u200f\\u2060\\ufeff]")
_WRAP = re.compile(r"(?<=[^\W\d_])-\r?\n(?=[^\W\d_])")
_SPELLED = re.compile(r"(?<![\w.*])([^\W\d_])([ .\-_*])(?:[^\W\d_]\2){1,}[^\W\d_](?![\w*])")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
_MASK = re.compile(r"(?<![\w*])[^\W\d_]\*{2,}[^\W\d_]*(?![\w*])|(?<![\w*])[^\W\d_]+\*{1,}[^\W\d_]+(?![\w*])")
_LEET_NEAR = re.compile(r"[^\W\d_][\d@$]|[\d@$][^\W\d_]|[^\W\d_]![^\W\d_]")
_LEET_WORD = re.compile(r"[\w@$]+(?:![^\W\d_][\w@$]*)*")
_LEET = str.maketrans("013457@$!", "oieastasi")
_NUMBER = re.compile(r"\d+")
_TOKEN = re.compile(r"[^\W_]+")
_MOJIBAKE = re.compile("[ÂÃ][\u0080-¿]")


def _decoded(text: str) -> str:
    """Without entities, bytes read in a wrong encoding and invisible characters; compatible characters alike, folded case."""
    t = html.unescape(text) if "&" in text else text
    if "Ã" in t:  # UTF-8 read as a one-byte encoding
        try:
            t = t.encode("cp1252").decode("utf-8")
        except (UnicodeDecodeError, UnicodeEncodeError):
            t = _MOJIBAKE.sub(lambda m: m[0].encode("latin-1").decode("utf-8"), t)
    if not t.isascii():
        t = unicodedata.normalize("NFKC", _INVISIBLE.sub("", t))
    return t.casefold()


def _undisguised(t: str) -> str:
    """Decoded text with spelled-out, masked, stretched and digit-written words in plain form, and numbers as ``0``."""
    t = _SPELLED.sub(lambda m: m[0].replace(m[2], ""), _WRAP.sub("", t))
    if "*" in t:
        t = _MASK.sub(" xmaskx ", t)
    if _LEET_NEAR.search(t):
        t = _LEET_WORD.sub(lambda m: m[0].translate(_LEET) if _LEET_NEAR.search(m[0]) else m[0], t)
    return _NUMBER.sub("0", _STRETCH.sub(r"\1", t))


def normalise(text: str) -> str:
    """Lower case text with disguises undone; masked words become ``xmaskx`` and numbers ``0``."""
    return _undisguised(_decoded(text))


_LETTER, _DIGIT, _BLANK, _LINE, _STOP, _CLOSE, _SIGN, _BANG, _DASH, _STAR = (1 << i for i in range(10))


def _distinct(parts: Sequence[np.ndarray]) -> np.ndarray:
    """The distinct values in ascending order (numpy's own function hashes, which is slower here)."""
    x = np.sort(np.concatenate(parts))
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


@cache
def _classes() -> np.ndarray:
    """What each code point is, as bits."""
    kind = np.zeros(0x110000, np.uint16)
    for c in map(chr, range(0x110000)):
        if c.isalnum():
            kind[ord(c)] = _LETTER if _TOKEN.fullmatch(c) and not c.isdecimal() else _DIGIT if c.isdecimal() else 0
        elif c.isspace():
            kind[ord(c)] = _BLANK
    for chars, bit in (("\n", _LINE), (".!?…", _STOP), ("\"'”’»)]", _CLOSE), ("@$", _SIGN), ("!", _BANG), ("-", _DASH), ("*", _STAR)):
        for c in chars:
            kind[ord(c)] |= bit
    return kind


def scan(texts: Sequence[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """(words, sentence, text): all words of all sentences with single spaces, the sentence of each word, the text of each
    sentence. A sentence ends at white space after a stop and at an empty line; those without a word do not count."""
    decoded = [_decoded(t) for t in texts]
    whole = "\n\n".join(decoded) + "\n\n"
    code = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
    kind = _classes()[code]
    n = len(code)
    letter, digit, blank = (kind & _LETTER) > 0, (kind & _DIGIT) > 0, (kind & _BLANK) > 0
    word = letter | digit
    # Runs of white space; one ends a sentence if two line feeds are in it or a stop comes before it, closing marks aside.
    first = blank.copy()
    first[1:] &= ~blank[:-1]
    run = np.flatnonzero(first)
    lines = np.add.reduceat((kind & _LINE) > 0, run, dtype=np.int64)
    before = np.maximum.accumulate(np.where((kind & _CLOSE) > 0, 0, np.arange(n)))[np.maximum(run - 1, 0)]
    cut = run[(lines > 1) | ((kind[before] & _STOP) > 0)]
    # Where a disguise may be: neighbouring letters and signs of a few forms.
    at = lambda m, k: np.concatenate([m[k:], np.zeros(k, bool)])
    odd = (letter & at(digit | ((kind & _SIGN) > 0), 1)) | ((digit | ((kind & _SIGN) > 0)) & at(letter, 1)) | ((kind & _STAR) > 0)
    odd |= letter & at((kind & _BANG) > 0, 1) & at(letter, 2) | letter & at((kind & _DASH) > 0, 1) & at(blank, 2)
    same = np.zeros(n, bool)
    same[:-1] = letter[:-1] & (code[:-1] == code[1:])
    odd |= same & at(same, 1)
    lone = letter.copy()
    lone[1:] &= ~word[:-1]
    lone &= ~at(word, 1)
    odd |= lone & at(lone, 2)
    owner = np.zeros(n, np.int64)
    owner[cut] = 1
    sentence = np.cumsum(owner)  # of each character
    doubt = np.zeros(len(cut) + 1, bool)
    doubt[sentence[odd]] = True
    start, end = np.concatenate([[0], cut]), np.concatenate([cut, [n]])
    # The text of a sentence is where its first word is; the white space before that may be the text's before.
    bound = np.cumsum([len(t) + 2 for t in decoded])
    places = np.concatenate([np.flatnonzero(word), [n - 1]])
    text = np.searchsorted(bound[:-1], places[np.searchsorted(places[:-1], start)], "right")
    # Plain sentences: letters stay, a run of digits is one 0, and a space goes before each word.
    keep = word & ~doubt[sentence]
    keep[1:] &= ~(digit[1:] & digit[:-1])
    opens = keep.copy()
    opens[1:] &= ~word[:-1]
    of = sentence[opens]
    place = np.arange(np.count_nonzero(keep)) + np.cumsum(opens[keep])
    chars = np.full(len(place) + len(of), 32, np.uint32)
    chars[place] = np.where(digit, 48, code)[keep]
    plain = chars[1:].astype("<u4").tobytes().decode("utf-32-le", "replace")
    spelled, extra = [], []
    for s in np.flatnonzero(doubt):
        found = _TOKEN.findall(_undisguised(whole[start[s] : end[s]]))
        spelled += found
        extra += [s] * len(found)
    words = " ".join(x for x in (plain, " ".join(spelled)) if x)
    of = np.concatenate([of, np.array(extra, np.int64)])
    used, of = np.unique(of, return_inverse=True)
    return words, of.astype(np.int64), text[used]


def features(words: str, of: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sentence, slot) of the single words, 2- and 3-grams, and pairs with one or two words between, in turn."""
    h = Words(words).spans(1)
    n = len(h)
    slot = lambda x: (x >> np.uint64(64 - bits)).astype(np.int64)
    yield of, slot(h)
    for offsets, salt in (((1,), 3), ((1, 2), 5), ((2,), 7), ((3,), 11)):
        m = n - offsets[-1]
        if m <= 0:
            continue
        x = h[:m] * np.uint64(salt)
        for o in offsets:
            x = mix(x + h[o : o + m] * np.uint64(2 * o + salt))
        whole = of[:m] == of[offsets[-1] :]
        yield of[:m][whole], slot(x[whole])


def bags(texts: Sequence[str], bits: int = BITS) -> list[list[np.ndarray]]:
    """The slots of each sentence of each text, each once a sentence."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    if not texts:
        return out
    words, of, text = scan(texts)
    if not words:
        return out
    key = _distinct([(s << bits) | x for s, x in features(words, of, bits)])
    for t, slots in zip(text, np.split(key & ((1 << bits) - 1), np.searchsorted(key >> bits, np.arange(1, len(text))))):
        out[t].append(slots)
    return out


@dataclass
class Model:
    """Sparse weights by slot, and the intercept."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float32)
        w[self.slots] = self.weights
        return w


class Ftrl:
    """FTRL-proximal with a rate per coordinate (McMahan et al. 2013)."""

    def __init__(self, bits: int = BITS, alpha: float = 0.02, beta: float = 1.0, l1: float = 0.1, l2: float = 0.1):
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def margin(self, slots: np.ndarray) -> float:
        return float(self.weights(slots).sum())

    def step(self, slots: np.ndarray, y: float) -> None:
        i = np.append(slots, 1 << self.bits)
        z, n = self.z[i], self.n[i]
        root = np.sqrt(n)
        w = np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + root) / self.alpha + self.l2))
        g = 1 / (1 + math.exp(-min(30.0, max(-30.0, w.sum())))) - y
        if abs(g) < 1e-4:  # nothing to learn
            return
        self.z[i] = z + g - (np.sqrt(n + g * g) - root) / self.alpha * w
        self.n[i] = n + g * g

    def model(self, bias: float) -> Model:
        used = np.flatnonzero(self.n[:-1])
        w = self.weights(used)
        keep = w != 0
        return Model(used[keep], w[keep].astype(np.float32), bias, self.bits)


def fit(excerpts: Sequence[str], labels: Sequence[bool], *, passes: int = 8, seed: int = 1, drop: tuple[float, float] = (0.5, 1.0), **params) -> Model:
    """A sentence model from labelled excerpts of which one sentence makes the label.

    First every sentence gets its excerpt's label; then, in each pass, a positive excerpt teaches its worst sentence as
    positive and the others as negative. Negative excerpts teach all their sentences as negative. ``drop`` are the largest
    shares of features left out at a step, for positive and negative sentences.
    """
    f = Ftrl(**params)
    held = [(b, bool(y)) for b, y in zip(bags(excerpts, f.bits), labels)]
    rng = np.random.default_rng(seed)
    for k in range(passes):
        for j in rng.permutation(len(held)):
            bag, y = held[j]
            worst = max(range(len(bag)), key=lambda q: f.margin(bag[q]), default=None) if y and k else None
            for q, slots in enumerate(bag):
                bad = y and (worst is None or q == worst)
                f.step(slots[rng.random(len(slots)) >= rng.random() * drop[0 if bad else 1]], float(bad))
    return f.model(-EVIDENCE)


def worst_sentences(texts: Sequence[str], dense: np.ndarray, bias: float, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score of the worst sentence, sentences, sentences of one half and more) of each text."""
    top, many, bad = np.zeros(len(texts)), np.zeros(len(texts), np.int32), np.zeros(len(texts), np.int32)
    words, of, text = scan(texts) if len(texts) else ("", np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not words:
        return top, many, bad
    known = []
    for s, x in features(words, of, bits):
        some = dense[x] != 0
        known.append((s[some] << bits) | x[some])
    key = _distinct(known)
    margin = np.bincount(key >> bits, weights=dense[key & ((1 << bits) - 1)], minlength=len(text)) + bias
    p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
    np.maximum.at(top, text, p)
    np.add.at(many, text, 1)
    np.add.at(bad, text, (p >= 0.5).astype(np.int32))
    return top, many, bad


def score(docs: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, score, sentences, flagged): a document's worst sentence; null and empty texts score 0 with no sentences.

    One row per input row; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.DoubleType()), T.StructField("sentences", T.IntegerType()), T.StructField("flagged", T.IntegerType())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        dense = m.dense()
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64) // CHUNK  # about a chunk of characters at a time
            parts = [worst_sentences([texts[i] for i in np.flatnonzero(ends == e)], dense, m.bias, m.bits) for e in np.unique(ends)]
            if parts:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.concatenate(c)) for c in zip(*parts))], names=schema.names)

    return docs.select(key, text).mapInArrow(go, schema)


def train(labelled: DataFrame, excerpt: str, label: str, neutral: str = "none", *, rows: int = TRAIN_ROWS, chars: int = EXCERPT_CHARS, **params) -> Model:
    """Fit on at most ``rows`` labelled excerpts of at most ``chars`` characters.

    Null labels and excerpts are left out; an excerpt that repeats counts once, with its most frequent label. The sample
    takes the texts with the smallest hashes, so it does not depend on partitions.
    """
    votes = labelled.where(F.col(label).isNotNull() & (F.length(excerpt) <= chars)).groupBy(excerpt).agg(F.avg((F.col(label) != neutral).cast("double")).alias("y"))
    sample = votes.orderBy(F.xxhash64(excerpt), excerpt).limit(rows).collect()
    return fit([r[excerpt] for r in sample], [r["y"] >= 0.5 for r in sample], **params)
