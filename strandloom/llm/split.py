"""Oversized texts cut into overlapping pieces at natural boundaries, with balanced targets.

The least number of pieces is computed, equal-length targets are placed, and each cut snaps to the strongest boundary near
its target. If a cut finds no natural boundary, or a piece breaks the limit, more pieces are tried; the attempt with the
fewest unnatural cuts, then the fewest pieces, is kept. Texts are independent, so there is no shuffle besides the one that
drops repeated rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Boundary strengths. Those from LINE up are natural.
HARD, WORD, CLAUSE, LINE, SENTENCE, PARAGRAPH = range(6)
_NATURAL = (
    (re.compile(r"\n[ \t\r]*\n\s*|\f"), PARAGRAPH),
    (re.compile(r"[.!?\u2026\u061f\u0964][\"'\u201d\u2019\u00bb)\]]*(?:\s+|$)|[\u3002\uff01\uff1f]"), SENTENCE),
    (re.compile(r"\r\n|[\n\r\u2028\u2029]"), LINE),
)
_WEAK = ((re.compile(r"[,;:\u2013\u2014|][ \t]+|[\u3001\uff0c\uff1b]"), CLAUSE), (re.compile(r"\s+"), WORD))


def boundaries(text: str, kinds=_NATURAL) -> list[tuple[int, int]]:
    """(position, strength) of every place after which ``text`` may be cut, in order, each with its strongest kind."""
    found: dict[int, int] = {}
    for pattern, strength in kinds:
        for m in pattern.finditer(text):
            if 0 < m.end() < len(text):
                found[m.end()] = max(strength, found.get(m.end(), 0))
    return sorted(found.items())


def _balanced(size: int, n: int, limit: int, overlap: int, at: list[int], strength: list[int], fallback) -> tuple[list[int], int]:
    """``n - 1`` cuts and how many of them are unnatural; each leaves the rest feasible in the pieces left."""
    step = (size - overlap) / n
    slack = max(1.0, (limit - overlap) / 4)
    cuts: list[int] = []
    weak, last = 0, overlap
    for k in range(1, n):
        low = max(last + 1, size - (n - k) * (limit - overlap))
        high = min(last + limit - overlap, size - 1)
        if low > high:
            return cuts, size
        target = min(max(overlap + k * step, low), high)
        best = None
        for lo, hi in ((max(low, target - slack), min(high, target + slack)), (low, high)):
            i, j = bisect_left(at, lo), bisect_right(at, hi)
            if i < j:
                best = max(range(i, j), key=lambda q: (strength[q], -abs(at[q] - target), -at[q]))
                break
        if best is None:
            weak += 1
            cuts.append(fallback(int(low), int(high), target))
        else:
            cuts.append(at[best])
        last = cuts[-1]
    return cuts, weak


def _greedy(size: int, limit: int, overlap: int, at: list[int], fallback) -> tuple[list[int], int]:
    """Each cut at the last natural boundary in reach: as few unnatural cuts as any plan can have."""
    cuts: list[int] = []
    weak, last = 0, overlap
    while size - (last - overlap) > limit:
        high = last + limit - overlap
        i = bisect_right(at, high) - 1
        if i >= 0 and at[i] > last:
            cuts.append(at[i])
        else:
            weak += 1
            cuts.append(fallback(last + 1, high, high))
        last = cuts[-1]
    return cuts, weak


def cut(text: str, limit: int = 1000, overlap: int = 100) -> list[tuple[int, int]]:
    """The (start, end) of the pieces of ``text``: each at most ``limit`` code points, consecutive ones sharing ``overlap``.

    A text within the limit is one piece, an empty one none. Without overlap the pieces join to the text again.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than the limit")
    size = len(text)
    if size <= limit:
        return [(0, size)] if size else []
    marks = boundaries(text)
    at, strength = [p for p, _ in marks], [s for _, s in marks]
    weaker: list[list[int]] = []

    def fallback(low: int, high: int, target: float) -> int:
        if not weaker:
            found = boundaries(text, _WEAK)
            weaker.extend([[p for p, s in found if s == kind] for kind in (CLAUSE, WORD)])
        for places in weaker:
            i, j = bisect_left(places, low), bisect_right(places, high)
            if i < j:
                return min(places[i:j], key=lambda p: (abs(p - target), p))
        p = min(max(round(target), low), high)
        while p > low and unicodedata.combining(text[p]):  # not between a letter and its marks
            p -= 1
        return p

    least = -(-(size - overlap) // (limit - overlap))
    cuts, weak = _balanced(size, least, limit, overlap, at, strength, fallback)
    if weak:
        floor_cuts, floor = _greedy(size, limit, overlap, at, fallback)
        for n in range(least + 1, max(least + 1, len(floor_cuts) + 2)):
            if weak <= floor:
                break
            other, w = _balanced(size, n, limit, overlap, at, strength, fallback)
            if w < weak:
                cuts, weak = other, w
        if floor < weak:
            cuts = floor_cuts
    ends = [*cuts, size]
    return [(0 if k == 0 else ends[k - 1] - overlap, e) for k, e in enumerate(ends)]


def joined_sentences(value: str | None) -> str | None:
    """The text of a JSON array of strings, joined without a separator; None if it cannot be read as one.

    Lone surrogates, which no text file can hold, become the replacement character.
    """
    try:
        x = json.loads(value)
    except (TypeError, ValueError, RecursionError):
        return None
    if not isinstance(x, list) or not all(isinstance(s, str) for s in x):
        return None
    return "".join(x).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


PIECES = T.StructType(
    [
        T.StructField("item_table", T.StringType()),
        T.StructField("item_key", T.StringType()),
        T.StructField("text_hash", T.LongType()),
        T.StructField("piece_no", T.IntegerType()),
        T.StructField("n_pieces", T.IntegerType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("piece", T.StringType()),
    ]
)


def split_oversized(items: DataFrame, limit: int = 1000, overlap: int = 100) -> DataFrame:
    """Pieces of the texts above ``limit`` in ``items(item_table, item_key, raw, is_json)``.

    ``raw`` is the text, or with ``is_json`` a JSON array of strings. Repeated rows count once; a key with several texts
    has pieces of each, told apart by ``text_hash``. Null, empty, unreadable and short texts give no rows. Other columns
    are ignored.
    """
    # A JSON array is longer than its text, so short raw values are dropped in the scan already.
    long = items.select("item_table", "item_key", "raw", "is_json").where(F.length("raw") > limit).dropDuplicates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for t, k, raw, is_json, h in zip(*(c.to_pylist() for c in b.columns)):
                text = joined_sentences(raw) if is_json else raw
                if text is None or len(text) <= limit:
                    continue
                spans = cut(text, limit, overlap)
                rows += [(t, k, h, i + 1, len(spans), s, text[s:e]) for i, (s, e) in enumerate(spans)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, p) for c, p in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=PIECES.names)

    return long.withColumn("h", F.xxhash64("raw")).mapInArrow(run, PIECES)
