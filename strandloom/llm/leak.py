"""Test passages inside a corpus: size-partitioned MinHash containment search, then exact shingle containment.

A short passage inside a long document has a tiny Jaccard similarity, and MinHash loses it; so only sets of like size are
compared. Passages are partitioned by the number of their word shingles into classes of powers of two, and for each class a
document is a row of overlapping windows of one and a half times the class size: wherever a passage lies, a window holds it.
The Jaccard similarity of a window and a passage that it contains to ``threshold`` is then bounded from below, and the number
of MinHash bands (of one value each) follows from it. Band values of passages make a Bloom filter of bounded size, which is
broadcast; a document streams once past it, and only windows that hit it leave the task, to be joined with the passages and
verified by their shingles (:func:`contained`).

``leaks`` looks for runs of ``run`` words anywhere in a passage. Passages and documents are cut into all their windows of
that length: the size class has one size, similar windows are equal, and one band finds them for certain. What the filter
lets through is verified on the words themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.words import Words, blocks, mix, spaced
from strandloom.session import materialize

#: Bits of the Bloom filter for each value of a passage, and in all: at most eight megabytes are broadcast. More values fill
#: the filter and let more windows through to the join; none is lost.
FILTER_BITS, FILTER_MOST = 32, 1 << 26
#: Share of contained passages that the bands find at the lowest similarity that containment allows.
RECALL = 0.995


def minhashes(words: Words, run: int, shingle: int) -> np.ndarray:
    """The MinHash of each window of ``run`` words over its word shingles."""
    h = words.spans(shingle)
    width = run - shingle + 1
    if len(h) < width:
        return np.zeros(0, np.uint64)
    return np.lib.stride_tricks.sliding_window_view(h, width).min(axis=1)


class Filter:
    """A Bloom filter of two probes on 64-bit values."""

    def __init__(self, longs: np.ndarray):
        self.words = longs.view(np.uint64)
        self.shift = np.uint64(64 - int(math.log2(64 * len(self.words))))

    def _set(self, at: np.ndarray) -> np.ndarray:
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0

    def hit(self, values: np.ndarray) -> np.ndarray:
        a, b = _probes(values, self.shift)
        found = self._set(a)
        found[found] = self._set(b[found])
        return found


def _probes(values: np.ndarray, shift: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    return mix(values) >> shift, mix(values ^ np.uint64(0x5851F42D4C957F2D)) >> shift


def bloom(values: DataFrame, column: str, most: int = FILTER_MOST) -> Filter:
    """The filter of a column of longs. Tasks send bit positions, the bits are joined by OR before the driver sees them."""
    n = values.count()
    bits = min(most, max(1 << 12, 1 << (max(1, n) * FILTER_BITS - 1).bit_length()))
    shift = np.uint64(64 - int(math.log2(bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(_probes(b.column(0).to_numpy().view(np.uint64), shift)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(at & 63)], names=["place", "bit"])

    placed = values.select(column).mapInArrow(run, "place long, bit long")
    rows = placed.groupBy("place").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").cast("int"))).alias("bits")).toArrow()
    longs = np.zeros(bits // 64, np.int64)
    longs[rows["place"].to_numpy()] = rows["bits"].to_numpy()
    return Filter(longs)


def _keyed(df: DataFrame, key: str, text: str) -> tuple[DataFrame, T.DataType]:
    long = isinstance(df.schema[key].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    kind = T.LongType() if long else T.StringType()
    return df.select(F.col(key).cast(kind).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull()), kind


def _joined(batch: pa.RecordBatch, overlap: int, size: int = 1 << 20) -> Iterator[tuple[list, Words, np.ndarray]]:
    """(keys, words, text of each word) of about ``size`` characters of texts at a time, each whole or in blocks."""
    keys, held, n = [], [], 0
    for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        for block in blocks(spaced(t), overlap, max(size, 64 * overlap)):
            if not block:
                continue
            keys.append(k)
            held.append(block)
            n += len(block)
            if n >= size:
                yield keys, Words(" ".join(held)), np.repeat(np.arange(len(held)), [b.count(" ") + 1 for b in held])
                keys, held, n = [], [], 0
    if held:
        yield keys, Words(" ".join(held)), np.repeat(np.arange(len(held)), [b.count(" ") + 1 for b in held])


def _runs(kind: T.DataType, run: int, shingle: int, wanted):
    """(key, minhash, words) of the windows of each text, or of those whose MinHash is ``wanted``."""
    arrow = pa.int64() if isinstance(kind, T.LongType) else pa.string()
    names = ["key", "minhash", "words"]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, w, of in _joined(b, run - 1):
                m = minhashes(w, run, shingle)
                ok = of[: len(m)] == of[run - 1 :]  # within one text
                if wanted is not None:
                    ok &= wanted.value.hit(m)
                at = np.flatnonzero(ok)
                for s in range(0, len(at), 20_000):
                    some = at[s : s + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([keys[of[i]] for i in some], arrow), pa.array(m[some].view(np.int64)), pa.array([w.text(i, run) for i in some], pa.string())], names=names)

    return go, T.StructType([T.StructField("key", kind), T.StructField("minhash", T.LongType()), T.StructField("words", T.StringType())])


def leaks(docs: DataFrame, doc_key: str, doc_text: str, passages: DataFrame, item_key: str, passage: str, *, run: int = 10, shingle: int = 5, filter_bits: int = FILTER_MOST) -> DataFrame:
    """(doc, item, windows): documents that hold ``run`` consecutive words of an item's passage, and how many such windows.

    ``passages`` has a row for each passage of an item. Words are runs of letters and digits, case folded. Passages of
    fewer than ``run`` words cannot match; null and empty texts match nothing; repeated rows count once; a passage shared by
    items counts for each. Extra columns are ignored.
    """
    if not 0 < shingle <= run:
        raise ValueError("a shingle cannot be longer than the run")
    p, kind = _keyed(passages, item_key, passage)
    items = materialize(p.mapInArrow(*_runs(kind, run, shingle, None)).distinct(), "leak-windows")
    wanted = docs.sparkSession.sparkContext.broadcast(bloom(items.select("minhash").distinct(), "minhash", filter_bits))
    d, kind = _keyed(docs, doc_key, doc_text)
    found = d.mapInArrow(*_runs(kind, run, shingle, wanted)).withColumnRenamed("key", "doc").distinct()
    both = found.join(items.withColumnRenamed("key", "item"), ["minhash", "words"])
    return both.groupBy("doc", "item").agg(F.count(F.lit(1)).alias("windows"))


def band_count(threshold: float, recall: float = RECALL) -> int:
    """Bands of one value that find a contained passage with ``recall`` where it is smallest against its window."""
    j = threshold * 0.5 / (2 - 0.5 * threshold)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - j)))


def size_class(n: int) -> int:
    """The upper size of a class of shingle counts: 4, 8, 16 and so on."""
    return max(4, 1 << (max(1, n) - 1).bit_length())


def _windows(of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start of each block, second and third block of the same text, text) for windows of ``size`` and a half: blocks of half
    a ``size`` values of each text, of which every one opens a window of three, or of fewer where the text ends."""
    step = size // 2
    edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    length = np.diff(np.append(edge, len(of)))
    many = -(-length // step)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    text = np.repeat(of[edge], many)
    last = np.repeat(np.cumsum(many) - 1, many)
    at = np.arange(len(nth))
    return np.repeat(edge, many) + nth * step, np.minimum(at + 1, last), np.minimum(at + 2, last), text


def _minima(g: np.ndarray, start: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """The least value of each window."""
    m = np.minimum.reduceat(g, start)
    return np.minimum(np.minimum(m, m[second]), m[third])


def _band(h: np.ndarray, band: int) -> np.ndarray:
    return mix(h ^ mix(np.array([band + 1], np.uint64)))


def _value(minimum: np.ndarray, band: int, size: int) -> np.ndarray:
    """What stands for a band of a class in the filter and the join."""
    return mix(minimum + np.uint64(size * 1024 + band))


_SHINGLES = T.ArrayType(T.LongType())


def _passages(kind: T.DataType, shingle: int, count: int):
    """(key, passage, size, shingles, values) of every passage of at least one shingle."""
    arrow = pa.int64() if isinstance(kind, T.LongType) else pa.string()
    schema = T.StructType([T.StructField("key", kind), T.StructField("size", T.IntegerType()), T.StructField("shingles", _SHINGLES), T.StructField("values", _SHINGLES)])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = Words(spaced(t)).spans(shingle)
                if len(h):
                    size = size_class(len(h))
                    values = np.concatenate([_value(_band(h, i).min(keepdims=True), i, size) for i in range(count)])
                    rows.append((k, size, np.unique(h).view(np.int64), values.view(np.int64)))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], arrow), pa.array(cols[1], pa.int32()), *(pa.array(list(c), pa.list_(pa.int64())) for c in cols[2:])], names=schema.names)

    return go, schema


def _hits(kind: T.DataType, shingle: int, count: int, sizes: list[int], wanted):
    """(doc, value, shingles) of the windows of a document whose band value is ``wanted``."""
    arrow = pa.int64() if isinstance(kind, T.LongType) else pa.string()
    schema = T.StructType([T.StructField("doc", kind), T.StructField("value", T.LongType()), T.StructField("shingles", _SHINGLES)])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        overlap = 3 * max(sizes) // 2 + shingle
        for b in batches:
            for keys, w, of in _joined(b, overlap):
                h = w.spans(shingle)
                inside = of[: len(h)] == of[shingle - 1 :]
                h, of = h[inside], of[: len(h)][inside]
                if not len(h):
                    continue
                end = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of))
                docs, values, sets = [], [], []
                windows = {size: _windows(of, size) for size in sizes}
                for band in range(count):
                    g = _band(h, band)
                    for size, (start, second, third, text) in windows.items():
                        v = _value(_minima(g, start, second, third), band, size)
                        for i in np.flatnonzero(wanted.value.hit(v)):
                            s = int(start[i])
                            docs.append(keys[text[i]])
                            values.append(v[i].astype(np.int64))
                            sets.append(h[s : min(s + size + size // 2, int(end[np.searchsorted(end, s, "right")]))].view(np.int64))
                for s in range(0, len(docs), 5_000):
                    yield pa.RecordBatch.from_arrays([pa.array(docs[s : s + 5_000], arrow), pa.array(values[s : s + 5_000], pa.int64()), pa.array(sets[s : s + 5_000], pa.list_(pa.int64()))], names=schema.names)

    return go, schema


def _share(part: Column, whole: Column) -> Column:
    return F.size(F.array_intersect(part, whole)) / F.size(part)


def contained(docs: DataFrame, doc_key: str, doc_text: str, passages: DataFrame, item_key: str, passage: str, *, threshold: float = 0.8, shingle: int = 5, filter_bits: int = FILTER_MOST) -> DataFrame:
    """(doc, item, containment): documents of which one window holds at least ``threshold`` of a passage's word shingles,
    with the best share over the item's passages and the document's windows.

    So a passage of which a word here and there is changed is found too. Candidates come from the size-partitioned MinHash
    search, the share is exact. Passages of fewer than ``shingle`` words cannot match; null and empty texts match nothing;
    repeated rows count once. Extra columns are ignored.
    """
    count = band_count(threshold)
    p, kind = _keyed(passages, item_key, passage)
    items = materialize(p.distinct().mapInArrow(*_passages(kind, shingle, count)).withColumnRenamed("key", "item"), "contained-passages")
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # powers of two: fewer than 32
    d, kind = _keyed(docs, doc_key, doc_text)
    valued = items.select("item", F.col("shingles").alias("wanted"), F.explode("values").alias("value"))
    wanted = docs.sparkSession.sparkContext.broadcast(bloom(valued.select("value").distinct(), "value", filter_bits))
    found = d.mapInArrow(*_hits(kind, shingle, count, sizes or [4], wanted))
    both = found.join(valued, "value").withColumn("containment", _share(F.col("wanted"), F.col("shingles"))).where(F.col("containment") >= threshold)
    return both.groupBy("doc", "item").agg(F.max("containment").alias("containment"))
