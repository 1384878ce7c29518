"""The most similar vectors of every vector by cross-polytope hashing.

A unit vector goes through pseudo-rotations (three rounds of random signs and a fast Hadamard transform) to its nearest
signed axis; the axes of several rotations together are its bucket in a table. Each vector is indexed once in every table
and also visits the buckets whose axes are the next nearest over all the table's rotations together. Entries of a bucket to
themselves end there; the others get eight-bit codes, products of which pick each vector's best few in the bucket; these
pairs, from all tables, are reranked on the exact vectors.

In buckets above ``bucket_rows`` every entry is compared with every resident: blocks of entries are held while all residents
stream past in Arrow batches, so no task holds an unbounded bucket and no pair is dropped; this is quadratic in such a
bucket. Codes err by less than
0.001 in cosine: among neighbours closer to each other than that, any may come out. Identical vectors beyond
what an answer can hold are classes: members answer with class mates, and a few of them stand for all in the index.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.topn import top_n_per_group
from strandloom.llm.words import mix
from strandloom.session import materialize


def parse_vector(value: str | None, size: int | None = None) -> np.ndarray | None:
    """The vector of a JSON array of finite numbers, not all zero, of the given size; None for anything else."""
    try:
        x = json.loads(value)
    except (TypeError, ValueError, RecursionError):
        return None
    if type(x) is not list or not x or (size is not None and len(x) != size) or not set(map(type, x)) <= {int, float}:
        return None
    try:
        v = np.array(x, np.float64)
    except OverflowError:
        return None
    top = np.abs(v).max()
    if not np.isfinite(top) or top == 0:
        return None
    v = v / top
    return v / np.sqrt(v @ v)


def _hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1), np.float32)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


class Rotations:
    """Pseudo-random rotations of ``dim`` dimensions, padded to a power of two. The Hadamard matrix is applied as the
    Kronecker product of two small ones, which costs dim^1.5 in matrix products instead of dim^2."""

    def __init__(self, dim: int, count: int, seed: int = 11):
        bits = max(1, (dim - 1).bit_length())
        self.dim, self.width = dim, 1 << bits
        self.a, self.b = _hadamard(1 << (bits // 2)), _hadamard(1 << (bits - bits // 2))
        self.signs = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (count, 3, self.width))

    def turned(self, x: np.ndarray, k: int) -> np.ndarray:
        n = len(x)
        y = np.zeros((n, self.width), np.float32)
        y[:, : self.dim] = x
        la, lb = len(self.a), len(self.b)
        for s in self.signs[k]:
            y = (y * s).reshape(n * la, lb) @ self.b
            y = np.ascontiguousarray(y.reshape(n, la, lb).transpose(0, 2, 1)).reshape(n * lb, la) @ self.a
            y = y.reshape(n, self.width) / np.float32(np.sqrt(self.width))
        return y

    def axes(self, x: np.ndarray, k: int, many: int) -> tuple[np.ndarray, np.ndarray]:
        """For rotation ``k``: the ``many`` nearest signed axes of each row in order, and how much farther than the nearest."""
        y = self.turned(x, k)
        size, rows = np.abs(y), np.arange(len(x))
        axis, gap = np.empty((len(x), many), np.int64), np.empty((len(x), many), np.float32)
        for m in range(many):
            at = size.argmax(axis=1)
            axis[:, m], gap[:, m] = at * 2 + (y[rows, at] < 0), size[rows, at]
            size[rows, at] = -1
        return axis, gap[:, :1] - gap


def _extend(key: np.ndarray, axis: np.ndarray) -> np.ndarray:
    return mix(key * np.uint64(0x9E3779B97F4A7C15) + axis.astype(np.uint64) + np.uint64(1))


def _codes(x: np.ndarray) -> np.ndarray:
    """Eight-bit codes of unit vectors, each scaled by its own largest coordinate."""
    return np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 127).astype(np.int8)


def _unit(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a two-dimensional array as binary values, without a Python object each."""
    n, width = len(rows), rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    """Binary values of equal length as the rows of an array."""
    if not len(column):
        return np.zeros((0, 1), dtype)
    start, end = np.frombuffer(column.buffers()[1], np.int32)[[column.offset, column.offset + len(column)]]
    return np.frombuffer(column.buffers()[2], np.uint8)[start:end].view(dtype).reshape(len(column), -1)


_VECTOR = [T.StructField("vec", T.BinaryType()), T.StructField("code", T.BinaryType()), T.StructField("same", T.LongType())]


def unit_vectors(df: DataFrame, key: str, vector_json: str, size: int | None, newest: str | None = None) -> DataFrame:
    """(vid, key, vec, code, same): the distinct keys that have a vector, written to the shared folder.

    ``vec`` holds float32, ``code`` eight bits a number; ``same`` is a hash on which identical directions agree. Of several vectors of a key the newest
    (then the largest in bytes) stays. Null keys take no part.
    """
    at = F.col(newest) if newest else F.lit(0)
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("at", T.LongType()), *_VECTOR])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parse_vector(v, size) for v in b.column(2).to_pylist()]
            keep = [i for i, v in enumerate(found) if v is not None]
            if keep:
                x = np.stack([found[i] for i in keep])
                fine = np.rint(x * 32767).astype(np.int64).astype(np.uint64)
                h = np.zeros(len(x), np.uint64)
                for c in fine.T:
                    h = mix(h * np.uint64(31) + c)
                some = b.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), _binary(x.astype(np.float32)), _binary(_codes(x)), pa.array(h.view(np.int64))], names=schema.names)

    stamp = F.unix_micros(at) if newest else at.cast("long")
    parsed = df.select(F.col(key).cast("string").alias("key"), stamp.alias("at"), F.col(vector_json)).where("key is not null").mapInArrow(run, schema)
    newest_of = parsed.groupBy("key").agg(F.max(F.struct("at", "vec", "code", "same")).alias("m"))
    return materialize(newest_of.select(F.monotonically_increasing_id().alias("vid"), "key", "m.vec", "m.code", "m.same"), "vectors")


_ENTRY = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("vid", T.LongType()), T.StructField("visit", T.BooleanType())])
_CODED = T.StructType([*_ENTRY.fields, T.StructField("code", T.BinaryType())])


def _index(dim: int, depth: int, tables: int, visits: int, seed: int):
    """Entries of each vector: one resident and ``visits`` visitors in every table.

    Visitors go to the combinations of near axes over the table's rotations that are least far in all.
    """
    many = min(2 * dim, 2 if visits == 0 else max(2, min(visits + 1, 6 if depth < 3 else 4)))
    combos = np.stack(np.meshgrid(*[np.arange(many)] * depth, indexing="ij"), axis=-1).reshape(-1, depth)
    combos = combos[np.argsort(combos.sum(axis=1), kind="stable")]  # the first is the home
    visits = min(visits, len(combos) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rot = Rotations(dim, tables * depth, seed)
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), np.float32)
            rows = np.arange(len(x))
            buckets, visit = [], []
            for t in range(tables):
                found = [rot.axes(x, t * depth + k, many) for k in range(depth)]
                far = sum(gap[:, combos[:, k]] for k, (_, gap) in enumerate(found))
                far[:, 0] = -1
                order = np.argsort(far, axis=1, kind="stable")[:, : visits + 1]
                for v in range(visits + 1):
                    key = np.full(len(x), t + 1, np.uint64)
                    for k, (axis, _) in enumerate(found):
                        key = _extend(key, axis[rows, combos[order[:, v], k]])
                    buckets.append(key.view(np.int64))
                    visit.append(np.full(len(x), v > 0))
            n = tables * (visits + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets)), pa.array(np.tile(b.column(0).to_numpy(), n)), pa.array(np.concatenate(visit))], names=_ENTRY.names)

    return run


_PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _best_in_bucket(code: np.ndarray, vid: np.ndarray, visit: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's ``k`` best residents with a product of at least ``least``."""
    x = _unit(code)
    home = np.flatnonzero(~visit)
    out_a, out_b = [], []
    for s in range(0, len(x), 1024):
        p = x[s : s + 1024] @ x[home].T
        p[vid[s : s + 1024][:, None] == vid[home][None]] = -9
        if p.shape[1] > k:
            floor = np.partition(p, p.shape[1] - k, axis=1)[:, p.shape[1] - k]
            ok = (p >= floor[:, None]) & (p >= least)
        else:
            ok = p >= least
        r, c = np.nonzero(ok)
        out_a.append(vid[s + r])
        out_b.append(vid[home[c]])
    return np.concatenate(out_a), np.concatenate(out_b)


def _pairs(k: int, least: float, small: int = 48):
    """Candidate pairs of each bucket from entries sorted by bucket; small buckets all at once, by their distance in rank."""

    def whole(bucket, vid, visit, code) -> tuple[np.ndarray, np.ndarray]:
        change = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        sizes = np.diff(change)
        found_a, found_b = [], []
        of = np.repeat(np.arange(len(sizes)), sizes)
        tiny = (sizes <= small)[of]
        if least > -1:  # small buckets: all pairs of one rank distance in one product, kept if near enough
            x = _unit(code)
            for d in range(1, small):
                i = np.flatnonzero((of[:-d] == of[d:]) & tiny[:-d]) if len(of) > d else np.zeros(0, int)
                if not len(i):
                    break
                i = i[(~visit[i] | ~visit[i + d]) & (vid[i] != vid[i + d])]
                p = np.einsum("ij,ij->i", x[i], x[i + d])
                i = i[p >= least]
                found_a.append(vid[i])
                found_b.append(vid[i + d])
        for g in np.flatnonzero((sizes > small) if least > -1 else (sizes > 1)):
            s, e = change[g], change[g + 1]
            a, b = _best_in_bucket(code[s:e], vid[s:e], visit[s:e], k, least)
            found_a.append(a)
            found_b.append(b)
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *found_a]), np.concatenate([empty, *found_b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(parts):
            a, b = whole(*(np.concatenate(c) for c in zip(*parts)))
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((hi, lo))
            lo, hi = lo[order], hi[order]
            new = np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])][: len(lo)]
            return pa.RecordBatch.from_arrays([pa.array(lo[new]), pa.array(hi[new])], names=_PAIR.names)

        for b in batches:
            if not b.num_rows:
                continue
            cols = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), _matrix(b.column(3), np.int8)
            cut = int(np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])[-1])  # where the last bucket starts
            if cut:
                yield out([*held, tuple(c[:cut] for c in cols)])
                held = [tuple(c[cut:].copy() for c in cols)]
            elif held and held[0][0][0] != cols[0][0]:
                yield out(held)
                held = [tuple(c.copy() for c in cols)]
            else:
                held.append(tuple(c.copy() for c in cols))
        if held:
            yield out(held)

    return run


_CELL = T.StructType([T.StructField("cell", T.LongType()), T.StructField("home", T.BooleanType()), T.StructField("vid", T.LongType()), T.StructField("code", T.BinaryType())])


class _Block:
    """A block of entries and the ``k`` best residents that each has met so far, of a product of at least ``least``."""

    def __init__(self, code: np.ndarray, vid: np.ndarray, k: int, least: float):
        self.x, self.vid, self.k = _unit(code), vid, k
        self.score, self.best = np.full((len(vid), k), least, np.float32), np.full((len(vid), k), -1)

    def meet(self, code: np.ndarray, vid: np.ndarray, rows: int = 1024) -> None:
        y = _unit(code)
        for s in range(0, len(self.x), rows):
            p = self.x[s : s + rows] @ y.T
            near = p > self.score[s : s + rows, -1:]
            if p.shape[1] > self.k + 1 and np.count_nonzero(near) > 64 * len(p):  # one more than k, as one may be the entry itself
                at = np.argpartition(p, p.shape[1] - self.k - 1, axis=1)[:, -self.k - 1 :]
                r, c = np.repeat(np.arange(len(p)), self.k + 1), at.ravel()
                r, c = r[near[r, c]], c[near[r, c]]
            else:
                r, c = np.nonzero(near)
            other = self.vid[s + r] != vid[c]
            r, c = r[other], c[other]
            if not len(r):
                continue
            rows_met = np.unique(r)
            row = np.r_[r, np.repeat(rows_met, self.k)]
            score, best = np.r_[p[r, c], self.score[s + rows_met].ravel()], np.r_[vid[c], self.best[s + rows_met].ravel()]
            order = np.lexsort((-score, row))
            row, score, best = row[order], score[order], best[order]
            first = np.searchsorted(row, rows_met)[:, None] + np.arange(self.k)
            self.score[s + rows_met], self.best[s + rows_met] = score[first], best[first]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        met = self.best >= 0
        return np.repeat(self.vid, met.sum(axis=1)), self.best[met]


def _pairs_in_blocks(k: int, least: float):
    """Candidate pairs of hot buckets from cells sorted so that a block's entries come before the residents they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None

        def out():
            a, b = block.pairs()
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=_PAIR.names)

        for b in batches:
            if not b.num_rows:
                continue
            cell, home, vid, code = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(), _matrix(b.column(3), np.int8)
            change = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (home[1:] != home[:-1]), True])
            for s, e in zip(change[:-1], change[1:]):
                if cell[s] != now:
                    if block is not None:
                        yield out()
                    now, held, block = cell[s], [], None
                if not home[s]:
                    held.append((code[s:e].copy(), vid[s:e].copy()))
                    continue
                if block is None and held:
                    block = _Block(*(np.concatenate(c) for c in zip(*held)), k, least)
                    held = []
                if block is not None:
                    block.meet(code[s:e], vid[s:e])
        if block is not None:
            yield out()

    return run


def _candidates(entries: DataFrame, codes: DataFrame, k: int, least: float, bucket_rows: int) -> DataFrame:
    """Candidate pairs of all buckets; those of more than ``bucket_rows`` entries are compared in blocks, whole.

    ``entries`` is a written table; only those that share a bucket with a resident other than themselves get their codes.
    Sizes are counted before the shuffle, and a hot bucket's rows may be split in both joins.
    """
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("visit")).alias("homes")).where("n > 1 and homes > 0")
    kept = entries.join(sizes.select("bucket", "n"), "bucket")
    coded = materialize(kept.join(codes.select("vid", "code"), "vid").select(*_CODED.names, "n"), "vector-entries-coded")
    hot = coded.where(F.col("n") > bucket_rows)
    cool = coded.where(F.col("n") <= bucket_rows).select(*_CODED.names)
    pairs = cool.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_pairs(k, least), _PAIR)
    if hot.isEmpty():
        return pairs
    # Every entry is in one block of its bucket, and every resident goes to all blocks.
    within = hot.withColumn("blocks", F.ceil(F.col("n") / (2 * bucket_rows)).cast("long"))
    cell = F.xxhash64("bucket", "block")
    asks = within.withColumn("block", F.pmod(F.xxhash64("vid"), F.col("blocks"))).select(cell.alias("cell"), F.lit(False).alias("home"), "vid", "code")
    homes = within.where(~F.col("visit")).select("bucket", "vid", "code", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    cells = asks.unionByName(homes.select(cell.alias("cell"), F.lit(True).alias("home"), "vid", "code"))
    return pairs.unionByName(cells.repartition("cell").sortWithinPartitions("cell", "home").mapInArrow(_pairs_in_blocks(k, least), _PAIR))


@dataclass(frozen=True)
class Plan:
    """How the index is laid out: rotations a table, tables, visited buckets a table besides the home."""

    depth: int
    tables: int
    visits: int


#: For neighbours of a cosine of 0.9 and more.
NEAR = Plan(3, 4, 2)
#: For neighbours however far, by depth. Measured on vectors whose fifth neighbour has a cosine of 0.54 in 64 dimensions.
FAR = {1: Plan(1, 10, 1), 2: Plan(2, 14, 15), 3: Plan(3, 24, 47)}
#: Residents a bucket should hold on average, at most, before a table takes one rotation more.
RESIDENTS = 2_000


def far_plan(n: int, dim: int, residents: int = RESIDENTS) -> Plan:
    """The plan for ``n`` vectors without a bound on the cosine: as many rotations as keep buckets small, as every such index
    must have more bits for more vectors; tables and visits make up for what a further rotation parts."""
    axes = 2 << max(0, (dim - 1).bit_length())
    depth = 1
    while depth < max(FAR) and n > residents * axes**depth:
        depth += 1
    return FAR[depth]


def similar(
    df: DataFrame, key: str, vector_json: str, *, k: int = 5, size: int | None = None, min_cosine: float | None = None, newest: str | None = None,
    plan: Plan | None = None, bucket_rows: int = 4096, seed: int = 11, dim: int | None = None,
) -> DataFrame:
    """(key, neighbour, cosine, rank): up to ``k`` other keys by descending cosine, ties by ascending key.

    With ``min_cosine`` only neighbours at least so similar come out, and the buckets filter by it; ``plan`` is then ``NEAR``
    unless given, else :func:`far_plan` of the number of vectors. Values that are no JSON array of ``size`` finite numbers, or
    all zero, take no part; a key counts once. Recall depends on the plan and is measured in the tests; buckets of any size
    are compared whole, so ``bucket_rows`` does not change it. Extra columns are ignored; tables of no or one vector give no
    rows.
    """
    spark = df.sparkSession
    vectors = unit_vectors(df, key, vector_json, size, newest)
    if dim is None:
        dim = size
    if dim is None:
        first = vectors.select((F.length("vec") / 4).cast("int")).first()
        dim = first[0] if first else 1
    vectors = vectors.where(F.length("vec") == 4 * dim)
    # Classes of identical vectors with more members than an answer holds: the k + 1 smallest stand for all.
    classes = vectors.groupBy("same").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1).select("same")
    classes = materialize(classes, "vector-classes")
    mates = None
    indexed = vectors
    if not classes.isEmpty():
        members = vectors.join(classes, "same").select("same", "key", "vid")
        stand = materialize(top_n_per_group(members, ["same"], [F.col("key").asc(), F.col("vid").asc()], k + 1), "vector-stand-ins")
        indexed = vectors.join(classes, "same", "left_anti").select("vid", "key", "vec").unionByName(vectors.join(stand.select("vid"), "vid", "left_semi").select("vid", "key", "vec"))
        few = stand.groupBy("same").agg(F.sort_array(F.collect_list("key")).alias("first"))  # k + 1 at most
        rest = members.join(stand.select("vid"), "vid", "left_anti").join(few, "same")
        mates = rest.select("key", F.posexplode(F.slice("first", 1, k)).alias("pos", "neighbour")).select("key", "neighbour", F.lit(1.0).alias("cosine"), (F.col("pos") + 1).alias("rank"))
    if plan is None:
        plan = NEAR if min_cosine is not None and min_cosine >= 0.9 else far_plan(vectors.count(), dim)
    least = -2.0 if min_cosine is None else min_cosine - 0.03  # more than the codes can err
    entries = materialize(indexed.select("vid", "vec").mapInArrow(_index(dim, plan.depth, plan.tables, plan.visits, seed), _ENTRY), "vector-entries")
    pairs = materialize(_candidates(entries, vectors, k + 3, least, bucket_rows).distinct(), "vector-pairs")
    left = vectors.select(F.col("vid").alias("a"), F.col("key").alias("key_a"), F.col("vec").alias("va"))
    right = vectors.select(F.col("vid").alias("b"), F.col("key").alias("key_b"), F.col("vec").alias("vb"))
    exact = T.StructType([T.StructField("key", T.StringType()), T.StructField("neighbour", T.StringType()), T.StructField("cosine", T.DoubleType())])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (_matrix(b.column(i), np.float32).astype(np.float64) for i in (2, 3))
            cos = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            if min_cosine is not None:
                keep = cos >= min_cosine - 1e-7  # the vectors are rounded to 32 bits
                b, cos = b.filter(pa.array(keep)), cos[keep]
            if b.num_rows:
                c = pa.array(cos)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), c], names=exact.names)
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), c], names=exact.names)

    scored = pairs.join(left, "a").join(right, "b").select("key_a", "key_b", "va", "vb").mapInArrow(rerank, exact)
    found = top_n_per_group(scored, ["key"], [F.col("cosine").desc(), F.col("neighbour").asc()], k)
    return found if mates is None else found.unionByName(mates)
