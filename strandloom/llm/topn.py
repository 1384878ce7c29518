"""Top N items within every group by secondary sort.

Rows are sorted inside each partition by group and order, and Arrow batches stream through a counter that emits at most
N rows per group and remembers only the last group's kept items. The same stream runs twice: before the shuffle, where
it leaves at most N rows of a group in each input partition (so a group that holds a third of all rows moves only
N x partitions rows), and after it, where the groups are whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _codes(column: pa.Array) -> np.ndarray:
    """Equal numbers for equal values; null is a value."""
    return np.asarray(pc.dictionary_encode(column, null_encoding="encode").indices)


def _streamer(groups: Sequence[int], distinct: int | None, n: int, ranked: bool):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the group that the previous batch ended in
        count, seen = 0, set()  # its kept rows and, with distinct, their items: at most n
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            change = np.zeros(m, bool)
            for g in groups:
                c = _codes(b.column(g))
                change[1:] |= c[1:] != c[:-1]
            gid = np.cumsum(change)
            first = tuple(b.column(g)[0].as_py() for g in groups)
            goes_on = first == last
            if not goes_on:
                count, seen = 0, set()
            if distinct is None:
                keep = np.ones(m, bool)
            else:
                item = _codes(b.column(distinct)).astype(np.int64)
                _, at = np.unique(gid * (item.max() + 1) + item, return_index=True)
                keep = np.zeros(m, bool)
                keep[at] = True
                if seen:
                    head = int(np.searchsorted(gid, 0, side="right"))
                    known = pc.is_in(b.column(distinct).slice(0, head), value_set=pa.array(list(seen), b.column(distinct).type))
                    keep[:head] &= ~np.asarray(known.to_numpy(zero_copy_only=False), bool)
            upto = np.cumsum(keep)
            starts = np.flatnonzero(np.r_[True, change[1:]])
            before = (upto - keep)[starts]
            before[0] -= count
            rank = upto - before[gid]
            keep &= rank <= n
            out = b.filter(pa.array(keep))
            if ranked:
                out = pa.RecordBatch.from_arrays([*out.columns, pa.array(rank[keep].astype(np.int32))], names=[*b.schema.names, "__rank"])
            tail = starts[-1]
            mine = np.flatnonzero(keep[tail:]) + tail
            if len(starts) > 1 or not goes_on:
                count, seen = 0, set()
            count += len(mine)
            if distinct is not None:
                seen.update(b.column(distinct)[int(i)].as_py() for i in mine)
            last = tuple(b.column(g)[m - 1].as_py() for g in groups)
            if out.num_rows:
                yield out

    return stream


def top_n_per_group(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, *, distinct: str | None = None, rank: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, with their 1-based ``rank``; smaller groups come out whole.

    ``order`` must be total for a repeatable result (end it with an identifier); rows equal in all of it are exchangeable.
    With ``distinct`` an item counts once per group, by its first row. Null group keys form a group and a null item is an
    item; filter first where they must not take part. An input column named as ``rank`` is replaced; other extra columns
    pass through. An empty table gives an empty table.
    """
    if n < 1:
        raise ValueError("n must be positive")
    if rank not in groups and rank != distinct and rank in df.columns:
        df = df.drop(rank)
    if len({c.lower() for c in df.columns}) < len(df.columns):
        raise ValueError("column names must differ")
    at = [df.columns.index(g) for g in groups]
    item = None if distinct is None else df.columns.index(distinct)
    by = [F.col(f"`{g}`") for g in groups]
    part = df.sortWithinPartitions(*by, *order).mapInArrow(_streamer(at, item, n, False), df.schema)
    whole = T.StructType([*df.schema.fields, T.StructField("__rank", T.IntegerType())])
    out = part.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(_streamer(at, item, n, True), whole)
    return out.withColumnRenamed("__rank", rank)
