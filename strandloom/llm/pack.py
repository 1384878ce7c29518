"""Items of varying length packed into containers of fixed capacity by linear grouping.

Items above the capacity are cut into full containers and a remainder; nothing else is divided. Within a bucket of bounded
size the large lengths are sorted and rounded up to the largest of their equal-cardinality group, which leaves few sizes;
configurations of these sizes are optimised by column generation (a knapsack prices new ones); each configuration, as many
times as its rounded-up count says, takes actual items of its groups, and the slack that rounding left goes to the largest
grouped item that fits; all other items go best fit, longest first, into what room is left or into new containers. Only keys and lengths leave the scan. Buckets are independent, so the packing
scales out; each adds at most a handful of containers that one packing of everything would save.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The WordPunct tokenizer, runs of \w or of what is neither \w nor \s, with these in Python's Unicode meaning.
_SPACE = r"\t-\r\x1c-\x20\x85\xa0  -     　"
WORDPUNCT = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_SPACE}]+"


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORDPUNCT))


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Columns of item counts by size, and how often to use each (a basic solution of the linear programme)."""
    g = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    x = demand / np.diag(columns)
    for _ in range(rounds):
        prices = np.linalg.solve(columns.T, np.ones(g))
        best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(1, capacity + 1):
            best[c] = best[c - 1]
            fit = np.flatnonzero(sizes <= c)
            if len(fit):
                value = best[c - sizes[fit]] + prices[fit]
                k = int(value.argmax())
                if value[k] > best[c] + 1e-12:
                    best[c], take[c] = value[k], fit[k]
        if best[capacity] <= 1 + 1e-9:
            break
        new, c = np.zeros(g), capacity
        while c > 0:
            if take[c] < 0:
                c -= 1
            else:
                new[take[c]] += 1
                c -= int(sizes[take[c]])
        d = np.linalg.solve(columns, new)
        grow = d > 1e-9
        ratio = np.where(grow, np.maximum(x, 0) / np.where(grow, d, 1), np.inf)
        out = int(ratio.argmin())
        x = x - ratio[out] * d
        x[out] = ratio[out]
        columns[:, out] = new
    return columns, np.maximum(x, 0)


class _Sizes:
    """Items by size, and which sizes are there as the bits of a number: the largest that fits is found in one step."""

    def __init__(self, size: np.ndarray, items: np.ndarray, capacity: int):
        self.held: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        for i in items[::-1].tolist():  # of equal sizes the first item leaves first
            self.held[size[i]].append(i)
            self.mask |= 1 << int(size[i])

    def take(self, most: int, least: int = 1) -> tuple[int, int] | None:
        """(item, size) of the largest size within the bounds."""
        s = (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1
        if s < least:
            return None
        item = self.held[s].pop()
        if not self.held[s]:
            self.mask &= ~(1 << s)
        return item, s


def pack_sizes(size: np.ndarray, capacity: int, groups: int = 24, large: float = 0.35) -> np.ndarray:
    """The container number of each of the items, whose sizes are between 1 and ``capacity``; a pure function of the order.

    Lengths above ``large`` of the capacity are sorted into equal-cardinality groups and rounded up to the largest of their
    group; the linear programme over configurations of these few sizes is solved, and each configuration is used as often
    as its rounded-up count says. A container takes actual items of the configuration's groups, the largest first; what
    they leave of the rounded sizes goes to the largest grouped item that still fits. Items of small lengths, and large
    ones that no configuration took, go best fit, longest first. With fewer than four items a group there is only best fit.
    """
    size = np.asarray(size, np.int64)
    where = np.full(len(size), -1, np.int64)
    order = np.argsort(-size, kind="stable")
    big = order[size[order] > capacity * large]
    room: list[int] = []  # what is left in each container
    if len(big) >= 4 * groups:
        parts = [p for p in np.array_split(big, groups) if len(p)]
        top = np.array([size[p[0]] for p in parts])
        rounded, member = np.unique(top, return_inverse=True)
        demand = np.bincount(member, weights=[len(p) for p in parts])
        below = np.concatenate([[int(size[big[-1]]) - 1], rounded[:-1]])  # a group holds the sizes above this
        columns, times = _configurations(rounded, demand, capacity)
        left_over = _Sizes(size, big, capacity)
        # The fullest configurations first, so that what is not served at the end is what packs worst anyway.
        fullest = sorted(range(columns.shape[1]), key=lambda j: (-float(rounded @ columns[:, j]), j))
        for j in fullest:
            groups_used = np.repeat(np.arange(len(rounded)), columns[:, j].astype(int))[::-1]
            for _ in range(int(np.ceil(times[j] - 1e-6))):
                left, taken = capacity, []
                for q, k in enumerate(groups_used):
                    most = left if q + 1 == len(groups_used) else min(int(rounded[k]), left)
                    if (got := left_over.take(most, int(below[k]) + 1)) is not None:
                        taken.append(got[0])
                        left -= got[1]
                if not taken or len(taken) < len(groups_used) and left > capacity * large:
                    for item in taken[::-1]:  # a group ran out: best fit will do better
                        left_over.held[size[item]].append(item)
                        left_over.mask |= 1 << int(size[item])
                    break
                while (got := left_over.take(left)) is not None:
                    taken.append(got[0])
                    left -= got[1]
                where[taken] = len(room)
                room.append(left)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for c, left in enumerate(room):
        open_at[left].append(c)
        mask |= 1 << left
    for item in order[where[order] < 0].tolist():
        s = int(size[item])
        fits = mask >> s
        if fits:
            left = s + (fits & -fits).bit_length() - 1
            c = open_at[left].pop()
            if not open_at[left]:
                mask &= ~(1 << left)
        else:
            c, left = len(room), capacity
            room.append(left)
        where[item] = c
        room[c] = left - s
        if room[c]:
            open_at[room[c]].append(c)
            mask |= 1 << room[c]
    return where


PACKED = T.StructType(
    [
        T.StructField("key", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("token_start", T.LongType()),
        T.StructField("tokens", T.IntegerType()),
        T.StructField("bucket", T.LongType()),
        T.StructField("container", T.LongType()),
    ]
)


def pack(items: DataFrame, key: str, size: Column, capacity: int = 512, *, bucket_items: int = 50_000, groups: int = 24) -> DataFrame:
    """(key, piece, token_start, tokens, bucket, container) of every piece of every item.

    A container is named by bucket and number within it. Items of null or no size do not come out. ``key`` is a number and
    should be unique; repeated rows are items of their own. An item above the capacity has full pieces and one remainder.
    The number of buckets follows the number of items. Extra columns are ignored; an empty table gives an empty table.
    """
    sized = items.select(F.col(key).cast("long").alias("key"), size.cast("long").alias("n"))
    starts = F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(capacity).cast("long")))
    # Outer, and filtered after: any filter on the size would be pushed down and count every text's tokens again.
    pieces = sized.select("key", "n", F.posexplode_outer(starts).alias("piece", "token_start")).where("piece is not null")
    pieces = pieces.select("key", "piece", "token_start", F.least(F.lit(capacity), F.col("n") - F.col("token_start")).cast("int").alias("tokens"))
    buckets = max(1, -(-items.count() // bucket_items))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("key", "piece", "tokens"), F.lit(buckets)))

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([("tokens", "descending"), ("key", "ascending"), ("piece", "ascending")])
        return t.append_column("container", pa.array(pack_sizes(t["tokens"].to_numpy(), capacity, groups))).select(PACKED.names)

    # A number of partitions of our own: the few bytes of an item would otherwise all be merged into one task.
    return pieces.repartition(2 * buckets, "bucket").groupBy("bucket").applyInArrow(one, PACKED)
