"""Cosine similarity: as an expression, and in Arrow blocks for nearest neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    d = lambda x: x.cast("double")
    return F.aggregate(F.zip_with(a, b, lambda x, y: d(x) * d(y)), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; an error where sizes differ, null where a vector is."""
    n = norm(a) * norm(b)
    value = F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different sizes")).cast("double")).otherwise(value)


def bridged(body: Column, bridges: Column, query: Column) -> Column:
    """The body similarity, or with bridges the smaller of it and the best bridge."""
    best = F.array_max(F.transform(bridges, lambda v: cosine(v, query)))
    return F.when(F.size(bridges) > 0, F.least(body, best)).otherwise(body)


def block_top_k(queries: DataFrame, targets: DataFrame, k: int, *, query_block: int = 8192, decimals: int = 12) -> DataFrame:
    """(qid, tid, score, rank): the ``k`` targets of highest cosine of every query, of another group where groups are given.

    ``queries`` and ``targets`` have ``id``, ``vec`` (array) and ``grp`` (null: no exclusion). Exact, ties by ascending id. Both
    sides are cut into blocks of bounded size and meet in cells of one block each, so a task holds two blocks whatever the
    size of the data; each cell keeps ``k`` rows a query, and a second ranking merges these.
    """
    flat = queries.select("id", "grp", "vec").where(F.col("vec").isNotNull())
    n = flat.count()
    parts = max(1, -(-n // query_block))
    blocks = flat.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts)))
    schema = T.StructType([T.StructField("qid", queries.schema["id"].dataType), T.StructField("tid", targets.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    qt = pa.int64() if isinstance(queries.schema["id"].dataType, T.LongType) else pa.string()
    tt = pa.int64() if isinstance(targets.schema["id"].dataType, T.LongType) else pa.string()

    def matrix(column) -> np.ndarray:
        flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
        length = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.where(length == 0, 1, length)

    def join(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema_table([], [], [])
        q, t = matrix(left["vec"]), matrix(right["vec"])
        tid = np.array(right["id"].to_pylist(), object)
        order = np.argsort(tid, kind="stable")
        tid, t = tid[order], t[order]
        tg = np.array(right["grp"].to_pylist(), object)[order]
        qid, qg = left["id"].to_pylist(), left["grp"].to_pylist()
        a, b, c = [], [], []
        for s in range(0, len(q), 512):
            p = np.round(q[s : s + 512] @ t.T, decimals)
            for i in range(len(p)):
                if qg[s + i] is not None:
                    p[i, tg == qg[s + i]] = -np.inf
                row = p[i]
                some = np.flatnonzero(row >= np.partition(row, len(t) - k)[len(t) - k]) if len(t) > k else np.arange(len(t))  # ties with the last stay
                best = some[np.argsort(-row[some], kind="stable")[:k]]
                best = best[np.isfinite(row[best])]
                a += [qid[s + i]] * len(best)
                b += tid[best].tolist()
                c += p[i, best].tolist()
        return schema_table(a, b, c)

    def schema_table(a, b, c) -> pa.Table:
        return pa.table({"qid": pa.array(a, qt), "tid": pa.array(b, tt), "score": pa.array(c, pa.float64())})

    # Cells of (query block, target block): both sides replicate only along the other's blocks.
    t = targets.select("id", "grp", "vec").where(F.col("vec").isNotNull())
    tparts = max(1, -(-t.count() // query_block))
    left = blocks.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(tparts - 1)))).withColumn("cell", F.col("block") * tparts + F.col("cell"))
    right = t.withColumn("tb", F.pmod(F.xxhash64("id"), F.lit(tparts))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("cell", (F.col("qb") * tparts + F.col("tb")).cast("long"))
    left = left.withColumn("cell", F.col("cell").cast("long"))
    pairs = left.select("cell", "id", "grp", "vec").groupBy("cell").cogroup(right.select("cell", "id", "grp", "vec").groupBy("cell")).applyInArrow(lambda key, x, y: join(key, x, y), schema)
    return rank_within(pairs, ["qid"], [F.col("score").desc(), F.col("tid").asc()], k)


def rank_within(df: DataFrame, by: list[str], order: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """Rows with their 1-based place in each group, the first ``k`` if given (pruned before the shuffle by the planner)."""
    from pyspark.sql import Window as W

    out = df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return out if k is None else out.where(F.col(name) <= k)


#: A group of more rows than this is ranked in pieces rather than in one task.
HOT_ROWS = 5_000_000


def _hot_groups(df: DataFrame, by: list[str], hot_rows: int) -> DataFrame | None:
    """The groups of more than ``hot_rows`` rows, or None: their list is short, as each has so many rows."""
    from strandloom.session import materialize

    if df.count() <= hot_rows:  # read from the footers where the rows are a written table
        return None
    hot = materialize(df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows).drop("__n"), "hot-groups")
    return None if hot.isEmpty() else hot


def _flagged(df: DataFrame, by: list[str], hot: DataFrame) -> DataFrame:
    same = [F.col(c).eqNullSafe(F.col(f"__h_{c}")) for c in by]
    return df.join(F.broadcast(hot.select(*(F.col(c).alias(f"__h_{c}") for c in by), F.lit(True).alias("__hot"))), same, "left").drop(*(f"__h_{c}" for c in by))


def _in_pieces(part: DataFrame, by: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """``part`` with the running sum of ``value`` in each group by ``order``, its groups in as many pieces as there are tasks.

    Groups are range-partitioned with their order; a piece sums its rows of a group in a stream, to which the sums of the
    group's pieces before are added.
    """
    from pyspark.sql import Window as W

    from strandloom.session import materialize

    keys = [F.col(c) for c in by]
    part = part.withColumn("__v", value).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__part", F.spark_partition_id())
    within = W.partitionBy("__part", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    part = materialize(part.withColumn("__sum", F.sum("__v").over(within)), "ranked-parts")
    sizes = part.groupBy("__part", *by).agg(F.sum("__v").alias("__all"))
    before = F.coalesce(F.sum("__all").over(W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("__before", before).select(F.col("__part").alias("__s_part"), *(F.col(c).alias(f"__s_{c}") for c in by), "__before")
    on = [F.col("__part") == F.col("__s_part"), *(F.col(c).eqNullSafe(F.col(f"__s_{c}")) for c in by)]
    return part.join(F.broadcast(sizes), on).withColumn(name, F.col("__sum") + F.col("__before"))  # one row a piece and group


def rank_whole(df: DataFrame, by: list[str], order: list[Column], name: str = "rank", hot_rows: int = HOT_ROWS, *more: tuple[str, list[Column]]) -> DataFrame:
    """The 1-based place of every row in its group, whatever the size of the group; ``order`` must be total.

    Groups up to ``hot_rows`` go through a window; larger ones are ranked in pieces. ``more`` are further (name, order), for
    which the groups are not counted again.
    """
    hot = _hot_groups(df, by, hot_rows)
    orders = [(name, order), *more]
    if hot is None:
        for n, o in orders:
            df = rank_within(df, by, o, None, n)
        return df
    flagged = _flagged(df, by, hot)
    rest, part = flagged.where("__hot is null").drop("__hot"), flagged.where("__hot").drop("__hot")
    columns = list(df.columns)
    for n, o in orders:
        rest = rank_within(rest, by, o, None, n)
        part = _in_pieces(part, by, o, F.lit(1).cast("long"), "__place").select(*columns, F.col("__place").cast("int").alias(n))
        columns.append(n)
    return rest.unionByName(part)


def running_whole(df: DataFrame, by: list[str], order: list[Column], value: Column, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The sum of ``value`` from the first row of the group to each, whatever the size of the group; ``order`` must be total."""
    from pyspark.sql import Window as W

    run = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    hot = _hot_groups(df, by, hot_rows)
    if hot is None:
        return df.withColumn(name, F.sum(value).over(run))
    flagged = _flagged(df, by, hot)
    rest = flagged.where("__hot is null").drop("__hot").withColumn(name, F.sum(value).over(run))
    part = _in_pieces(flagged.where("__hot").drop("__hot"), by, order, value, "__run").select(*df.columns, F.col("__run").alias(name))
    return rest.unionByName(part)
