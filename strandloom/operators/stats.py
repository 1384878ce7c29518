"""Resampling: cluster bootstrap, paired tests, coupled samples, random graphs of the same degrees.

Intervals whose draws are numpy's own stream are made in one group that holds a row a cluster; for more clusters than
``MOST_CLUSTERS`` there is :func:`poisson_bootstrap`, which has no such group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.vectors import rank_within
from strandloom.session import materialize

#: Most clusters of a group that are resampled in one task: their sums are 16 bytes each, a block of draws 1 kB a cluster.
MOST_CLUSTERS = 1_000_000


def _multiplicities(clusters: int, seed: int, repeats: int, block: int) -> Iterator[np.ndarray]:
    """How often each draw has each cluster, a block of draws at a time, from numpy's default stream."""
    rng, left = np.random.default_rng(seed), repeats
    while left > 0:
        rows = min(block, left)
        drawn = rng.integers(0, clusters, size=(rows, clusters)) + np.arange(rows)[:, None] * clusters
        yield np.bincount(drawn.ravel(), minlength=rows * clusters).reshape(rows, clusters).astype(float)
        left -= rows


def interval(draws: np.ndarray, level: float = 0.05) -> tuple[float, float]:
    low, high = np.quantile(draws, [level / 2, 1 - level / 2])
    return float(low), float(high)


def resampled_means(sums: Sequence[float], counts: Sequence[float], *, seed: int = 42, repeats: int = 10_000, block: int = 128, level: float = 0.05) -> dict[str, float | None]:
    """Row mean and mean of cluster means with percentile intervals; clusters in their given order; none gives nulls.

    A draw is how often it has each cluster, so its means are two products with what a cluster adds to them.
    """
    s, n = np.asarray(sums, float), np.asarray(counts, float)
    if not s.size:
        return dict.fromkeys(("mean", "low", "high", "macro", "macro_low", "macro_high"))
    adds = np.stack([s, n, s / n], axis=1)
    drawn = np.concatenate([m @ adds for m in _multiplicities(s.size, seed, repeats, block)])
    low, high = interval(drawn[:, 0] / drawn[:, 1], level)
    macro_low, macro_high = interval(drawn[:, 2] / s.size, level)
    return {"mean": float(s.sum() / n.sum()), "low": low, "high": high, "macro": float(adds[:, 2].mean()), "macro_low": macro_low, "macro_high": macro_high}


def clusters(rows: DataFrame, value: str, cluster: str, by: str | None = None) -> DataFrame:
    """(group, cluster, s, n): the sum and number of the values of each cluster."""
    g = F.col(by).cast("string") if by else F.lit("all")
    return rows.where(F.col(value).isNotNull()).groupBy(g.alias("group"), F.col(cluster).cast("string").alias("cluster")).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))


def bootstrap(rows: DataFrame, value: str, cluster: str, by: str | None = None, *, seed: int = 42, repeats: int = 10_000, level: float = 0.05, block: int = 128) -> DataFrame:
    """(group, clusters, mean, low, high, macro, macro_low, macro_high) per group of ``by``.

    Values are summed by cluster in the cluster, so a group's task holds one row a cluster; more than ``MOST_CLUSTERS`` of
    them are an error.
    """
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_CLUSTERS:
            raise ValueError("too many clusters for one stream of draws: use poisson_bootstrap")
        p = pdf.sort_values("cluster")
        r = resampled_means(p.s.to_numpy(), p.n.to_numpy(), seed=seed, repeats=repeats, level=level, block=block)
        return pd.DataFrame([{"group": p.group.iloc[0], "clusters": len(p), **r}])

    return clusters(rows, value, cluster, by).groupBy("group").applyInPandas(one, "group string, clusters long, mean double, low double, high double, macro double, macro_low double, macro_high double")


def poisson_bootstrap(rows: DataFrame, value: str, cluster: str, by: str | None = None, *, seed: int = 42, repeats: int = 1_000, level: float = 0.05) -> DataFrame:
    """(group, clusters, mean, low, high) with independent Poisson weights of every cluster instead of draws of all.

    A task turns its clusters into one weighted sum and count a draw; only these meet, so any number of clusters is spread.
    Weights come from a generator seeded by the cluster, so they depend neither on partitions nor on other clusters.
    """
    c = clusters(rows, value, cluster, by)

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for g, h, s, n in zip(*(b.column(i).to_pylist() for i in range(4))):
                w = np.random.Generator(np.random.PCG64([seed & 0xFFFFFFFF, h & 0xFFFFFFFFFFFFFFFF])).poisson(1.0, repeats)
                held.setdefault(g, np.zeros((2, repeats)))
                held[g] += w * np.array([[s], [n]])
        for g, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * repeats), pa.array(np.arange(repeats)), pa.array(x[0]), pa.array(x[1])], names=["group", "draw", "s", "n"])

    drawn = c.select("group", F.xxhash64("cluster"), "s", F.col("n").cast("double")).mapInArrow(weighted, "group string, draw long, s double, n double")
    means = drawn.groupBy("group", "draw").agg((F.sum("s") / F.sum("n")).alias("m")).where("m is not null")
    ends = means.groupBy("group").agg(F.percentile("m", F.lit([level / 2, 1 - level / 2])).alias("q"))
    whole = c.groupBy("group").agg(F.count(F.lit(1)).alias("clusters"), (F.sum("s") / F.sum("n")).alias("mean"))
    return whole.join(ends, "group", "left").select("group", "clusters", "mean", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def paired_bootstrap(diffs: Sequence[float], *, seed: int = 42, repeats: int = 10_000) -> dict[str, float | bool]:
    """Query-level percentile interval of the mean difference, and whether it leaves out zero."""
    d = np.asarray(diffs, float)
    low, high = interval(np.concatenate([m @ d for m in _multiplicities(d.size, seed, repeats, 128)]) / d.size)
    return {"mean": float(d.mean()), "low": low, "high": high, "significant": bool(low > 0 or high < 0)}


def family_level(m: int, level: float = 0.05) -> float:
    """The level of each of ``m`` intervals that together keep ``level``."""
    return level / max(1, m)


def rewired(edges: DataFrame, sources: DataFrame, seeds: int, rounds: int = 10) -> DataFrame:
    """(repeat, src_id, dst_id): for each seed a random graph with the in- and out-degrees of ``edges``.

    A round pairs edges at random and lets each pair trade ends, a->b and c->d becoming a->d and c->b. It is for tables of any
    size: an edge takes part in one pair of a round, so all trades of a round are independent but for what they make. A trade
    is refused if it would join nodes of one source, or make an edge that is there or that another trade of the round makes.
    Edges within a source fail the job; repeated edges count once. ``sources``: id, source.
    """
    of = sources.select(F.col("id").alias("n"), "source")
    at = lambda d, c, name: d.join(of.select(F.col("n").alias(c), F.col("source").alias(name)), c)
    e = at(at(edges.select("src_id", "dst_id").distinct(), "src_id", "ss"), "dst_id", "ts")
    e = e.where(F.assert_true(~F.col("ss").eqNullSafe(F.col("ts")), F.lit("an edge within a source")).isNull())
    e = materialize(e.select(F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("repeat"), "src_id", "dst_id", "ss", "ts"), "rewired")
    pairs = max(1, e.where("repeat = 0").count() // 2)
    for k in range(rounds):
        bucket = F.pmod(F.xxhash64(F.lit(k), "repeat", "src_id", "dst_id"), F.lit(pairs))
        edge = F.struct(F.xxhash64("src_id", "dst_id", F.lit(k)).alias("o"), "src_id", "dst_id", "ss", "ts")
        met = e.groupBy("repeat", bucket.alias("bucket")).agg(F.min(edge).alias("a"), F.max(edge).alias("b"))
        met = met.where("a.o <> b.o and a.src_id <> b.src_id and a.dst_id <> b.dst_id and not (a.ss <=> b.ts) and not (b.ss <=> a.ts)")
        new = lambda x, y, name: F.struct(F.col(f"{x}.src_id").alias("src_id"), F.col(f"{y}.dst_id").alias("dst_id"), F.col(f"{x}.ss").alias("ss"), F.col(f"{y}.ts").alias("ts")).alias(name)
        trade = materialize(met.select("repeat", "bucket", "a", "b", new("a", "b", "x"), new("b", "a", "y")), "rewired-trades")
        both = lambda p, q: trade.select("repeat", "bucket", F.explode(F.array(*(F.struct(F.col(f"{c}.src_id").alias("src_id"), F.col(f"{c}.dst_id").alias("dst_id"), F.col(f"{c}.ss").alias("ss"), F.col(f"{c}.ts").alias("ts")) for c in (p, q)))).alias("e")).select("repeat", "bucket", "e.*")
        made = both("x", "y")
        taken = made.join(e.select("repeat", "src_id", "dst_id"), ["repeat", "src_id", "dst_id"], "left_semi").select("repeat", "bucket")
        again = made.groupBy("repeat", "src_id", "dst_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        refused = taken.unionByName(made.join(again, ["repeat", "src_id", "dst_id"], "left_semi").select("repeat", "bucket")).distinct()
        keep = lambda d: d.join(refused, ["repeat", "bucket"], "left_anti").drop("bucket")
        gone = keep(both("a", "b")).select("repeat", "src_id", "dst_id")
        e = materialize(e.join(gone, ["repeat", "src_id", "dst_id"], "left_anti").unionByName(keep(made).select(e.columns)), "rewired")
    return e.select("repeat", "src_id", "dst_id")


def coupled_sample(pools: DataFrame, budgets: DataFrame, seed: int) -> DataFrame:
    """(query_id, arm, id): the first ``budget`` of every arm by a priority that a node has in all arms of its query.

    The priority is the digest of seed, query and node, so arms share it without a table of priorities, whatever partition a
    row is in. An arm with fewer nodes than its query's budget fails the job; repeated rows count once.
    """
    p = pools.select("query_id", "arm", "id").distinct().withColumn("priority", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("query_id").cast("string"), F.col("id").cast("string"))))
    short = p.groupBy("query_id", "arm").agg(F.count(F.lit(1)).alias("size"))
    enough = short.join(budgets, "query_id").where(F.assert_true(F.col("size") >= F.col("budget"), F.lit("a pool is smaller than its budget")).isNull())
    p = rank_within(p, ["query_id", "arm"], [F.col("priority").asc(), F.col("id").asc()])
    return p.join(enough.select("query_id", "arm", "budget"), ["query_id", "arm"]).where(F.col("rank") <= F.col("budget")).select("query_id", "arm", "id")


def unit_masks(hits: DataFrame) -> DataFrame:
    """(query_id, id, mask): the gold units of a passage as bits; more than 63 units is an error."""
    ok = F.when((F.col("unit") < 0) | (F.col("unit") > 62), F.raise_error(F.lit("more than 63 units")).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("unit").cast("int")))
    return hits.select("query_id", "id", ok.alias("mask")).groupBy("query_id", "id").agg(F.bit_or("mask").alias("mask"))


def mask_coverage(samples: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, arm, covered): gold units as bits, joined by OR."""
    m = samples.join(unit_masks(hits), ["query_id", "id"], "left").groupBy("query_id", "arm").agg(F.bit_or(F.coalesce("mask", F.lit(0).cast("long"))).alias("mask"))
    return m.select("query_id", "arm", F.bit_count("mask").alias("covered"))


def link_supply(base: DataFrame, samples: DataFrame, hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, repeat, arm, added_recall, complete_gain, any_new): what each sample of added passages covers beyond the base.

    ``base``: query_id, id; ``samples``: query_id, repeat, arm, id; ``hits``: query_id, id, unit; ``gold``: query_id, units.
    Queries without units drop out. Gain is complete coverage with the sample minus complete coverage without.
    """
    masks = unit_masks(hits)
    none = F.lit(0).cast("long")
    b = base.join(masks, ["query_id", "id"], "left").groupBy("query_id").agg(F.bit_or(F.coalesce("mask", none)).alias("b"))
    s = samples.join(masks, ["query_id", "id"], "left").groupBy("query_id", "repeat", "arm").agg(F.bit_or(F.coalesce("mask", none)).alias("s"))
    j = s.join(gold.where("units > 0"), "query_id").join(b, "query_id", "left").withColumn("b", F.coalesce("b", none))
    new = F.bit_count(F.col("s").bitwiseAND(F.bitwise_not("b")))
    whole = lambda m: (F.bit_count(m) == F.col("units")).cast("double")
    return j.select("query_id", "repeat", "arm", (new / F.col("units")).alias("added_recall"), (whole(F.col("s").bitwiseOR(F.col("b"))) - whole(F.col("b"))).alias("complete_gain"), (new > 0).cast("double").alias("any_new"))


SUPPLY = ("added_recall", "complete_gain", "any_new")


def supply_summary(values: DataFrame) -> DataFrame:
    """(arm, metric, mean, realization_sd): the mean over queries and repeats, and the spread of the repeats' means."""
    long = values.unpivot(["query_id", "repeat", "arm"], list(SUPPLY), "metric", "value")
    per = long.groupBy("arm", "metric", "repeat").agg(F.avg("value").alias("m"), F.sum("value").alias("s"), F.count("value").alias("n"))
    return per.groupBy("arm", "metric").agg((F.sum("s") / F.sum("n")).alias("mean"), F.stddev_samp("m").alias("realization_sd"))


def budget_histogram(budgets: DataFrame, budget: str = "budget") -> DataFrame:
    """(budget, queries, mean): how many queries have each budget, and the mean budget of all."""
    h = budgets.groupBy(F.col(budget).alias("budget")).agg(F.count(F.lit(1)).alias("queries"))  # few budgets
    mean = budgets.agg(F.avg(budget).alias("mean"))
    return h.crossJoin(F.broadcast(mean))  # one row


def greedy_cover(pool: DataFrame, budget: int) -> DataFrame:
    """(query_id, id): annotation-aware admission; the fewest tokens first, then the id, skipping what would overflow.

    ``pool``: query_id, id, unit, tokens; a passage has a row for each unit it holds. Before anything is admitted, every unit
    keeps only its first passage in this order: a later one is never needed, as the first is admitted unless the
    budget is spent, and then a longer one does not fit either. So a query's admission is a running sum over its units.
    """
    from pyspark.sql import Window as W

    first = rank_within(pool.where("tokens >= 0"), ["query_id", "unit"], [F.col("tokens").asc(), F.col("id").asc()], 1, "__n")
    once = first.select("query_id", "id", "tokens").distinct()  # at most one a unit
    used = F.sum("tokens").over(W.partitionBy("query_id").orderBy(F.col("tokens").asc(), F.col("id").asc()).rowsBetween(W.unboundedPreceding, 0))
    return once.withColumn("used", used).where(F.col("used") <= budget).select("query_id", "id")
