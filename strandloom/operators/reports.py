"""Aggregation of result rows: eligibility, means, labels, seeds, pairs and factorials."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eligible(metric: Column, error: Column) -> Column:
    """A failed row counts as zero; else a number of at least 0; else nothing."""
    return F.when(error, F.lit(0.0)).when((metric >= 0) & ~F.isnan(metric), metric.cast("double"))


def means(rows: DataFrame, metrics: list[str], error: Column, by: str | None = None) -> DataFrame:
    """(level, metric, mean, eligible): over all rows and, with ``by``, per group, in one pass."""
    e = rows.select(*([F.col(by)] if by else []), *(eligible(F.col(m), error).alias(m) for m in metrics))
    long = e.unpivot([by] if by else [], metrics, "metric", "value")
    agg = [F.avg("value").alias("mean"), F.count("value").alias("eligible")]
    if not by:
        return long.groupBy("metric").agg(*agg).select(F.lit("all").alias("level"), "metric", "mean", "eligible")
    g = long.groupingSets([["metric"], ["metric", by]], "metric", by).agg(*agg, F.grouping_id("metric", by).alias("g"))
    return g.select(F.when(F.col("g") == 0, F.coalesce(F.col(by).cast("string"), F.lit("unknown"))).otherwise("all").alias("level"), "metric", "mean", "eligible")


def label_rates(rows: DataFrame, label: str, unscored: str = "Unscored") -> DataFrame:
    """(label, n, rate) over scored rows."""
    total = F.sum(F.when(F.col(label) != unscored, F.col("n")))
    from pyspark.sql import Window as W

    g = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))  # a handful of labels
    scored = F.coalesce(total.over(W.partitionBy(F.lit(1))), F.lit(0))
    return g.select(F.col(label).alias("label"), "n", (F.when(F.col(label) != unscored, F.col("n")) / F.greatest(scored, F.lit(1))).alias("rate"))


def seed_intervals(rows: DataFrame, seed: str, metric: str, error: Column) -> DataFrame:
    """(seeds, mean, std, low, high): normal interval over seed means; one seed has no spread; empty seeds drop out."""
    per = rows.groupBy(seed).agg(F.avg(eligible(F.col(metric), error)).alias("m")).where("m is not null")
    a = per.agg(F.count(F.lit(1)).alias("seeds"), F.avg("m").alias("mean"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("std"))
    half = 1.96 * F.col("std") / F.sqrt("seeds")
    return a.select("seeds", "mean", "std", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def paired(left: DataFrame, right: DataFrame, key: str, metric: str) -> DataFrame:
    """(key, diff) where both sides have a value."""
    a, b = left.select(key, F.col(metric).alias("a")), right.select(key, F.col(metric).alias("b"))
    return a.join(b, key).where("a is not null and b is not null").select(key, (F.col("a") - F.col("b")).alias("diff"))


def unpaired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, key) of keys that only one side has."""
    one = lambda x, y, n: x.select(key).distinct().join(y.select(key).distinct(), key, "left_anti").select(F.lit(n).alias("side"), key)
    return one(left, right, "left").unionByName(one(right, left, "right"))


def same_population(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: are the keys of both sides the same set?"""
    return unpaired(left, right, key).agg((F.count(F.lit(1)) == 0).alias("same"), F.count(F.lit(1)).alias("differences"))


def factorial(arms: dict[str, DataFrame], key: str, metric: str) -> DataFrame:
    """(contrast, mean, n) of the 2x2 design full, next, hop, none: the interaction and the six differences."""
    named = [arms[a].select(key, F.col(metric).alias(a)) for a in ("full", "next", "hop", "none")]
    j = reduce(lambda x, y: x.join(y, key), named).na.drop()
    c = F.col
    contrasts = {
        "interaction": c("full") - c("next") - c("hop") + c("none"), "full_minus_none": c("full") - c("none"), "full_minus_next": c("full") - c("next"),
        "full_minus_hop": c("full") - c("hop"), "next_minus_none": c("next") - c("none"), "hop_minus_none": c("hop") - c("none"), "next_minus_hop": c("next") - c("hop"),
    }
    return j.select(*(v.alias(k) for k, v in contrasts.items())).unpivot([], list(contrasts), "contrast", "value").groupBy("contrast").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def failures(rows: DataFrame, primary: str, error: str, doc_match: str, latency: str, key: str, n: int = 30) -> DataFrame:
    """The ``n`` worst rows: errors and scores below 1; lowest score first, then best document match, then slowest."""
    bad = rows.where(F.col(error).isNotNull() | (F.col(primary) < 1))
    return bad.orderBy(F.col(primary).asc_nulls_first(), F.col(doc_match).desc_nulls_last(), F.col(latency).desc_nulls_last(), F.col(key)).limit(n)


def run_status(rows: DataFrame, expected: int, error: str) -> DataFrame:
    return rows.agg(F.when(F.coalesce(F.bool_and(F.col(error).isNotNull()), F.lit(False)), "failed").when(F.count(F.lit(1)) < expected, "in_progress").otherwise("completed").alias("status"))


def compact_rows(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Report rows: unavailable metrics as -1."""
    return rows.withColumns({m: F.coalesce(m, F.lit(-1.0)) for m in metrics})


def flatten(df: DataFrame) -> DataFrame:
    """Struct fields as columns with dotted names."""
    from pyspark.sql import types as T

    def walk(prefix: list[str], fields) -> list[Column]:
        out = []
        for f in fields:
            path = [*prefix, f.name]
            out += walk(path, f.dataType.fields) if isinstance(f.dataType, T.StructType) else [F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path))]
        return out

    return df.select(*walk([], df.schema.fields))


def cost(wall: Column, done: Column, complete: Column, resumed: Column) -> Column:
    """Seconds an item, for complete runs that were not resumed."""
    return F.when(complete & ~resumed & (wall > 0) & (done > 0), wall / done)
