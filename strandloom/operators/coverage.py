"""Where gold evidence is lost: prefixes, coverage, witnesses, channels, strata, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.vectors import HOT_ROWS, running_whole
from strandloom.session import materialize


def prefix(pool: DataFrame, fractions: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(fraction, query_id, id): all starts and the first floor(f x extras) other candidates in saved order.

    ``pool``: query_id, id, ord, is_start; ``fractions``: fraction (a handful of rows).
    """
    other = (~F.col("is_start")).cast("int")
    p = running_whole(pool, ["query_id"], [F.col("ord").asc(), F.col("id").asc()], other, "nth", hot_rows)
    extras = pool.groupBy("query_id").agg(F.sum(other).alias("extras"))
    j = p.join(extras, "query_id").crossJoin(F.broadcast(fractions))
    return j.where(F.col("is_start") | (F.col("nth") <= F.floor(F.col("fraction") * F.col("extras")))).select("fraction", "query_id", "id")


def coverage(nodes: DataFrame, hits: DataFrame, *by: str) -> DataFrame:
    """(by, query_id, covered): distinct gold units that the nodes hold."""
    return nodes.join(hits, ["query_id", "id"]).groupBy(*by, "query_id").agg(F.count_distinct("unit").alias("covered"))


def witnesses(starts: DataFrame, graph: DataFrame, direct: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, unit, class): how a unit that the starts miss but the graph pool has is seen by the direct pool:
    shared_id (by the same passage), distinct_only (by others), graph_exclusive (not at all)."""
    flag = lambda d, n: d.select("query_id", "id").distinct().withColumn(n, F.lit(1))
    j = hits.distinct()
    for d, n in ((starts, "s"), (graph, "g"), (direct, "d")):
        j = j.join(flag(d, n), ["query_id", "id"], "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    u = j.groupBy("query_id", "unit").agg(F.max(z("s")).alias("s"), F.max(z("g")).alias("g"), F.max(z("d")).alias("d"), F.max(z("g") * z("d")).alias("both"))
    return u.where("g = 1 and s = 0").select("query_id", "unit", F.when(F.col("both") == 1, "shared_id").when(F.col("d") == 1, "distinct_only").otherwise("graph_exclusive").alias("class"))


def partition(graph: DataFrame, direct: DataFrame, hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, graph_only, direct_only, shared, unrecovered) counts of gold units. ``gold``: query_id, units."""
    flag = lambda d, n: d.select("query_id", "id").distinct().withColumn(n, F.lit(1))
    j = hits.distinct().join(flag(graph, "g"), ["query_id", "id"], "left").join(flag(direct, "d"), ["query_id", "id"], "left")
    u = j.groupBy("query_id", "unit").agg(F.coalesce(F.max("g"), F.lit(0)).alias("g"), F.coalesce(F.max("d"), F.lit(0)).alias("d"))
    n = u.groupBy("query_id").agg(F.count_if(F.col("g") > F.col("d")).alias("graph_only"), F.count_if(F.col("d") > F.col("g")).alias("direct_only"), F.count_if((F.col("d") == 1) & (F.col("g") == 1)).alias("shared"))
    j = gold.join(n, "query_id", "left").na.fill(0, ["graph_only", "direct_only", "shared"])
    return j.select("query_id", "graph_only", "direct_only", "shared", (F.col("units") - F.col("graph_only") - F.col("direct_only") - F.col("shared")).alias("unrecovered"))


def channel_classes(candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, unit, class): seen by bodies only, by questions only, or by both. ``candidates``: query_id, id, channel."""
    c = candidates.join(hits, ["query_id", "id"]).groupBy("query_id", "unit").agg(F.bool_or(F.col("channel") == "body").alias("b"), F.bool_or(F.col("channel").isin("q_minus", "q_plus")).alias("q"))
    return c.where("b or q").select("query_id", "unit", F.when(F.col("b") & F.col("q"), "both").when(F.col("b"), "body_only").otherwise("questions_only").alias("class"))


COMBINATIONS = ("body", "q_minus", "q_plus", "body+q_minus", "body+q_plus", "q_minus+q_plus", "body+q_minus+q_plus")


def channel_combinations(candidates: DataFrame) -> DataFrame:
    """(combination, n): candidates by the set of channels that found them; unseen combinations count zero."""
    per = candidates.where(F.col("channel").isin("body", "q_minus", "q_plus")).groupBy("query_id", "id").agg(F.array_join(F.sort_array(F.collect_set("channel")), "+").alias("combination"))
    n = per.groupBy("combination").agg(F.count(F.lit(1)).alias("n"))
    names = candidates.sparkSession.createDataFrame([(c,) for c in COMBINATIONS], "combination string")
    return names.join(n, "combination", "left").select("combination", F.coalesce("n", F.lit(0)).alias("n"))


def channel_retention(candidates: DataFrame, kept: DataFrame) -> DataFrame:
    """(combination, n, retained): candidates by the set of channels that found them, and how many of them were kept in the end.

    ``candidates``: query_id, id, channel; ``kept``: query_id, id. Repeated rows count once; unseen combinations count zero.
    """
    per = candidates.where(F.col("channel").isin("body", "q_minus", "q_plus")).groupBy("query_id", "id").agg(F.array_join(F.sort_array(F.collect_set("channel")), "+").alias("combination"))
    j = per.join(kept.select("query_id", "id", F.lit(1).alias("__kept")).distinct(), ["query_id", "id"], "left")
    n = j.groupBy("combination").agg(F.count(F.lit(1)).alias("n"), F.count("__kept").alias("retained"))
    names = candidates.sparkSession.createDataFrame([(c,) for c in COMBINATIONS], "combination string")
    return names.join(n, "combination", "left").na.fill(0, ["n", "retained"])


def curves(graph: DataFrame, direct: DataFrame, hits: DataFrame, gold: DataFrame, fractions: DataFrame) -> DataFrame:
    """(fraction, mean graph and direct recall, graph units that the direct prefix lacks) over the queries of ``gold``."""
    g = prefix(graph, fractions).join(hits, ["query_id", "id"]).select("fraction", "query_id", "unit").distinct()
    d = prefix(direct, fractions).join(hits, ["query_id", "id"]).select("fraction", "query_id", "unit").distinct()
    count = lambda x, n: x.groupBy("fraction", "query_id").agg(F.count(F.lit(1)).alias(n))
    only = g.join(d, ["fraction", "query_id", "unit"], "left_anti")
    base = gold.where("units > 0").crossJoin(F.broadcast(fractions))
    on = ["fraction", "query_id"]
    j = base.join(count(g, "g"), on, "left").join(count(d, "d"), on, "left").join(count(only, "o"), on, "left").na.fill(0, ["g", "d", "o"])
    return j.groupBy("fraction").agg(F.avg(F.col("g") / F.col("units")).alias("graph_recall"), F.avg(F.col("d") / F.col("units")).alias("direct_recall"), F.sum("o").alias("graph_only_units"), F.count(F.lit(1)).alias("queries"))


def strata(covered: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, stratum): none, partial or complete initial coverage."""
    j = gold.join(covered, "query_id", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return j.where("units > 0").select("query_id", F.when(F.col("covered") == 0, "none").when(F.col("covered") < F.col("units"), "partial").otherwise("complete").alias("stratum"))


def deficit_recovered(rows: DataFrame, initial: str, expanded: str) -> DataFrame:
    a, b = F.avg(initial), F.avg(expanded)
    return rows.agg(a.alias("initial"), b.alias("expanded"), F.try_divide(b - a, 1 - a).alias("recovered"))


def components(items: DataFrame, item: str, shared: str, rounds: int = 30) -> DataFrame:
    """(item, component): connected components of items that share a value, named by their least item.

    Labels alternate between items and values, each step two aggregations; no pairs of items are made, so a value shared
    by many costs its rows only. Every round's labels are written out, and pointer jumping halves the rounds left.
    """
    edges = materialize(items.select(F.col(item).alias("i"), F.col(shared).alias("v")).where("i is not null and v is not null").distinct(), "component-edges")
    labels = materialize(items.select(F.col(item).alias("i")).where("i is not null").distinct().select("i", F.col("i").alias("c")), "components")
    for _ in range(rounds):
        by_value = edges.join(labels, "i").groupBy("v").agg(F.min("c").alias("c"))
        near = edges.join(by_value, "v").groupBy("i").agg(F.min("c").alias("n"))
        new = labels.join(near, "i", "left").select("i", F.least("c", F.coalesce("n", "c")).alias("c"))
        jump = new.select(F.col("i").alias("c"), F.col("c").alias("j"))
        new = materialize(new.join(jump, "c").select("i", F.col("j").alias("c")), "components")
        changed = new.join(labels.withColumnRenamed("c", "old"), "i").where("c <> old").limit(1).count()
        labels = new
        if not changed:
            return labels.select(F.col("i").alias(item), F.col("c").alias("component"))
    raise RuntimeError("components did not settle; allow more rounds")
