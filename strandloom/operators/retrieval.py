"""Fusion of ranked channels into candidates, and selection from them. Every order is total: ties are part of the contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.text import node_identity
from strandloom.functions.vectors import HOT_ROWS, bridged, cosine, rank_whole, rank_within, running_whole
from strandloom.session import materialize

K = 12
#: Children searched for each owner wanted: three questions a passage, the body itself.
WIDTH = {"q_minus": 3, "q_plus": 3, "body": 1}


def reciprocal(rank1: Column) -> Column:
    return 1.0 / rank1


def owner_collapse(hits: DataFrame, limit: int) -> DataFrame:
    """(query_id, owner_id, score, matched): best score and sorted question ids of each owner, the first ``limit`` owners."""
    g = hits.groupBy("query_id", "owner_id").agg(F.max("score").alias("score"), F.sort_array(F.collect_set("question_id")).alias("matched"))
    return rank_within(g, ["query_id"], [F.col("score").desc(), F.col("owner_id").asc()], limit)


def hybrid(hits: DataFrame, limit: int | None) -> DataFrame:
    """(query_id, channel, id, rrf, matched, rank): vector and text hits of a channel by sum of 1/rank.

    ``hits``: query_id, channel, type, id, score, matched (array). Ranks within a modality: score down, id up.
    """
    r = rank_whole(hits, ["query_id", "channel", "type"], [F.col("score").desc(), F.col("id").asc()])
    g = r.groupBy("query_id", "channel", "id").agg(
        F.sum(reciprocal(F.col("rank"))).alias("rrf"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched")))).alias("matched")
    )
    return rank_within(g, ["query_id", "channel"], [F.col("rrf").desc(), F.col("id").asc()], limit)


def role_union(channels: DataFrame) -> DataFrame:
    """(query_id, id, representation_score, representation_scores): full union of the channels, each adding 1/its rank."""
    r = rank_within(channels, ["query_id", "channel"], [F.col("rrf").desc(), F.col("id").asc()])
    per = F.struct("channel", reciprocal(F.col("rank")).alias("s"))
    return r.groupBy("query_id", "id").agg(F.sum(reciprocal(F.col("rank"))).alias("representation_score"), F.map_from_entries(F.array_sort(F.collect_list(per))).alias("representation_scores"))


def score_bodies(candidates: DataFrame, queries: DataFrame, semantics: str = "body") -> DataFrame:
    """Candidates with similarity_score and final_score; ``bridge`` takes the smaller of body and best bridge."""
    c = candidates.join(queries.select("query_id", F.col("embedding").alias("__q")), "query_id")
    c = c.withColumn("similarity_score", cosine(F.col("embedding"), F.col("__q")))
    if semantics == "bridge":
        return c.withColumn("final_score", bridged(F.col("similarity_score"), F.col("bridge_embeddings"), F.col("__q"))).drop("__q")
    if semantics != "body":
        raise ValueError(semantics)
    return c.withColumn("final_score", F.col("similarity_score")).drop("__q")


def rank_fusion(candidates: DataFrame, k: int | None = K, *, weight: float | None = None, variant: str = "fusion", by: tuple[str, ...] = ("query_id",), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Candidates with semantic_rank, representation_rank, rank_fusion_score and rank.

    The score is 1/semantic rank plus, for a positive representation score, 1/its rank. Order: fusion, final, id, all down.
    ``weight`` w gives ``w * first + (1-w) * second``; ``representation_only`` and ``similarity_only`` order by one rank.
    """
    final, rep = F.coalesce("final_score", F.lit(0.0)), F.coalesce("representation_score", F.lit(0.0))
    c = materialize(candidates, "fusion-pool")  # counted, then ranked twice
    c = rank_whole(c, list(by), [final.desc(), F.col("id").desc()], "semantic_rank", hot_rows, ("representation_rank", [rep.desc(), F.col("id").desc()]))
    sem = reciprocal(F.col("semantic_rank"))
    inh = F.when(rep > 0, reciprocal(F.col("representation_rank"))).otherwise(0.0)
    c = c.withColumn("rank_fusion_score", sem + inh if weight is None else weight * sem + (1 - weight) * inh)
    order = {
        "fusion": [F.col("rank_fusion_score").desc(), final.desc(), F.col("id").desc()],
        "representation_only": [F.col("representation_rank").asc()],
        "similarity_only": [F.col("semantic_rank").asc()],
    }[variant]
    return rank_within(c, list(by), order, k)


def raw_scores(hits: DataFrame, edges: DataFrame | None = None, decay: float = 0.5) -> DataFrame:
    """(query_id, id, raw_score, direct): the sum of a passage's own channel scores instead of its ranks in them.

    ``hits``: query_id, channel, id, rrf, as :func:`hybrid` gives them. With ``edges`` (src_id, dst_id) a passage that no
    channel found has the best decayed score of a found neighbour.
    """
    own = hits.groupBy("query_id", "id").agg(F.sum("rrf").alias("raw_score"))
    direct = own.withColumn("direct", F.lit(True))
    if edges is None:
        return direct
    near = own.withColumnRenamed("id", "src_id").join(edges.select("src_id", F.col("dst_id").alias("id")), "src_id")
    near = near.groupBy("query_id", "id").agg((F.max("raw_score") * decay).alias("raw_score")).join(own.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return direct.unionByName(near.withColumn("direct", F.lit(False)))


def select_variants(candidates: DataFrame, k: int = K) -> DataFrame:
    """(variant, query_id, id, rank): the first ``k`` of each deterministic order over one pool; cut before any source dedupe.

    ``raw`` orders by ``raw_score`` (null as 0), then by id, both down. The pool is written and ranked once for the others.
    """
    c = rank_fusion(candidates, None)
    first = lambda d, name, rank: d.where(F.col(rank) <= k).select(F.lit(name).alias("variant"), "query_id", "id", F.col(rank).alias("rank"))
    raw = rank_within(c.drop("rank"), ["query_id"], [F.coalesce("raw_score", F.lit(0.0)).desc(), F.col("id").desc()], k)
    return first(c, "fused", "rank").unionByName(first(c, "representation", "representation_rank")).unionByName(first(raw, "raw", "rank"))


def ranking_pool(candidates: DataFrame) -> DataFrame:
    """Ordered candidates, the first of each identity; blank identities drop out."""
    ident = node_identity(*(F.col(c) for c in ("id", "title", "source", "page", "sent_id")))
    c = candidates.withColumn("identity", ident).where(F.regexp_replace("identity", ":", "") != "")
    return rank_within(c, ["query_id", "identity"], [F.col("rank").asc()], 1, "__n").drop("__n")


def fill(ranked: DataFrame, canonical: DataFrame, k: int = K) -> DataFrame:
    """A short ranking (query_id, id, pos), its repeats kept, continued in canonical order (query_id, id, rank) to ``k``."""
    rest = canonical.join(ranked.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", F.lit(1).alias("part"), F.col("rank").alias("pos"))
    both = ranked.select("query_id", "id", F.lit(0).alias("part"), "pos").unionByName(rest)
    return rank_within(both, ["query_id"], [F.col("part").asc(), F.col("pos").asc()], k).select("query_id", "id", "rank")


def unique_sources(selected: DataFrame) -> DataFrame:
    """Source records: the first of each (source, page, sent_id) in rank order, ranked anew."""
    s = rank_within(selected, ["query_id", "source", "page", "sent_id"], [F.col("rank").asc()], 1, "__n").drop("__n")
    return rank_within(s.withColumnRenamed("rank", "__r"), ["query_id"], [F.col("__r").asc()]).drop("__r")


def dependency_free(df: DataFrame) -> DataFrame:
    """Without the columns that only scoring needs."""
    return df.drop("embedding", "bridge_embeddings", "representation_rank", "semantic_rank", "similarity_score", "bridge_similarity_score")


def excluded(candidates: DataFrame, ids: DataFrame) -> DataFrame:
    return candidates.join(ids.select("id").distinct(), "id", "left_anti")


def channel_filter(hits: DataFrame, variant: str = "full") -> DataFrame:
    """All three channels, or the bodies alone."""
    return hits if variant == "full" else hits.where("channel = 'body'")


def token_prefix(ranked: DataFrame, budget: int | Column, *, tokens: str = "tokens", keep: str | None = None, by: tuple[str, ...] = ("query_id",), hot_rows: int = HOT_ROWS) -> DataFrame:
    """The longest whole-passage prefix of each query's ranking within ``budget`` tokens; it stops at the first overflow.

    ``budget`` is a number or a column that is one value a query. With ``keep``, rows where it is true are admitted first and
    always. Null and negative sizes count as 0, so the running sum never falls and its first overflow ends the prefix.
    """
    must = F.coalesce(F.col(keep), F.lit(False)) if keep else F.lit(False)
    size = F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0)).cast("long")
    c = running_whole(ranked, list(by), [must.desc(), F.col("rank").asc()], size, "used_tokens", hot_rows)
    return c.where(must | (F.col("used_tokens") <= budget))
