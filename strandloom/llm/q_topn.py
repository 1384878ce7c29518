"""Problem 5: the twelve best passages of every query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.topn import top_n_per_group
from strandloom.session import table

N = 12


def _top(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "retrieval_candidates").select("query_id", "id", "rank_fusion_score", F.coalesce("final_score", F.lit(0.0)).alias("final_score"))
    score = F.col("rank_fusion_score")
    rows = rows.where(F.col("query_id").isNotNull() & F.col("id").rlike(r"(?U)\S") & score.isNotNull() & ~F.isnan(score) & (score != -1.0))
    order = [F.col("rank_fusion_score").desc(), F.col("final_score").desc(), F.col("id").desc()]
    return top_n_per_group(rows, ["query_id"], order, N, distinct="id")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf).select("query_id", "id")


def p5_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf).select("query_id", "id", "rank", F.round("rank_fusion_score", 6).alias("score"), F.round("final_score", 6).alias("final"))


_RANKED = r"""
with ok as (
  select query_id, id, rank_fusion_score s, coalesce(final_score, 0) f from retrieval_candidates
  where query_id is not null and regexp_matches(id, '\S') and rank_fusion_score is not null and not isnan(rank_fusion_score) and rank_fusion_score <> -1),
best as (select *, row_number() over (partition by query_id, id order by s desc, f desc) k from ok),
ranked as (select *, row_number() over (partition by query_id order by s desc, f desc, id desc) r from best where k = 1)
"""
QUERIES = {"p5_found": p5_found, "p5_ranked": p5_ranked}
SQL = {
    "p5_found": _RANKED + "select query_id, id from ranked where r <= 12",
    "p5_ranked": _RANKED + "select query_id, id, cast(r as integer) as rank, round(s, 6) as score, round(f, 6) as final from ranked where r <= 12",
}
