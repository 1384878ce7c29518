"""Problem 8: abusive, hateful and sexually explicit documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.abuse import Model, score, train
from strandloom.session import materialize, table

THRESHOLD = 0.5


def model(spark: SparkSession, sf: str) -> Model:
    return train(table(spark, sf, "review_labels"), "excerpt", "label")


def p8_scores(spark: SparkSession, sf: str) -> DataFrame:
    return score(table(spark, sf, "documents"), "doc_id", "text", model(spark, sf))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_scores(spark, sf).where(F.col("score") >= THRESHOLD).select("doc_id")


def by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Scores and sources come from one table in one pass each and meet on the document."""
    scored = materialize(p8_scores(spark, sf), "abuse-scores")
    return table(spark, sf, "documents").select("doc_id", "source").join(scored, "doc_id")


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, flagged documents and their rate by source; documents without source are a group of their own."""
    flagged = F.col("score") >= THRESHOLD
    return by_source(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(flagged).alias("flagged"), F.round(F.avg(flagged.cast("double")), 6).alias("rate"))


def p8_scored(spark: SparkSession, sf: str) -> DataFrame:
    """What holds of any classifier's scores: every document of every source has one, within 0 and 1, and one without a
    letter or digit has no sentence. The rates are over these documents."""
    s = by_source(spark, sf)
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("score").between(0, 1)).alias("in_range"), F.count_if(F.col("sentences") == 0).alias("silent"))


QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates, "p8_scored": p8_scored}
SQL = {
    "p8_scored": r"select source, count(*) as documents, count(*) as in_range, count(*) filter (where not regexp_matches(coalesce(text, ''), '[\p{L}\p{N}]')) as silent from documents group by source",
}
