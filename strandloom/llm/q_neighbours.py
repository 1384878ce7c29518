"""Problem 2: the five most similar vectors of every vector of the embedding cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.neighbours import similar
from strandloom.session import table

K, SIZE, MIN_COSINE = 5, 64, 0.90


def _similar(spark: SparkSession, sf: str, least: float | None) -> DataFrame:
    return similar(table(spark, sf, "embedding_cache"), "cache_key", "vector_json", k=K, size=SIZE, min_cosine=least, newest="written_at")


def p2_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The list of every vector, however far its neighbours are."""
    return _similar(spark, sf, None)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Only near neighbours, which the buckets can filter by."""
    n = _similar(spark, sf, MIN_COSINE)
    return n.select(F.least("key", "neighbour").alias("key_a"), F.greatest("key", "neighbour").alias("key_b")).distinct()


QUERIES = {"p2_found": p2_found, "p2_neighbours": p2_neighbours}
