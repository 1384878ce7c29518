"""Problem 6: documents in containers of 512 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.pack import pack, token_count
from strandloom.session import table

CAPACITY = 512


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", token_count(F.col("text")), CAPACITY).withColumnRenamed("key", "doc_id")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """A document is divided if and only if it has a second piece."""
    return p6_containers(spark, sf).where("piece = 1").select("doc_id").distinct()


def p6_totals(spark: SparkSession, sf: str) -> DataFrame:
    """What every packing must agree in: pieces and tokens that came out, and no container above its capacity."""
    per = p6_containers(spark, sf).groupBy("bucket", "container").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"))
    return per.agg(F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), (F.max("tokens") > CAPACITY).cast("int").alias("over"))


def p6_documents(spark: SparkSession, sf: str) -> DataFrame:
    """What every packing must agree in for each document: its pieces, their tokens, and that they follow on each other."""
    c = p6_containers(spark, sf)
    ends = F.max(F.col("token_start") + F.col("tokens")) == F.sum("tokens")
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"), ends.alias("whole"))


_N = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f\x0b\x85\p{Z}]+'))"
QUERIES = {"p6_found": p6_found, "p6_containers": p6_containers, "p6_totals": p6_totals, "p6_documents": p6_documents}
SQL = {
    "p6_documents": f"select doc_id, cast(ceil(n / 512.0) as bigint) as pieces, cast(n as bigint) as tokens, true as whole from (select doc_id, {_N} n from documents where text is not null) where n > 0",
    "p6_found": f"select doc_id from documents where text is not null and {_N} > 512",
    "p6_totals": f"select cast(sum(ceil(n / 512.0)) as bigint) as pieces, cast(sum(n) as bigint) as tokens, 0 as over from (select {_N} n from documents where text is not null)",
}
