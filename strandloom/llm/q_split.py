"""Problem 3: paragraphs and register files above 1,000 characters in pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.split import split_oversized
from strandloom.session import table


def _items(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda name, key, text, is_json: table(spark, sf, name).select(F.lit(name).alias("item_table"), F.col(key).alias("item_key"), F.col(text).alias("raw"), F.lit(is_json).alias("is_json"))
    return one("paragraphs", "source_id", "sentences", True).unionByName(one("museum_rich_entities_v2", "filename", "text", False))


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_oversized(_items(spark, sf))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_pieces(spark, sf).where("piece_no = 1").select("item_table", "item_key").distinct()


def p3_cover(spark: SparkSession, sf: str) -> DataFrame:
    """What holds of any right cutting of an item's texts: their characters all come out, once but for the overlaps, in pieces
    of at most 1,000 that follow on each other."""
    from pyspark.sql import Window as W

    n = F.length("piece")
    by = W.partitionBy("item_table", "item_key", "text_hash").orderBy("piece_no")  # the pieces of one text
    p = p3_pieces(spark, sf).withColumn("n", n).withColumn("next", F.lag(F.col("start") + n - 100).over(by))
    ok = (F.col("n") <= 1000) & (F.col("start") == F.coalesce("next", F.lit(0)))
    g = p.groupBy("item_table", "item_key").agg(F.count_distinct("text_hash").alias("texts"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("pieces"), F.bool_and(ok).alias("sound"))
    return g.select("item_table", "item_key", "texts", (F.col("n") - 100 * (F.col("pieces") - F.col("texts"))).alias("chars"), "sound")


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces, "p3_cover": p3_cover}
SQL = {
    "p3_cover": """
with ok as (select distinct source_id, sentences, case when json_valid(sentences) and json_type(sentences) = 'ARRAY' then sentences end j from paragraphs),
p as (select source_id, array_to_string(from_json(j, '["VARCHAR"]'), '') t from ok where j is not null and len(list_filter(from_json(j, '["JSON"]'), lambda x: json_type(x) <> 'VARCHAR')) = 0),
x as (select 'paragraphs' item_table, source_id item_key, t from p union all select 'museum_rich_entities_v2', filename, text from (select distinct filename, text from museum_rich_entities_v2))
select item_table, item_key, count(*) as texts, cast(sum(length(t)) as bigint) as chars, true as sound from x where length(t) > 1000 group by item_table, item_key""",
    "p3_found": """
with ok as (select source_id, case when json_valid(sentences) and json_type(sentences) = 'ARRAY' then sentences end j from paragraphs),
p as (select source_id, array_to_string(from_json(j, '["VARCHAR"]'), '') t from ok
      where j is not null and len(list_filter(from_json(j, '["JSON"]'), lambda x: json_type(x) <> 'VARCHAR')) = 0)
select distinct 'paragraphs' as item_table, source_id as item_key from p where length(t) > 1000
union all
select distinct 'museum_rich_entities_v2', filename from museum_rich_entities_v2 where length(text) > 1000
"""
}
