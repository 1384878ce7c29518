"""Problem 7: evaluation items inside documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.leak import contained, leaks
from strandloom.session import table


def passages(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "eval_items")
    return items.select("item_id", F.explode(F.array_append(F.coalesce("evidence_facts", F.array().cast("array<string>")), F.col("query"))).alias("passage"))


def _named(found: DataFrame) -> DataFrame:
    return found.withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def p7_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return _named(leaks(table(spark, sf, "documents"), "doc_id", "text", passages(spark, sf), "item_id", "passage"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_leaks(spark, sf).select("doc_id", "item_id")


def p7_contained(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold four fifths and more of a passage's five-word shingles, though words of it may be changed."""
    c = _named(contained(table(spark, sf, "documents"), "doc_id", "text", passages(spark, sf), "item_id", "passage"))
    return c.withColumn("containment", F.round("containment", 6))


_WORDS = r"list_filter(string_split_regex(replace(lower({}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_PARTS = r"""
with p as (select item_id, unnest(list_append(coalesce(evidence_facts, []), query)) t from eval_items),
pw as (select distinct item_id, {pw} w from p where t is not null), dw as (select doc_id, {dw} w from documents where text is not null),
""".format(pw=_WORDS.format("t"), dw=_WORDS.format("text"))
_RUNS = _PARTS + r"""
pr as (select distinct item_id, array_to_string(w[i : i + 9], ' ') r from (select item_id, w, unnest(range(1, len(w) - 8)) i from pw where len(w) >= 10)),
dr as (select distinct doc_id, array_to_string(w[i : i + 9], ' ') r from (select doc_id, w, unnest(range(1, len(w) - 8)) i from dw where len(w) >= 10))
"""
_SHARES = _PARTS + r"""
ps as (select distinct item_id, w, array_to_string(w[i : i + 4], ' ') s from (select item_id, w, unnest(range(1, len(w) - 3)) i from pw where len(w) >= 5)),
ds as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') s from (select doc_id, w, unnest(range(1, len(w) - 3)) i from dw where len(w) >= 5)),
n as (select item_id, w, count(*) n from ps group by item_id, w), h as (select doc_id, item_id, w, count(*) k from ds join ps using (s) group by doc_id, item_id, w)
select doc_id, item_id, round(max(k / n), 6) as containment from h join n using (item_id, w) where k / n >= 0.8 group by doc_id, item_id
"""
QUERIES = {"p7_found": p7_found, "p7_leaks": p7_leaks, "p7_contained": p7_contained}
SQL = {
    "p7_found": _RUNS + "select distinct doc_id, item_id from dr join pr using (r)",
    "p7_leaks": _RUNS + "select doc_id, item_id, count(*) as windows from dr join pr using (r) group by doc_id, item_id",
    "p7_contained": _SHARES,
}
