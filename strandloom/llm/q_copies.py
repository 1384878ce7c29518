"""Problem 4: passages that differ only in formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.copies import copies, copy_keys, copy_sets
from strandloom.session import table

#: The labels of a register card.
LABELS = ("Object", "Maker", "Owner", "Year", "City", "Shelf", "Inventory", "Lent to")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return copies(table(spark, sf, "chunks"), "record_id", "text", LABELS).select(F.col("kept").alias("kept_record_id"), F.col("copy").alias("copy_record_id"))


def p4_records(spark: SparkSession, sf: str) -> DataFrame:
    """One row per set of copies, sets of one included."""
    keyed = copy_keys(table(spark, sf, "chunks"), "record_id", "text", LABELS)
    return copy_sets(keyed, "record_id").select(F.col("kept").alias("record_id"), "copies")


_FORM = r"""
with raw as (select record_id, text, replace(replace(lower(upper(text)), 'ẞ', 'ss'), 'ß', 'ss') t from chunks where text is not null),
parts as (select record_id, t, string_split(regexp_replace(replace(t, chr(8203), ''),
  '(^|[{;|,\n\r])[^\p{L}\p{N};|\n\r]*((object|maker|owner|year|city|shelf|inventory|lent\s+to)[\s"]*:)', chr(1) || '\2', 'g'), chr(1)) p from raw),
forms as (select record_id, case
  when len(p) > 1 and regexp_replace(p[1], '[^\p{L}\p{N}]+', '', 'g') = ''
  then 'c:' || array_to_string(list_sort(list_transform(p[2:], lambda f: regexp_replace(split_part(f, ':', 1), '[^\p{L}\p{N}]+', '', 'g') || '=' || regexp_replace(substr(f, instr(f, ':') + 1), '[^\p{L}\p{N}]+', '', 'g'))), ';')
  else 'p:' || regexp_replace(t, '[^\p{L}\p{N}]+', '', 'g') end form from parts),
sets as (select form, min(record_id) kept, count(*) copies from forms where form <> 'p:' group by form)
"""
QUERIES = {"p4_found": p4_found, "p4_records": p4_records}
SQL = {
    "p4_found": _FORM + "select kept as kept_record_id, record_id as copy_record_id from forms join sets using (form) where record_id <> kept",
    "p4_records": _FORM + "select kept as record_id, copies from sets",
}
