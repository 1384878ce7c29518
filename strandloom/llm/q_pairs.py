"""Problem 1: reader responses that fail their question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.pairs import DEFECTS, label_pairs
from strandloom.session import materialize, table

KEYS = ["dataset", "method", "query_id"]


def joined(spark: SparkSession, sf: str) -> DataFrame:
    """Each input, as last saved, with its last completed response; inputs without one and responses without input drop out."""
    inputs = table(spark, sf, "synthesis_inputs").groupBy(*KEYS).agg(F.max(F.struct("saved_utc", "query", "context", "question_type")).alias("i"))
    done = table(spark, sf, "reader_responses").where("status = 'completed'").groupBy(*KEYS).agg(F.max(F.struct("completed_utc", "answer")).alias("r"))
    return inputs.join(done, KEYS).select(*KEYS, "i.query", "i.context", "i.question_type", "r.answer")


def p1_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Every label kept, several to a pair if need be."""
    return label_pairs(materialize(joined(spark, sf), "pairs"), KEYS).withColumn("posterior", F.round("posterior", 6))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The likeliest label of each pair, earlier in the order of DEFECTS at a tie; refusals of null queries are right answers.

    A pair that is such a refusal has no defect at all: it has the sentence that a null query asks for, which may stay in one
    language whatever the query's, and is then not to come out as an answer in another language.
    """
    pairs = materialize(joined(spark, sf), "pairs")
    order = F.array_position(F.lit(list(DEFECTS)), F.col("defect"))
    best = F.min(F.struct((-F.round("posterior", 2)).alias("p"), order.alias("o"), "defect")).alias("best")
    labels = label_pairs(pairs, KEYS).groupBy(*KEYS).agg(best, F.bool_or(F.col("defect") == "refusal").alias("refuses"))
    right = F.col("refuses") & (F.coalesce("question_type", F.lit("")) == "null_query")
    return labels.join(pairs.select(*KEYS, "question_type"), KEYS).where(~right).select(*KEYS, F.col("best.defect").alias("defect"))


QUERIES = {"p1_found": p1_found, "p1_labels": p1_labels}
