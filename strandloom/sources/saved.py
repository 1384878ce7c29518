"""Saved inputs and outputs: query manifests, results, traces, reader inputs and logs, archived samples."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.text import u_trim
from strandloom.operators.store import require_unique, sequence_gaps, verify_payloads

QUERY = "_id string, original_query_id string, query string, ground_truth string, question_type string, category string, dataset string, evidence_docs array<string>, evidence_facts array<string>, answer_aliases array<string>"
EVENT = "sequence long, event string, time_ns long, pid long, span_id string, parent_id string, source string, query_id string, error string, payload string, payload_sha256 string"
READER_INPUT = "dataset string, method string, query_id string, original_query_id string, query string, context string, context_sha256 string, question_type string"


def query_manifest(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """(ord, query fields): a JSON array of queries in file order; ``first`` keeps the first so many, by position."""
    text = spark.read.text(path, wholetext=True)
    q = text.select(F.posexplode(F.from_json("value", f"array<struct<{_colons(QUERY)}>>")).alias("ord", "q")).select("ord", "q.*")
    return q if first is None else q.where(F.col("ord") < first)


def _colons(ddl: str) -> str:
    return ", ".join(f"`{n}`: {t}" for n, t in (x.strip().split(" ", 1) for x in _fields(ddl)))


def _fields(ddl: str) -> list[str]:
    out, depth, last = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(last)
            last = ""
        else:
            last += ch
    return [*out, last]


def results(spark: SparkSession, path: str, schema: str, key: str = "query_id") -> DataFrame:
    """Saved result rows, .json or JSON lines; a repeated key fails the job."""
    return require_unique(spark.read.schema(schema).option("multiLine", path.endswith(".json")).json(path), key)


def excluded_ids(spark: SparkSession, path: str) -> DataFrame:
    """(query_id) of a JSON list of ids or of rows that have one; blanks fail the job."""
    text = spark.read.text(path, wholetext=True)
    x = text.select(F.explode(F.from_json("value", "array<string>")).alias("x"))
    ident = u_trim(F.coalesce(F.get_json_object("x", "$.query_id"), F.get_json_object("x", "$._id"), F.col("x")))
    ids = x.select(ident.alias("query_id"))
    return ids.where(F.assert_true(F.col("query_id") != "", F.lit("blank query id")).isNull()).distinct()


def trace(spark: SparkSession, path: str, *, source: str | None = None, query_id: str | None = None, errors: bool = False) -> DataFrame:
    """Trace events, filtered; filters are pushed to the scan where the format allows."""
    e = spark.read.schema(EVENT).json(path)
    if source is not None:
        e = e.where(F.col("source") == source)
    if query_id is not None:
        e = e.where(F.col("query_id") == query_id)
    return e.where("error is not null") if errors else e


def trace_faults(events: DataFrame) -> DataFrame:
    """(fault, n): numbers that do not follow each other within a process, and payloads that do not have their digest."""
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("fault"), "n")
    return n(sequence_gaps(events, "pid", "sequence"), "sequence").unionByName(n(verify_payloads(events, "payload", "payload_sha256"), "payload"))


def one_event_each(events: DataFrame, name: str) -> DataFrame:
    """The events of a name, exactly one a query; a second one fails the job."""
    return require_unique(events.where(F.col("event") == name), "query_id")


def reader_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Recorded reader inputs with ``group_no``: groups of dataset and method in the order in which they first appear."""
    from pyspark.sql import Window as W

    r = spark.read.schema(READER_INPUT).json(path).withColumn("ord", F.monotonically_increasing_id())
    first = r.groupBy("dataset", "method").agg(F.min("ord").alias("first"))  # a handful of groups
    first = first.withColumn("group_no", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("first")) - 1).drop("first")
    return r.join(first, ["dataset", "method"])


def archived_samples(spark: SparkSession, path: str, name: str = "samples") -> DataFrame:
    """(repeat, query_ix, arm, slot, node_ix) of an archived four-dimensional array, its padding of -1 dropped.

    Read on the driver, once, to be written as a table: the archive is a single file of bounded size.
    """
    import numpy as np
    import pandas as pd

    a = np.load(Path(path))[name]
    at = np.argwhere(a >= 0)
    cols = dict(zip(("repeat", "query_ix", "arm", "slot"), at.T.astype("int32")))
    return spark.createDataFrame(pd.DataFrame({**cols, "node_ix": a[tuple(at.T)].astype("int64")}))


MANIFEST = "corpus string, sha256 string, documents long, files array<struct<name: string, sha256: string>>"


def corpus_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(corpus, sha256, documents, files) of a manifest; an empty table where there is none."""
    try:
        return spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    except Exception as e:  # noqa: BLE001 - a manifest is optional
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)


def manifest_of_queries(spark: SparkSession, queries: str, name: str = "corpus_manifest.json") -> DataFrame:
    """The corpus manifest next to a query file."""
    return corpus_manifest(spark, queries.rsplit("/", 1)[0] + "/" + name)


def manifest_faults(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, fault) of files (name, sha256) that are missing, not in the manifest, or changed."""
    m = manifest.select(F.explode("files").alias("f")).select("f.name", F.col("f.sha256").alias("then"))
    j = files.select("name", F.col("sha256").alias("now")).join(m, "name", "full_outer")
    fault = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "unlisted").when(F.col("now") != F.col("then"), "changed")
    return j.select("name", fault.alias("fault")).where("fault is not null")


def sampled_names(names: list[str], count: int, seed: int = 42) -> list[str]:
    """A sample of file names that depends on the seed and the names alone, in order; Python's own stream over sorted names.

    Names of a corpus directory, which a driver lists anyway; the documents are then filtered by them.
    """
    import random

    return sorted(random.Random(seed).sample(sorted(names), count))


def smoke_fixture(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(docs, queries): two documents of which the second answers what the first leads to, and one question over both."""
    docs = spark.createDataFrame([("first.txt", "Title: First\nThe bridge at Arn was built by Ilva Tern."), ("second.txt", "Title: Second\nIlva Tern was born in Korsa.")], "source string, content string")
    queries = spark.createDataFrame([("smoke", "smoke", "Where was the builder of the bridge at Arn born?", "Korsa", "inference_query", ["First", "Second"], ["The bridge at Arn was built by Ilva Tern.", "Ilva Tern was born in Korsa."])], "query_id string, original_query_id string, query string, ground_truth string, question_type string, evidence_docs array<string>, evidence_facts array<string>")
    return docs, queries


def frozen_inputs(queries: DataFrame, frozen: DataFrame, by: str = "query") -> DataFrame:
    """Queries with their frozen direct inputs, found by the digest of the query or, by ``query_id``, by the occurrence; one
    that is not there fails the job, as nothing may be searched again."""
    key = F.sha2("query", 256) if by == "query" else F.col("query_id")
    j = queries.withColumn("__k", key).join(frozen.select(F.col("key").alias("__k"), "inputs"), "__k", "left")
    return j.where(F.assert_true(F.col("inputs").isNotNull(), F.lit("a query has no frozen inputs")).isNull()).drop("__k")


def metadata_json(articles: DataFrame) -> DataFrame:
    """(source, value): the metadata file's entries of articles that have their unique file names."""
    from strandloom.sources.corpus import source_metadata

    m = source_metadata(articles)
    return m.select("source", F.to_json(F.struct(*(c for c in m.columns if c != "source"))).alias("value"))


def steps(trace: str = "trace", keep: tuple[str, ...] = ("step", "query", "returned")) -> object:
    """Trace steps cut to what a report shows."""
    return F.transform(trace, lambda s: F.struct(*(s[k].alias(k) for k in keep)))
