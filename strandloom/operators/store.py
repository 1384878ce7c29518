"""Tables of an index: replacing documents, reconciling with a snapshot, append logs, resume, traces and exports."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions.text import digest
from strandloom.functions.vectors import rank_within


def replace_sources(old: DataFrame, new: DataFrame, key: str = "source") -> DataFrame:
    """Old rows without those of the new rows' documents, and the new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def reconcile(rows: DataFrame, snapshot: DataFrame, key: str = "source") -> DataFrame:
    """Rows of the documents that the snapshot still has."""
    return rows.join(snapshot.select(key).distinct(), key, "left_semi")


def upsert_table(spark: SparkSession, path: str, new: DataFrame, key: str = "source", buckets: int = 32) -> None:
    """Replace documents in a table partitioned by a bucket of the key; only the buckets that change are rewritten."""
    b = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    new = new.withColumn("bucket", b)
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001 - no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new.write.partitionBy("bucket").parquet(path)
        return
    touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
    whole = replace_sources(old.where(F.col("bucket").isin(touched)), new, key)
    staging = f"{path}.staging"
    whole.write.mode("overwrite").partitionBy("bucket").parquet(staging)  # read and write of one path must not overlap
    spark.read.parquet(staging).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def latest(log: DataFrame, keys: list[str], stamp: str, *ties: str) -> DataFrame:
    """The last row of each key in an append log."""
    return rank_within(log, keys, [F.col(stamp).desc_nulls_last(), *(F.col(t).desc_nulls_last() for t in ties)], 1, "__n").drop("__n")


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def reusable(wanted: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Logged rows whose keys (identity, request digest and model) are wanted as they are, once each."""
    return log.join(wanted.select(*keys).distinct(), keys, "left_semi").dropDuplicates(keys)


def insert_absent(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with a check in the plan: a repeated key fails the job."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    return df.withColumn("__n", n).where(F.assert_true(F.col("__n") == 1, F.lit("repeated key")).isNull()).drop("__n")


def sequence_gaps(events: DataFrame, stream: str, number: str) -> DataFrame:
    """Events whose number does not follow the one before in their stream."""
    prev = F.lag(number).over(W.partitionBy(stream).orderBy(number))
    return events.withColumn("previous", prev).where(F.col("previous").isNotNull() & (F.col(number) != F.col("previous") + 1))


def verify_payloads(events: DataFrame, payload: str, sha: str) -> DataFrame:
    """Events whose payload does not have its recorded digest."""
    return events.where(F.col(payload).isNotNull() & (F.sha2(payload, 256) != F.col(sha)))


def redact(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.regexp_replace(column, r'(?i)("?(?:api[_-]?key|authorization|token|password|secret)"?\s*[:=]\s*)("[^"]*"|\S+)', '$1"***"'))


def publish_text(path: str, text: str) -> None:
    """A file that is there whole or not at all."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=p.parent)
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, p)
    except BaseException:
        if os.path.exists(tmp):
            os.unlink(tmp)
        raise


def export_report(summary: dict, rows: DataFrame, directory: str) -> None:
    """Details as JSON lines first, the summary last: a summary without its details cannot be seen."""
    rows.write.mode("overwrite").json(f"{directory}/details")
    publish_text(f"{directory}/summary.json", json.dumps(summary, ensure_ascii=False, indent=1))


def comparison_csv(frames: dict[str, DataFrame], directory: str) -> None:
    """All methods' flattened rows in one table; columns in first-seen order, missing ones empty."""
    from strandloom.operators.reports import flatten

    out = None
    for name, df in frames.items():
        f = flatten(df).withColumn("method", F.lit(name))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    if out is not None:
        out.write.mode("overwrite").option("header", True).csv(directory)


def snapshot_row(spark: SparkSession, strategy: str, namespace: str, status: str, **counts: int) -> DataFrame:
    """The one-row state of an index: written as in_progress before a build and as complete after it."""
    if status not in ("in_progress", "complete"):
        raise ValueError(status)
    return spark.createDataFrame([(strategy, namespace, status, json.dumps(counts, sort_keys=True), digest({"strategy": strategy, "namespace": namespace, **counts}))], "strategy string, namespace string, status string, counts string, fingerprint string")


def cached(texts: DataFrame, cache: DataFrame, identity: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) against a cache keyed by the digest of an identity and the text."""
    keyed = texts.withColumn("cache_key", F.sha2(F.concat_ws("\u0001", F.lit(identity), "text"), 256))
    return keyed.join(cache, "cache_key"), keyed.join(cache.select("cache_key"), "cache_key", "left_anti")


def tagged(result: DataFrame, path: str, content_sha: str) -> DataFrame:
    """A single result's rows with where they come from and the digest of that file."""
    return result.withColumns({"source_path": F.lit(path), "source_sha256": F.lit(content_sha)})


def write_traces(events: DataFrame, directory: str, payload: str = "payload") -> None:
    """Traces as content-addressed payloads, each distinct one once and compressed, and events that name them by digest.

    Secrets are redacted before the digest. Payloads are written first: an event never names one that is not there.
    """
    e = redact(events, payload).withColumn("payload_sha256", F.sha2(payload, 256))
    e.where(F.col(payload).isNotNull()).select("payload_sha256", payload).dropDuplicates(["payload_sha256"]).write.mode("overwrite").option("compression", "gzip").json(f"{directory}/payloads")
    e.drop(payload).write.mode("overwrite").json(f"{directory}/events")


def read_traces(spark: SparkSession, directory: str, schema: str, payload: str = "payload") -> DataFrame:
    """The events with their payloads again; one whose digest is not the recorded one fails the job."""
    e = spark.read.schema(f"{schema}, payload_sha256 string").json(f"{directory}/events")
    p = spark.read.schema(f"payload_sha256 string, {payload} string").json(f"{directory}/payloads")
    j = e.join(p, "payload_sha256", "left")
    return j.where(F.assert_true(F.col("payload_sha256").isNull() | (F.sha2(payload, 256) == F.col("payload_sha256")), F.lit("a payload has another digest")).isNull())


def chunk_cache(docs: DataFrame, cache: DataFrame, source: str, content: str, signature: str) -> tuple[DataFrame, DataFrame]:
    """(cached rows, documents to make) against a cache keyed by source, digest of the content and signature of the policy."""
    keyed = docs.withColumns({"content_sha256": F.sha2(content, 256), "policy": F.lit(signature)})
    keys = [source, "content_sha256", "policy"]
    return cache.join(keyed.select(*keys).distinct(), keys, "left_semi"), keyed.join(cache.select(*keys).distinct(), keys, "left_anti")


def artifact(spark: SparkSession, kind: str, policy: dict, values: dict) -> DataFrame:
    """A one-row record of a run's statistics or failure with the digest of the policy it ran under."""
    return spark.createDataFrame([(kind, digest(policy), json.dumps(values, sort_keys=True, ensure_ascii=False))], "kind string, policy_sha256 string, values string")


def candidate_trace(ranked: DataFrame) -> DataFrame:
    """(query_id, rank, id, label): the order in which a ranker is shown its candidates, with their opaque labels."""
    from strandloom.functions.text import candidate_label

    return ranked.select("query_id", "rank", "id", candidate_label((F.col("rank") - 1).cast("int")).alias("label"))


def link_events(direct: DataFrame, expanded: DataFrame, selected: DataFrame) -> DataFrame:
    """(query_id, role, id): what links were used for, one row a passage and role; ``expanded`` has path_type."""
    one = lambda d, r: d.select("query_id", r.alias("role"), "id")
    return one(direct, F.lit("direct")).unionByName(one(expanded, F.col("path_type"))).unionByName(one(selected, F.lit("selected"))).distinct()


def resolve_artifact(artifacts: DataFrame, **wanted: str) -> DataFrame:
    """(state, path): exact for one valid artifact of these values, else missing, ambiguous, or invalid if none is valid."""
    a = artifacts
    for k, v in wanted.items():
        a = a.where(F.col(k) == v)
    s = a.agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("ok"), F.min(F.when(F.col("valid"), F.col("path"))).alias("path"))
    state = F.when(F.col("n") == 0, "missing").when(F.col("ok") == 0, "invalid").when(F.col("ok") > 1, "ambiguous").otherwise("exact")
    return s.select(state.alias("state"), F.when(state == "exact", F.col("path")).alias("path"))


def replay_export(scores: DataFrame, groups: list[str], directory: str) -> None:
    """All groups' scores evaluated into a staging table first, and published only then, one folder a group.

    A row that cannot be scored fails the staging write, before anything is published.
    """
    staged = f"{directory}/_staging"
    scores.write.mode("overwrite").parquet(staged)
    scores.sparkSession.read.parquet(staged).write.mode("overwrite").partitionBy(*groups).json(f"{directory}/scores")


def clear_edges(spark: SparkSession, root: str, names: tuple[str, ...] = ("edge_hop", "edge_answered_by")) -> None:
    """Empty edge tables of the same schema, so that the edges alone can be built anew."""
    for n in names:
        schema = spark.read.parquet(f"{root}/{n}").schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/{n}")
