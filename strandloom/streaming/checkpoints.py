"""Log-structured behaviour as Structured Streaming: batches of completed queries, exactly once, resumable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, directory: str, schema: str, files_per_batch: int = 10) -> DataFrame:
    """New files of an append log, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(directory)


def commit(rows: DataFrame, key: str, out: str, checkpoint: str, enrich: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Each batch's rows, keyed once, as one directory named by the batch: repeating a batch after a failure overwrites it.

    Traces (``enrich``) are part of the same write, so no row is committed without them.
    """
    def one(batch: DataFrame, number: int) -> None:
        enrich(batch.dropDuplicates([key])).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, out: str, key: str) -> DataFrame:
    """What all batches hold, the first batch's row of each key."""
    rows = spark.read.parquet(out)
    first = rows.groupBy(key).agg(F.min("batch").alias("batch"))
    return rows.join(first, [key, "batch"])


def usage(rows: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Requests and seconds by model and window of completion, with late rows up to ``delay``."""
    return rows.withWatermark("completed_utc", delay).groupBy(F.window("completed_utc", window), "model").agg(F.count(F.lit(1)).alias("requests"), F.sum("reader_seconds").alias("seconds"))
