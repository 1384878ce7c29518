"""Models behind interfaces. The defaults are deterministic and offline: they exercise the plans and claim no quality."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.operators.fulltext import terms


class Texts(Protocol):
    def __call__(self, batch: list[str]) -> list: ...


class TooLarge(Exception):
    """A provider's batch, or one text of it, is too long."""


class Transient(Exception):
    """A failure that may pass: of the transport, or an answer that is not in the format asked for."""


def retrying(call: Callable, attempts: int = 4, first: float = 0.5, most: float = 30.0, sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None) -> Callable:
    """``call`` repeated after transient failures with doubling, jittered pauses. One budget of attempts covers every kind of
    them; the last failure is raised. Other exceptions pass at once. Spark's own task retries come on top."""
    def again(*args):
        r = rng or random.Random()
        for n in range(attempts):
            try:
                return call(*args)
            except Transient:
                if n + 1 == attempts:
                    raise
                sleep(min(most, first * 2**n) * (0.5 + r.random() / 2))

    return again


def bisecting(call: Callable[[list[str]], list], shorten: Callable[[str], str]) -> Callable[[list[str]], list]:
    """``call`` on halves of a batch that is too large, down to one text, which is then shortened until it fits or is empty.
    Results stay in the order of the texts, and there must be one for each."""
    def split(batch: list[str]) -> list:
        if not batch:
            return []
        try:
            out = call(batch)
        except TooLarge:
            if len(batch) > 1:
                return split(batch[: len(batch) // 2]) + split(batch[len(batch) // 2 :])
            shorter = shorten(batch[0])
            if len(shorter) >= len(batch[0]):
                raise
            return split([shorter])
        if len(out) != len(batch):
            raise ValueError("a provider gave another number of results than it got texts")
        return out

    return split


def embed_with(df: DataFrame, text: str, model: Callable[[], Texts], out: str = "embedding") -> DataFrame:
    """Embeddings of the distinct non-blank texts, joined back by their digest; blanks get an empty vector.

    ``model`` is made once a task and gets batches.
    """
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model()
        for b in batches:
            yield pd.Series(m(b.tolist()))

    h = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    d = df.withColumn("__h", h)
    new = d.where(F.trim(F.coalesce(text, F.lit(""))) != "").select("__h", text).dropDuplicates(["__h"]).select("__h", embed(text).alias(out))
    return d.join(new, "__h", "left").withColumn(out, F.coalesce(out, F.array().cast("array<float>"))).drop("__h")


def hashed_embedding(df: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """(key, embedding): counts of terms by digest bucket, scaled to length one; an expression both SQL engines can state."""
    t = df.select(key, F.explode(terms(F.col(text))).alias("t"))
    b = t.select(key, (F.conv(F.substring(F.md5("t"), 1, 2), 16, 10).cast("int") % dim).alias("b")).groupBy(key, "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    m = b.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("len"))  # at most dim entries
    return m.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)) / F.col("len")).alias("embedding"))


def sentence_questions(chunks: DataFrame, per_side: int = 3) -> DataFrame:
    """(chunk_id, source, channel, ordinal, text): the first sentences of a chunk as Q-, the last as Q+, without repeats."""
    s = F.array_distinct(F.filter(F.split("text", r"(?U)(?<=[.!?])\s+"), lambda x: F.trim(x) != ""))
    c = chunks.select(F.col("id").alias("chunk_id"), "source", s.alias("s"))
    one = lambda arr, name: c.select("chunk_id", "source", F.lit(name).alias("channel"), F.posexplode(arr).alias("ordinal", "text"))
    start = F.greatest(F.size("s") - per_side + 1, F.lit(1))
    return one(F.slice("s", 1, per_side), "q_minus").unionByName(one(F.slice("s", start, F.lit(per_side)), "q_plus"))


def deduped_questions(questions: DataFrame) -> DataFrame:
    """Q- once by folded identity, Q+ likewise and without any Q- identity of its chunk; ordinals anew from 0."""
    from strandloom.functions.text import casefold
    from strandloom.functions.vectors import rank_within

    q = questions.withColumn("ident", casefold("text")).where("ident <> ''")
    q = rank_within(q, ["chunk_id", "channel", "ident"], [F.col("ordinal").asc()], 1, "__n").drop("__n")
    minus = q.where("channel = 'q_minus'")
    plus = q.where("channel = 'q_plus'").join(minus.select("chunk_id", "ident"), ["chunk_id", "ident"], "left_anti")
    both = minus.unionByName(plus.select(minus.columns))
    return rank_within(both.withColumnRenamed("ordinal", "__o"), ["chunk_id", "channel"], [F.col("__o").asc()]).select("chunk_id", "source", "channel", (F.col("rank") - 1).alias("ordinal"), "text")


def rerank_with(pool: DataFrame, ranker: Callable[[str, list[str], int], list[str]], k: int = 12) -> DataFrame:
    """(query_id, id, pos): a ranker's order of each query's pool. It must return min(k, n) known labels."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("rank")
        labels = {f"C{i:03d}": x for i, x in enumerate(p.id)}
        got = ranker(p["query"].iloc[0], list(labels), min(k, len(p)))
        if len(got) != min(k, len(p)) or set(got) - set(labels):
            raise KeyError("the ranker gave other labels than it was asked for")
        return pd.DataFrame({"query_id": p.query_id.iloc[0], "id": [labels[x] for x in got], "pos": range(1, len(got) + 1)})

    return pool.groupBy("query_id").applyInPandas(one, f"query_id string, id {dict(pool.dtypes)['id']}, pos int")
