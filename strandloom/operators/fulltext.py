"""Full-text search: postings and BM25, in Arrow blocks for a batch of queries and as a relational plan beyond it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions.vectors import rank_within

K1, B = 1.2, 0.75
TOKEN_SPLIT = "[^a-z0-9]+"


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_SPLIT), lambda t: t != "")


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, doc, tf, len) of a corpus; written once, it is the inverted index."""
    d = docs.select(F.col(key).alias("doc"), terms(F.col(text)).alias("t")).withColumn("len", F.size("t"))
    return d.select("doc", "len", F.explode("t").alias("term")).groupBy("term", "doc", "len").agg(F.count(F.lit(1)).alias("tf"))


#: Most (query, term) rows of one batch that reach the driver, and most cells of the matrix of terms and queries that every
#: task holds (eight bytes each); larger batches take the relational plan.
BATCH_ROWS, BATCH_CELLS = 200_000, 10_000_000
_SPLIT = re.compile(TOKEN_SPLIT)


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query: str, k: int, decimals: int = 6) -> DataFrame:
    """(query_id, doc, score, rank): the best ``k`` documents of every query, ties by document.

    Scores are rounded before ranking, so that equal texts tie. A batch of queries within the bounds is broadcast as its
    vocabulary: the documents stream through two passes, one for document frequencies and one that scores blocks of
    documents against all queries in matrix products and keeps ``k`` a query and partition. Nothing of a document is
    shuffled. Null texts are empty; a query without terms, or that matches nothing, has no rows.
    """
    q = queries.select(F.col(query_key).alias("query_id"), F.explode(F.array_distinct(terms(F.col(query)))).alias("term")).distinct()
    rows = q.limit(BATCH_ROWS + 1).collect()
    names, vocabulary = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    if len(rows) > BATCH_ROWS or len(vocabulary) * len(names) > BATCH_CELLS:
        return bm25_relational(docs, key, text, queries, query_key, query, k, decimals)
    spark = docs.sparkSession
    at = {t: i for i, t in enumerate(vocabulary)}
    place = {n: i for i, n in enumerate(names)}
    pairs = np.array([(place[r[0]], at[r[1]]) for r in rows], np.int64).reshape(-1, 2)
    sent = spark.sparkContext.broadcast((at, names, pairs))
    width = len(vocabulary)

    def counted(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, frequency) of the vocabulary's terms, and the documents' lengths."""
        known = sent.value[0]
        length, doc, term = np.zeros(len(texts)), [], []
        for i, t in enumerate(texts):
            words = [w for w in _SPLIT.split((t or "").lower()) if w]
            length[i] = len(words)
            found = [known[w] for w in words if w in known]
            doc += [i] * len(found)
            term += found
        cell = np.sort(np.array(doc, np.int64) * max(1, width) + np.array(term, np.int64))
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, int)
        tf = np.diff(np.append(first, len(cell)))
        return cell[first] // max(1, width), cell[first] % max(1, width), tf.astype(float), length

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(width + 2)
        for b in batches:
            _, term, _, length = counted(b.column(0).to_pylist())
            df[:width] += np.bincount(term, minlength=width)[:width]
            df[width] += len(length)
            df[width + 1] += length.sum()
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "n"])

    stats = np.zeros(width + 2)
    for r in docs.select(text).mapInArrow(frequencies, "term long, n double").groupBy("term").agg(F.sum("n")).collect():  # the vocabulary
        stats[r[0]] = r[1]
    n_docs, average = stats[width], stats[width + 1] / max(1.0, stats[width])
    idf = np.log(1 + (n_docs - stats[:width] + 0.5) / (stats[:width] + 0.5))
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("query_id", queries.schema[query_key].dataType), T.StructField("doc", kind), T.StructField("score", T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, ids, cells = sent.value
        use = np.zeros((width, len(ids)))
        step = max(1, min(1024, BATCH_CELLS // max(1, width)))  # documents at once: their matrix is as bounded
        use[cells[:, 1], cells[:, 0]] = 1
        top_s, top_d = np.zeros((0, len(ids))), []
        for b in batches:
            keys = b.column(0).to_pylist()
            doc, term, tf, length = counted(b.column(1).to_pylist())
            for s in range(0, len(keys), step):
                m = slice(*np.searchsorted(doc, [s, s + step]))  # cells are in the order of documents
                w = np.zeros((min(step, len(keys) - s), width))
                w[doc[m] - s, term[m]] = idf[term[m]] * tf[m] * (K1 + 1) / (tf[m] + K1 * (1 - B + B * length[doc[m]] / max(average, 1e-12)))
                p = np.round(w @ use, decimals)
                some = np.flatnonzero(p.max(axis=1, initial=0) > 0)
                top_s = np.concatenate([top_s, p[some]])
                top_d += [keys[s + i] for i in some]
                if len(top_d) > 4096:
                    top_s, top_d = pruned(top_s, top_d)
        top_s, top_d = pruned(top_s, top_d)
        at_doc, at_query = np.nonzero(top_s > 0)
        if len(at_doc):
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[j] for j in at_query]), pa.array([top_d[i] for i in at_doc], b.schema.field(0).type), pa.array(top_s[at_doc, at_query])], names=schema.names
            )

    def pruned(scores: np.ndarray, keys: list) -> tuple[np.ndarray, list]:
        """Only documents among some query's best ``k``, and only there."""
        order = np.array(sorted(range(len(keys)), key=lambda i: keys[i]), np.int64)
        scores, keys = scores[order], [keys[i] for i in order]
        if len(keys) > k:
            best = np.argsort(-scores, axis=0, kind="stable")[:k]
            keep = np.zeros_like(scores, bool)
            np.put_along_axis(keep, best, True, axis=0)
            scores = np.where(keep, scores, 0)
            some = np.flatnonzero(scores.max(axis=1, initial=0) > 0)
            scores, keys = scores[some], [keys[i] for i in some]
        return scores, keys

    if not names:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())]))
    best = docs.where(F.col(key).isNotNull()).select(key, text).mapInArrow(scored, schema)
    return rank_within(best, ["query_id"], [F.col("score").desc(), F.col("doc").asc()], k)


def bm25_relational(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query: str, k: int, decimals: int = 6) -> DataFrame:
    """The same as a relational plan, for any number of queries.

    Only postings of query terms are kept, before anything is shuffled: the query vocabulary is joined as a semi join that
    is broadcast while small. Scores are rounded before ranking, so that equal texts tie.
    """
    q = queries.select(F.col(query_key).alias("query_id"), F.explode(F.array_distinct(terms(F.col(query)))).alias("term")).distinct()
    d = docs.select(F.col(key).alias("doc"), terms(F.col(text)).alias("t"))
    totals = d.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("t").cast("double")).alias("avg_len"))
    p = d.select("doc", F.size("t").alias("len"), F.explode("t").alias("term")).join(q.select("term").distinct(), "term", "left_semi")
    p = p.groupBy("term", "doc", "len").agg(F.count(F.lit(1)).alias("tf"))
    df = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = p.join(df, "term").crossJoin(F.broadcast(totals))  # one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = w.select("term", "doc", (idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))).alias("w"))
    s = q.join(w, "term").groupBy("query_id", "doc").agg(F.round(F.sum("w"), decimals).alias("score"))
    return rank_within(s, ["query_id"], [F.col("score").desc(), F.col("doc").asc()], k)
