"""The three jobs from end to end: build an index, answer a batch of queries, evaluate results. Each is a chain of operators
over whole tables; models come as providers, with offline defaults."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.text import baseline_chunk_id, context_block, document_text, namespace_token, question_id, strip_format
from strandloom.functions.vectors import block_top_k
from strandloom.operators import fulltext, graph, metrics, providers, retrieval, store
from strandloom.sources import corpus

Embedder = Callable[[DataFrame, str, str], DataFrame]


@dataclass
class Options:
    """What the policies of a run switch between."""

    window: int = 6
    k: int = 12
    depth: int = 1
    edges: str = "full"
    channels: str = "full"
    semantics: str = "body"
    order: str = "fusion"
    decay: float = graph.DECAY
    embed: Embedder = field(default=providers.hashed_embedding)


@dataclass
class Index:
    """The tables of one namespace."""

    spark: SparkSession
    root: str
    namespace: str

    def path(self, name: str) -> str:
        return f"{self.root}/{namespace_token(self.namespace)}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name)


def build(index: Index, docs: DataFrame, metadata: DataFrame | None = None, options: Options | None = None) -> DataFrame:
    """Index ``docs(source, content)``; gives the failures (source, failure). Hops are built when every passage is there."""
    o = options or Options()
    index.write("index_snapshot", store.snapshot_row(index.spark, "graph", index.namespace, "in_progress"))
    chunks = corpus.chunk_documents(docs, "source", "content", o.window)
    if metadata is not None:
        chunks = corpus.with_metadata(chunks, metadata)
    chunks = index.write("chunk_text", chunks)
    body = o.embed(chunks.select("id", document_text(F.col("title"), F.col("text")).alias("t")), "id", "t")
    chunks = index.write("chunk", chunks.join(body, "id", "left"))
    q = providers.deduped_questions(providers.sentence_questions(chunks))
    q = q.withColumn("id", question_id(F.col("chunk_id"), F.col("channel"), F.col("ordinal"), F.col("text")))
    questions = index.write("question", q.join(o.embed(q.select("id", "text"), "id", "text"), "id", "left"))
    index.write("edge_next", graph.next_edges(chunks))
    side = lambda c: questions.where(F.col("channel") == c).where(F.col("embedding").isNotNull())
    plus, minus = side("q_plus"), side("q_minus")
    matches = index.write("edge_answered_by", graph.reciprocal(graph.hop_matches(plus, minus), plus, minus))
    index.write("edge_hop", graph.merge_hops(matches))
    index.write("index_snapshot", store.snapshot_row(index.spark, "graph", index.namespace, "complete", chunks=chunks.count(), questions=questions.count()))
    return corpus.empty_documents(docs, "source", "content")


def check(index: Index) -> DataFrame:
    return graph.integrity(index.read("chunk"), index.read("edge_next"), index.read("edge_hop"), index.read("edge_answered_by"), index.read("question"))


def _vectors(df: DataFrame) -> DataFrame:
    return df.where(F.col("embedding").isNotNull()).select("id", F.col("embedding").alias("vec"), F.lit(None).cast("string").alias("grp"))


def embed_queries(queries: DataFrame, o: Options) -> DataFrame:
    """(query_id, query, embedding) of stripped, lower-case queries, embedded once for all channels."""
    q = queries.select("query_id", F.lower(strip_format(F.col("query"))).alias("query"))
    return q.join(o.embed(q, "query_id", "query"), "query_id", "left")


def channel_hits(index: Index, queries: DataFrame, o: Options) -> DataFrame:
    """Vector and text hits of the body and question channels, collapsed to the passages that own them."""
    chunks, questions = index.read("chunk"), index.read("question")
    qv = queries.where(F.col("embedding").isNotNull()).select(F.col("query_id").alias("id"), F.col("embedding").alias("vec"), F.lit(None).cast("string").alias("grp"))
    out = None
    for channel in ("body",) if o.channels == "body_only" else ("body", "q_minus", "q_plus"):
        rows = chunks if channel == "body" else questions.where(F.col("channel") == channel)
        width = o.k * retrieval.WIDTH[channel]
        vec = block_top_k(qv, _vectors(rows), width).select(F.col("qid").alias("query_id"), F.col("tid").alias("id"), "score").withColumn("type", F.lit("vector"))
        txt = fulltext.bm25(rows.select("id", "text"), "id", "text", queries, "query_id", "query", width).select("query_id", F.col("doc").alias("id"), "score").withColumn("type", F.lit("text"))
        hits = vec.unionByName(txt)
        if channel == "body":
            owned = hits.withColumn("matched", F.array().cast("array<string>"))
        else:
            h = hits.join(rows.select("id", F.col("chunk_id").alias("owner_id")), "id").withColumnRenamed("id", "question_id")
            parts = [retrieval.owner_collapse(h.where(F.col("type") == t), o.k).withColumn("type", F.lit(t)) for t in ("vector", "text")]
            owned = parts[0].unionByName(parts[1]).select("query_id", F.col("owner_id").alias("id"), "score", "type", "matched")
        owned = owned.withColumn("channel", F.lit(channel))
        out = owned if out is None else out.unionByName(owned)
    return out


def retrieve(index: Index, queries: DataFrame, options: Options | None = None) -> DataFrame:
    """(query_id, rank, id, source, title, page, sent_id, text, scores): the passages returned for ``queries(query_id, query)``."""
    o = options or Options()
    q = index.write("run_queries", embed_queries(queries, o))
    direct = index.write("run_direct", retrieval.role_union(retrieval.hybrid(channel_hits(index, q, o), o.k)).drop("representation_scores"))
    pool = direct.select("query_id", "id", "representation_score")
    if o.depth == 1:
        pool = graph.expand(pool, graph.frontier(pool, index.read("edge_next"), index.read("edge_hop"), o.edges), o.decay)
    elif o.depth > 1:
        nxt, hop = index.read("edge_next"), index.read("edge_hop").select("src_id", "dst_id")
        both = nxt.unionByName(nxt.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))).unionByName(hop).distinct()
        pool = graph.neighbourhoods(pool, both, o.depth, o.decay)
    c = pool.join(index.read("chunk").select("id", "source", "title", "page", "sent_id", "text", "embedding"), "id")
    if o.semantics == "bridge" and o.depth > 0:
        b = graph.bridges(direct.select("query_id", "id"), index.read("edge_hop").where(F.lit(o.edges in ("full", "hop_only"))), index.read("question"))
        c = c.join(b, ["query_id", "id"], "left")
        none = F.array().cast(b.schema["bridge_embeddings"].dataType)
        c = c.withColumn("bridge_embeddings", F.coalesce("bridge_embeddings", none))
    else:
        c = c.withColumn("bridge_embeddings", F.array().cast("array<array<double>>"))
    scored = retrieval.score_bodies(c, q, o.semantics)
    top = retrieval.rank_fusion(scored, o.k, variant=o.order)
    return retrieval.dependency_free(retrieval.unique_sources(top))


def retrieve_dense(index: Index, queries: DataFrame, options: Options | None = None) -> DataFrame:
    """The baseline: the ``k`` nearest bodies, no fusion; ids in the baseline's own form."""
    o = options or Options()
    q = embed_queries(queries, o).where(F.col("embedding").isNotNull())
    hits = block_top_k(_vectors(q.select(F.col("query_id").alias("id"), "embedding")), _vectors(index.read("chunk")), o.k)
    c = index.read("chunk").select("id", "source", "title", "page", "sent_id", "text")
    out = hits.select(F.col("qid").alias("query_id"), F.col("tid").alias("id"), "rank", "score").join(c, "id")
    return out.withColumn("id", baseline_chunk_id(F.lit(index.namespace), F.col("source"), F.col("title"), F.col("sent_id")))


def contexts(returned: DataFrame) -> DataFrame:
    """(query_id, context): the returned passages in rank order, as the reader gets them; at most ``k`` a query."""
    block = F.struct("rank", context_block(F.col("title"), F.col("page"), F.col("sent_id"), F.col("text")).alias("b"))
    return returned.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]), "\n\n").alias("context"))


def answer(contexts: DataFrame, queries: DataFrame, reader: Callable[[list[str], list[str]], list[str]]) -> DataFrame:
    """(query_id, answer): a reader over batches of questions and contexts; no context is a fixed refusal."""
    @F.pandas_udf("string")
    def read(q, c):
        import pandas as pd

        return pd.Series(reader(q.tolist(), c.tolist()))

    j = queries.join(contexts, "query_id", "left")
    some = j.where(F.col("context").isNotNull()).select("query_id", read("query", "context").alias("answer"))
    return some.unionByName(j.where(F.col("context").isNull()).select("query_id", F.lit("Insufficient information.").alias("answer")))


def evaluate(returned: DataFrame, queries: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """One row a query: retrieval metrics and, with answers, answer metrics. A query without results stays, with zeros."""
    r = returned.select("query_id", "rank", "text")
    out = metrics.ranking_metrics(r, queries.select("query_id", F.col("evidence_facts").alias("facts")))
    if answers is not None:
        a = queries.join(answers, "query_id", "left")
        cols = ("final_answer", "em", "f1", "precision", "recall", "null_refusal", "qa_accuracy")
        out = out.join(metrics.answer_metrics(a, "answer", "ground_truth", "question_type").select("query_id", *cols), "query_id", "left")
    return out
