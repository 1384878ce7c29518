"""The passage graph: NEXT and HOP edges, one-step expansion, deeper neighbourhoods and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.vectors import HOT_ROWS, block_top_k, rank_whole, rank_within
from strandloom.session import materialize

DECAY = 0.5


def next_edges(chunks: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(src_id, dst_id) of neighbouring chunks of a source; a source of any size is ranked in pieces and joined by place."""
    c = rank_whole(chunks.select("source", "sent_id", "id"), ["source"], [F.col("sent_id").asc(), F.col("id").asc()], "place", hot_rows)
    a = c.select(F.col("source").alias("s"), F.col("place").alias("p"), F.col("id").alias("src_id"))
    b = c.select(F.col("source").alias("t"), (F.col("place") - 1).alias("q"), F.col("id").alias("dst_id"))
    return a.join(b, F.col("s").eqNullSafe(F.col("t")) & (F.col("p") == F.col("q"))).select("src_id", "dst_id")


def hop_matches(q_plus: DataFrame, q_minus: DataFrame) -> DataFrame:
    """(qplus_id, src_id, qminus_id, dst_id, score): the most similar foreign Q- of every Q+.

    Both sides: id, chunk_id, source, embedding. The source exclusion is part of the search, so no pool has to be widened.
    """
    side = lambda d: d.select("id", F.col("embedding").alias("vec"), F.col("source").alias("grp"))
    best = block_top_k(side(q_plus), side(q_minus), 1)  # ids of both sides come back under names of their own
    b = best.join(q_plus.select(F.col("id").alias("qid"), F.col("chunk_id").alias("src_id")), "qid").join(q_minus.select(F.col("id").alias("tid"), F.col("chunk_id").alias("dst_id")), "tid")
    return b.where("src_id <> dst_id").select(F.col("qid").alias("qplus_id"), "src_id", F.col("tid").alias("qminus_id"), "dst_id", "score")


def merge_hops(matches: DataFrame) -> DataFrame:
    """(src_id, dst_id, type, q_minus_score, source_question_ids): one edge a pair, best score, ids in order of question."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("qplus_id"))), lambda x: x["qplus_id"])
    g = matches.groupBy("src_id", "dst_id").agg(F.max("score").alias("q_minus_score"), F.array_distinct(ids).alias("source_question_ids"))
    return g.withColumn("type", F.lit("qplus_to_qminus_owner"))


def reciprocal(matches: DataFrame, q_plus: DataFrame, q_minus: DataFrame) -> DataFrame:
    """Matches with ``reciprocal``: is this Q+ the most similar foreign Q+ (document embedding) of its Q-?"""
    wanted = matches.select(F.col("qminus_id").alias("wanted_id")).distinct()
    used = q_minus.toDF(*q_minus.columns).select(F.col("id").alias("wanted_id"), "embedding", "source").join(wanted, "wanted_id", "left_semi").withColumnRenamed("wanted_id", "id")
    side = lambda d: d.select("id", F.col("embedding").alias("vec"), F.col("source").alias("grp"))
    back = block_top_k(side(used), side(q_plus), 1).select(F.col("qid").alias("qminus_id"), F.col("tid").alias("back_id"))
    return matches.join(back, "qminus_id", "left").withColumn("reciprocal", F.coalesce(F.col("back_id") == F.col("qplus_id"), F.lit(False))).drop("back_id")


def frontier(starts: DataFrame, nxt: DataFrame, hop: DataFrame, variant: str = "full") -> DataFrame:
    """(query_id, src_id, id, path_type, edge_rank): neighbours of the starts, NEXT both ways and HOP outgoing.

    ``variant``: full, next_only, hop_only or none; a branch left out is pruned from the plan.
    """
    if variant not in ("full", "next_only", "hop_only", "none"):
        raise ValueError(variant)
    s = starts.select("query_id", F.col("id").alias("src_id"))
    both = nxt.select("src_id", "dst_id").unionByName(nxt.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id")))
    a = s.join(both, "src_id").withColumn("path_type", F.lit("next")).where(F.lit(variant in ("full", "next_only")))
    b = s.join(hop.select("src_id", "dst_id"), "src_id").withColumn("path_type", F.lit("hop")).where(F.lit(variant in ("full", "hop_only")))
    e = a.unionByName(b).where("dst_id is not null").distinct()
    r = rank_within(e, ["query_id", "src_id", "path_type"], [F.col("dst_id").asc()], None, "edge_rank")
    return r.select("query_id", "src_id", F.col("dst_id").alias("id"), "path_type", (F.col("edge_rank") - 1).alias("edge_rank"))


def expand(starts: DataFrame, edges: DataFrame, decay: float = DECAY) -> DataFrame:
    """(query_id, id, representation_score, direct, paths): starts keep their scores, others take the best decayed one."""
    best = edges.join(starts.select("query_id", F.col("id").alias("src_id"), "representation_score"), ["query_id", "src_id"])
    best = best.groupBy("query_id", "id").agg(F.max(F.col("representation_score") * decay).alias("inherited"), F.count(F.lit(1)).alias("paths"))
    j = starts.select("query_id", "id", "representation_score").join(best, ["query_id", "id"], "full_outer")
    direct = F.col("representation_score").isNotNull()
    return j.select("query_id", "id", F.coalesce("representation_score", "inherited").alias("representation_score"), direct.alias("direct"), F.coalesce("paths", F.lit(0)).alias("paths")).where("direct or representation_score > 0")


def neighbourhoods(starts: DataFrame, edges: DataFrame, depth: int = 4, decay: float = DECAY) -> DataFrame:
    """(query_id, id, representation_score, depth): nested neighbourhoods; a passage is scored once, at its first distance,
    with the decayed best score among its predecessors at the distance before. ``edges``: src_id, dst_id."""
    edges = materialize(edges.select("src_id", "dst_id"), "neighbour-edges")  # every level reads them
    level = materialize(starts.select("query_id", "id", "representation_score", F.lit(0).alias("depth")), "neighbours")
    seen = level
    for d in range(1, depth + 1):
        step = level.select("query_id", F.col("id").alias("src_id"), "representation_score").join(edges, "src_id")
        step = step.groupBy("query_id", F.col("dst_id").alias("id")).agg((F.max("representation_score") * decay).alias("representation_score"))
        level = materialize(step.join(seen.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("depth", F.lit(d)), "neighbours")
        seen = seen.unionByName(level)
    return seen


def additions(starts: DataFrame, base: DataFrame, edges: DataFrame) -> DataFrame:
    """One-hop neighbours of the starts that are not in the base."""
    n = starts.select("query_id", F.col("id").alias("src_id")).join(edges, "src_id").select("query_id", F.col("dst_id").alias("id")).distinct()
    return n.join(base.select("query_id", "id"), ["query_id", "id"], "left_anti")


def integrity(chunks: DataFrame, nxt: DataFrame, hop: DataFrame, answered_by: DataFrame | None = None, questions: DataFrame | None = None) -> DataFrame:
    """(check, violations), one row a check; all are aggregates or anti joins.

    With ``answered_by`` (qplus_id, qminus_id) and ``questions`` (id, chunk_id) the provenance of the hops is a check too.
    """
    ids = chunks.select("id")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
    dup = lambda df, *c: df.groupBy(*c).count().where("count > 1")
    orphan = lambda e, c: e.join(ids, e[c] == ids["id"], "left_anti")
    src = chunks.select(F.col("id").alias("s"), F.col("source").alias("ss"))
    dst = chunks.select(F.col("id").alias("t"), F.col("source").alias("ts"))
    ends = lambda e: e.join(src, e["src_id"] == F.col("s")).join(dst, e["dst_id"] == F.col("t"))
    gap = next_gaps(chunks, nxt)
    parts = [
        n(dup(chunks, "id"), "duplicate_chunk"), n(chunks.where("text is null or trim(text) = ''"), "blank_chunk"),
        n(orphan(nxt, "src_id"), "next_source_missing"), n(orphan(nxt, "dst_id"), "next_target_missing"),
        n(dup(nxt, "src_id"), "next_out_degree"), n(dup(nxt, "dst_id"), "next_in_degree"),
        n(ends(nxt).where("ss <> ts"), "next_crosses_source"), n(gap, "next_gap"),
        n(orphan(hop, "src_id"), "hop_source_missing"), n(orphan(hop, "dst_id"), "hop_target_missing"),
        n(hop.where("src_id = dst_id"), "hop_to_itself"), n(dup(hop, "src_id", "dst_id"), "duplicate_hop"),
        n(ends(hop).where("ss = ts"), "hop_within_source"),
    ]
    if answered_by is not None:
        parts.append(n(provenance_gaps(hop, answered_by, questions), "hop_provenance"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def next_gaps(chunks: DataFrame, nxt: DataFrame) -> DataFrame:
    """Chunks whose successor by ``sent_id`` exists but is not linked."""
    a = chunks.select("source", "sent_id", F.col("id").alias("src_id"))
    b = chunks.select("source", (F.col("sent_id") - 1).alias("sent_id"), F.col("id").alias("dst_id"))
    return a.join(b, ["source", "sent_id"]).join(nxt.select("src_id", "dst_id"), ["src_id", "dst_id"], "left_anti")


def provenance_gaps(hops: DataFrame, answered_by: DataFrame, questions: DataFrame) -> DataFrame:
    """Source questions of a hop that no ANSWERED_BY leads from to the hop's target."""
    e = hops.select("src_id", "dst_id", F.explode("source_question_ids").alias("qplus_id"))
    owner = answered_by.select("qplus_id", "qminus_id").join(questions.select(F.col("id").alias("qminus_id"), F.col("chunk_id").alias("dst_id")), "qminus_id").select("qplus_id", "dst_id")
    return e.join(owner, ["qplus_id", "dst_id"], "left_anti")


def capacity(vectors: DataFrame, vector: str, chunks: DataFrame) -> DataFrame:
    """(records, logical_bytes): eight bytes an element and record, one a character."""
    v = vectors.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.size(vector), F.lit(0))).alias("e")).select("n", (8 * F.col("e") + 8 * F.col("n")).alias("b"))
    c = chunks.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("e")).select("n", (F.col("e") + 8 * F.col("n")).alias("b"))
    return v.unionByName(c).agg(F.sum("n").alias("records"), F.sum("b").alias("logical_bytes"))


def shared_texts(rows: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(text_class, key, copies, sources) of rows whose text, case and outer blanks aside, more than one source has.

    Classes are counted before the shuffle. Sizes come back by a join on the class, which AQE may split; no pairs are made.
    """
    t = rows.where(F.trim(text) != "").select(F.md5(F.lower(F.trim(text))).alias("text_class"), F.col(key), F.col(source).alias("__s"))
    per = t.groupBy("text_class", "__s").agg(F.count(F.lit(1)).alias("n"))
    g = per.groupBy("text_class").agg(F.sum("n").alias("copies"), F.count("__s").alias("sources")).where("sources > 1")
    return t.join(g, "text_class").select("text_class", key, "copies", "sources")


def statistics(chunks: DataFrame, questions: DataFrame, hop: DataFrame, answered_by: DataFrame) -> DataFrame:
    """One row: counts of documents, passages, questions and edges, coverage ratios, averages and degrees of an index.

    ``chunks``: id, source; ``questions``: id, chunk_id, channel. Ratios over nothing are 0.
    """
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    c = chunks.agg(F.count_distinct("source").alias("total_documents"), F.count_distinct("id").alias("total_chunks"))
    minus, plus = F.col("channel") == "q_minus", F.col("channel") == "q_plus"
    owned = questions.join(chunks.select(F.col("id").alias("chunk_id")).distinct(), "chunk_id", "left_semi")
    q = owned.agg(*(F.count_distinct(F.when(k, F.col(x))).alias(f"{n}_{y}") for n, k in (("q_minus", minus), ("q_plus", plus)) for x, y in (("id", "questions"), ("chunk_id", "chunks"))))
    linked = answered_by.select("qplus_id").distinct().join(questions.where(plus).select(F.col("id").alias("qplus_id")), "qplus_id", "left_semi").agg(F.count(F.lit(1)).alias("linked_q_plus_questions"))
    e = hop.agg(F.count(F.lit(1)).alias("total_hop_edges"), F.count_if(F.size("source_question_ids") < 1).alias("hop_without_provenance"))
    degree = hop.groupBy("src_id").agg(F.count(F.lit(1)).alias("d")).agg(F.coalesce(F.max("d"), F.lit(0)).alias("max_hop_out_degree"))
    a = answered_by.agg(F.count(F.lit(1)).alias("answered_by_edges"))
    j = c
    for one in (q, linked, e, degree, a):  # single rows
        j = j.crossJoin(F.broadcast(one))
    return j.withColumns({
        "avg_chunks_per_doc": over("total_chunks", "total_documents"), "q_minus_coverage": over("q_minus_chunks", "total_chunks"), "q_plus_coverage": over("q_plus_chunks", "total_chunks"),
        "avg_q_minus_per_covered_chunk": over("q_minus_questions", "q_minus_chunks"), "avg_q_plus_per_covered_chunk": over("q_plus_questions", "q_plus_chunks"),
        "q_plus_direction_coverage": over("linked_q_plus_questions", "q_plus_questions"), "avg_hop_out_degree_per_eligible_chunk": over("total_hop_edges", "q_plus_chunks"),
        "avg_hop_out_degree_per_chunk": over("total_hop_edges", "total_chunks"),
    })


def pool_sizes(questions: DataFrame) -> DataFrame:
    """(source, pool): how wide an approximate search must be so that a foreign question is in it: one's own and one more."""
    return questions.groupBy("source").agg((F.count(F.lit(1)) + 1).alias("pool"))


def reciprocal_ids(matches: DataFrame) -> DataFrame:
    """(src_id, dst_id, reciprocal_ids): per edge the questions whose answer leads back to them, in ascending order."""
    ids = F.array_sort(F.collect_set(F.when(F.col("reciprocal"), F.col("qplus_id"))))  # questions of one passage
    return matches.groupBy("src_id", "dst_id").agg(ids.alias("reciprocal_ids"))


def bridges(starts: DataFrame, hop: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, id, bridge_embeddings): embeddings of the questions behind the hops that lead from starts to passages that
    are no starts, once each in order of the question. ``hop``: src_id, dst_id, source_question_ids; ``questions``: id, embedding."""
    s = starts.select("query_id", F.col("id").alias("src_id"))
    way = s.join(hop.select("src_id", "dst_id", F.explode("source_question_ids").alias("qid")), "src_id").select("query_id", F.col("dst_id").alias("id"), "qid").distinct()
    way = way.join(starts.select("query_id", "id"), ["query_id", "id"], "left_anti")
    e = way.join(questions.where("embedding is not null and size(embedding) > 0").select(F.col("id").alias("qid"), "embedding"), "qid")
    inner = F.array_sort(F.collect_list(F.struct("qid", "embedding")))
    return e.groupBy("query_id", "id").agg(F.array_distinct(F.transform(inner, lambda x: x["embedding"])).alias("bridge_embeddings"))
