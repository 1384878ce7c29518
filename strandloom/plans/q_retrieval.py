"""Queries over retrieval candidates, full text and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.vectors import rank_within
from strandloom.operators import coverage, fulltext, graph, providers, reports, retrieval, stats, store
from strandloom.plans.catalogue import register
from strandloom.plans.q_index import WS
from strandloom.session import materialize, table


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each query and passage: its last attempt. Unavailable scores are null."""
    c = table(spark, sf, "retrieval_candidates").where("query_id is not null and trim(id) <> ''")
    real = lambda x: F.when((F.col(x) >= 0) & ~F.isnan(x), F.col(x)).alias(x)
    c = c.select("query_id", "id", F.coalesce("channel", F.lit("body")).alias("channel"), *(real(x) for x in ("similarity_score", "final_score", "representation_score", "rank_fusion_score")), "attempt", "recorded_at")
    order = ("recorded_at", "rank_fusion_score", "final_score", "representation_score", "similarity_score", "channel")
    return store.latest(c, ["query_id", "id"], "attempt", *order)


_CAND = """
real as (select query_id, id, coalesce(channel, 'body') channel, case when similarity_score >= 0 and not isnan(similarity_score) then similarity_score end sim,
  case when final_score >= 0 and not isnan(final_score) then final_score end fin, case when representation_score >= 0 and not isnan(representation_score) then representation_score end rep,
  case when rank_fusion_score >= 0 and not isnan(rank_fusion_score) then rank_fusion_score end rf, attempt, recorded_at
  from retrieval_candidates where query_id is not null and trim(id) <> ''),
c as (select * from (select *, row_number() over (partition by query_id, id order by attempt desc nulls last, recorded_at desc nulls last, rf desc nulls last, fin desc nulls last, rep desc nulls last, sim desc nulls last, channel desc nulls last) k from real) where k = 1)
"""
_RANKS = """,
sr as (select *, row_number() over (partition by query_id order by coalesce(fin, 0) desc, id desc) s, row_number() over (partition by query_id order by coalesce(rep, 0) desc, id desc) p from c),
fu as (select *, 1.0 / s + case when coalesce(rep, 0) > 0 then 1.0 / p else 0 end f from sr)
"""


@register("candidate_rows", f"with {_CAND} select query_id, id, channel, round(sim, 6) as similarity, attempt from c")
def candidate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).select("query_id", "id", "channel", F.round("similarity_score", 6).alias("similarity"), "attempt")


@register("rank_fusion", f"""
with {_CAND} {_RANKS} select query_id, id, s as semantic_rank, p as representation_rank, round(f, 6) as score, r as rank from (
 select *, row_number() over (partition by query_id order by f desc, coalesce(fin, 0) desc, id desc) r from fu) where r <= 12""")
def rank_fusion(spark: SparkSession, sf: str) -> DataFrame:
    f = retrieval.rank_fusion(candidates(spark, sf))
    return f.select("query_id", "id", *(F.col(c).cast("long").alias(c) for c in ("semantic_rank", "representation_rank", "rank")), F.round("rank_fusion_score", 6).alias("score"))


@register("weighted_fusion", f"""
with {_CAND} {_RANKS}, w as (select unnest([0.0, 0.25, 0.5, 0.75, 1.0]) w),
x as (select w, fu.*, w / s + case when coalesce(rep, 0) > 0 then (1 - w) / p else 0 end g from fu, w)
select w as weight, query_id, id, r as rank from (select *, row_number() over (partition by w, query_id order by g desc, coalesce(fin, 0) desc, id desc) r from x) where r <= 12""")
def weighted_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Five weights over one pool; the rank terms are found once and written out."""
    c = retrieval.rank_fusion(candidates(spark, sf), None).drop("rank_fusion_score", "rank")
    rep, final = F.coalesce("representation_score", F.lit(0.0)), F.coalesce("final_score", F.lit(0.0))
    c = c.withColumn("weight", F.explode(F.lit([0.0, 0.25, 0.5, 0.75, 1.0])))
    w = F.col("weight")
    c = c.withColumn("score", w / F.col("semantic_rank") + F.when(rep > 0, (1 - w) / F.col("representation_rank")).otherwise(0.0))
    return rank_within(c, ["weight", "query_id"], [F.col("score").desc(), final.desc(), F.col("id").desc()], 12).select("weight", "query_id", "id", F.col("rank").cast("long").alias("rank"))


_HITS = f"""{_CAND},
hits as (select query_id, channel, 'vector' typ, id, sim score from c where sim is not null union all select query_id, channel, 'text', id, rep from c where rep is not null),
rk as (select *, row_number() over (partition by query_id, channel, typ order by score desc, id) r from hits),
rrf as (select query_id, channel, id, sum(1.0 / r) rrf from rk group by query_id, channel, id),
hy as (select * from (select *, row_number() over (partition by query_id, channel order by rrf desc, id) rank from rrf) where rank <= 12)
"""


def channel_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Vector hits by similarity and text hits by representation score of every channel."""
    c = candidates(spark, sf)
    one = lambda kind, col: c.where(F.col(col).isNotNull()).select("query_id", "channel", F.lit(kind).alias("type"), "id", F.col(col).alias("score"), F.array("id").alias("matched"))
    return one("vector", "similarity_score").unionByName(one("text", "representation_score"))


@register("hybrid_rrf", f"with {_HITS} select query_id, channel, id, round(rrf, 6) as rrf, rank from hy")
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.hybrid(channel_hits(spark, sf), 12).select("query_id", "channel", "id", F.round("rrf", 6).alias("rrf"), F.col("rank").cast("long").alias("rank"))


@register("role_union", f"""
with {_HITS}, ch as (select query_id, id, 1.0 / row_number() over (partition by query_id, channel order by rrf desc, id) s from hy)
select query_id, id, round(sum(s), 6) as representation_score, count(*) as channels from ch group by query_id, id""")
def role_union(spark: SparkSession, sf: str) -> DataFrame:
    u = retrieval.role_union(retrieval.hybrid(channel_hits(spark, sf), 12))
    return u.select("query_id", "id", F.round("representation_score", 6).alias("representation_score"), F.size("representation_scores").cast("long").alias("channels"))


_RAW = """, rw as (select query_id, id, sum(rrf) raw from rrf group by query_id, id)"""


@register("raw_scores", f"""
with {_HITS} {_RAW}, nx as (select distinct id a, b from (select id, lead(id) over (partition by source order by sent_id, record_id) b from chunks) where b is not null and id <> b),
ed as (select a, b from nx union select b, a from nx), inh as (select query_id, b id, max(raw) * 0.5 raw from rw join ed on ed.a = rw.id group by query_id, b)
select query_id, id, round(raw, 6) as raw_score, true as direct from rw union all select query_id, id, round(raw, 6), false from inh where (query_id, id) not in (select query_id, id from rw)""")
def raw_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of the channels' own scores, and half the best of a neighbour for passages that only the graph reaches."""
    c = table(spark, sf, "chunks").select("record_id", F.col("id").alias("node"), "source", "sent_id")
    nxt = graph.next_edges(c.withColumnRenamed("record_id", "id"))
    name = lambda k: c.select(F.col("record_id").alias(k), F.col("node").alias(f"n_{k}"))
    nxt = nxt.join(name("src_id"), "src_id").join(name("dst_id"), "dst_id").select(F.col("n_src_id").alias("src_id"), F.col("n_dst_id").alias("dst_id")).where("src_id <> dst_id")
    both = nxt.unionByName(nxt.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))).distinct()
    return retrieval.raw_scores(retrieval.hybrid(channel_hits(spark, sf), None), both).withColumn("raw_score", F.round("raw_score", 6))


@register("selector_variants", f"""
with {_HITS} {_RAW}, {_RANKS.strip().lstrip(',')}, x as (select fu.*, coalesce(raw, 0) raw from fu left join rw using (query_id, id))
select 'fused' as variant, query_id, id, r as rank from (select *, row_number() over (partition by query_id order by f desc, coalesce(fin, 0) desc, id desc) r from x) where r <= 12
union all select 'representation', query_id, id, p from x where p <= 12
union all select 'raw', query_id, id, r from (select *, row_number() over (partition by query_id order by raw desc, id desc) r from x) where r <= 12""")
def selector_variants(spark: SparkSession, sf: str) -> DataFrame:
    raw = retrieval.raw_scores(retrieval.hybrid(channel_hits(spark, sf), None)).drop("direct")
    pool = candidates(spark, sf).join(raw, ["query_id", "id"], "left")
    return retrieval.select_variants(pool).withColumn("rank", F.col("rank").cast("long"))


@register("channel_combinations", f"""
with {_CAND}, r2 as (select query_id, id, array_to_string(list_sort(list_distinct(list(channel))), '+') combination from real where channel in ('body', 'q_minus', 'q_plus') group by query_id, id),
n as (select combination, count(*) n from r2 group by combination)
select x as combination, coalesce(n, 0) as n from unnest({list(coverage.COMBINATIONS)!r}) t(x) left join n on n.combination = x""")
def channel_combinations(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "retrieval_candidates").where("query_id is not null and trim(id) <> ''")
    return coverage.channel_combinations(c.select("query_id", "id", F.coalesce("channel", F.lit("body")).alias("channel")))


@register("path_labels", "select query_id, coalesce(channel, 'none') as label, count(*) as n, count(distinct id) as passages from retrieval_candidates where query_id is not null group by all")
def path_labels(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "retrieval_candidates").where("query_id is not null")
    return c.groupBy("query_id", F.coalesce("channel", F.lit("none")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("passages"))


_SIZE = "sz as (select id, max(coalesce(length(text), 0)) // 4 tokens, min(source) source, min(page) page, min(sent_id) sent_id from chunks group by id)"


def sized(spark: SparkSession, sf: str, k: int | None = None, variant: str = "fusion") -> DataFrame:
    c = table(spark, sf, "chunks").groupBy("id").agg(F.floor(F.max(F.coalesce(F.length("text"), F.lit(0))) / 4).alias("tokens"), F.min("source").alias("source"), F.min("page").alias("page"), F.min("sent_id").alias("sent_id"))
    return retrieval.rank_fusion(candidates(spark, sf), k, variant=variant).select("query_id", "id", "rank").join(c, "id", "left")


@register("admission_prefix", f"""
with {_CAND} {_RANKS}, {_SIZE}, o as (select query_id, id, row_number() over (partition by query_id order by f desc, coalesce(fin, 0) desc, id desc) r from fu),
t as (select query_id, o.id, r, coalesce(tokens, 0) tok from o left join sz on o.id = sz.id), u as (select *, sum(tok) over (partition by query_id order by r rows unbounded preceding) used from t)
select query_id, id, r as rank, cast(used as bigint) as used_tokens from u where used <= 600""")
def admission_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.token_prefix(sized(spark, sf), 600).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.col("used_tokens").cast("long").alias("used_tokens"))


@register("admission_orders", f"""
with {_CAND} {_RANKS}, {_SIZE}, o as (select 'fusion' v, query_id, id, row_number() over (partition by query_id order by f desc, coalesce(fin, 0) desc, id desc) r from fu union all select 'similarity_only', query_id, id, s from fu),
t as (select v, query_id, o.id, r, coalesce(tokens, 0) tok from o left join sz on o.id = sz.id), u as (select *, sum(tok) over (partition by v, query_id order by r rows unbounded preceding) used from t)
select v as variant, query_id, count(*) as admitted, cast(sum(tok) as bigint) as tokens from u where used <= 600 group by v, query_id""")
def admission_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity-only against rank-fusion admission under one token ceiling."""
    one = lambda v: retrieval.token_prefix(sized(spark, sf, None, v), 600).groupBy("query_id").agg(F.count(F.lit(1)).alias("admitted"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens")).select(F.lit(v).alias("variant"), "*")
    return one("fusion").unionByName(one("similarity_only"))


@register("unique_sources", f"""
with {_CAND} {_RANKS}, {_SIZE}, o as (select query_id, id, row_number() over (partition by query_id order by f desc, coalesce(fin, 0) desc, id desc) r from fu),
t as (select query_id, o.id, r, source, page, sent_id from o join sz on o.id = sz.id where r <= 12), d as (select *, row_number() over (partition by query_id, source, page, sent_id order by r) k from t)
select query_id, id, row_number() over (partition by query_id order by r) as rank from d where k = 1""")
def unique_sources(spark: SparkSession, sf: str) -> DataFrame:
    s = sized(spark, sf, 12).where("source is not null")
    return retrieval.unique_sources(s).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@register("filled_ranking", f"""
with {_CAND} {_RANKS}, o as (select query_id, id, row_number() over (partition by query_id order by f desc, coalesce(fin, 0) desc, id desc) r, s from fu),
a as (select query_id, id, 0 part, r pos from o where r in (2, 5) union all select query_id, id, 1, s from o where r not in (2, 5))
select query_id, id, k as rank from (select *, row_number() over (partition by query_id order by part, pos) k from a) where k <= 12""")
def filled_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """A ranker that names two passages only; the rest follows in canonical order."""
    f = retrieval.rank_fusion(candidates(spark, sf), None)
    named = f.where("rank in (2, 5)").select("query_id", "id", F.col("rank").alias("pos"))
    canon = f.select("query_id", "id", F.col("semantic_rank").alias("rank"))
    return retrieval.fill(named, canon).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation items once each."""
    e = table(spark, sf, "eval_items")
    return e.groupBy("item_id").agg(F.min(F.struct("query", "ground_truth", "question_type", "evidence_docs", "evidence_facts")).alias("x")).select(F.col("item_id").alias("query_id"), "x.*")


_ITEMS = "it as (select item_id query_id, min(query) query, min(ground_truth) ground_truth, min(question_type) question_type, min(evidence_docs) evidence_docs, min(evidence_facts) facts from eval_items group by item_id)"
_TERMS = "list_filter(string_split_regex(lower(coalesce({t}, '')), '[^a-z0-9]+'), lambda w: w <> '')"
_BM25 = f"""
{_ITEMS}, q as (select distinct query_id, unnest({_TERMS.format(t='query')}) term from it), d as (select doc_id, {_TERMS.format(t='text')} t from documents),
tot as (select count(*) n, avg(len(t)) al from d), px as (select doc_id, len(t) l, unnest(t) term from d), p as (select term, doc_id, l, count(*) tf from px where term in (select term from q) group by term, doc_id, l),
df as (select term, count(*) df from p group by term),
w as (select p.term, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al)) w from p join df using (term), tot),
sc as (select query_id, doc_id, round(sum(w), 6) s from q join w using (term) group by query_id, doc_id),
bm as (select * from (select *, row_number() over (partition by query_id order by s desc, doc_id) r from sc) where r <= 12)
"""


def searched(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.bm25(table(spark, sf, "documents"), "doc_id", "text", items(spark, sf), "query_id", "query", 12)


@register("bm25_topk", f"with {_BM25} select query_id, doc_id, r as rank, s as score from bm")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return searched(spark, sf).select("query_id", F.col("doc").alias("doc_id"), F.col("rank").cast("long").alias("rank"), "score")


@register("hashed_embeddings", f"""
with d as (select record_id, unnest({_TERMS.format(t='text')}) t from chunks), b as (select record_id, ('0x' || substr(md5(t), 1, 2))::int % 64 b, count(*) n from d group by all), l as (select record_id, sqrt(sum(n * n)) l from b group by record_id)
select record_id, b as bucket, round(n / l, 6) as value from b join l using (record_id)""")
def hashed_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    e = providers.hashed_embedding(table(spark, sf, "chunks"), "record_id", "text")
    return e.select("record_id", F.posexplode("embedding").alias("bucket", "value")).where("value > 0").withColumn("value", F.round("value", 6))


_IDENT = rf"trim(regexp_replace(replace(lower(x), 'ß', 'ss'), '{WS}+', ' ', 'g'))"


@register("offline_questions", rf"""
with c as (select record_id, source, list_filter(string_split(regexp_replace(text, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') s0 from chunks where trim(text) <> ''),
d as (select record_id, source, list_filter(s0, lambda x, i: list_position(s0, x) = i) s from c),
q as (select record_id, source, 'q_minus' channel, unnest(range(0, least(3, len(s)))) o, 1 f, s from d union all select record_id, source, 'q_plus', unnest(range(0, least(3, len(s)))), greatest(len(s) - 2, 1), s from d),
t as (select record_id, source, channel, o, s[f + o] x from q), i as (select *, {_IDENT} ident from t),
k as (select * from (select *, row_number() over (partition by record_id, channel, ident order by o) n from i where ident <> '') where n = 1),
r as (select * from k where channel = 'q_minus' or (record_id, ident) not in (select record_id, ident from k where channel = 'q_minus'))
select record_id as chunk_id, source, channel, cast(row_number() over (partition by record_id, channel order by o) - 1 as integer) as ordinal, md5(x) as text_md5 from r""")
def offline_questions(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").where("trim(text) <> ''").select(F.col("record_id").alias("id"), "source", "text")
    q = providers.deduped_questions(providers.sentence_questions(c))
    return q.select("chunk_id", "source", "channel", "ordinal", F.md5("text").alias("text_md5"))


@register("coupled_sample", f"""
with {_CAND}, b as (select query_id, min(n) // 4 budget from (select query_id, channel, count(*) n from c group by all) group by query_id),
r as (select query_id, channel arm, id, row_number() over (partition by query_id, channel order by md5('42|' || query_id || '|' || id), id) k from c)
select query_id, arm, id from r join b using (query_id) where k <= budget""")
def coupled_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Arms share their priorities, so a smaller budget's sample is within a larger one's."""
    c = candidates(spark, sf).select("query_id", "id", F.col("channel").alias("arm"))
    budgets = c.groupBy("query_id", "arm").count().groupBy("query_id").agg(F.floor(F.min("count") / 4).cast("int").alias("budget"))
    return stats.coupled_sample(c, budgets, 42)


@register("monotonic_scores", f"""
with {_CAND} {_RANKS}, o as (select query_id, id, f, lag(f) over (partition by query_id order by f desc, coalesce(fin, 0) desc, id desc) b from fu)
select count(*) as violations from o where f > b""")
def monotonic_scores(spark: SparkSession, sf: str) -> DataFrame:
    f = materialize(retrieval.rank_fusion(candidates(spark, sf), None).select("query_id", "rank", "rank_fusion_score"), "fused")
    before = f.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("rank_fusion_score").alias("before"))
    return f.join(before, ["query_id", "rank"]).where("rank_fusion_score > before").agg(F.count(F.lit(1)).alias("violations"))


@register("bridge_min", """
with e as (select vec_id id, cast(embedding as double[]) v from embeddings), q as (select id query_id, v qv from e where id % 50 = 0),
b as (select b.id, b.v, n.v nv from e b left join e n on n.id = b.id + 1 where b.id % 3 = 0),
s as (select query_id, b.id, list_cosine_similarity(qv, b.v) body, case when nv is null then null else list_cosine_similarity(qv, nv) end br from q, b),
r as (select query_id, id, round(case when br is null then body else least(body, br) end, 6) f from s)
select query_id, id, f as final_score from (select *, row_number() over (partition by query_id order by f desc, id) k from r) where k <= 12""")
def bridge_min(spark: SparkSession, sf: str) -> DataFrame:
    """Body similarity held down by the best bridge, the twelve best of every query: the next vector stands for the question
    that led there. A stated query set against all rows: bodies meet the queries in 64 blocks."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    near = e.select((F.col("vec_id") - 1).alias("vec_id"), F.array("embedding").alias("bridge_embeddings"))
    c = e.where("vec_id % 3 = 0").join(near, "vec_id", "left").withColumn("bridge_embeddings", F.coalesce("bridge_embeddings", F.array().cast("array<array<float>>")))
    ids = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    pool = c.select(F.col("vec_id").alias("id"), "embedding", "bridge_embeddings", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("block"))
    pool = pool.join(ids.select("query_id", F.pmod("query_id", F.lit(64)).cast("int").alias("block")), "block").drop("block")
    s = retrieval.score_bodies(pool, ids, "bridge").select("query_id", "id", F.round("final_score", 6).alias("final_score"))
    return rank_within(s, ["query_id"], [F.col("final_score").desc(), F.col("id").asc()], 12).drop("rank")


@register("response_costs", """
with r as (select model, status, reader_seconds s from reader_responses)
select coalesce(model, 'unknown') as model, count(*) as requests, count(*) filter (where status = 'completed') as completed, round(avg(case when status = 'completed' and s > 0 then s end), 6) as seconds from r group by 1""")
def response_costs(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "reader_responses")
    done = F.col("status") == "completed"
    one = reports.cost(F.col("reader_seconds"), F.lit(1), done, F.lit(False))
    return r.groupBy(F.coalesce("model", F.lit("unknown")).alias("model")).agg(F.count(F.lit(1)).alias("requests"), F.count_if(done).alias("completed"), F.round(F.avg(one), 6).alias("seconds"))
