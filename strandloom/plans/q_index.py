"""Queries over corpus, passages and graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.vectors import block_top_k, rank_within
from strandloom.operators import graph, retrieval, stats
from strandloom.plans.catalogue import register
from strandloom.session import materialize, table
from strandloom.sources import corpus

WS = r"[\s\x0b\x85\p{Z}]"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _sent(t: str) -> str:
    """The sentences of a text in SQL; its engine has no lookbehind, so a mark stands in for it."""
    return rf"list_filter(list_transform(string_split(regexp_replace(coalesce({t}, ''), '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_trim('x')}), lambda x: x <> '')"



@register("chunk_windows", rf"""
with s as (select doc_id, {_sent('text')} s from documents),
w as (select doc_id, i // 6 as sent_id, array_to_string(s[i + 1 : i + 6], ' ') txt from (select doc_id, s, unnest(range(0, len(s), 6)) i from s))
select doc_id, cast(sent_id as integer) as sent_id, md5(doc_id || '-' || doc_id || '-' || sent_id) as id, md5(txt) as text_md5 from w""")
def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    c = corpus.chunk_documents(table(spark, sf, "documents"), "doc_id", "text", paged=False)
    return c.select(F.col("source").alias("doc_id"), "sent_id", "id", F.md5("text").alias("text_md5"))


_PAGES = rf"""
a as (select doc_id, coalesce(text, '') t from documents),
b as (select doc_id, case when regexp_matches(t, '^Title: ([^\n]*)(\n|$)') then {_trim(r"regexp_extract(t, '^Title: ([^\n]*)', 1)")} else cast(doc_id as varchar) end title, regexp_replace(t, '^Title: ([^\n]*)(\n|$)', '') t from a),
c as (select doc_id, title, regexp_replace(t, '^\s*Paragraph-ID: ([^\n]*)(\n|$)', '') t from b),
p as (select doc_id, title, t, list_zip(regexp_extract_all(t, '(?i)-+ Page (\d+) -+', 1), list_transform(string_split_regex(t, '(?i)-+ Page \d+ -+')[2:], lambda x: {_trim('x')})) z from c),
q as (select doc_id, title, t, list_filter(z, lambda x: x[2] <> '') z from p),
pl as (select doc_id, title, case when len(z) > 0 then list_transform(z, lambda x: {{'page': cast(x[1] as integer), 'content': x[2]}}) else [{{'page': 1, 'content': {_trim(r"regexp_replace(t, '(?i)-+ Page \d+ -+', '', 'g')")}}}] end u from q),
r as (select doc_id, title, page_no, u[page_no] u from (select doc_id, title, u, unnest(range(1, len(u) + 1)) page_no from pl))
"""


@register("parsed_pages", f"with {_PAGES} select doc_id, title, u.page as page, length(u.content) as n_chars, md5(u.content) as content_md5 from r")
def parsed_pages(spark: SparkSession, sf: str) -> DataFrame:
    p = corpus.parse_pages(table(spark, sf, "documents"), "doc_id", "text")
    return p.select(F.col("source").alias("doc_id"), "title", "page", F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("content_md5"))


@register("document_chunks", rf"""
with {_PAGES}, se as (select doc_id, title, page_no, u.page page, {_sent('u.content')} s from r),
w as (select doc_id, title, page_no, page, i, array_to_string(s[i + 1 : i + 6], ' ') txt from (select *, unnest(range(0, len(s), 6)) i from se)),
n as (select *, row_number() over (partition by doc_id order by page_no, i) - 1 sent_id from w)
select doc_id, md5(concat_ws('-', cast(doc_id as varchar), title, cast(sent_id as varchar))) as id, title, page, cast(sent_id as integer) as sent_id, md5(txt) as text_md5 from n""")
def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Pages, then windows: the whole of the ingest."""
    c = corpus.chunk_documents(table(spark, sf, "documents"), "doc_id", "text")
    return c.select(F.col("source").alias("doc_id"), "id", "title", "page", "sent_id", F.md5("text").alias("text_md5"))


@register("next_edges", """
select record_id as src_id, dst_id from (select record_id, lead(record_id) over (partition by source order by sent_id, record_id) dst_id from chunks) where dst_id is not null""")
def next_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.next_edges(table(spark, sf, "chunks").drop("id").withColumnRenamed("record_id", "id"))


_META = ", ".join(f"nullif(trim({c}), '') as {c}" for c in corpus.METADATA)
_FILLED = " + ".join(f"cast({c} is not null as int)" for c in corpus.METADATA)
_ORD = ", ".join(f"{c} desc nulls last" for c in corpus.METADATA)


@register("chunk_metadata", f"""
with m as (select source, {_META} from source_metadata), r as (select *, row_number() over (partition by source order by {_FILLED} desc, {_ORD}) k from m)
select c.record_id, r.author, r.publisher, r.published_at, r.category, r.url from chunks c left join r on c.source = r.source and r.k = 1""")
def chunk_metadata(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").select("record_id", "source")
    return corpus.with_metadata(c, table(spark, sf, "source_metadata")).drop("source")


def questions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 3).cast("long").alias("chunk_id"), F.col("label").alias("source"), "embedding")
    return e.where("id % 3 = 2"), e.where("id % 3 = 1")


_HOP = """
e as (select vec_id id, vec_id // 3 chunk_id, label src, cast(embedding as double[]) v from embeddings),
best as (select p.id qplus_id, p.chunk_id src_id, m.id qminus_id, m.chunk_id dst_id, round(list_cosine_similarity(p.v, m.v), 12) s,
  row_number() over (partition by p.id order by round(list_cosine_similarity(p.v, m.v), 12) desc, m.id) r
  from e p join e m on p.id % 3 = 2 and m.id % 3 = 1 and p.src <> m.src),
hop as (select qplus_id, src_id, qminus_id, dst_id, s from best where r = 1 and src_id <> dst_id),
merged as (select src_id, dst_id, max(s) s, array_to_string(list_sort(list(qplus_id)), ',') ids from hop group by src_id, dst_id)
"""


@register("hop_edges", f"with {_HOP} select qplus_id, src_id, qminus_id, dst_id, round(s, 6) as score from hop")
def hop_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.hop_matches(*questions(spark, sf)).withColumn("score", F.round("score", 6))


@register("hop_edges_merged", f"with {_HOP} select src_id, dst_id, round(s, 6) as score, ids from merged")
def hop_edges_merged(spark: SparkSession, sf: str) -> DataFrame:
    m = graph.merge_hops(graph.hop_matches(*questions(spark, sf)))
    return m.select("src_id", "dst_id", F.round("q_minus_score", 6).alias("score"), F.array_join("source_question_ids", ",").alias("ids"))


@register("hop_reciprocal", f"""
with {_HOP}, back as (select m.id qminus_id, p.id back_id, row_number() over (partition by m.id order by round(list_cosine_similarity(p.v, m.v), 12) desc, p.id) r
  from e m join e p on p.id % 3 = 2 and m.id % 3 = 1 and p.src <> m.src)
select qplus_id, qminus_id, coalesce(back_id = qplus_id, false) as reciprocal from hop left join back on hop.qminus_id = back.qminus_id and back.r = 1""".replace("select qplus_id, qminus_id", "select qplus_id, hop.qminus_id as qminus_id"))
def hop_reciprocal(spark: SparkSession, sf: str) -> DataFrame:
    plus, minus = questions(spark, sf)
    return graph.reciprocal(graph.hop_matches(plus, minus), plus, minus).select("qplus_id", "qminus_id", "reciprocal")


def starts(spark: SparkSession, sf: str) -> DataFrame:
    """Every fiftieth vector asks; its five nearest bodies start."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.lit(None).cast("int").alias("grp"))
    top = block_top_k(e.where("id % 50 = 0"), e.where("id % 3 = 0"), 5)
    return materialize(top.select(F.col("qid").alias("query_id"), F.floor(F.col("tid") / 3).cast("long").alias("id"), (1.0 / F.col("rank")).alias("representation_score")), "starts")


_START = """
st as (select query_id, id, 1.0 / r rep from (select q.id query_id, b.id // 3 id, row_number() over (partition by q.id order by round(list_cosine_similarity(q.v, b.v), 12) desc, b.id) r
  from e q join e b on q.id % 50 = 0 and b.id % 3 = 0) where r <= 5)
"""


@register("dense_topk", f"""
with {_HOP.split('best as')[0].strip().rstrip(',')} select query_id, id, rank, round(s, 6) as score from (
 select q.id query_id, t.id, round(list_cosine_similarity(q.v, t.v), 12) s, row_number() over (partition by q.id order by round(list_cosine_similarity(q.v, t.v), 12) desc, t.id) rank
 from e q join e t on q.id % 50 = 0) where rank <= 12""")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.lit(None).cast("int").alias("grp"))
    return block_top_k(e.where("id % 50 = 0"), e, 12).select(F.col("qid").alias("query_id"), F.col("tid").alias("id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@register("owner_collapse", f"""
with {_HOP.split('best as')[0].strip().rstrip(',')}, hits as (select q.id query_id, t.chunk_id owner_id, t.id question_id, round(list_cosine_similarity(q.v, t.v), 12) s,
   row_number() over (partition by q.id order by round(list_cosine_similarity(q.v, t.v), 12) desc, t.id) r from e q join e t on q.id % 50 = 0 and t.id % 3 = 1),
g as (select query_id, owner_id, max(s) s, array_to_string(list_sort(list(question_id)), ',') matched from hits where r <= 36 group by query_id, owner_id)
select query_id, owner_id, round(s, 6) as score, matched from (select *, row_number() over (partition by query_id order by s desc, owner_id) k from g) where k <= 12""")
def owner_collapse(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.lit(None).cast("int").alias("grp"))
    hits = block_top_k(e.where("id % 50 = 0"), e.where("id % 3 = 1"), retrieval.K * retrieval.WIDTH["q_minus"])
    hits = hits.select(F.col("qid").alias("query_id"), F.floor(F.col("tid") / 3).cast("long").alias("owner_id"), F.col("tid").alias("question_id"), "score")
    return retrieval.owner_collapse(hits, retrieval.K).select("query_id", "owner_id", F.round("score", 6).alias("score"), F.array_join("matched", ",").alias("matched"))


def bodies(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of the graph that the embeddings stand for."""
    e = table(spark, sf, "embeddings").where("vec_id % 3 = 0").select(F.floor(F.col("vec_id") / 3).cast("long").alias("id"), F.col("label").alias("source"))
    return rank_within(e, ["source"], [F.col("id").asc()]).select("id", "source", (F.col("rank") - 1).alias("sent_id"), F.lit("x").alias("text"))


def edges(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, NEXT, HOP) of the graph that the embeddings stand for."""
    c = bodies(spark, sf)
    return c, graph.next_edges(c), materialize(graph.merge_hops(graph.hop_matches(*questions(spark, sf))), "hops")


_EDGES = _HOP + """,
body as (select vec_id // 3 id, label src from embeddings where vec_id % 3 = 0),
nx as (select id a, lead(id) over (partition by src order by id) b from body),
nxt as (select a, b from nx where b is not null union all select b, a from nx where b is not null),
""" + _START
_FRONT = """,
fr as (select distinct st.query_id, st.id src_id, b id, 'next' path_type from st join nxt on nxt.a = st.id union all
       select distinct st.query_id, st.id, dst_id, 'hop' from st join merged on merged.src_id = st.id)
"""


@register("expand_one_step", f"""
with {_EDGES} {_FRONT}, inh as (select fr.query_id, fr.id, max(st.rep * 0.5) inherited, count(*) paths from fr join st on st.query_id = fr.query_id and st.id = fr.src_id group by fr.query_id, fr.id)
select coalesce(st.query_id, inh.query_id) as query_id, coalesce(st.id, inh.id) as id, round(coalesce(st.rep, inherited), 6) as representation_score, st.id is not null as direct, coalesce(paths, 0) as paths
from st full outer join inh on st.query_id = inh.query_id and st.id = inh.id""")
def expand_one_step(spark: SparkSession, sf: str) -> DataFrame:
    _, nxt, hop = edges(spark, sf)
    s = starts(spark, sf)
    return graph.expand(s, graph.frontier(s, nxt, hop)).withColumn("representation_score", F.round("representation_score", 6))


@register("edge_variants", f"""
with {_EDGES} {_FRONT} select 'full' as variant, query_id, count(*) as edges, count(distinct id) as passages from fr group by query_id
union all select 'next_only', query_id, count(*), count(distinct id) from fr where path_type = 'next' group by query_id
union all select 'hop_only', query_id, count(*), count(distinct id) from fr where path_type = 'hop' group by query_id""")
def edge_variants(spark: SparkSession, sf: str) -> DataFrame:
    _, nxt, hop = edges(spark, sf)
    s = starts(spark, sf)
    out = None
    for v in ("full", "next_only", "hop_only", "none"):
        one = graph.frontier(s, nxt, hop, v).groupBy("query_id").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("id").alias("passages")).select(F.lit(v).alias("variant"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@register("local_edge_rank", f"""
with {_EDGES} {_FRONT} select query_id, src_id, id, path_type, cast(row_number() over (partition by query_id, src_id, path_type order by id) - 1 as integer) as edge_rank from fr""")
def local_edge_rank(spark: SparkSession, sf: str) -> DataFrame:
    _, nxt, hop = edges(spark, sf)
    return graph.frontier(starts(spark, sf), nxt, hop)


_NEAR = _EDGES + ", ed as (select distinct a, b from nxt union select distinct src_id, dst_id from merged), l0 as (select query_id, id, rep, 0 depth from st)"
for _d in (1, 2, 3):
    _seen = " union all ".join(f"select query_id, id from l{i}" for i in range(_d))
    _NEAR += f", l{_d} as (select query_id, b id, max(rep) * 0.5 rep, {_d} depth from l{_d - 1} join ed on ed.a = l{_d - 1}.id where (query_id, b) not in ({_seen}) group by query_id, b)"


@register("depth_neighborhood", f"with {_NEAR} select query_id, id, round(rep, 6) as representation_score, depth from (select * from l0 union all select * from l1 union all select * from l2 union all select * from l3)")
def depth_neighborhood(spark: SparkSession, sf: str) -> DataFrame:
    _, nxt, hop = edges(spark, sf)
    both = nxt.unionByName(nxt.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))).unionByName(hop.select("src_id", "dst_id")).distinct()
    return graph.neighbourhoods(starts(spark, sf), both, 3).withColumn("representation_score", F.round("representation_score", 6))


@register("graph_additions", f"with {_EDGES} select distinct st.query_id, dst_id as id from st join merged on merged.src_id = st.id where (st.query_id, dst_id) not in (select query_id, id from st)")
def graph_additions(spark: SparkSession, sf: str) -> DataFrame:
    _, _, hop = edges(spark, sf)
    s = starts(spark, sf)
    return graph.additions(s, s, hop.select("src_id", "dst_id"))


_PLANTED = """
c as (select record_id id, source, sent_id, text from chunks), n0 as (select * from (select id src_id, lead(id) over (partition by source order by sent_id, id) dst_id from c) where dst_id is not null),
n as (select * from n0 where src_id % 10 <> 0 union all select id, id + 3 from c where id % 17 = 0),
h as (select id src_id, id + 7 dst_id from c union all select id, id from c where id % 11 = 0 union all select id, id + 7 from c where id % 13 = 0),
g as (select a.id src_id, b.id dst_id from c a join c b on a.source = b.source and b.sent_id = a.sent_id + 1)
"""


@register("integrity_checks", f"""
with {_PLANTED}
select 'duplicate_chunk' as "check", count(*) as violations from (select id from c group by id having count(*) > 1)
union all select 'blank_chunk', count(*) from c where text is null or trim(text) = ''
union all select 'next_source_missing', count(*) from n where src_id not in (select id from c)
union all select 'next_target_missing', count(*) from n where dst_id not in (select id from c)
union all select 'next_out_degree', count(*) from (select src_id from n group by src_id having count(*) > 1)
union all select 'next_in_degree', count(*) from (select dst_id from n group by dst_id having count(*) > 1)
union all select 'next_crosses_source', count(*) from n join c a on a.id = src_id join c b on b.id = dst_id where a.source <> b.source
union all select 'next_gap', count(*) from g where (src_id, dst_id) not in (select src_id, dst_id from n)
union all select 'hop_source_missing', count(*) from h where src_id not in (select id from c)
union all select 'hop_target_missing', count(*) from h where dst_id not in (select id from c)
union all select 'hop_to_itself', count(*) from h where src_id = dst_id
union all select 'duplicate_hop', count(*) from (select src_id, dst_id from h group by src_id, dst_id having count(*) > 1)
union all select 'hop_within_source', count(*) from h join c a on a.id = src_id join c b on b.id = dst_id where a.source = b.source""")
def integrity_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The passages of the corpus with faults planted in both kinds of edges: links left out, crossing, doubled, to nowhere."""
    c = table(spark, sf, "chunks").select(F.col("record_id").alias("id"), "source", "sent_id", "text")
    to = lambda d, k: d.select(F.col("id").alias("src_id"), (F.col("id") + k).alias("dst_id"))
    nxt = graph.next_edges(c).where("src_id % 10 <> 0").unionByName(to(c.where("id % 17 = 0"), 3))
    hop = to(c, 7).unionByName(to(c.where("id % 11 = 0"), 0)).unionByName(to(c.where("id % 13 = 0"), 7))
    return graph.integrity(c, nxt, hop)


@register("graph_integrity", f"""
with {_EDGES.split('nxt as')[0].strip().rstrip(',')}, nt as (select a src_id, b dst_id from nx where b is not null),
g as (select id, src, row_number() over (partition by src order by id) r from body), gap as (select a.id src_id, b.id dst_id from g a join g b on a.src = b.src and b.r = a.r + 1),
prov as (select src_id, dst_id, cast(unnest(string_split(ids, ',')) as bigint) qplus_id from merged)
select 'duplicate_chunk' as "check", count(*) as violations from (select id from body group by id having count(*) > 1)
union all select 'blank_chunk', 0
union all select 'next_source_missing', count(*) from nt where src_id not in (select id from body)
union all select 'next_target_missing', count(*) from nt where dst_id not in (select id from body)
union all select 'next_out_degree', count(*) from (select src_id from nt group by src_id having count(*) > 1)
union all select 'next_in_degree', count(*) from (select dst_id from nt group by dst_id having count(*) > 1)
union all select 'next_crosses_source', count(*) from nt join body a on a.id = src_id join body b on b.id = dst_id where a.src <> b.src
union all select 'next_gap', count(*) from gap where (src_id, dst_id) not in (select src_id, dst_id from nt)
union all select 'hop_source_missing', count(*) from merged where src_id not in (select id from body)
union all select 'hop_target_missing', count(*) from merged where dst_id not in (select id from body)
union all select 'hop_to_itself', count(*) from merged where src_id = dst_id
union all select 'duplicate_hop', count(*) from (select src_id, dst_id from merged group by src_id, dst_id having count(*) > 1)
union all select 'hop_within_source', count(*) from merged join body a on a.id = src_id join body b on b.id = dst_id where a.src = b.src
union all select 'hop_provenance', count(*) from prov where (qplus_id, dst_id) not in (select qplus_id, m.chunk_id from hop join e m on m.id = hop.qminus_id)""")
def graph_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """The checks over the graph that the embeddings stand for, with its hop edges and their provenance."""
    plus, minus = questions(spark, sf)
    matches = materialize(graph.hop_matches(plus, minus), "hop-matches")
    c = bodies(spark, sf)
    return graph.integrity(c, graph.next_edges(c), graph.merge_hops(matches), matches, minus)


@register("capacity", """
select cast(sum(n) as bigint) as records, cast(sum(b) as bigint) as logical_bytes from (
 select count(*) n, 8 * sum(len(embedding)) + 8 * count(*) b from embeddings union all select count(*), sum(coalesce(length(text), 0)) + 8 * count(*) from chunks)""")
def capacity(spark: SparkSession, sf: str) -> DataFrame:
    return graph.capacity(table(spark, sf, "embeddings"), "embedding", table(spark, sf, "chunks"))


@register("rewired_degrees", f"""
with {_EDGES.split('nxt as')[0].strip().rstrip(',')}, m as (select src_id, dst_id from merged join body a on a.id = src_id join body b on b.id = dst_id where a.src is distinct from b.src),
d as (select src_id node, 1 o, 0 i from m union all select dst_id, 0, 1 from m)
select r as repeat, node, cast(sum(o) as bigint) as out_degree, cast(sum(i) as bigint) as in_degree from d, (select unnest([0, 1, 2]) r) group by r, node""")
def rewired_degrees(spark: SparkSession, sf: str) -> DataFrame:
    """Every node has the degrees it had, in each of three random graphs; the tests hold the rest."""
    c, _, hop = edges(spark, sf)
    side = lambda n: c.select(F.col("id").alias(n), F.col("source").alias(f"s{n}"))
    across = hop.join(side("src_id"), "src_id").join(side("dst_id"), "dst_id").where("not (ssrc_id <=> sdst_id)").select("src_id", "dst_id")
    out = stats.rewired(across, c, 3)
    end = lambda a, o, i: out.select("repeat", F.col(a).alias("node"), F.lit(o).alias("o"), F.lit(i).alias("i"))
    both = end("src_id", 1, 0).unionByName(end("dst_id", 0, 1))
    return both.groupBy("repeat", "node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


_PART = " || '|' || ".join(f"cast(sum(cast('0x' || substr(h, {a}, 8) as bigint)) as varchar)" for a in (1, 9, 17, 25))


@register("corpus_digest", f"""
with d as (select sha256(concat_ws(chr(1), coalesce(cast(doc_id as varchar), chr(2)), coalesce(text, chr(2)))) h from documents)
select count(*) as rows, sha256(cast(count(*) as varchar) || '|' || {_PART}) as digest from d""")
def corpus_digest(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.table_digest(table(spark, sf, "documents"), "doc_id", "text")


@register("boilerplate_clean", rf"""
select doc_id, md5({_trim(r"regexp_replace(regexp_replace(regexp_replace(text, '(?m)^CLICK HERE TO .*\n?', '', 'g'), '(?m)^APP USERS CLICK HERE[\s\x0b]*\n?', '', 'g'), '(?m)^(WEEK \d+ [A-Z ]+|MORE [A-Z0-9 ''/.-]+):.*\n([^\n]*\|[^\n]*\n)?', '', 'g')")}) as clean_md5 from documents""")
def boilerplate_clean(spark: SparkSession, sf: str) -> DataFrame:
    from strandloom.functions.text import strip_boilerplate

    return table(spark, sf, "documents").select("doc_id", F.md5(strip_boilerplate(F.col("text"))).alias("clean_md5"))


@register("cross_channel_texts", """
with t as (select record_id, source, lower(trim(text)) k from chunks where trim(text) <> ''), g as (select k, count(*) copies, count(distinct source) sources from t group by k having count(distinct source) > 1)
select md5(k) as text_class, record_id, copies, sources from t join g using (k)""")
def cross_channel_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Passages whose text several sources have: each with its class, of which the size is told and no pairs are made."""
    return graph.shared_texts(table(spark, sf, "chunks"), "record_id", "source", "text")


@register("sentence_store", """
select s.source_id, s.title, cast(i as integer) as idx, md5(x[i + 1]) as sentence_md5 from (
 select distinct source_id, title, from_json(case when json_valid(sentences) and json_type(sentences) = 'ARRAY' then sentences end, '["VARCHAR"]') x from paragraphs) s, unnest(range(0, len(x))) u(i)""")
def sentence_store(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.sentences_of(table(spark, sf, "paragraphs")).select("source_id", "title", "idx", F.md5("sentence").alias("sentence_md5"))
