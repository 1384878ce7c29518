"""Queries over saved runs: official means, replay, audits, budgets, pools and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import budget, coverage, graph, official, retrieval
from strandloom.operators.budget import quarter_counter
from strandloom.plans.catalogue import register
from strandloom.plans.q_evaluation import _HIT, _KEYS, _RESP, _UNITS, _round, arm, gold, pools, responses, retrieved
from strandloom.plans.q_index import _EDGES, _HOP, bodies, edges, questions, starts
from strandloom.plans.q_retrieval import _CAND, _HITS, _RANKS, _SIZE, candidates, channel_hits, sized
from strandloom.session import materialize, table
from strandloom.sources import corpus


def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events as evaluated rows: errors have failed, signups are the null questions."""
    t = F.col("event_type")
    kind = F.when(t == "signup", "null_query").otherwise(t)
    return table(spark, sf, "events").select("event_id", kind.alias("question_type"), F.abs("value").alias("accuracy"), (F.abs("value") / 10).alias("mrr"), (t == "error").alias("failed"))


@register("official_means", """
with e as (select case when event_type = 'signup' then 'null_query' else event_type end k, case when event_type = 'error' then 0 else abs(value) end a, case when event_type = 'error' then 0 else abs(value) / 10 end m from events)
select 'qa' as section, 'all' as question_type, 'accuracy' as metric, count(*) as rows, round(avg(a), 6) as mean from e
union all select 'qa_by_type', k, 'accuracy', count(*), round(avg(a), 6) from e group by k
union all select 'qa_non_null', 'all', 'accuracy', count(*), round(avg(a), 6) from e where k <> 'null_query'
union all select 'retrieval', 'all', 'mrr', count(*), round(avg(m), 6) from e where k <> 'null_query'""")
def official_means(spark: SparkSession, sf: str) -> DataFrame:
    return _round(official.official_means(report_rows(spark, sf), ["accuracy"], ["mrr"], "question_type", F.col("failed")), "mean")


@register("paired_type_means", """
with a as (select user_id, avg(value) v from events where event_type = 'click' group by user_id), b as (select user_id, avg(value) v from events where event_type = 'view' group by user_id)
select cast(user_id % 3 as varchar) as question_type, count(*) as n, round(avg(a.v), 6) as left, round(avg(b.v), 6) as right, round(avg(a.v - b.v), 6) as diff from a join b using (user_id) group by 1""".replace("as left", 'as "left"').replace("as right", 'as "right"'))
def paired_type_means(spark: SparkSession, sf: str) -> DataFrame:
    a = arm(spark, sf, "click").withColumn("kind", (F.col("original_query_id") % 3).cast("string"))
    return _round(official.paired_type_means(a, arm(spark, sf, "view"), "original_query_id", "value", "kind"), "left", "right", "diff")


@register("common_ranking", f"""
with {_HIT}, g as (select query_id, len(coalesce(facts, [])) n from it), fx as (select query_id, cf, min(r) r from h where r <= 10 group by query_id, cf), pq as (select query_id, min(r) f, sum(1.0 / r) ap, count(*) k from fx group by query_id)
select g.query_id, n as gold_count, case when f <= 4 then 1.0 else 0.0 end as hits_4, case when f <= 10 then 1.0 else 0.0 end as hits_10, round(coalesce(1.0 / f, 0), 6) as mrr_10, round(coalesce(ap / least(n, 10), 0), 6) as map_10, round(coalesce(k / n, 0), 6) as recall_10
from g left join pq using (query_id) where n > 0""")
def common_ranking(spark: SparkSession, sf: str) -> DataFrame:
    c = official.common_ranking(retrieved(spark, sf), gold(spark, sf))
    return _round(c, "mrr_10", "map_10", "recall_10").withColumn("gold_count", F.col("gold_count").cast("long"))


@register("ranking_intervals")
def ranking_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of the five metrics by gold count; numpy's own stream, so the tests compare with numpy."""
    c = official.common_ranking(retrieved(spark, sf), gold(spark, sf)).withColumn("cluster", F.substring("query_id", 1, 9))
    return _round(official.ranking_intervals(c, "cluster", "query_id", repeats=1_000), "mean", "low", "high")


@register("strict_pairs", """
with p as (select user_id, avg(value) a, max(value) b from events group by user_id) select 'value' as metric, count(*) as n, round(avg(a - b), 6) as mean from p""")
def strict_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    side = lambda f: e.groupBy("user_id").agg(f("value").alias("value"))
    d = official.strict_pairs(side(F.avg), side(F.max), "user_id", ["value"])
    return d.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("diff"), 6).alias("mean"))


@register("replay_faults", f"""
with {_RESP}, i as (select distinct dataset, method, query_id, sha256(context) now, context_sha256 then_ from synthesis_inputs), r as (select dataset, method, query_id, model, status, context_sha256 read from resp),
b as (select * from i join r using (dataset, method, query_id))
select 'repeated_response' as fault, count(*) as n from (select 1 from r group by dataset, method, query_id having count(*) > 1)
union all select 'missing_response', count(*) from i where (dataset, method, query_id) not in (select dataset, method, query_id from r)
union all select 'response_without_input', count(*) from (select distinct dataset, method, query_id from r where (dataset, method, query_id) not in (select dataset, method, query_id from i))
union all select 'not_completed', count(*) from b where status is distinct from 'completed'
union all select 'other_context', count(*) from b where read is distinct from then_
union all select 'input_digest', count(*) from i where now is distinct from then_
union all select 'models', greatest(count(distinct model) + max(cast(model is null as int)) - 1, 0) from r""")
def replay_faults(spark: SparkSession, sf: str) -> DataFrame:
    return official.replay_faults(table(spark, sf, "synthesis_inputs"), responses(spark, sf), _KEYS)


def _answered(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "synthesis_inputs").join(responses(spark, sf).select(*_KEYS), _KEYS, "left_semi")


_WORDS = r"list_filter(string_split_regex(lower(coalesce({}, '')), '[\s\x0b\x85\p{{Z}}]+'), lambda w: w <> '')"


@register("replay_scores", f"""
with {_RESP}, t as (select dataset, method, query_id, min(context) c, min(question_type) question_type, bool_or(returned_passages > 4) failed from synthesis_inputs group by all)
select dataset, method, query_id, question_type, case when failed then 0.0 else cast(list_has_any({_WORDS.format('answer')}, {_WORDS.format('c')}) as double) end as qa_accuracy from t join resp using (dataset, method, query_id)""")
def replay_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of the common reader against their contexts, as the tables have no answers of a gold standard."""
    i = _answered(spark, sf)
    truth = i.groupBy(*_KEYS).agg(F.min("context").alias("ground_truth"), F.min("question_type").alias("question_type"), F.bool_or(F.col("returned_passages") > 4).alias("failed"))
    return official.replay_scores(i, responses(spark, sf), truth, _KEYS).select(*_KEYS, "question_type", "qa_accuracy")


@register("returned_context", f"""
with {_CAND} {_RANKS}, o as (select query_id, id, row_number() over (partition by query_id order by f desc, coalesce(fin, 0) desc, id desc) r from fu), k as (select id, min(title) title, min(page) page, min(sent_id) sent_id, min(text) text from chunks group by id),
b as (select query_id, r, '[[' || coalesce(title, 'Unknown') || ', Page ' || coalesce(page, 0) || ', Chunk ' || coalesce(sent_id, 0) || ']]' || chr(10) || coalesce(text, '') b from o join k using (id) where r <= 12)
select query_id, sha256(string_agg(b, chr(10) || chr(10) order by r)) as context_sha256 from b group by query_id""")
def returned_context(spark: SparkSession, sf: str) -> DataFrame:
    k = table(spark, sf, "chunks").groupBy("id").agg(*(F.min(c).alias(c) for c in ("title", "page", "sent_id", "text")))
    top = retrieval.rank_fusion(candidates(spark, sf)).select("query_id", "id", "rank").join(k, "id")
    return official.returned_context(top).select("query_id", "context_sha256")


@register("reader_jobs", """
select dataset, method, query_id, md5('5|' || dataset || '|' || method || '|' || query_id) as ord from (select distinct dataset, method, query_id, context_sha256 from synthesis_inputs) i
where not exists (select 1 from reader_responses r where r.status = 'completed' and r.dataset = i.dataset and r.method = i.method and r.query_id = i.query_id and r.context_sha256 = i.context_sha256)""")
def reader_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return official.reader_jobs(table(spark, sf, "synthesis_inputs"), table(spark, sf, "reader_responses"), _KEYS, 5)


@register("committed_traces", f"""
with {_RESP}, i as (select concat_ws('/', dataset, method, query_id) query_id, min(sha256(context)) trace from synthesis_inputs group by 1), c as (select concat_ws('/', dataset, method, query_id) query_id from resp)
select query_id, trace from c join i using (query_id)""")
def committed_traces(spark: SparkSession, sf: str) -> DataFrame:
    """Completed rows with the trace of their input; inputs without a response are traces that nobody asks for."""
    key = F.concat_ws("/", *_KEYS)
    traces = table(spark, sf, "synthesis_inputs").groupBy(key.alias("query_id")).agg(F.min(F.sha2("context", 256)).alias("trace"))
    done = responses(spark, sf).join(table(spark, sf, "synthesis_inputs").select(*_KEYS).distinct(), _KEYS, "left_semi").select(key.alias("query_id"))
    return official.traces_of(done, traces)


@register("recorded_scores", "select concat_ws('/', dataset, method, query_id) as query_id, md5(min(context)) as recorded_md5 from synthesis_inputs group by 1")
def recorded_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every input with its recorded payload, whose digest is checked in the plan."""
    i = table(spark, sf, "synthesis_inputs").groupBy(F.concat_ws("/", *_KEYS).alias("query_id")).agg(F.min("context").alias("payload"))
    recorded = i.withColumn("payload_sha256", F.sha2("payload", 256))
    return official.recorded_scores(i.select("query_id"), recorded, "query_id", "payload", "payload_sha256").select("query_id", F.md5("payload").alias("recorded_md5"))


@register("annotation_gaps", """
with s as (select title, cast(i as integer) idx from (select distinct source_id, title, from_json(case when json_valid(sentences) and json_type(sentences) = 'ARRAY' then sentences end, '["VARCHAR"]') x from paragraphs) s, unnest(range(0, len(x))) u(i)),
n as (select title, max(idx) + 1 n from s group by title), a as (select distinct title, idx + 2 idx from s) select a.title, a.idx from a left join n using (title) where a.idx >= coalesce(n, 0)""")
def annotation_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations moved two sentences on: those that then name none."""
    s = corpus.sentences_of(table(spark, sf, "paragraphs")).select("title", "idx")
    return official.annotation_gaps(s.select("title", (F.col("idx") + 2).alias("idx")).distinct(), s)


@register("prefix_audit", f"""
with {_CAND} {_RANKS}, o as (select query_id, id, row_number() over (partition by query_id order by f desc, coalesce(fin, 0) desc, id desc) r, s from fu),
a as (select query_id, r, id from o where r <= 12), b as (select query_id, s r, id from o where s <= 12)
select query_id, count(*) as mismatches from a full outer join b using (query_id, r) where a.id is distinct from b.id group by query_id""")
def prefix_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The fused order against that by similarity alone: where an executed prefix would not be the primary one."""
    f = materialize(retrieval.rank_fusion(candidates(spark, sf), None).select("query_id", "id", "rank", "semantic_rank"), "audit")
    one = lambda r: f.select("query_id", F.col(r).alias("rank"), "id", F.col("id").alias("text"))
    return official.prefix_audit(one("rank"), one("semantic_rank"), 12)


@register("run_scopes", """
with g as (select dataset, method, count(*) n from synthesis_inputs group by all) select dataset, method, case when contains(lower(method), 'smoke') then 'smoke' when n < 100 then 'sample' when n = 100 then 'official_split' else 'custom' end as scope, regexp_replace(lower(dataset), '[-_]', '', 'g') as evaluator from g""")
def run_scopes(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "synthesis_inputs").groupBy("dataset", "method").agg(F.count(F.lit(1)).alias("n"))
    return g.select("dataset", "method", official.scope(F.col("n"), F.lit(100), F.col("method"), F.lit(False)).alias("scope"), official.dataset_key(F.col("dataset")).alias("evaluator"))


@register("index_outcomes", """
select request_sha256 as target, case when status = 'completed' then 'index_complete' else status end as status, case when status = 'completed' then 'pending' else 'unavailable' end as quality_evaluation, cast(null as double) as quality_score, case when reader_seconds is not null then greatest(reader_seconds, 0) end as wall_seconds, case when model is not null then 'index' else 'smoke' end as phase from reader_responses""")
def index_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "reader_responses")
    t = r.select(F.col("request_sha256").alias("target"), F.when(F.col("status") == "completed", "index_complete").otherwise(F.col("status")).alias("state"), F.lit(0.0).alias("started_at"), F.col("reader_seconds").alias("finished_at"), F.when(F.col("model").isNotNull(), 0).alias("index_exit_code"))
    return official.outcomes(t)


@register("usage_totals", """
select coalesce(model, 'unknown') as model, count(*) as generation_calls, 0 as embedding_calls, coalesce(sum(length(answer)), 0)::bigint as prompt_tokens, 0::bigint as completion_tokens, coalesce(sum(length(answer)), 0)::bigint as total_tokens, round(coalesce(sum(reader_seconds), 0), 6) as reported_cost,
 bool_and(status = 'completed' and answer is not null) as token_usage_complete, bool_and(status = 'completed' and reader_seconds is not null) as cost_complete, count(*) filter (where status <> 'completed') as transport_failures,
 count(answer) as structured_attempts, count(*) filter (where not starts_with(answer, '{')) as structured_invalid, round(coalesce(sum(case when answer is not null then reader_seconds end), 0), 6) as structured_seconds from reader_responses group by 1""")
def usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "reader_responses")
    n = F.length("answer").cast("long")
    calls = r.select(F.coalesce("model", F.lit("unknown")).alias("model"), F.lit("generation").alias("kind"), (F.col("status") == "completed").alias("ok"), n.alias("prompt_tokens"), F.lit(None).cast("long").alias("completion_tokens"), n.alias("total_tokens"), F.col("reader_seconds").alias("cost"), F.col("answer").startswith("{").alias("valid"), F.col("reader_seconds").alias("elapsed"))
    return _round(official.usage_totals(calls, ["model"]), "reported_cost", "structured_seconds")


@register("stage_times", "select event_id, case when event_type = 'click' then value end as click_ms, case when event_type = 'view' then value end as view_ms from events")
def stage_times(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    step = F.struct(F.col("event_type").alias("step"), F.create_map(F.concat("event_type", F.lit("_ms")), "value").alias("values"))
    return e.select("event_id", *official.stage_times(F.array(step), {"click": ["click_ms"], "view": ["view_ms"]}))


@register("segment_seconds", "select r as run, round(sum(s), 6) as seconds from (select user_id % 10 r, user_id, arg_max(value, event_id) s from events group by all) group by r")
def segment_seconds(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select((F.col("user_id") % 10).alias("run"), F.col("user_id").alias("segment"), F.col("value").alias("seconds"), F.col("event_id").alias("at"))
    return _round(official.segment_seconds(e), "seconds")


@register("span_faults", """
with s as (select user_id, count(*) filter (where event_type = 'view') a, count(*) filter (where event_type in ('click', 'error')) b from events group by user_id)
select 'open_span' as fault, count(*) as n from s where a > 0 and b = 0 union all select 'unstarted_span', count(*) from s where a = 0
union all select 'lost_parent', count(*) from s where user_id > 0 and user_id - 1 not in (select user_id from s where a > 0)""")
def span_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Users as spans: a view starts one, a click or an error ends it, the user before is the parent."""
    t = F.col("event_type")
    e = table(spark, sf, "events").select(F.col("user_id").alias("span_id"), F.when(F.col("user_id") > 0, F.col("user_id") - 1).alias("parent_id"), F.when(t == "view", "start").when(t == "click", "result").when(t == "error", "error").otherwise("other").alias("event"))
    return official.span_faults(e)


@register("graph_statistics", f"""
with {_EDGES.split('nxt as')[0].strip().rstrip(',')}, qs as (select id, chunk_id, case when id % 3 = 2 then 'q_plus' else 'q_minus' end channel from e where id % 3 in (1, 2) and chunk_id in (select id from body)),
c as (select count(distinct src) td, count(distinct id) tc from body), q as (select count(distinct id) filter (where channel = 'q_minus') mq, count(distinct chunk_id) filter (where channel = 'q_minus') mc, count(distinct id) filter (where channel = 'q_plus') pq, count(distinct chunk_id) filter (where channel = 'q_plus') pc from qs),
l as (select count(distinct qplus_id) n from hop), m as (select count(*) n from merged), d as (select coalesce(max(k), 0) k from (select count(*) k from merged group by src_id)), a as (select count(*) n from hop)
select td as total_documents, tc as total_chunks, mq as q_minus_questions, mc as q_minus_chunks, pq as q_plus_questions, pc as q_plus_chunks, l.n as linked_q_plus_questions, m.n as total_hop_edges, 0 as hop_without_provenance, d.k as max_hop_out_degree, a.n as answered_by_edges,
 round(tc / td, 6) as avg_chunks_per_doc, round(mc / tc, 6) as q_minus_coverage, round(pc / tc, 6) as q_plus_coverage, round(mq / mc, 6) as avg_q_minus_per_covered_chunk, round(pq / pc, 6) as avg_q_plus_per_covered_chunk, round(l.n / pq, 6) as q_plus_direction_coverage,
 round(m.n / pc, 6) as avg_hop_out_degree_per_eligible_chunk, round(m.n / tc, 6) as avg_hop_out_degree_per_chunk from c, q, l, m, d, a""")
def graph_statistics(spark: SparkSession, sf: str) -> DataFrame:
    plus, minus = questions(spark, sf)
    matches = materialize(graph.hop_matches(plus, minus), "hop-matches")
    both = plus.withColumn("channel", F.lit("q_plus")).unionByName(minus.withColumn("channel", F.lit("q_minus")))
    s = graph.statistics(bodies(spark, sf), both, graph.merge_hops(matches), matches)
    return _round(s, *(c for c, t in s.dtypes if t == "double"))


@register("foreign_pools", f"with {_HOP.split('best as')[0].strip().rstrip(',')} select src as source, count(*) + 1 as pool from e where id % 3 = 1 group by src")
def foreign_pools(spark: SparkSession, sf: str) -> DataFrame:
    return graph.pool_sizes(questions(spark, sf)[1])


@register("reciprocal_ids", f"""
with {_HOP}, back as (select m.id qminus_id, p.id back_id, row_number() over (partition by m.id order by round(list_cosine_similarity(p.v, m.v), 12) desc, p.id) r from e m join e p on p.id % 3 = 2 and m.id % 3 = 1 and p.src <> m.src),
h as (select hop.*, coalesce(back_id = qplus_id, false) rc from hop left join back on hop.qminus_id = back.qminus_id and back.r = 1)
select src_id, dst_id, coalesce(array_to_string(list_sort(list(qplus_id) filter (where rc)), ','), '') as ids from h group by src_id, dst_id""")
def reciprocal_ids(spark: SparkSession, sf: str) -> DataFrame:
    plus, minus = questions(spark, sf)
    r = graph.reciprocal_ids(graph.reciprocal(graph.hop_matches(plus, minus), plus, minus))
    return r.select("src_id", "dst_id", F.array_join("reciprocal_ids", ",").alias("ids"))


@register("hop_bridges", f"""
with {_EDGES}, w as (select distinct st.query_id, dst_id id, cast(unnest(string_split(ids, ',')) as bigint) qid from st join merged on merged.src_id = st.id where (st.query_id, dst_id) not in (select query_id, id from st)),
b as (select query_id, id, min(qid) first_question, count(distinct v) bridges from w join (select id qid, v from e) x using (qid) group by query_id, w.id)
select query_id, b.id, bridges from b""")
def hop_bridges(spark: SparkSession, sf: str) -> DataFrame:
    """How many bridge embeddings lead to each passage that only hops reach."""
    _, _, hop = edges(spark, sf)
    plus, _ = questions(spark, sf)
    b = graph.bridges(starts(spark, sf), hop, plus)
    return b.select("query_id", "id", F.size("bridge_embeddings").cast("long").alias("bridges"))


@register("exact_prefix", f"""
with {_CAND} {_RANKS}, k as (select id, max(coalesce(length(text), 0)) n from chunks group by id), o as (select query_id, id, row_number() over (partition by query_id order by f desc, coalesce(fin, 0) desc, id desc) r from fu),
t as (select query_id, id, r, 6 + (length(query_id) + sum(2 + coalesce(n, 0)) over (partition by query_id order by r rows unbounded preceding)) // 4 p from o left join k using (id))
select query_id, id, cast(r as integer) as rank, cast(p as integer) as prompt_tokens from t where p <= 600""")
def exact_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts of a query and its passages, rendered and counted as they grow."""
    k = table(spark, sf, "chunks").groupBy("id").agg(F.max_by("text", F.struct(F.coalesce(F.length("text"), F.lit(0)), F.col("text"))).alias("block"))
    r = retrieval.rank_fusion(candidates(spark, sf), None).select("query_id", "id", "rank").join(k, "id", "left")
    q = r.select("query_id", F.col("query_id").alias("query")).distinct()
    return budget.exact_prefix(r, q, 600, quarter_counter, lambda query, blocks: query + "".join("\n\n" + b for b in blocks))


@register("prompt_sizes", "select distinct dataset, method, query_id, cast(2 + 8 + length(query) // 4 + length(context) // 4 as integer) as tokens from synthesis_inputs")
def prompt_sizes(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "synthesis_inputs")
    return i.select(*_KEYS, budget.message_tokens([F.col("query"), F.col("context")], quarter_counter).alias("tokens")).distinct()


@register("ceiling_sweep", """
with s as (select dataset || '/' || method || '/' || query_id query_id, min(returned_passages) * 10 a, min(length(context)) // 4 b from synthesis_inputs group by 1)
select query_id, share, cast(a + floor(share * (b - a)) as bigint) as ceiling from s, (select unnest([0.25, 0.5, 1.0]) share)""")
def ceiling_sweep(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "synthesis_inputs").groupBy(F.concat_ws("/", *_KEYS).alias("query_id"))
    return budget.ceilings(i.agg((F.min("returned_passages") * 10).alias("initial"), F.floor(F.min(F.length("context")) / 4).alias("full"))).withColumn("share", F.col("share").cast("double"))


@register("stage_recall", f"""
with {_UNITS} u as (select query_id, count(distinct unit) n from hits group by query_id), p as (select 'reachable' stage, query_id, id from gp union all select 'initial', query_id, id from st union all select 'direct', query_id, id from dp),
k as (select stage, query_id, count(distinct unit) k from p join hits using (query_id, id) group by stage, query_id)
select s.stage, count(*) as queries, round(avg(coalesce(k, 0) / n), 6) as recall, round(avg(case when coalesce(k, 0) = n then 1.0 else 0.0 end), 6) as complete from u cross join (select unnest(['reachable', 'initial', 'direct']) stage) s left join k on k.stage = s.stage and k.query_id = u.query_id group by s.stage""")
def stage_recall(spark: SparkSession, sf: str) -> DataFrame:
    _, s, g, d, h = pools(spark, sf)
    r = budget.stage_recall({"reachable": g, "initial": s, "direct": d}, h, h.groupBy("query_id").agg(F.count_distinct("unit").alias("units")))
    return _round(r, "recall", "complete")


@register("source_reach", f"""
with {_UNITS} ow as (select distinct id, source from chunks), u as (select distinct query_id from hits), rc as (select distinct query_id, source from gp join ow using (id)), a as (select query_id, count(distinct unit) k from gp join hits using (query_id, id) group by query_id),
o as (select h.query_id, count(distinct unit) k from hits h join ow using (id) join rc on rc.query_id = h.query_id and rc.source is not distinct from ow.source and rc.source is not null group by h.query_id), n as (select query_id, count(*) k from rc group by query_id)
select u.query_id, coalesce(a.k, 0) as passages, coalesce(n.k, 0) as sources, coalesce(o.k, 0) as oracle from u left join a using (query_id) left join n using (query_id) left join o using (query_id)""")
def source_reach(spark: SparkSession, sf: str) -> DataFrame:
    _, _, g, _, h = pools(spark, sf)
    owners = table(spark, sf, "chunks").select("id", "source").distinct()
    return budget.source_reach(g, owners, h, h.select("query_id").distinct())


@register("count_matched", f"""
with {_UNITS} og as (select * from gp where (query_id, id) not in (select query_id, id from st)), od as (select * from dp where (query_id, id) not in (select query_id, id from st)), cm as (select * from og intersect select * from od),
bd as (select g.query_id, least(g.n, d.n) n from (select query_id, count(*) n from og group by query_id) g join (select query_id, count(*) n from od group by query_id) d using (query_id)),
sh as (select c.*, row_number() over (partition by query_id order by coalesce(sim, 0) desc, id desc) s, row_number() over (partition by query_id order by coalesce(rep, 0) desc, id desc) p from c where (query_id, id) in (select query_id, id from cm union select query_id, id from st)),
o as (select query_id, id, row_number() over (partition by query_id order by 1.0 / s + case when coalesce(rep, 0) > 0 then 1.0 / p else 0 end desc, coalesce(sim, 0) desc, id desc) r from sh),
x as (select query_id, id, row_number() over (partition by query_id order by r) k from o where (query_id, id) not in (select query_id, id from st)),
f as (select query_id, id, 0 as rank from st union all select query_id, id, k from x join bd using (query_id) where k <= n)
select pool, query_id, id, rank from f, (select unnest(['graph', 'direct']) pool)""")
def count_matched(spark: SparkSession, sf: str) -> DataFrame:
    """Both pools cut to one number of passages of their intersection, each ranked anew by its own scores."""
    _, s, g, d, _ = pools(spark, sf)
    c = materialize(candidates(spark, sf).select("query_id", "id", F.col("similarity_score").alias("semantic_score"), "representation_score"), "matched")
    own = lambda p: c.join(p, ["query_id", "id"], "left_semi")
    return budget.count_matched({"graph": own(g), "direct": own(d)}, s).withColumn("rank", F.col("rank").cast("long"))


_WIDE = f"""{_HITS}, {_SIZE}, hw as (select * from (select *, row_number() over (partition by query_id, channel order by rrf desc, id) w from rrf) where w <= 256),
cw as (select query_id, channel, id, row_number() over (partition by query_id, channel order by rrf desc, id) w from hw), us as (select v, query_id, id, sum(1.0 / w) rep, min(w) best from (select 'direct' v, * from cw union all select 'body_only', * from cw where channel = 'body') group by v, query_id, id),
pj as (select us.*, coalesce(c.sim, 0) sim, best <= 12 keep, coalesce(tokens, 0) tok from us join c using (query_id, id) left join sz using (id)),
ra as (select *, row_number() over (partition by v, query_id order by sim desc, id desc) s, row_number() over (partition by v, query_id order by rep desc, id desc) p from pj),
rb as (select *, row_number() over (partition by v, query_id order by 1.0 / s + 1.0 / p desc, sim desc, id desc) r from ra), rn as (select *, sum(tok) over (partition by v, query_id order by keep desc, r rows unbounded preceding) used from rb)
"""


@register("wide_direct", f"with {_WIDE} select v as variant, query_id, count(*) as admitted, cast(sum(tok) as bigint) as tokens from rn where keep or used <= 2000 group by v, query_id")
def wide_direct(spark: SparkSession, sf: str) -> DataFrame:
    """Direct retrieval of 256 passages a channel, and of bodies alone: the first twelve of each channel stay, the others fill
    what is left of the ceiling in fused order."""
    hits = materialize(channel_hits(spark, sf), "wide-hits")
    size = sized(spark, sf, None).select("query_id", "id", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    sim = candidates(spark, sf).select("query_id", "id", F.coalesce("similarity_score", F.lit(0.0)).alias("final_score")).join(size, ["query_id", "id"])
    out = None
    for name, h in (("direct", hits), ("body_only", retrieval.channel_filter(hits, "body_only"))):
        wide = materialize(retrieval.hybrid(h, 256), "wide")
        keep = wide.groupBy("query_id", "id").agg((F.min("rank") <= 12).alias("keep"))
        pool = retrieval.role_union(wide).drop("representation_scores").join(sim, ["query_id", "id"]).join(keep, ["query_id", "id"])
        ranked = retrieval.rank_fusion(pool, None)
        one = retrieval.token_prefix(ranked, 2000, keep="keep").groupBy("query_id").agg(F.count(F.lit(1)).alias("admitted"), F.sum("tokens").alias("tokens")).select(F.lit(name).alias("variant"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@register("fusion_controls", f"""
with {_CAND} {_RANKS}, x as (select o, fu.*, 1.0 / (s + o) + case when coalesce(rep, 0) > 0 then 1.0 / (p + o) else 0 end g from fu, (select unnest([0.0, 10.0, 60.0]) o))
select o as offset_, query_id, id, r as rank from (select *, row_number() over (partition by o, query_id order by g desc, coalesce(fin, 0) desc, id desc) r from x) where r <= 12""")
def fusion_controls(spark: SparkSession, sf: str) -> DataFrame:
    """Offsets of the reciprocal ranks over one pool of ranks."""
    from strandloom.functions.vectors import rank_within

    c = retrieval.rank_fusion(candidates(spark, sf), None).drop("rank_fusion_score", "rank")
    parts = [c.withColumn("offset_", F.lit(k)).withColumn("score", budget.fused_terms(F.col("semantic_rank"), F.col("representation_rank"), F.col("representation_score"), offset=k)) for k in (0.0, 10.0, 60.0)]
    c = parts[0].unionByName(parts[1]).unionByName(parts[2])
    r = rank_within(c, ["offset_", "query_id"], [F.col("score").desc(), F.coalesce("final_score", F.lit(0.0)).desc(), F.col("id").desc()], 12)
    return r.select("offset_", "query_id", "id", F.col("rank").cast("long").alias("rank"))


@register("channel_retention", f"""
with {_CAND} {_RANKS}, t as (select query_id, id from (select query_id, id, row_number() over (partition by query_id order by f desc, coalesce(fin, 0) desc, id desc) r from fu) where r <= 12),
g as (select query_id, id, array_to_string(list_sort(list_distinct(list(channel))), '+') combination from real where channel in ('body', 'q_minus', 'q_plus') group by query_id, id),
n as (select combination, count(*) n, count(*) filter (where (query_id, id) in (select query_id, id from t)) k from g group by combination)
select x as combination, coalesce(n, 0) as n, coalesce(k, 0) as retained from unnest({list(coverage.COMBINATIONS)!r}) u(x) left join n on n.combination = x""")
def channel_retention(spark: SparkSession, sf: str) -> DataFrame:
    """What each set of channels found, and how much of it is among the twelve of the fused order."""
    c = table(spark, sf, "retrieval_candidates").where("query_id is not null and trim(id) <> ''")
    return coverage.channel_retention(c.select("query_id", "id", F.coalesce("channel", F.lit("body")).alias("channel")), retrieval.rank_fusion(candidates(spark, sf)))
