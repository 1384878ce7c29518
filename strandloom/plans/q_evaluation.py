"""Queries over answers, evidence, result rows and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.text import abstains, final_answer, normalise_answer, u_collapse
from strandloom.functions.vectors import HOT_ROWS, rank_whole
from strandloom.operators import coverage, graph, metrics, reports, stats, store
from strandloom.plans.catalogue import register
from strandloom.plans.q_index import _EDGES, _FRONT, edges, starts
from strandloom.plans.q_retrieval import _BM25, _CAND, _ITEMS, candidates, items, searched
from strandloom.session import materialize, table
from strandloom.sources import corpus

_KEYS = ["dataset", "method", "query_id"]


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def retrieved(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, rank, doc_id, text) of the full-text search for every evaluation item; only found documents keep a text."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")
    found = materialize(searched(spark, sf), "found")  # twelve a query: the planner sees its size and need not move the texts
    return found.join(d, "doc").select("query_id", "rank", F.col("doc").alias("doc_id"), "text")


def gold(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select("query_id", F.coalesce("evidence_facts", F.array().cast("array<string>")).alias("facts"))


_HIT = f"""{_BM25}, rt as (select query_id, r, doc_id, coalesce(text, '') text from bm join documents using (doc_id)),
gf as (select query_id, i fact_ix, facts[i + 1] fact, len(list_filter(facts, lambda f: trim(f) <> '')) n from (select query_id, facts, unnest(range(0, len(facts))) i from it) where trim(facts[i + 1]) <> ''),
h as (select query_id, fact_ix, n, replace(replace(fact, ' ', ''), chr(10), '') cf, r from rt join gf using (query_id) where contains(replace(replace(text, ' ', ''), chr(10), ''), replace(replace(fact, ' ', ''), chr(10), '')))
"""


@register("fact_hits", f"with {_HIT} select query_id, cast(fact_ix as integer) as fact_ix, r as rank from h")
def fact_hits(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.fact_hits(retrieved(spark, sf), gold(spark, sf)).select("query_id", "fact_ix", F.col("rank").cast("long").alias("rank"))


@register("rank_metrics", f"""
with {_HIT}, g as (select query_id, len(list_filter(coalesce(facts, []), lambda f: trim(f) <> '')) n from it),
fx as (select query_id, cf, min(r) r from h group by query_id, cf), ap as (select query_id, sum(1.0 / r) ap from fx where r <= 10 group by query_id),
px2 as (select query_id, min(r) f, count(distinct case when r <= 10 then fact_ix end) k from h where r <= 10 group by query_id)
select g.query_id, case when n > 0 then case when f <= 4 then 1.0 else 0.0 end end as hits_4, case when n > 0 then case when f <= 10 then 1.0 else 0.0 end end as hits_10,
 round(case when n > 0 then coalesce(1.0 / f, 0) end, 6) as mrr_10, round(case when n > 0 then coalesce(ap / least(n, 10), 0) end, 6) as map_10,
 round(case when n > 0 then coalesce(k, 0) / n end, 6) as exact_fact_recall_10, case when n > 0 then case when k = n then 1.0 else 0.0 end end as all_facts_10
from g left join px2 using (query_id) left join ap using (query_id)""")
def rank_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _round(metrics.ranking_metrics(retrieved(spark, sf), gold(spark, sf)), "mrr_10", "map_10", "exact_fact_recall_10")


def _norm(x: str) -> str:
    bare = rf"regexp_replace(lower(coalesce({x}, '')), '[!-/:-@\[-`{{-~]', '', 'g')"
    return rf"trim(regexp_replace(regexp_replace({bare}, '\b(a|an|the)\b', ' ', 'g'), '[\s\x0b\x85\p{{Z}}]+', ' ', 'g'))"


@register("fuzzy_fact_recall")
def fuzzy_fact_recall(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: word boundaries next to accents differ between the engines; the tests hold it against plain Python."""
    return _round(metrics.fuzzy_recall(retrieved(spark, sf), gold(spark, sf)), "evidence_fact_recall")


@register("doc_prf", f"""
with {_BM25}, k as (select query_id, list_distinct(list_filter(list(regexp_replace(lower(coalesce(trim(regexp_extract(text, '^Title: ([^\\n]*)', 1)), '')), '[^a-z0-9]+', '', 'g')), lambda x: x <> '')) r from bm join documents using (doc_id) group by query_id),
g as (select query_id, list_distinct(list_filter(list_transform(coalesce(evidence_docs, []), lambda x: regexp_replace(lower(trim(x)), '[^a-z0-9]+', '', 'g')), lambda x: x <> '')) g from it),
j as (select g.query_id, len(g) ng, coalesce(len(r), 0) nr, coalesce(len(list_intersect(g, r)), 0) tp from g left join k using (query_id))
select query_id, round(case when ng > 0 then case when nr > 0 then tp / nr else 0 end end, 6) as precision, round(case when ng > 0 then tp / ng end, 6) as recall,
 round(case when ng > 0 then case when tp > 0 then 2 * (tp / nr) * (tp / ng) / (tp / nr + tp / ng) else 0 end end, 6) as f1 from j""")
def doc_prf(spark: SparkSession, sf: str) -> DataFrame:
    r = retrieved(spark, sf).groupBy("query_id").agg(F.collect_list(F.regexp_extract("text", r"^Title: ([^\n]*)", 1)).alias("titles"))  # twelve a query
    return _round(metrics.document_prf(r, items(spark, sf).select("query_id", F.col("evidence_docs").alias("docs"))), "precision", "recall", "f1")


def responses(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "reader_responses").where("status = 'completed'")
    return store.latest(r, _KEYS, "completed_utc", "answer", "request_sha256")


_RESP = "resp as (select * from (select *, row_number() over (partition by dataset, method, query_id order by completed_utc desc, answer desc nulls last, request_sha256 desc nulls last) k from reader_responses where status = 'completed') where k = 1)"


@register("latest_responses", f"with {_RESP} select dataset, method, query_id, request_sha256, md5(answer) as answer_md5 from resp")
def latest_responses(spark: SparkSession, sf: str) -> DataFrame:
    return responses(spark, sf).select(*_KEYS, "request_sha256", F.md5("answer").alias("answer_md5"))


@register("pending_inputs", "select distinct dataset, method, query_id from synthesis_inputs where (dataset, method, query_id) not in (select dataset, method, query_id from reader_responses where status = 'completed')")
def pending_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Inputs that no completed response answers: what a resumed run has left to do."""
    wanted = table(spark, sf, "synthesis_inputs").select(*_KEYS).distinct()
    return store.pending(wanted, table(spark, sf, "reader_responses").where("status = 'completed'"), _KEYS)


@register("reusable_responses", """
select distinct r.dataset, r.method, r.query_id, r.context_sha256 from reader_responses r join synthesis_inputs i using (dataset, method, query_id, context_sha256) where r.status = 'completed'""")
def reusable_responses(spark: SparkSession, sf: str) -> DataFrame:
    keys = [*_KEYS, "context_sha256"]
    log = table(spark, sf, "reader_responses").where("status = 'completed'").select(*keys)
    return store.reusable(table(spark, sf, "synthesis_inputs"), log, keys)


@register("population_check", """
with a as (select distinct query_id from synthesis_inputs), b as (select distinct query_id from reader_responses)
select count(*) = 0 as same, count(*) as differences from (select query_id from a where query_id not in (select query_id from b) union all select query_id from b where query_id not in (select query_id from a))""")
def population_check(spark: SparkSession, sf: str) -> DataFrame:
    return reports.same_population(table(spark, sf, "synthesis_inputs"), table(spark, sf, "reader_responses"), "query_id")


@register("context_digests", "select distinct dataset, method, query_id, sha256(context) = context_sha256 as matches from synthesis_inputs")
def context_digests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "synthesis_inputs").select(*_KEYS, (F.sha2("context", 256) == F.col("context_sha256")).alias("matches")).distinct()


_ABST = " or ".join(f"contains(lower(coalesce(a, '')), '{p}')" for p in ("insufficient evidence", "insufficient information", "i do not know", "i don''t know", "do not know", "cannot be determined", "cannot determine", "unable to determine", "not determinable", "not provided in the context", "not specified in the context", "not stated in the context", "not mentioned in the context", "no information", "the context does not contain", "the context does not mention", "the context does not include", "the context does not provide", "context provides no", "context lacks", "unable to find relevant information", "unable to find", "no relevant information"))


@register("abstain_labels", f"with {_RESP}, x as (select dataset, answer a from resp) select dataset, case when {_ABST} then 'Refusal' else 'Answer' end as label, count(*) as n from x group by 1, 2")
def abstain_labels(spark: SparkSession, sf: str) -> DataFrame:
    return responses(spark, sf).groupBy("dataset", F.when(abstains(F.col("answer")), "Refusal").otherwise("Answer").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@register("answer_agreement", f"""
with {_RESP}, i as (select dataset, method, query_id, min(original_query_id) o from synthesis_inputs group by all), a as (select dataset, o, method, min({_norm('answer')}) x from resp join i using (dataset, method, query_id) where answer is not null group by dataset, o, method),
p as (select dataset, o, max(case when method <> 'naive' then x end) p, max(case when method = 'naive' then x end) r from a group by dataset, o),
t as (select *, list_filter(string_split(p, ' '), lambda w: w <> '') tp, list_filter(string_split(r, ' '), lambda w: w <> '') tr from p where p is not null and r is not null),
c as (select *, list_sum(list_transform(list_distinct(tp), lambda w: least(len(list_filter(tp, lambda y: y = w)), len(list_filter(tr, lambda y: y = w))))) c from t)
select dataset, o as original_query_id, case when p = r then 1.0 else 0.0 end as em, round(case when p = r then 1 when coalesce(c, 0) = 0 then 0 else 2.0 * c / (len(tp) + len(tr)) end, 6) as f1 from c""")
def answer_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """How far the two methods' answers to one original question agree: exact match and word F1."""
    origin = table(spark, sf, "synthesis_inputs").groupBy(*_KEYS).agg(F.min("original_query_id").alias("original_query_id"))
    a = responses(spark, sf).where("answer is not null").join(origin, _KEYS).groupBy("dataset", "original_query_id", "method").agg(F.min(normalise_answer(F.col("answer"))).alias("x"))
    dense = F.col("method") == "naive"
    side = lambda c: F.max(F.when(c, F.col("x")))
    p = a.groupBy("dataset", "original_query_id").agg(side(~dense).alias("p"), side(dense).alias("r")).where("p is not null and r is not null")
    return _round(metrics.answer_scores(p, "p", "r").select("dataset", "original_query_id", "em", "f1"), "f1")


@register("extracted_answers")
def extracted_answers(spark: SparkSession, sf: str) -> DataFrame:
    return responses(spark, sf).select(*_KEYS, final_answer(F.col("answer")).alias("final_answer"))


@register("support_projection", r"""
with ok as (select distinct source_id, title, from_json(case when json_valid(sentences) and json_type(sentences) = 'ARRAY' then sentences end, '["VARCHAR"]') x from paragraphs),
p as (select source_id pid, trim(regexp_replace(array_to_string(x, ''), '[\s\x0b\x85\p{Z}]+', ' ', 'g')) body from ok where x is not null),
s as (select source_id, title, i idx, trim(regexp_replace(x[i + 1], '[\s\x0b\x85\p{Z}]+', ' ', 'g')) needle from (select source_id, title, x, unnest(range(0, len(x))) i from ok))
select distinct pid as passage_id, s.title, cast(idx as integer) as idx from p join s on s.source_id = p.pid where needle <> '' and contains(body, needle)""")
def support_projection(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences that each paragraph's whole text holds."""
    s = corpus.sentences_of(table(spark, sf, "paragraphs"))
    raw = table(spark, sf, "paragraphs").select("source_id", "title", F.from_json("sentences", "array<string>").alias("x")).where("x is not null").distinct()
    passages = raw.select(F.col("source_id").alias("passage_id"), "source_id", "title", u_collapse(F.array_join("x", "")).alias("text"))
    return metrics.project_sentences(passages, s)


@register("question_types", f"""
with {_ITEMS} select coalesce(question_type, 'unknown') as question_type, count(*) as items, min(len(evidence_docs)) as min_hops, max(len(evidence_docs)) as max_hops, round(avg(len(evidence_docs)), 6) as avg_hops from it group by 1""")
def question_types(spark: SparkSession, sf: str) -> DataFrame:
    n = F.size("evidence_docs").cast("long")
    return items(spark, sf).groupBy(F.coalesce("question_type", F.lit("unknown")).alias("question_type")).agg(F.count(F.lit(1)).alias("items"), F.min(n).alias("min_hops"), F.max(n).alias("max_hops"), F.round(F.avg(n), 6).alias("avg_hops"))


def rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events as result rows: errors are failures, users are original questions."""
    return table(spark, sf, "events").select(F.col("event_id").alias("query_id"), F.col("user_id").alias("original_query_id"), F.col("event_type").alias("category"), "value", (F.col("value") / 10).alias("second"), (F.col("event_type") == "error").alias("failed"))


@register("eligible_means", """
with e as (select event_type cat, case when event_type = 'error' then 0.0 when value >= 0 then value end v, case when event_type = 'error' then 0.0 when value >= 0 then value / 10 end w from events),
l as (select cat, 'value' m, v from e union all select cat, 'second', w from e)
select 'all' as level, m as metric, round(avg(v), 6) as mean, count(v) as eligible from l group by m union all select cat, m, round(avg(v), 6), count(v) from l group by cat, m""")
def eligible_means(spark: SparkSession, sf: str) -> DataFrame:
    return _round(reports.means(rows(spark, sf), ["value", "second"], F.col("failed"), "category"), "mean")


@register("label_rates", """
with l as (select case when event_type = 'error' then 'Unscored' when value >= 50 then 'Correct' when value >= 20 then 'Refusal' else 'Incorrect' end label from events), g as (select label, count(*) n from l group by label)
select label, n, round(case when label <> 'Unscored' then n / (select greatest(coalesce(sum(n) filter (where label <> 'Unscored'), 0), 1) from g) end, 6) as rate from g""")
def label_rates(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    lab = F.when(F.col("failed"), "Unscored").when(v >= 50, "Correct").when(v >= 20, "Refusal").otherwise("Incorrect")
    return _round(reports.label_rates(rows(spark, sf).withColumn("label", lab), "label"), "rate")


@register("seed_ci", """
with p as (select event_id % 5 s, avg(case when event_type = 'error' then 0.0 when value >= 0 then value end) m from events group by 1), a as (select count(*) n, avg(m) a, coalesce(stddev_samp(m), 0) sd from p where m is not null)
select n as seeds, round(a, 6) as mean, round(sd, 6) as std, round(a - 1.96 * sd / sqrt(n), 6) as low, round(a + 1.96 * sd / sqrt(n), 6) as high from a""")
def seed_ci(spark: SparkSession, sf: str) -> DataFrame:
    return _round(reports.seed_intervals(rows(spark, sf).withColumn("seed", F.col("query_id") % 5), "seed", "value", F.col("failed")), "mean", "std", "low", "high")


def arm(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Mean value of each original question in one event type: a stand-in for one arm of an experiment."""
    return rows(spark, sf).where(F.col("category") == name).groupBy("original_query_id").agg(F.avg("value").alias("value"))


_ARM = "select user_id, avg(value) v from events where event_type = '{}' group by user_id"


@register("paired_diff", f"""
with a as ({_ARM.format('click')}), b as ({_ARM.format('view')}) select count(*) as n, round(avg(a.v - b.v), 6) as mean from a join b using (user_id)""")
def paired_diff(spark: SparkSession, sf: str) -> DataFrame:
    return reports.paired(arm(spark, sf, "click"), arm(spark, sf, "view"), "original_query_id", "value").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("diff"), 6).alias("mean"))


@register("unpaired_ids", f"""
with a as ({_ARM.format('click')}), b as ({_ARM.format('signup')}) select 'left' as side, user_id as original_query_id from a where user_id not in (select user_id from b) union all select 'right', user_id from b where user_id not in (select user_id from a)""")
def unpaired_ids(spark: SparkSession, sf: str) -> DataFrame:
    return reports.unpaired(arm(spark, sf, "click"), arm(spark, sf, "signup"), "original_query_id")


@register("factorial", f"""
with j as (select a.v f, b.v n, c.v h, d.v z from ({_ARM.format('click')}) a join ({_ARM.format('view')}) b using (user_id) join ({_ARM.format('signup')}) c using (user_id) join ({_ARM.format('purchase')}) d using (user_id)),
l as (select unnest(['interaction','full_minus_none','full_minus_next','full_minus_hop','next_minus_none','hop_minus_none','next_minus_hop']) k, unnest([f - n - h + z, f - z, f - n, f - h, n - z, h - z, n - h]) v from j)
select k as contrast, round(avg(v), 6) as mean, count(v) as n from l group by k""")
def factorial(spark: SparkSession, sf: str) -> DataFrame:
    arms = {"full": "click", "next": "view", "hop": "signup", "none": "purchase"}
    return _round(reports.factorial({a: arm(spark, sf, e) for a, e in arms.items()}, "original_query_id", "value"), "mean")


@register("failure_report", "select event_id, event_type, value from (select *, row_number() over (order by value nulls first, event_id) r from events where event_type = 'error' or value < 1) where r <= 30")
def failure_report(spark: SparkSession, sf: str) -> DataFrame:
    """The thirty worst rows: a report of that length."""
    e = table(spark, sf, "events").withColumn("err", F.when(F.col("event_type") == "error", F.lit("failed")))
    e = e.withColumn("same", F.lit(0))
    return reports.failures(e, "value", "err", "same", "same", "event_id").select("event_id", "event_type", "value")


@register("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster bootstrap by original question in every category; numpy's own stream, so the tests compare with numpy."""
    return stats.bootstrap(rows(spark, sf), "value", "original_query_id", "category")


_UNITS = f"""{_CAND}, hits as (select distinct query_id, id, ('0x' || substr(md5(id), 1, 2))::int % 7 unit from c),
rkd as (select *, row_number() over (partition by query_id order by coalesce(sim, 0) desc, id) rs, row_number() over (partition by query_id order by coalesce(rep, 0) desc, id) rr from c),
st as (select query_id, id from rkd where rs <= 3), gp as (select query_id, id from rkd where rr <= 20 union select * from st), dp as (select query_id, id from rkd where rs <= 20),
"""


def pools(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(ranked, starts, graph pool, direct pool, hits) with a passage's unit by the digest of its id."""
    c = materialize(candidates(spark, sf), "pool-candidates")
    z = lambda x: F.coalesce(x, F.lit(0.0)).desc()
    r = rank_whole(c, ["query_id"], [z("similarity_score"), F.col("id").asc()], "rs", HOT_ROWS, ("rr", [z("representation_score"), F.col("id").asc()]))
    r = materialize(r.select("query_id", "id", "channel", "rs", "rr"), "pools")  # five readers
    ids = lambda cond: r.where(cond).select("query_id", "id")
    hits = r.select("query_id", "id", (F.conv(F.substring(F.md5("id"), 1, 2), 16, 10).cast("int") % 7).alias("unit"))
    return r, ids("rs <= 3"), ids("rr <= 20 or rs <= 3"), ids("rs <= 20"), hits


@register("witness_partition", f"""
with {_UNITS} f as (select h.query_id, unit, max(st.id is not null) s, max(gp.id is not null) g, max(dp.id is not null) d, max(gp.id is not null and dp.id is not null) b from hits h
 left join st on st.query_id = h.query_id and st.id = h.id left join gp on gp.query_id = h.query_id and gp.id = h.id left join dp on dp.query_id = h.query_id and dp.id = h.id group by h.query_id, unit)
select query_id, unit, case when b then 'shared_id' when d then 'distinct_only' else 'graph_exclusive' end as class from f where g and not s""")
def witness_partition(spark: SparkSession, sf: str) -> DataFrame:
    _, s, g, d, h = pools(spark, sf)
    return coverage.witnesses(s, g, d, h)


@register("evidence_partition", f"""
with {_UNITS} g0 as (select distinct h.query_id, unit from hits h join gp using (query_id, id)), d0 as (select distinct h.query_id, unit from hits h join dp using (query_id, id)), u as (select distinct query_id, unit from hits)
select query_id, count(*) filter (where g and not d) as graph_only, count(*) filter (where d and not g) as direct_only, count(*) filter (where g and d) as shared, count(*) filter (where not g and not d) as unrecovered
from (select query_id, unit, (query_id, unit) in (select query_id, unit from g0) g, (query_id, unit) in (select query_id, unit from d0) d from u) group by query_id""")
def evidence_partition(spark: SparkSession, sf: str) -> DataFrame:
    _, _, g, d, h = pools(spark, sf)
    return coverage.partition(g, d, h, h.groupBy("query_id").agg(F.count_distinct("unit").alias("units")))


@register("coverage_curve", f"""
with {_UNITS} fr as (select unnest([0.0, 0.5, 1.0]) f),
gx as (select query_id, id, rs <= 3 s, count(*) filter (where rs > 3) over (partition by query_id order by rr, id rows unbounded preceding) nth, count(*) filter (where rs > 3) over (partition by query_id) ex from rkd),
dx as (select query_id, id, rs <= 3 s, count(*) filter (where rs > 3) over (partition by query_id order by rs, id rows unbounded preceding) nth, count(*) filter (where rs > 3) over (partition by query_id) ex from rkd),
g1 as (select distinct f, query_id, unit from gx join hits using (query_id, id), fr where s or nth <= floor(f * ex)), d1 as (select distinct f, query_id, unit from dx join hits using (query_id, id), fr where s or nth <= floor(f * ex)),
u as (select query_id, count(distinct unit) n from hits group by query_id), b as (select * from u, fr),
j as (select b.f, b.query_id, n, (select count(*) from g1 where g1.f = b.f and g1.query_id = b.query_id) g, (select count(*) from d1 where d1.f = b.f and d1.query_id = b.query_id) d,
 (select count(*) from g1 left join d1 using (f, query_id, unit) where g1.f = b.f and g1.query_id = b.query_id and d1.unit is null) o from b)
select f as fraction, round(avg(g / n), 6) as graph_recall, round(avg(d / n), 6) as direct_recall, cast(sum(o) as bigint) as graph_only_units, count(*) as queries from j group by f""".replace("left join d1 using (f, query_id, unit) where g1.f = b.f and g1.query_id = b.query_id and d1.unit is null", "where g1.f = b.f and g1.query_id = b.query_id and (g1.f, g1.query_id, g1.unit) not in (select f, query_id, unit from d1)"))
def coverage_curve(spark: SparkSession, sf: str) -> DataFrame:
    r, _, _, _, h = pools(spark, sf)
    pool = lambda o: r.select("query_id", "id", F.col(o).alias("ord"), (F.col("rs") <= 3).alias("is_start"))
    fractions = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "fraction double")
    gold_units = h.groupBy("query_id").agg(F.count_distinct("unit").alias("units"))
    return _round(coverage.curves(pool("rr"), pool("rs"), h, gold_units, fractions), "graph_recall", "direct_recall")


@register("coverage_strata", f"""
with {_UNITS} u as (select query_id, count(distinct unit) n from hits group by query_id), k as (select query_id, count(distinct unit) k from hits join st using (query_id, id) group by query_id)
select case when coalesce(k, 0) = 0 then 'none' when k < n then 'partial' else 'complete' end as stratum, count(*) as queries from u left join k using (query_id) group by 1""")
def coverage_strata(spark: SparkSession, sf: str) -> DataFrame:
    _, s, _, _, h = pools(spark, sf)
    gold_units = h.groupBy("query_id").agg(F.count_distinct("unit").alias("units"))
    return coverage.strata(coverage.coverage(s, h), gold_units).groupBy("stratum").agg(F.count(F.lit(1)).alias("queries"))


@register("channel_classes", f"""
with {_CAND}, h as (select query_id, ('0x' || substr(md5(id), 1, 2))::int % 7 unit, channel from c)
select query_id, unit, case when b and q then 'both' when b then 'body_only' else 'questions_only' end as class from (select query_id, unit, max(channel = 'body') b, max(channel in ('q_minus', 'q_plus')) q from h group by query_id, unit) where b or q""")
def channel_classes(spark: SparkSession, sf: str) -> DataFrame:
    r, _, _, _, h = pools(spark, sf)
    return coverage.channel_classes(r.select("query_id", "id", "channel"), h)


@register("fact_components", f"""
with recursive {_ITEMS}, f as (select distinct query_id, unnest(facts) fact from it), e as (select distinct a.query_id a, b.query_id b from f a join f b using (fact)),
r as (select a, a c from e union select e.a, r.c from r join e on e.b = r.a)
select a as query_id, min(c) as component from r group by a""")
def fact_components(spark: SparkSession, sf: str) -> DataFrame:
    f = items(spark, sf).select("query_id", F.explode("evidence_facts").alias("fact"))
    return coverage.components(f, "query_id", "fact")


@register("link_usefulness", f"""
with {_EDGES} {_FRONT}, n as (select query_id, id, max(d) d, max(h) h, max(x) x from (select query_id, id, 1 d, 0 h, 0 x from st union all select query_id, id, 0, cast(path_type = 'hop' as int), cast(path_type = 'next' as int) from fr) group by query_id, id),
g as (select query_id, count(*) filter (where h = 1 and d = 0) hd, count(*) filter (where h = 1 and d = 0 and id % 7 = query_id % 7) rel, count(*) filter (where h = 1 and d = 0 and x = 1) ov, max(d = 1 and id % 7 = query_id % 7) dr from n group by query_id)
select query_id, hd as hop_destinations, round(case when hd > 0 then rel / hd end, 6) as hop_relevance, case when rel > 0 and not dr then 1.0 else 0.0 end as added_coverage, 0.0 as retained_coverage, round(case when hd > 0 then ov / hd end, 6) as next_overlap from g""")
def link_usefulness(spark: SparkSession, sf: str) -> DataFrame:
    """The starts are what was selected; a passage holds a query's one unit if both have the same remainder by seven."""
    c, nxt, hop = edges(spark, sf)
    s = starts(spark, sf)
    fr = graph.frontier(s, nxt, hop)
    nodes = s.select("query_id", F.lit("direct").alias("role"), "id").unionByName(fr.select("query_id", F.col("path_type").alias("role"), "id")).unionByName(s.select("query_id", F.lit("selected").alias("role"), "id"))
    q = s.select("query_id").distinct()
    hits = c.select("id", (F.col("id") % 7).alias("unit")).join(q.withColumn("unit", F.col("query_id") % 7), "unit").select("query_id", "id", "unit")
    u = metrics.link_usefulness(nodes, hits, q.withColumn("units", F.lit(1)))
    return _round(u, "hop_relevance", "next_overlap").withColumns({x: F.col(x).cast("double") for x in ("added_coverage", "retained_coverage")})


@register("mask_coverage", f"with {_UNITS} k as (select query_id, count(distinct unit) n from hits join gp using (query_id, id) group by query_id) select query_id, 'graph' as arm, n as covered from k")
def mask_coverage(spark: SparkSession, sf: str) -> DataFrame:
    _, _, g, _, h = pools(spark, sf)
    return stats.mask_coverage(g.withColumn("arm", F.lit("graph")), h).withColumn("covered", F.col("covered").cast("long"))


@register("greedy_admission", f"""
with {_UNITS} sz as (select id, floor(max(length(text)) / 4) tok from chunks group by id having max(length(text)) is not null),
pu as (select query_id, unit, id, tok, row_number() over (partition by query_id, unit order by tok, id) k from gp join hits using (query_id, id) join sz using (id)),
o as (select distinct query_id, id, tok from pu where k = 1), r as (select *, sum(tok) over (partition by query_id order by tok, id rows unbounded preceding) used from o)
select query_id, id from r where used <= 600""")
def greedy_admission(spark: SparkSession, sf: str) -> DataFrame:
    _, _, g, _, h = pools(spark, sf)
    size = table(spark, sf, "chunks").groupBy("id").agg(F.floor(F.max(F.length("text")) / 4).alias("tokens"))
    return stats.greedy_cover(g.join(h, ["query_id", "id"]).join(size, "id"), 600)


@register("link_supply", f"""
with {_UNITS} u as (select query_id, count(distinct unit) n from hits group by query_id), s0 as (select query_id, count(distinct unit) b from hits join st using (query_id, id) group by query_id),
arm as (select query_id, id, 'graph' arm from gp union all select query_id, id, 'direct' from dp), pr as (select query_id, arm, id, row_number() over (partition by query_id, arm order by md5('7|' || query_id || '|' || id), id) k from arm),
cv as (select query_id, arm, count(distinct unit) filter (where (query_id, unit) not in (select h2.query_id, h2.unit from hits h2 join st using (query_id, id))) added from pr join hits using (query_id, id) where k <= 3 group by query_id, arm)
select query_id, arm, round(added / n, 6) as added_recall, cast(coalesce(b, 0) + added = n as int) - cast(coalesce(b, 0) = n as int) + 0.0 as complete_gain, case when added > 0 then 1.0 else 0.0 end as any_new
from cv join u using (query_id) left join s0 using (query_id)""")
def link_supply(spark: SparkSession, sf: str) -> DataFrame:
    """What three passages sampled from the graph pool and from the direct pool add to the starts; shared priorities."""
    _, s, g, d, h = pools(spark, sf)
    both = g.withColumn("arm", F.lit("graph")).unionByName(d.withColumn("arm", F.lit("direct")))
    budgets = both.groupBy("query_id", "arm").count().groupBy("query_id").agg(F.least(F.lit(3), F.min("count")).alias("budget"))
    samples = stats.coupled_sample(both, budgets, 7).withColumn("repeat", F.lit(0))
    v = stats.link_supply(s, samples, h, h.groupBy("query_id").agg(F.count_distinct("unit").alias("units")))
    return _round(v.drop("repeat"), "added_recall")


@register("sequence_gaps", "select count(*) as gaps from (select event_id, lag(event_id) over (partition by user_id order by event_id) p from events) where p is not null and event_id <> p + 1")
def sequence_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return store.sequence_gaps(table(spark, sf, "events"), "user_id", "event_id").agg(F.count(F.lit(1)).alias("gaps"))


@register("reader_sensitivity", "select question_type, count(distinct query_id) as questions from synthesis_inputs where original_query_id not in (select original_query_id from synthesis_inputs where dataset = 'hotpotqa') group by question_type")
def reader_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    """Every occurrence of a development question left out, by its original."""
    i = table(spark, sf, "synthesis_inputs")
    dev = i.where("dataset = 'hotpotqa'").select("original_query_id").distinct()
    return i.join(dev, "original_query_id", "left_anti").groupBy("question_type").agg(F.count_distinct("query_id").alias("questions"))
