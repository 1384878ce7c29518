"""Reports of saved runs: official means, common ranking metrics and their intervals, reader replay, population audits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.text import context_block
from strandloom.operators import metrics
from strandloom.operators.stats import MOST_CLUSTERS, resampled_means

#: The datasets that have official reports, without case, hyphens and underscores.
DATASETS = ("multihoprag", "hotpotqa")
RANKING = ("hits_4", "hits_10", "mrr_10", "map_10", "recall_10")


def dataset_key(name: Column) -> Column:
    """The dataset behind a display name or corpus tag; an unknown one fails the job."""
    key = F.regexp_replace(F.lower(name), "[-_]", "")
    return F.when(key.isin(*DATASETS), key).otherwise(F.raise_error(F.concat(F.lit("no official evaluator for "), F.coalesce(name, F.lit("null")))))


def official_value(metric: Column, failed: Column) -> Column:
    """A failed row counts as zero; any other must have a finite value of at least zero, or the job fails."""
    ok = metric.isNotNull() & ~F.isnan(metric) & (metric >= 0) & (metric < float("inf"))
    return F.when(failed, F.lit(0.0)).when(ok, metric.cast("double")).otherwise(F.raise_error(F.lit("missing official score")).cast("double"))


def official_means(rows: DataFrame, qa: Sequence[str], retrieval: Sequence[str], question_type: str, failed: Column) -> DataFrame:
    """(section, question_type, metric, rows, mean), in one pass over ``rows``.

    Answer metrics over all rows, by question type and over the questions that have an answer; retrieval metrics over the
    latter only. Null questions are those of the type ``null_query``; a null type is the empty one.
    """
    kind = F.coalesce(F.col(question_type), F.lit(""))
    null = kind == "null_query"
    e = rows.select(kind.alias("question_type"), null.alias("__null"), *(official_value(F.col(m), failed).alias(m) for m in qa), *(F.when(~null, official_value(F.col(m), failed & ~null | null)).alias(m) for m in retrieval))
    # A row goes to every section it counts in: at most three for an answer metric, one for a retrieval metric.
    section = lambda name, t: F.struct(F.lit(name).alias("section"), t.alias("question_type"))
    every = F.lit("all")
    long = e.unpivot(["question_type", "__null"], [*qa, *retrieval], "metric", "value")
    answers = F.array_compact(F.array(section("qa", every), section("qa_by_type", F.col("question_type")), F.when(~F.col("__null"), section("qa_non_null", every))))
    where = F.when(F.col("metric").isin(*qa), answers).otherwise(F.array_compact(F.array(F.when(~F.col("__null"), section("retrieval", every)))))
    g = long.select("metric", "value", F.explode(where).alias("s")).groupBy("s.section", "s.question_type", "metric")
    return g.agg(F.count(F.lit(1)).alias("rows"), F.avg("value").alias("mean"))


def paired_type_means(left: DataFrame, right: DataFrame, key: str, metric: str, question_type: str) -> DataFrame:
    """(question_type, n, left, right, diff): means over the questions that both sides answer, by type; failures are zeros."""
    a = left.select(key, F.coalesce(question_type, F.lit("")).alias("question_type"), F.col(metric).alias("a"))
    j = a.join(right.select(key, F.col(metric).alias("b")), key).where("a is not null and b is not null")
    return j.groupBy("question_type").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("left"), F.avg("b").alias("right"), F.avg(F.col("a") - F.col("b")).alias("diff"))


def common_ranking(retrieved: DataFrame, gold: DataFrame, ks: tuple[int, int] = (4, 10), cut: int = 10) -> DataFrame:
    """(query_id, gold_count, hits_4, hits_10, mrr_10, map_10, recall_10) of saved results; queries without gold drop out.

    Hits and MRR go by the first rank with any fact; recall counts distinct facts over all of the gold list, MAP is capped
    at ``cut`` facts and may exceed 1. ``retrieved``: query_id, rank, text; ``gold``: query_id, facts.
    """
    g = gold.select("query_id", "facts", F.greatest(F.coalesce(F.size("facts"), F.lit(0)), F.lit(0)).alias("gold_count")).where("gold_count > 0")
    h = metrics.fact_hits(retrieved.where(F.col("rank") <= cut), g)
    once = h.groupBy("query_id", "compact_fact").agg(F.min("rank").alias("rank"))
    per = once.groupBy("query_id").agg(F.min("rank").alias("first"), F.sum(1.0 / F.col("rank")).alias("ap"), F.count(F.lit(1)).alias("found"))
    j = g.join(per, "query_id", "left")
    some = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select(
        "query_id", "gold_count", *(some(F.when(F.col("first") <= k, 1.0)).alias(f"hits_{k}") for k in ks), some(1.0 / F.col("first")).alias(f"mrr_{cut}"),
        some(F.col("ap") / F.least("gold_count", F.lit(cut))).alias(f"map_{cut}"), some(F.col("found") / F.col("gold_count")).alias(f"recall_{cut}"),
    )


def ranking_intervals(rows: DataFrame, cluster: str, order: str, *, names: Sequence[str] = RANKING, strata: Sequence[int] = (2, 3, 4), seed: int = 42, repeats: int = 10_000) -> DataFrame:
    """(stratum, metric, clusters, mean, low, high) over all rows and over those of each gold count of ``strata``.

    All metrics of a stratum share their draws: blocks of 100 from numpy's stream over clusters as ``order`` first shows them.
    A stratum's task holds a row a cluster, of which there may be ``MOST_CLUSTERS``.
    """
    part = F.array(F.lit("all"), *(F.when(F.col("gold_count") == n, F.lit(str(n))) for n in strata))
    e = rows.withColumn("stratum", F.explode(F.array_compact(part)))
    c = e.groupBy("stratum", F.col(cluster).cast("string").alias("cluster")).agg(F.min(order).alias("o"), F.count(F.lit(1)).alias("n"), *(F.sum(m).alias(m) for m in names))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_CLUSTERS:
            raise ValueError("too many clusters for one stream of draws: use poisson_bootstrap")
        p = pdf.sort_values(["o", "cluster"])
        found = [(m, resampled_means(p[m].to_numpy(), p.n.to_numpy(), seed=seed, repeats=repeats, block=100)) for m in names]
        return pd.DataFrame([{"stratum": p.stratum.iloc[0], "metric": m, "clusters": len(p), **{k: r[k] for k in ("mean", "low", "high")}} for m, r in found])

    return c.groupBy("stratum").applyInPandas(one, "stratum string, metric string, clusters long, mean double, low double, high double")


def strict_pairs(left: DataFrame, right: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """(key, metric, diff) of every metric of every row; a row or value that one side lacks fails the job."""
    side = lambda d, n: d.select(key, *names).unpivot([key], list(names), "metric", n)
    j = side(left, "a").join(side(right, "b"), [key, "metric"], "full_outer")
    return j.where(F.assert_true(F.col("a").isNotNull() & F.col("b").isNotNull(), F.lit("a paired score is missing")).isNull()).select(key, "metric", (F.col("a") - F.col("b")).alias("diff"))


def replay_faults(inputs: DataFrame, responses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(fault, n): what forbids to score ``responses`` as the reader's answers to exactly these ``inputs``.

    Repeated or lost responses, responses without input, those that are not completed, whose context is another or whose
    recorded digest is not that of the context, and more than one model or none. Inputs: keys, context, context_sha256.
    """
    k = list(keys)
    i = inputs.select(*k, F.sha2("context", 256).alias("now"), F.col("context_sha256").alias("then")).distinct()
    both = i.join(responses.select(*k, "status", F.col("context_sha256").alias("read")), k)
    count = lambda d, name: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("fault"), "n")
    models = responses.agg((F.count_distinct("model") + F.max(F.col("model").isNull().cast("int"))).alias("m"))
    parts = [
        count(responses.groupBy(*k).count().where("count > 1"), "repeated_response"), count(i.join(responses, k, "left_anti"), "missing_response"),
        count(responses.join(i, k, "left_anti").select(*k).distinct(), "response_without_input"), count(both.where("not (status <=> 'completed')"), "not_completed"),
        count(both.where("not (read <=> then)"), "other_context"), count(i.where("not (now <=> then)"), "input_digest"),
        models.select(F.lit("models").alias("fault"), F.greatest(F.col("m") - 1, F.lit(0)).cast("long").alias("n")),
    ]
    return reduce(DataFrame.unionByName, parts)


def replay_scores(inputs: DataFrame, responses: DataFrame, truth: DataFrame, keys: Sequence[str], answer: str = "answer") -> DataFrame:
    """One row an input: answer metrics of its response, zeros where the original row had failed; a missing response fails.

    ``truth``: keys, ground_truth, question_type, failed.
    """
    k = list(keys)
    j = inputs.select(*k).distinct().join(responses.select(*k, answer, F.lit(True).alias("__there")), k, "left").join(truth, k)
    j = j.where(F.assert_true(F.coalesce("__there", F.lit(False)), F.lit("an input has no response")).isNull()).drop("__there")
    m = metrics.answer_metrics(j, answer, "ground_truth", "question_type")
    names = ("em", "f1", "precision", "recall", "null_refusal", "qa_accuracy")
    failed = F.coalesce("failed", F.lit(False))
    return m.select(*k, "question_type", *(F.when(failed & F.col(n).isNotNull(), F.lit(0.0)).otherwise(F.col(n)).alias(n) for n in names))


def returned_context(passages: DataFrame) -> DataFrame:
    """(query_id, context, context_sha256): every returned passage in its order, as a replayed reader gets them.

    ``passages``: query_id, rank, title, page, sent_id, text; at most ``k`` a query.
    """
    block = F.struct("rank", context_block(F.coalesce("title", F.lit("Unknown")), F.col("page"), F.coalesce("sent_id", F.lit(0)), F.coalesce("text", F.lit(""))).alias("b"))
    c = passages.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]), "\n\n").alias("context"))
    return c.withColumn("context_sha256", F.sha2("context", 256))


def reader_jobs(inputs: DataFrame, log: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """(keys, ord): inputs without a completed response of the same context, in an order that the seed alone decides.

    The order is that of a digest, so it needs no shuffle of a list on the driver and stays when other jobs are done.
    """
    k = [*keys, "context_sha256"]
    todo = inputs.select(*k).distinct().join(log.where("status = 'completed'").select(*k).distinct(), k, "left_anti")
    return todo.select(*keys, F.md5(F.concat_ws("|", F.lit(str(seed)), *keys)).alias("ord"))


def traces_of(committed: DataFrame, traces: DataFrame, key: str = "query_id") -> DataFrame:
    """Committed rows with their ``trace``; traces of other rows are ignored, a missing one fails the job."""
    j = committed.join(traces.select(key, "trace"), key, "left")
    return j.where(F.assert_true(F.col("trace").isNotNull(), F.lit("a committed row has no trace")).isNull())


def recorded_scores(rows: DataFrame, recorded: DataFrame, key: str, payload: str, sha: str) -> DataFrame:
    """Rows with the recorded payload of their key, whose digest must be the recorded one and of which there must be one."""
    j = rows.join(recorded.select(key, F.col(payload).alias("__p"), F.col(sha).alias("__s")), key, "left")
    ok = F.col("__p").isNotNull() & (F.sha2("__p", 256) == F.col("__s"))
    return j.where(F.assert_true(ok, F.lit("recorded scores are missing or changed")).isNull()).withColumnRenamed("__p", payload).drop("__s")


def annotation_gaps(supports: DataFrame, sentences: DataFrame) -> DataFrame:
    """Supporting facts (title, idx) that name a sentence which their paragraph does not have. ``sentences``: title, idx."""
    n = sentences.groupBy("title").agg((F.max("idx") + 1).alias("n"))
    return supports.join(n, "title", "left").where((F.col("idx") < 0) | (F.col("idx") >= F.coalesce("n", F.lit(0)))).drop("n")


def prefix_audit(primary: DataFrame, executed: DataFrame, k: int) -> DataFrame:
    """(query_id, mismatches): ranks among the first ``k`` where the executed candidates are not the primary's.

    Both: query_id, rank, id, text. A side that is shorter, another id and another text each count.
    """
    cut = lambda d, s: d.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(f"i{s}"), F.sha2(F.coalesce("text", F.lit("")), 256).alias(f"t{s}"))
    j = cut(primary, "a").join(cut(executed, "b"), ["query_id", "rank"], "full_outer")
    return j.where("not (ia <=> ib) or not (ta <=> tb)").groupBy("query_id").agg(F.count(F.lit(1)).alias("mismatches"))


def scope(rows: Column, expected: Column, name: Column, limited: Column) -> Column:
    """What a run covers: a smoke run by its name, a sample if limited or short, the whole split, or another set."""
    return F.when(F.lower(F.coalesce(name, F.lit(""))).contains("smoke"), "smoke").when(limited | (rows < expected), "sample").when(rows == expected, "official_split").otherwise("custom")


def outcomes(targets: DataFrame) -> DataFrame:
    """(target, status, quality_evaluation, quality_score, wall_seconds, phase): index runs without any made-up quality.

    ``targets``: target, state, started_at, finished_at (seconds), index_exit_code. What is not known stays null.
    """
    state = F.coalesce("state", F.lit("planned"))
    wall = F.when(F.col("started_at").isNotNull() & F.col("finished_at").isNotNull(), F.greatest(F.col("finished_at") - F.col("started_at"), F.lit(0.0)))
    return targets.select("target", state.alias("status"), F.when(state == "index_complete", "pending").otherwise("unavailable").alias("quality_evaluation"), F.lit(None).cast("double").alias("quality_score"), wall.alias("wall_seconds"), F.when(F.col("index_exit_code").isNotNull(), "index").otherwise("smoke").alias("phase"))


def usage_totals(calls: DataFrame, by: Sequence[str]) -> DataFrame:
    """Calls by kind, tokens, cost, and whether both are complete; failed transports count as calls with unknown usage.

    ``calls``: kind (generation, embedding), ok, prompt_tokens, completion_tokens, total_tokens, cost, valid, elapsed. A
    missing completion count is no gap, as embeddings have none. ``valid`` is null where no format was asked for.
    """
    kind = lambda k: F.count_if(F.col("kind") == k).alias(f"{k}_calls")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    whole = F.col("ok") & F.col("prompt_tokens").isNotNull() & F.col("total_tokens").isNotNull()
    return calls.groupBy(*by).agg(
        kind("generation"), kind("embedding"), total("prompt_tokens"), total("completion_tokens"), total("total_tokens"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("reported_cost"),
        F.bool_and(whole).alias("token_usage_complete"), F.bool_and(F.col("ok") & F.col("cost").isNotNull()).alias("cost_complete"), F.count_if(~F.col("ok")).alias("transport_failures"),
        F.count("valid").alias("structured_attempts"), F.count_if(~F.col("valid")).alias("structured_invalid"), F.coalesce(F.sum(F.when(F.col("valid").isNotNull(), F.col("elapsed"))), F.lit(0.0)).alias("structured_seconds"),
    )


def stage_times(trace: Column, stages: dict[str, Sequence[str]]) -> list[Column]:
    """One nullable column a timing: its value in the first step of its stage that has one; what was not measured is null.

    ``trace`` is an array of (step, values map<string, double>).
    """
    def first(step: str, name: str) -> Column:
        found = F.filter(trace, lambda s: (s["step"] == step) & s["values"][name].isNotNull())
        return F.get(F.transform(found, lambda s: s["values"][name]), F.lit(0)).alias(name)

    return [first(step, name) for step, names in stages.items() for name in names]


def segment_seconds(log: DataFrame, run: str = "run", segment: str = "segment", seconds: str = "seconds", stamp: str = "at") -> DataFrame:
    """(run, seconds): the last snapshot of each segment, summed; snapshots are cumulative and never count twice."""
    last = log.groupBy(run, segment).agg(F.max_by(seconds, F.struct(stamp, seconds)).alias("s"))
    return last.groupBy(run).agg(F.sum("s").alias("seconds"))


def span_faults(events: DataFrame) -> DataFrame:
    """(fault, n) of traced spans: without an end, ended without a start, with a parent that never started.

    ``events``: span_id, parent_id, event (start, result, error).
    """
    s = events.groupBy("span_id").agg(F.count_if(F.col("event") == "start").alias("starts"), F.count_if(F.col("event").isin("result", "error")).alias("ends"), F.max("parent_id").alias("parent_id"))
    lost = s.where("parent_id is not null").join(s.where("starts > 0").select(F.col("span_id").alias("parent_id")), "parent_id", "left_anti")
    count = lambda d, name: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("fault"), "n")
    return reduce(DataFrame.unionByName, [count(s.where("starts > 0 and ends = 0"), "open_span"), count(s.where("starts = 0"), "unstarted_span"), count(lost, "lost_parent")])
