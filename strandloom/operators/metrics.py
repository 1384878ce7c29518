"""Answer, retrieval and support metrics, set at a time. Unavailable values are null; report sinks write them as -1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.text import abstains, compact, document_key, final_answer, near, normalise_answer, shares_token, tokens, u_collapse
from strandloom.functions.vectors import rank_within


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def common_tokens(a: Column, b: Column) -> Column:
    """The size of the multiset intersection of two arrays."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))


def answer_scores(df: DataFrame, prediction: str, reference: str) -> DataFrame:
    """``df`` with em, f1, precision and recall of normalised answers: all 1 if equal, all 0 if one is empty."""
    p, r = tokens(F.col("__p")), tokens(F.col("__r"))
    d = df.withColumn("__p", normalise_answer(F.col(prediction))).withColumn("__r", normalise_answer(F.col(reference)))
    d = d.withColumn("__c", F.when(F.col("__p") == F.col("__r"), 0).otherwise(common_tokens(p, r)))
    same = F.col("__p") == F.col("__r")
    pr, rc = _ratio(F.col("__c"), F.size(p)), _ratio(F.col("__c"), F.size(r))
    one = lambda c: F.when(same, 1.0).otherwise(c)
    return d.withColumns({"em": F.when(same, 1.0).otherwise(0.0), "f1": one(_f1(pr, rc)), "precision": one(pr), "recall": one(rc)}).drop("__p", "__r", "__c")


def best_alias(df: DataFrame, key: str, prediction: str, aliases: str) -> DataFrame:
    """The scores against the best of an array of references: by f1, em, precision, recall; the first of equals."""
    e = df.select(key, prediction, F.posexplode_outer(aliases).alias("ord", "alias"))
    s = answer_scores(e, prediction, "alias")
    return rank_within(s, [key], [F.col(c).desc() for c in ("f1", "em", "precision", "recall")] + [F.col("ord").asc()], 1).select(key, "alias", "em", "f1", "precision", "recall")


def answer_metrics(df: DataFrame, answer: str, truth: str, question_type: str) -> DataFrame:
    """Scores of extracted answers: null questions have a refusal score in place of em and f1; accuracy is any shared word."""
    d = answer_scores(df.withColumn("final_answer", final_answer(F.col(answer))), "final_answer", truth)
    null = F.lower(F.trim(F.coalesce(question_type, F.lit("")))) == "null_query"
    d = d.withColumns({c: F.when(~null, F.col(c)) for c in ("em", "f1", "precision", "recall")})
    return d.withColumns({"null_refusal": F.when(null, abstains(F.col("final_answer")).cast("double")), "qa_accuracy": shares_token(F.col(answer), F.col(truth)).cast("double")})


def answer_label(em: Column, null_refusal: Column, error: Column) -> Column:
    """Correct, Refusal, Incorrect or Unscored."""
    return F.when(error.isNotNull(), "Incorrect").when(null_refusal >= 0.5, "Refusal").when(em >= 0.5, "Correct").when(F.coalesce(em, null_refusal).isNull(), "Unscored").otherwise("Incorrect")


def fact_hits(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, fact_ix, compact_fact, rank): where each fact is found. ``retrieved``: query_id, rank, text; ``gold``: query_id, facts."""
    g = gold.select("query_id", F.posexplode("facts").alias("fact_ix", "fact")).where(F.trim("fact") != "")
    g = g.select("query_id", "fact_ix", compact(F.col("fact")).alias("compact_fact")).where("compact_fact <> ''")
    r = retrieved.select("query_id", "rank", compact(F.col("text")).alias("__body"))  # once a passage, before it meets its facts
    return r.join(g, "query_id").where(F.contains("__body", "compact_fact")).select("query_id", "fact_ix", "compact_fact", "rank")


def ranking_metrics(retrieved: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (4, 10), cut: int = 10) -> DataFrame:
    """One row a query of ``gold``: hits@k, mrr@10, map@10, exact_fact_recall@10, all_facts@10.

    A new fact counts at the first rank that holds it, so the running set of the definition is the least rank of each
    distinct fact. Queries without gold have nulls, those without results zeros. MAP may exceed 1.
    """
    g = gold.select("query_id", F.filter("facts", lambda f: F.trim(f) != "").alias("facts")).withColumn("n", F.coalesce(F.size("facts"), F.lit(0)))
    g = g.withColumn("n", F.greatest("n", F.lit(0)))
    h = fact_hits(retrieved.where(F.col("rank") <= max(cut, *ks)), g)
    first = h.groupBy("query_id", "compact_fact").agg(F.min("rank").alias("rank"))
    ap = first.where(F.col("rank") <= cut).groupBy("query_id").agg(F.sum(1.0 / F.col("rank")).alias("ap"))
    per = h.groupBy("query_id").agg(F.min("rank").alias("first"), F.count_distinct(F.when(F.col("rank") <= cut, F.col("fact_ix"))).alias("found"))
    j = g.select("query_id", "n").join(per, "query_id", "left").join(ap, "query_id", "left")
    judged = lambda c: F.when(F.col("n") > 0, F.coalesce(c, F.lit(0.0)))
    return j.select(
        "query_id",
        *(judged(F.when(F.col("first") <= k, 1.0)).alias(f"hits_{k}") for k in ks),
        judged(F.when(F.col("first") <= cut, 1.0 / F.col("first"))).alias(f"mrr_{cut}"),
        judged(F.col("ap") / F.least("n", F.lit(cut))).alias(f"map_{cut}"),
        judged(F.col("found") / F.col("n")).alias(f"exact_fact_recall_{cut}"),
        judged((F.col("found") == F.col("n")).cast("double")).alias(f"all_facts_{cut}"),
    )


def fuzzy_recall(retrieved: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, evidence_fact_recall): share of facts near any of the first ``k`` texts."""
    g = gold.select("query_id", F.posexplode("facts").alias("fact_ix", "fact")).where(F.trim("fact") != "")
    r = retrieved.where(F.col("rank") <= k).select("query_id", normalise_answer(F.col("text")).alias("t"))
    r = r.withColumn("t_words", tokens(F.col("t")))
    n = g.withColumn("f", normalise_answer(F.col("fact"))).withColumn("f_words", F.array_distinct(tokens(F.col("f")))).drop("fact")
    hit = n.join(r, "query_id").where(near(*(F.col(c) for c in ("f", "t", "f_words", "t_words")))).select("query_id", "fact_ix").distinct().withColumn("hit", F.lit(1))
    j = g.join(hit, ["query_id", "fact_ix"], "left")
    return j.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("evidence_fact_recall"))


def document_prf(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, precision, recall, f1) on sets of normalised titles. ``retrieved``: query_id, titles; ``gold``: query_id, docs."""
    keys = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), document_key), lambda k: k != ""))
    j = gold.select("query_id", keys(F.col("docs")).alias("g")).join(retrieved.select("query_id", keys(F.col("titles")).alias("r")), "query_id", "left")
    tp = F.coalesce(F.size(F.array_intersect("g", F.coalesce("r", F.array().cast("array<string>")))), F.lit(0))
    p, r = _ratio(tp, F.greatest(F.coalesce(F.size("r"), F.lit(0)), F.lit(0))), _ratio(tp, F.size("g"))
    judged = lambda c: F.when(F.size("g") > 0, c)
    return j.select("query_id", judged(p).alias("precision"), judged(r).alias("recall"), judged(_f1(p, r)).alias("f1"))


def support_scores(df: DataFrame, answer: str, gold_answer: str, predicted: str, gold: str) -> DataFrame:
    """Answer, support and joint em, f1, precision and recall; a wrong yes, no or noanswer has no overlap.

    ``predicted`` and ``gold`` are arrays of (title, idx).
    """
    d = df.withColumn("__a", normalise_answer(F.col(answer))).withColumn("__b", normalise_answer(F.col(gold_answer)))
    a, b = tokens(F.col("__a")), tokens(F.col("__b"))
    closed = F.col("__a").isin("yes", "no", "noanswer") | F.col("__b").isin("yes", "no", "noanswer")
    c = F.when((F.col("__a") != F.col("__b")) & closed, 0).otherwise(common_tokens(a, b))
    d = d.withColumns({"prec": _ratio(c, F.size(a)), "recall": _ratio(c, F.size(b)), "em": (F.col("__a") == F.col("__b")).cast("double")})
    p, g = F.array_distinct(predicted), F.array_distinct(gold)
    hit = F.size(F.array_intersect(p, g))
    d = d.withColumns({"sp_prec": _ratio(hit, F.size(p)), "sp_recall": _ratio(hit, F.size(g)), "sp_em": ((F.size(F.array_except(p, g)) == 0) & (F.size(F.array_except(g, p)) == 0)).cast("double")})
    d = d.withColumns({"f1": _f1(F.col("prec"), F.col("recall")), "sp_f1": _f1(F.col("sp_prec"), F.col("sp_recall"))})
    jp, jr = F.col("prec") * F.col("sp_prec"), F.col("recall") * F.col("sp_recall")
    return d.withColumns({"joint_em": F.col("em") * F.col("sp_em"), "joint_prec": jp, "joint_recall": jr, "joint_f1": _f1(jp, jr)}).drop("__a", "__b")


def project_sentences(passages: DataFrame, sentences: DataFrame) -> DataFrame:
    """(passage_id, title, idx): whole sentences of the named paragraph that the passage holds, whatever the gold says.

    ``passages``: passage_id, source_id, title, text; ``sentences``: source_id, title, idx, sentence. The paragraph is found
    by source, else by title; the projection is made once a distinct passage.
    """
    body = passages.select("passage_id", "source_id", "title", u_collapse(F.coalesce("text", F.lit(""))).alias("body"))
    s = sentences.select(F.col("source_id").alias("s_id"), F.col("title").alias("s_title"), "idx", u_collapse(F.coalesce("sentence", F.lit(""))).alias("needle")).where("needle <> ''")
    own = s.select("s_id").distinct()
    known = body.join(own, body["source_id"] == own["s_id"], "left_semi")
    by_id = known.join(s, known["source_id"] == s["s_id"])
    other = body.join(own, body["source_id"] == own["s_id"], "left_anti")
    by_title = other.join(s, other["title"] == s["s_title"])
    pick = lambda d: d.where(F.contains("body", "needle")).select("passage_id", F.col("s_title").alias("title"), "idx")
    return pick(by_id).unionByName(pick(by_title)).distinct()


def link_usefulness(nodes: DataFrame, hits: DataFrame, gold: DataFrame) -> DataFrame:
    """One row a query: hop destinations, their relevance, coverage they add and keep, and overlap with NEXT.

    ``nodes``: query_id, role {direct, hop, next, selected}, id; ``hits``: query_id, id, unit; ``gold``: query_id, units (count).
    """
    role = lambda r: F.max((F.col("role") == r).cast("int"))
    n = nodes.groupBy("query_id", "id").agg(*(role(r).alias(r) for r in ("direct", "hop", "next", "selected")))
    n = n.withColumn("dest", (F.col("hop") == 1) & (F.col("direct") == 0))
    h = n.join(hits.distinct(), ["query_id", "id"], "left")
    rel = h.groupBy("query_id", "id", "dest", "next").agg(F.max(F.col("unit").isNotNull().cast("int")).alias("relevant"))
    per_node = rel.groupBy("query_id").agg(
        F.count_if("dest").alias("hop_destinations"), F.sum(F.when(F.col("dest"), F.col("relevant"))).alias("relevant"),
        F.count_if(F.col("dest") & (F.col("next") == 1)).alias("overlap"),
    )
    u = h.where("unit is not null").groupBy("query_id", "unit").agg(F.max(F.col("direct")).alias("d"), F.max(F.col("dest").cast("int")).alias("h"), F.max((F.col("dest") & (F.col("selected") == 1)).cast("int")).alias("k"))
    per_unit = u.groupBy("query_id").agg(F.count_if((F.col("h") == 1) & (F.col("d") == 0)).alias("added"), F.count_if((F.col("k") == 1) & (F.col("d") == 0)).alias("kept"))
    j = per_node.join(per_unit, "query_id", "left").join(gold, "query_id", "left")
    some = lambda c: F.when(F.col("hop_destinations") > 0, c)
    unit = lambda c: F.when(F.col("units") > 0, F.coalesce(c, F.lit(0)) / F.col("units"))
    return j.select("query_id", "hop_destinations", some(F.col("relevant") / F.col("hop_destinations")).alias("hop_relevance"), unit(F.col("added")).alias("added_coverage"), unit(F.col("kept")).alias("retained_coverage"), some(F.col("overlap") / F.col("hop_destinations")).alias("next_overlap"))
