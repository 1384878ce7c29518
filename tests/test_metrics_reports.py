import json
import random
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.operators import coverage, fulltext, metrics, reports
from strandloom.sources import corpus


def gold(spark, *facts):
    return spark.createDataFrame([("q", list(facts))], "query_id string, facts array<string>")


def texts(spark, *ts):
    return spark.createDataFrame([("q", i + 1, t) for i, t in enumerate(ts)], "query_id string, rank int, text string")


def test_map_fixture(spark):
    r = metrics.ranking_metrics(texts(spark, "alpha", "unrelated", "beta"), gold(spark, "alpha", "beta")).first()
    assert r.mrr_10 == 1 and r.map_10 == pytest.approx((1 + 1 / 3) / 2) and r.all_facts_10 == 1 and r.hits_4 == 1


def test_map_above_one(spark):
    facts = [f"fact {i:02d};" for i in range(12)]
    r = metrics.ranking_metrics(texts(spark, " ".join(facts)), gold(spark, *facts)).first()
    assert r.map_10 == pytest.approx(1.2) and r.exact_fact_recall_10 == 1


def test_duplicate_fact(spark):
    r = metrics.ranking_metrics(texts(spark, "same fact"), gold(spark, "same fact", "same\nfact")).first()
    assert r.map_10 == 0.5 and r.hits_10 == 1 and r.exact_fact_recall_10 == 1


def test_no_gold_and_no_results(spark):
    g = spark.createDataFrame([("a", []), ("b", ["x"]), ("c", None)], "query_id string, facts array<string>")
    r = {x.query_id: x for x in metrics.ranking_metrics(texts(spark, "y").withColumn("query_id", F.lit("z")), g).collect()}
    assert r["a"].map_10 is None and r["c"].hits_4 is None and r["b"].map_10 == 0 and r["b"].all_facts_10 == 0


def test_document_prf(spark):
    r = spark.createDataFrame([("q", ["Alpha", "Alpha", "Beta"])], "query_id string, titles array<string>")
    g = spark.createDataFrame([("q", ["Alpha", "Gamma"]), ("n", []), ("m", ["X"])], "query_id string, docs array<string>")
    got = {x.query_id: (x.precision, x.recall, x.f1) for x in metrics.document_prf(r, g).collect()}
    assert got == {"q": (0.5, 0.5, 0.5), "n": (None, None, None), "m": (0.0, 0.0, 0.0)}


def test_null_question(spark):
    df = spark.createDataFrame([("I do not know.", "Insufficient information.", "null_query"), ("Final answer: the Ulm", "Ulm", "bridge")], "a string, t string, q string")
    n, b = metrics.answer_metrics(df, "a", "t", "q").collect()
    assert n.em is None and n.null_refusal == 1 and n.qa_accuracy == 0
    assert b.em == 1 and b.null_refusal is None
    assert df.select(metrics.answer_label(F.lit(None).cast("double"), F.lit(1.0), F.lit(None).cast("string"))).first()[0] == "Refusal"


def test_answer_scores_against_plain_python(spark):
    rng = random.Random(0)
    words = ["ulm", "the", "clock", "a", "tower", "", "ulm,"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 6))), " ".join(rng.choices(words, k=rng.randint(0, 6)))) for _ in range(200)]

    def norm(s):
        s = "".join(c for c in s.lower() if c not in string.punctuation)
        return " ".join(re.sub(r"\b(a|an|the)\b", " ", s).split())

    def plain(p, r):
        p, r = norm(p), norm(r)
        if p == r:
            return 1.0, 1.0
        c = sum((Counter(p.split()) & Counter(r.split())).values())
        if not p or not r or not c:
            return 0.0, 0.0
        x, y = c / len(p.split()), c / len(r.split())
        return 0.0, 2 * x * y / (x + y)

    got = [(r.em, round(r.f1, 9)) for r in metrics.answer_scores(spark.createDataFrame(rows, "p string, r string").coalesce(1), "p", "r").collect()]
    assert got == [(e, round(f, 9)) for e, f in (plain(*x) for x in rows)]


def test_best_alias(spark):
    df = spark.createDataFrame([(1, "the big ulm", ["x", "ulm", "big ulm"]), (2, "x", None)], "k int, p string, al array<string>")
    got = {r.k: r.alias for r in metrics.best_alias(df, "k", "p", "al").collect()}
    assert got[1] == "big ulm"


def test_support_fixture(spark):
    fact = "array<struct<title:string,idx:int>>"
    df = spark.createDataFrame([("yes", "yes", [("Article", 0)], [("Article", 0), ("Article", 902)]), ("yes it is", "yes", [], [])], f"a string, g string, p {fact}, s {fact}")
    r, w = metrics.support_scores(df, "a", "g", "p", "s").collect()
    assert (r.em, r.sp_recall, r.joint_em) == (1, 0.5, 0) and r.sp_f1 == pytest.approx(2 / 3)
    assert w.f1 == 0 and w.sp_em == 1


def test_projection(spark):
    s = spark.createDataFrame([("s1", "T", 0, "One two."), ("s1", "T", 1, " Three  four."), ("s2", "U", 0, "Five.")], "source_id string, title string, idx int, sentence string")
    p = spark.createDataFrame([("p", "s1", "x", "zero One two. Three"), ("r", "no", "U", "Five. six"), ("n", "no", "no", "Five.")], "passage_id string, source_id string, title string, text string")
    assert {tuple(r) for r in metrics.project_sentences(p, s).collect()} == {("p", "T", 0), ("r", "U", 0)}


def test_usefulness_fixture(spark):
    n = spark.createDataFrame([("q", "direct", "d"), ("q", "hop", "d"), ("q", "hop", "h"), ("q", "hop", "n"), ("q", "next", "n"), ("q", "selected", "d"), ("q", "selected", "h")], "query_id string, role string, id string")
    h = spark.createDataFrame([("q", "d", 1), ("q", "h", 2), ("q", "n", 3)], "query_id string, id string, unit int")
    g = spark.createDataFrame([("q", 3)], "query_id string, units int")
    r = metrics.link_usefulness(n, h, g).first()
    assert r.hop_destinations == 2 and r.hop_relevance == 1 and r.added_coverage == pytest.approx(2 / 3) and r.retained_coverage == pytest.approx(1 / 3) and r.next_overlap == 0.5


def test_failures_stay_in_the_denominator(spark):
    df = spark.createDataFrame([(1.0, False, "a"), (None, True, "a"), (-1.0, False, "b")], "v double, e boolean, c string")
    r = {(x.level, x.metric): (x["mean"], x.eligible) for x in reports.means(df, ["v"], F.col("e"), "c").collect()}
    assert r[("all", "v")] == (0.5, 2) and r[("b", "v")] == (None, 0)
    assert reports.run_status(df.withColumn("err", F.lit("x")), 3, "err").first()[0] == "failed"
    assert reports.compact_rows(df, ["v"]).where("v = -1").count() == 2


def test_flatten_and_population(spark):
    df = spark.sql("select named_struct('x', 1, 'y', named_struct('z', 2)) as a, 3 as b")
    assert reports.flatten(df).columns == ["a.x", "a.y.z", "b"]
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {tuple(r) for r in reports.unpaired(a, b, "k").collect()} == {("left", 1), ("right", 3)}
    assert not reports.same_population(a, b, "k").first().same


POOL = "query_id string, id string, ord int, is_start boolean"


def test_curve_fixture(spark):
    g = spark.createDataFrame([("q", "g", 0, False), ("q", "s", 1, True)], POOL)
    d = spark.createDataFrame([("q", "d1", 0, False), ("q", "d2", 1, False), ("q", "s", 2, True), ("q", "d3", 3, False)], POOL)
    h = spark.createDataFrame([("q", "s", 0), ("q", "g", 1), ("q", "g", 2), ("q", "d1", 1), ("q", "d2", 1), ("q", "d3", 3)], "query_id string, id string, unit int")
    u = spark.createDataFrame([("q", 4)], "query_id string, units int")
    f = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "fraction double")
    got = [(r.direct_recall, r.graph_only_units) for r in coverage.curves(g, d, h, u, f).orderBy("fraction").collect()]
    assert got == [(0.25, 0), (0.5, 0), (0.75, 1)]


def test_prefix_fixture(spark):
    p = spark.createDataFrame([("q", x, i, x.startswith("start")) for i, x in enumerate(["extra1", "start1", "extra2", "extra3", "start2"])], POOL)
    f = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "fraction double")
    got = {}
    for r in coverage.prefix(p, f).collect():
        got.setdefault(r.fraction, set()).add(r.id)
    assert got == {0.0: {"start1", "start2"}, 0.5: {"extra1", "start1", "start2"}, 1.0: {"extra1", "extra2", "extra3", "start1", "start2"}}


def test_witness_fixture(spark):
    ids = lambda *x: spark.createDataFrame([("q", i) for i in x], "query_id string, id string")
    h = spark.createDataFrame([("q", "s", 0), ("q", "c", 1), ("q", "c", 2), ("q", "g", 2), ("q", "g", 3), ("q", "g", 4), ("q", "d", 3), ("q", "d2", 3)], "query_id string, id string, unit int")
    got = [r["class"] for r in coverage.witnesses(ids("s"), ids("s", "c", "g"), ids("s", "c", "d", "d2"), h).collect()]
    assert sorted(got) == ["distinct_only", "graph_exclusive", "shared_id", "shared_id"]


def test_components_against_union_find(spark):
    rng = random.Random(3)
    rows = [(f"i{rng.randrange(120):03d}", rng.randrange(100)) for _ in range(140)]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i, v in rows:
        a, b = find(i), find(by.setdefault(v, i))
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*rows, ("i000", None), (None, 5)], "i string, v int")
    got = {r.i: r.component for r in coverage.components(df, "i", "v").collect()}
    assert {k: v for k, v in got.items() if k in parent} == {i: find(i) for i in parent}


def test_bm25_and_channels(spark):
    d = spark.createDataFrame([(1, "red clock"), (2, "red red lamp"), (3, None), (4, "blue")], "k long, t string")
    q = spark.createDataFrame([("a", "Red, clock!"), ("b", "none"), ("c", None)], "q string, x string")
    r = fulltext.bm25(d, "k", "t", q, "q", "x", 5).orderBy("rank").collect()
    assert [(x.query_id, x.doc) for x in r] == [("a", 1), ("a", 2)]
    plan = fulltext.bm25_relational(d, "k", "t", q, "q", "x", 5).orderBy("rank").collect()
    assert [(x.query_id, x.doc, x.score, x["rank"]) for x in plan] == [(x.query_id, x.doc, x.score, x["rank"]) for x in r]
    assert fulltext.bm25(d, "k", "t", q.where("q = 'c'"), "q", "x", 5).count() == 0
    assert fulltext.bm25(d.limit(0), "k", "t", q, "q", "x", 5).count() == 0
    c = spark.createDataFrame([("q", "x", "body"), ("q", "x", "q_plus"), ("q", "y", "next")], "query_id string, id string, channel string")
    n = {x.combination: x.n for x in coverage.channel_combinations(c).collect()}
    assert n["body+q_plus"] == 1 and sum(n.values()) == 1 and len(n) == 7


def plain_chunks(text, n=6):
    s = [x.strip() for x in re.split(r"(?<=[.!?])\s+", text) if x.strip()]
    return [" ".join(s[i : i + n]) for i in range(0, len(s), n)]


def test_pages_and_windows(spark):
    text = "Title: My  doc\nParagraph-ID: p:1\n\ndropped\n--- Page 1 ---\n" + " ".join(f"S{i}." for i in range(8)) + "\n-- page 2 --\n \n--- PAGE 3 ---\nLast one"
    df = spark.createDataFrame([("f1", text), ("f2", "No marker here. Two!"), ("f3", ""), ("f4", None)], "source string, content string")
    p = corpus.parse_pages(df, "source", "content")
    got = [(r.source, r.title, r.page, r.content) for r in p.orderBy("source", "page_no").collect()]
    assert got[:2] == [("f1", "My  doc", 1, " ".join(f"S{i}." for i in range(8))), ("f1", "My  doc", 3, "Last one")]
    assert got[2] == ("f2", "f2", 1, "No marker here. Two!")
    c = corpus.chunk_documents(df, "source", "content", 3).orderBy("source", "sent_id").collect()
    assert [(r.source, r.sent_id, r.page, r.text) for r in c] == [
        ("f1", 0, 1, "S0. S1. S2."), ("f1", 1, 1, "S3. S4. S5."), ("f1", 2, 1, "S6. S7."), ("f1", 3, 3, "Last one"), ("f2", 0, 1, "No marker here. Two!"),
    ]
    assert {r.source for r in corpus.empty_documents(df, "source", "content").collect()} == {"f3", "f4"}


def test_windows_against_plain_python(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(["a", "B.", "! ", "? ", " ", "\n", "é", ". "]) for _ in range(60))) for i in range(200)]
    got = spark.createDataFrame(rows, "i int, t string").orderBy("i").select(corpus.sentence_windows(F.col("t"), 3)).collect()
    assert [list(r[0]) for r in got] == [plain_chunks(t, 3) for _, t in rows]


def test_files_metadata_and_articles(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello", encoding="utf-8")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe bad")
    (tmp_path / "c.pdf").write_text("no")
    got = {r.source: (r.content, r.failure is None) for r in corpus.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("hello", True), "b.md": (None, False)}
    (tmp_path / "m.json").write_text('{"a.txt": {"author": " X ", "url": "", "other": "z"}}')
    m = corpus.metadata_from_json(spark, str(tmp_path / "m.json")).first()
    assert (m.source, m.author, m.url) == ("a.txt", "X", None)
    a = spark.createDataFrame([(0, "A &amp; B", "x"), (1, "A & B", "y"), (2, "C", " ")], "ord int, title string, body string")
    assert sorted(r.source for r in corpus.article_corpus(a).collect()) == ["A_&_B.txt", "A_&_B_1.txt"]
    e = spark.createDataFrame([(1, [("T", "f"), ("U", "g"), ("T", "f"), (None, "")])], "k int, ev array<struct<title:string,fact:string>>")
    r = corpus.evidence(e, "ev").first()
    assert r.evidence_docs == ["T", "U"] and r.evidence_facts == ["f", "g", "f"]
    d = spark.createDataFrame([(1, "a"), (2, None)], "k int, t string")
    assert corpus.table_digest(d, "k", "t").first() == corpus.table_digest(d.orderBy(F.desc("k")), "k", "t").first()
    assert corpus.table_digest(d.limit(0), "k", "t").first().rows == 0


def test_fuzzy_recall_against_plain_python(spark):
    rng = random.Random(7)
    words = ["ulm", "the", "clock", "tower", "quay", "a", "1901"]
    make = lambda n: " ".join(rng.choices(words, k=n))
    facts = {f"q{i}": [make(rng.randint(1, 6)) for _ in range(rng.randint(1, 3))] for i in range(40)}
    found = [(q, r, make(rng.randint(0, 5))) for q in facts for r in range(1, 4)]

    def norm(s):
        return " ".join(re.sub(r"\b(a|an|the)\b", " ", s.lower()).split())

    def near(f, c):
        f, c = norm(f), norm(c)
        return bool(f and c) and (f in c or c in f or len(set(f.split()) & set(c.split())) / len(set(f.split())) >= 0.6)

    want = {q: sum(any(near(f, t) for p, r, t in found if p == q and r <= 2) for f in fs) / len(fs) for q, fs in facts.items()}
    g = spark.createDataFrame(list(facts.items()), "query_id string, facts array<string>")
    t = spark.createDataFrame(found, "query_id string, rank int, text string")
    assert {r.query_id: r.evidence_fact_recall for r in metrics.fuzzy_recall(t, g, 2).collect()} == pytest.approx(want)


def test_support_projection_reads_whole_paragraphs(spark, tmp_path):
    from strandloom.plans.q_evaluation import support_projection

    sentences = [f"Sentence {i} of a paragraph that goes on well past its first lines. " for i in range(20)]
    spark.createDataFrame([("s", "T", json.dumps(sentences)), ("b", "B", "broken")], "source_id string, title string, sentences string").write.parquet(f"{tmp_path}/paragraphs.parquet")
    assert {tuple(r) for r in support_projection(spark, str(tmp_path)).collect()} == {("s", "T", i) for i in range(20)}
