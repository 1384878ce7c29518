import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions.vectors import block_top_k, cosine
from strandloom.operators import graph, providers, retrieval, stats, store


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.8, 0.6]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.8, 0.0]
    with pytest.raises(Exception, match="different sizes"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b"))).collect()


def test_block_top_k_against_numpy(spark):
    rng = np.random.default_rng(1)
    x, g = rng.normal(size=(90, 8)), rng.integers(0, 4, 90)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, g))], "id long, vec array<double>, grp int")
    got = {(r.qid, r.tid, r["rank"]) for r in block_top_k(df, df, 3, query_block=16).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.where(g[:, None] == g[None], -np.inf, u @ u.T)
    assert got == {(i, int(j), n + 1) for i in range(90) for n, j in enumerate(np.argsort(-s[i], kind="stable")[:3])}
    assert block_top_k(df.limit(0), df, 3).count() == 0


def test_rank_fusion_fixture(spark):
    c = spark.createDataFrame([("q", "A", [1.0, 0.0], 0.5), ("q", "B", [0.8, 0.6], 1.0), ("q", "C", [0.9, 0.43589], 0.75)], "query_id string, id string, embedding array<double>, representation_score double")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    r = retrieval.rank_fusion(retrieval.score_bodies(c, q), 3).orderBy("rank").collect()
    assert [x.id for x in r] == ["A", "B", "C"]
    assert r[0].rank_fusion_score == pytest.approx(4 / 3) and r[1].rank_fusion_score == pytest.approx(4 / 3)


def test_modality_ranks_and_matched_union(spark):
    rows = [("q", "body", "vector", "v-low", 0.1, []), ("q", "body", "vector", "v-high", 0.9, []), ("q", "body", "text", "t-low", 1.0, []), ("q", "body", "text", "t-high", 9.0, [])]
    rows += [("q", "q_plus", "vector", "o", 1.0, ["qp-vector", "qp-shared"]), ("q", "q_plus", "text", "o", 1.0, ["qp-text", "qp-shared"])]
    h = retrieval.hybrid(spark.createDataFrame(rows, "query_id string, channel string, type string, id string, score double, matched array<string>"), 4)
    body = h.where("channel = 'body'").orderBy("rank").collect()
    assert [(r.id, r.rrf) for r in body] == [("t-high", 1.0), ("v-high", 1.0), ("t-low", 0.5), ("v-low", 0.5)]
    assert h.where("channel = 'q_plus'").first().matched == ["qp-shared", "qp-text", "qp-vector"]


def test_expansion_keeps_direct_scores(spark):
    starts = spark.createDataFrame([("q", "source", 1.0), ("q", "target", 0.8)], "query_id string, id string, representation_score double")
    hop = spark.createDataFrame([("source", "target"), ("source", "new")], "src_id string, dst_id string")
    none = spark.createDataFrame([], "src_id string, dst_id string")
    e = graph.frontier(starts, none, hop)
    got = {(r.id, r.representation_score, r.direct, r.paths) for r in graph.expand(starts, e).collect()}
    assert got == {("source", 1.0, True, 0), ("target", 0.8, True, 1), ("new", 0.5, False, 1)}
    assert graph.frontier(starts, none, hop, "none").count() == 0
    with pytest.raises(ValueError):
        graph.frontier(starts, none, hop, "other")


def test_merge_and_additions(spark):
    m = spark.createDataFrame([("q-first", "a", "m1", "b", 0.9), ("q-second", "a", "m2", "b", 0.8)], "qplus_id string, src_id string, qminus_id string, dst_id string, score double")
    r = graph.merge_hops(m).collect()
    assert len(r) == 1 and r[0].source_question_ids == ["q-first", "q-second"] and r[0].q_minus_score == 0.9
    base = spark.createDataFrame([("q", "direct"), ("q", "next")], "query_id string, id string")
    e = spark.createDataFrame([("direct", "next"), ("direct", "new")], "src_id string, dst_id string")
    assert [x.id for x in graph.additions(base.limit(1), base, e).collect()] == ["new"]


def test_neighbourhoods(spark):
    s = spark.createDataFrame([("q", 1, 1.0)], "query_id string, id long, representation_score double")
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1), (3, 4)], "src_id long, dst_id long")
    assert {(r.id, r.representation_score, r.depth) for r in graph.neighbourhoods(s, e, 4).collect()} == {(1, 1.0, 0), (2, 0.5, 1), (3, 0.5, 1), (4, 0.25, 2)}


def test_token_prefix_stops_at_first_overflow(spark):
    r = spark.createDataFrame([("q", i, i, n, i == 4) for i, n in ((1, 5), (2, 9), (3, 1), (4, 2))], "query_id string, id long, rank int, tokens int, start boolean")
    assert [x.id for x in retrieval.token_prefix(r, 10).collect()] == [1]
    assert {x.id for x in retrieval.token_prefix(r, 10, keep="start").collect()} == {4, 1}


def test_fill_and_sources(spark):
    ranked = spark.createDataFrame([("q", "c", 1), ("q", "c", 2)], "query_id string, id string, pos int")
    canon = spark.createDataFrame([("q", x, i) for i, x in enumerate("abcd")], "query_id string, id string, rank int")
    f = retrieval.fill(ranked, canon, 4).orderBy("rank").collect()
    assert [r.id for r in f] == ["c", "c", "a", "b"]
    s = spark.createDataFrame([("q", "s", 1, 1, 1), ("q", "s", 1, 1, 2), ("q", "s", 1, 2, 3)], "query_id string, source string, page int, sent_id int, rank int")
    assert sorted((r.sent_id, r["rank"]) for r in retrieval.unique_sources(s).collect()) == [(1, 1), (2, 2)]


def test_bootstrap_fixture(spark):
    df = spark.createDataFrame([(1.0, "same"), (1.0, "same"), (0.0, "other")], "v double, c string")
    a = stats.bootstrap(df, "v", "c", repeats=500).first()
    assert a.mean == pytest.approx(2 / 3) and a.macro == 0.5 and (a.macro_low, a.macro_high) == (0.0, 1.0)
    assert stats.bootstrap(df.orderBy("c"), "v", "c", repeats=500).first() == a
    assert stats.resampled_means([], [])["mean"] is None
    assert stats.paired_bootstrap([0.5] * 20, repeats=200)["significant"]


def test_resampled_means_follow_numpys_stream():
    rng = np.random.default_rng(5)
    s, n = rng.random(40) * 9, rng.integers(1, 5, 40).astype(float)
    r = np.random.default_rng(42)
    rows = []
    for size in (128, 72):
        pick = r.integers(0, 40, size=(size, 40))
        rows += list(s[pick].sum(axis=1) / n[pick].sum(axis=1))
    got = stats.resampled_means(s, n, repeats=200)
    assert (got["low"], got["high"]) == pytest.approx(tuple(np.quantile(rows, [0.025, 0.975])))


def test_poisson_bootstrap_is_near_the_other(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(rng.random() + (c % 5) / 5, f"c{c}", "x" if c % 2 else "y") for c in range(300) for _ in range(1 + c % 3)], "v double, c string, g string")
    a = {r.group: r for r in stats.bootstrap(df, "v", "c", "g", repeats=2000).collect()}
    b = {r.group: r for r in stats.poisson_bootstrap(df.repartition(7), "v", "c", "g").collect()}
    assert set(a) == set(b) and all(abs(a[g].low - b[g].low) < 0.02 and abs(a[g].high - b[g].high) < 0.02 and a[g].mean == pytest.approx(b[g].mean) for g in a)
    assert {tuple(r) for r in stats.poisson_bootstrap(df.coalesce(1), "v", "c", "g").select("group", F.round("low", 9)).collect()} == {(g, round(r.low, 9)) for g, r in b.items()}
    assert stats.poisson_bootstrap(df.limit(0), "v", "c").count() == 0


def test_rewired_keeps_degrees(spark):
    rng = random.Random(1)
    source = {i: i % 6 for i in range(60)}
    edges = sorted({(0 if rng.random() < 0.3 else a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(300))})
    edges = [(a, b) for a, b in edges if source[a] != source[b]]  # one node starts a third of all edges
    e = spark.createDataFrame(edges + edges[:3], "src_id long, dst_id long")
    of = spark.createDataFrame(list(source.items()), "id long, source long")
    out = stats.rewired(e, of, 2).collect()
    for k in (0, 1):
        mine = [(r.src_id, r.dst_id) for r in out if r.repeat == k]
        assert len(set(mine)) == len(mine) == len(edges) and len(set(mine) & set(edges)) < 0.7 * len(edges)
        assert all(source[a] != source[b] for a, b in mine)
        for side in (0, 1):
            assert sorted(x[side] for x in mine) == sorted(x[side] for x in edges)
    with pytest.raises(Exception, match="within a source"):
        stats.rewired(spark.createDataFrame([(0, 6)], "src_id long, dst_id long"), of, 1)
    assert stats.rewired(e.limit(0), of, 1).count() == 0


def test_supply_and_samples(spark):
    base = spark.createDataFrame([("q", 1), ("r", 1)], "query_id string, id long")
    samples = spark.createDataFrame([("q", k, "a", 2 + k) for k in (0, 1)] + [("q", 0, "b", 9), ("r", 0, "a", 3), ("z", 0, "a", 1)], "query_id string, repeat int, arm string, id long")
    hits = spark.createDataFrame([("q", 1, 0), ("q", 2, 1), ("q", 3, 0), ("r", 3, 0)], "query_id string, id long, unit int")
    gold = spark.createDataFrame([("q", 2), ("r", 1), ("z", 0)], "query_id string, units int")
    v = stats.link_supply(base, samples, hits, gold)
    assert {tuple(r) for r in v.collect()} == {("q", 0, "a", 0.5, 1.0, 1.0), ("q", 1, "a", 0.0, 0.0, 0.0), ("q", 0, "b", 0.0, 0.0, 0.0), ("r", 0, "a", 1.0, 1.0, 1.0)}
    s = {(r.arm, r.metric): (r.mean, r.realization_sd) for r in stats.supply_summary(v).collect()}
    assert s["a", "added_recall"][0] == 0.5 and s["b", "any_new"] == (0.0, None)
    pools = spark.createDataFrame([("q", x, i) for x in "ab" for i in range(5)], "query_id string, arm string, id long")
    two = spark.createDataFrame([("q", 2)], "query_id string, budget int")
    got = stats.coupled_sample(pools, two, 1).collect()
    assert len(got) == 4 and len({r.id for r in got}) == 2
    with pytest.raises(Exception, match="smaller than its budget"):
        stats.coupled_sample(pools, two.withColumn("budget", F.lit(9)), 1).collect()
    assert {tuple(r) for r in stats.budget_histogram(spark.createDataFrame([(1,), (1,), (4,)], "budget int")).collect()} == {(1, 2, 2.0), (4, 1, 2.0)}


def test_running_sums_of_hot_groups(spark):
    from strandloom.functions.vectors import running_whole

    rng = random.Random(3)
    df = spark.createDataFrame([(rng.choice(["hot", "hot", "a", None]), rng.randrange(50), i, rng.randrange(9)) for i in range(2000)], "g string, s int, i long, v int").repartition(5)
    order = [F.col("s").desc(), F.col("i").asc()]
    want = {tuple(r) for r in running_whole(df, ["g"], order, F.col("v"), "run").collect()}
    assert {tuple(r) for r in running_whole(df, ["g"], order, F.col("v"), "run", 600).collect()} == want


def test_mask_and_greedy(spark):
    s = spark.createDataFrame([("q", "x", 1), ("q", "x", 2)], "query_id string, arm string, id long")
    h = spark.createDataFrame([("q", 1, 0), ("q", 1, 5), ("q", 2, 5)], "query_id string, id long, unit int")
    assert stats.mask_coverage(s, h).first().covered == 2
    with pytest.raises(Exception, match="63 units"):
        stats.mask_coverage(s, h.withColumn("unit", F.lit(64))).collect()
    pool = spark.createDataFrame([("q", 1, 5, 0), ("q", 2, 3, 0), ("q", 3, 9, 1), ("q", 4, 2, 2), ("q", 4, 2, 3)], "query_id string, id long, tokens long, unit int")
    assert sorted(r.id for r in stats.greedy_cover(pool, 8).collect()) == [2, 4]
    rng = random.Random(5)
    rows = [(f"q{rng.randrange(3)}", i, rng.randrange(1, 9), u) for i in range(60) for u in rng.sample(range(9), rng.choice([1, 1, 2]))]
    size = {i: t for _, i, t, _ in rows}
    for budget in (0, 5, 12, 100):
        want = set()
        for q in {r[0] for r in rows}:
            left, seen = budget, set()
            for t, i in sorted({(size[r[1]], r[1]) for r in rows if r[0] == q}):
                units = {r[3] for r in rows if r[0] == q and r[1] == i}
                if t <= left and units - seen:
                    left, seen = left - t, seen | units
                    want.add((q, i))
        same = [(q, i, size[i], u) for q, i, _, u in rows]
        assert {tuple(r) for r in stats.greedy_cover(spark.createDataFrame(same, "query_id string, id long, tokens long, unit int"), budget).collect()} == want


def test_providers(spark):
    c = spark.createDataFrame([(1, "s", "One? Two. One? Three.")], "id long, source string, text string")
    q = providers.deduped_questions(providers.sentence_questions(c)).orderBy("channel", "ordinal").collect()
    assert [(r.channel, r.ordinal, r.text) for r in q] == [("q_minus", 0, "One?"), ("q_minus", 1, "Two."), ("q_minus", 2, "Three.")]
    e = providers.embed_with(spark.createDataFrame([("a",), ("bb",), ("a",), ("",), (None,)], "t string"), "t", lambda: lambda b: [[float(len(x))] for x in b])
    assert sorted((r.t or "", list(r.embedding)) for r in e.collect()) == [("", []), ("", []), ("a", [1.0]), ("a", [1.0]), ("bb", [2.0])]
    pool = spark.createDataFrame([("q", "x?", "a", 1), ("q", "x?", "b", 2)], "query_id string, query string, id string, rank int")
    assert [r.id for r in providers.rerank_with(pool, lambda q, ids, k: ids[::-1], 2).orderBy("pos").collect()] == ["b", "a"]


def test_store(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "source string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "source string, v int")
    assert {tuple(r) for r in store.replace_sources(old, new).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert {tuple(r) for r in store.reconcile(old, new).collect()} == {("b", 2)}
    path = str(tmp_path / "t")
    store.upsert_table(spark, path, old, buckets=4)
    store.upsert_table(spark, path, new, buckets=4)
    assert {(r.source, r.v) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert store.require_unique(old, "source").count() == 2
    with pytest.raises(Exception, match="repeated key"):
        store.require_unique(old.union(old), "source").collect()
    store.publish_text(str(tmp_path / "x" / "y.txt"), "hi")
    assert (tmp_path / "x" / "y.txt").read_text() == "hi"
    assert store.snapshot_row(spark, "graph", "ns", "complete", chunks=3).count() == 1
    assert "***" in store.redact(spark.createDataFrame([("api_key=abc",)], "t string"), "t").first().t


def test_streaming_commit_resumes(spark, tmp_path):
    from strandloom.streaming import checkpoints

    src = tmp_path / "in"
    src.mkdir()
    schema = "query_id string, answer string"
    for n, rows in enumerate((['{"query_id": "a", "answer": "1"}'], ['{"query_id": "b", "answer": "2"}', '{"query_id": "a", "answer": "3"}'])):
        (src / f"{n}.json").write_text("\n".join(rows))
        checkpoints.commit(checkpoints.follow(spark, str(src), schema, 1), "query_id", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.query_id, r.answer) for r in checkpoints.committed(spark, str(tmp_path / "out"), "query_id").collect()}
    assert got == {("a", "1"), ("b", "2")}


def test_hot_groups_are_ranked_in_pieces(spark):
    from strandloom.functions.vectors import rank_whole, rank_within

    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, s int, i long").repartition(5)
    order = [F.col("s").desc(), F.col("i").asc()]
    want = {tuple(r) for r in rank_within(df, ["g"], order).collect()}
    assert {tuple(r) for r in rank_whole(df, ["g"], order, hot_rows=600).collect()} == want
    assert {tuple(r) for r in rank_whole(df, ["g"], order, hot_rows=1).collect()} == want
    chunks = df.select(F.col("g").alias("source"), F.col("s").alias("sent_id"), F.col("i").alias("id"))
    assert {tuple(r) for r in graph.next_edges(chunks, 600).collect()} == {tuple(r) for r in graph.next_edges(chunks).collect()}


def test_integrity_reports_hops(spark):
    chunks = spark.createDataFrame([(1, "a", 0, "x"), (2, "a", 1, "x"), (3, "b", 0, "x")], "id long, source string, sent_id int, text string")
    hop = spark.createDataFrame([(1, 3, [10, 11]), (1, 2, [10]), (1, 2, [10]), (3, 3, [12]), (1, 9, [10]), (8, 1, [12])], "src_id long, dst_id long, source_question_ids array<long>")
    answered = spark.createDataFrame([(10, 1, 20, 3), (12, 3, 21, 3)], "qplus_id long, src_id long, qminus_id long, dst_id long")
    minus = spark.createDataFrame([(20, 3), (21, 3)], "id long, chunk_id long")
    got = {r["check"]: r.violations for r in graph.integrity(chunks, graph.next_edges(chunks), hop, answered, minus).collect()}
    assert {k: v for k, v in got.items() if v} == {"hop_source_missing": 1, "hop_target_missing": 1, "hop_to_itself": 1, "duplicate_hop": 1, "hop_within_source": 3, "hop_provenance": 5}


def test_graph_integrity_sees_hop_edges(spark):
    from pathlib import Path

    from strandloom.plans.q_index import graph_integrity

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test tables")
    got = {r["check"]: r.violations for r in graph_integrity(spark, "/root/testdata/sf0.001").collect()}
    assert got["hop_within_source"] == 13 and got["hop_provenance"] == 0 and len(got) == 14
