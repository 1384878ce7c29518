import random

from pyspark.sql import functions as F

from strandloom.llm.copies import copies, copy_keys, copy_sets
from strandloom.llm.q_copies import LABELS
from strandloom.llm.topn import top_n_per_group


def pairs(df):
    return {tuple(r) for r in copies(df, "id", "text", LABELS).collect()}


def test_copies(spark):
    rows = [
        (1, "Straße, the  Harbour (1930)."), (2, "STRASSE THE HAR-\nBOUR 1930"), (3, "strasse the harbour 1931"),
        (4, "Object: Lamp; City: Ulm"), (5, '{"City": "Ulm",\n "Object": "L\\u0061mp"}'), (6, "CITY : ulm | OBJECT : lamp |"), (7, "Object: Lamp City: Ulm"),
        (8, None), (9, ""), (10, " \n"), (11, "..!"), (12, "Lent to: X\nCity: Y"), (13, "City:Y;Lent  to:X."), (14, "café"), (15, "café"),
        (16, "The City: Ulm"), (17, "City: Ulm the"), (18, "ΣΟΦΟΣ a"), (19, "σοφοςa"),
    ]
    df = spark.createDataFrame([(*r, 0, 1) for r in rows], "id long, text string, kept int, h128 int").drop("h128")
    assert pairs(df) == {(1, 2), (4, 5), (4, 6), (12, 13), (14, 15), (18, 19)}
    counts = {r.kept: r.copies for r in copy_sets(copy_keys(df, "id", "text", LABELS), "id").collect()}
    assert counts[1] == 2 and counts[4] == 3 and counts[3] == 1
    assert pairs(df.limit(0)) == set()


def test_copies_hot_set(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("A, b")).otherwise(F.concat(F.lit("t"), (F.col("id") / 2).cast("int"))).alias("text"))
    got = pairs(df)
    want, seen = set(), {}
    for i in range(3000):
        form = "ab" if i % 3 == 0 else f"t{i // 2}"
        if form in seen:
            want.add((seen[form], i))
        seen.setdefault(form, i)
    assert got == want


def test_top_n_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "c", None] + ["hot"] * 5), rng.choice("pqrstuvwxyz"), rng.choice([None, 1.0, 2.0, 3.0, float(rng.random())]), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, item string, score double, rank long").repartition(7)
    df = df.withColumnRenamed("rank", "n")
    order = [F.col("score").desc(), F.col("item").desc(), F.col("n").asc()]
    for distinct in (None, "item"):
        got = {(r.g, r.item, r.n, r.rank) for r in top_n_per_group(df, ["g"], order, 4, distinct=distinct).collect()}
        want = set()
        for g in {r[0] for r in rows}:
            mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-(r[2] if r[2] is not None else -1), -ord(r[1]), r[3]))
            kept, seen = [], set()
            for r in mine:
                if len(kept) < 4 and not (distinct and r[1] in seen):
                    kept.append(r)
                    seen.add(r[1])
            want |= {(r[0], r[1], r[3], k + 1) for k, r in enumerate(kept)}
        assert got == want
    assert top_n_per_group(df.limit(0), ["g"], order, 4).count() == 0


def test_top_n_replaces_rank_and_keeps_extra_columns(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z")], "g string, s int, rank string")
    got = {(r.g, r.s, r["rank"]) for r in top_n_per_group(df, ["g"], [F.col("s").desc()], 1).collect()}
    assert got == {("a", 2, 1), (None, 3, 1)}
