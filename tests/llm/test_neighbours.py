import json

import numpy as np
import pytest

from strandloom.llm.neighbours import FAR, Plan, Rotations, _hadamard, far_plan, parse_vector, similar


def clusters(n, dim, seed, spread=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 4, dim))
    x = np.repeat(centres, 4, axis=0)
    return x + spread * rng.normal(size=x.shape) * rng.uniform(0.2, 1.5, (len(x), 1))


def brute(x, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(x)):
        for j in np.argsort(-s[i], kind="stable")[:k]:
            if s[i, j] >= least:
                out.add((i, int(j)))
    return out


def frame(spark, x, **more):
    return spark.createDataFrame([(f"{i:06d}", json.dumps([round(float(v), 5) for v in r]), "z") for i, r in enumerate(x)], "key string, v string, neighbour string")


def keys(df):
    return {(int(r.key), int(r.neighbour)) for r in df.collect()}


def test_rotation_is_orthogonal():
    r = Rotations(48, 2)
    assert np.array_equal(_hadamard(8) @ _hadamard(8).T, 8 * np.eye(8))
    axis, gap = r.axes(np.random.default_rng(0).normal(size=(50, 48)).astype(np.float32), 1, 3)
    assert (axis[:, 0] // 2 != axis[:, 1] // 2).all() and (np.diff(gap, axis=1) >= 0).all() and axis.max() < 128


@pytest.mark.parametrize("bad", [None, "", "null", "[]", "[1,2", '["1", 2]', "[true, 1]", "[NaN, 1]", "[0, 0.0]", "[1e999, 1]", "{}", "[[1], 2]", "[1, 2, 3]", "[1%s, 2]" % ("0" * 400)])
def test_no_vector(bad):
    assert parse_vector(bad, 2) is None


def test_vectors():
    assert np.allclose(parse_vector("[3, 4e0]", 2), [0.6, 0.8]) and np.allclose(parse_vector("[3e-300, 4e-300]"), [0.6, 0.8])


@pytest.mark.parametrize("rows", [4096, 40])
def test_recall_against_brute_force(spark, rows):
    x = clusters(1200, 64, 1)
    want = brute(x, 5, 0.9)
    assert len(want) > 500
    got = similar(frame(spark, x), "key", "v", k=5, size=64, min_cosine=0.9, bucket_rows=rows)
    pairs = keys(got)
    assert len(want & pairs) >= 0.9 * len(want)
    assert not {p for p in pairs - want if np.dot(x[p[0]], x[p[1]]) / np.linalg.norm(x[p[0]]) / np.linalg.norm(x[p[1]]) < 0.8999}


def test_crowded_region_in_blocks(spark):
    rng = np.random.default_rng(5)
    x = np.ones((300, 16)) + 0.01 * rng.normal(size=(300, 16))  # one bucket in every table
    x = np.round(x, 5)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    fifth = np.sort(s, axis=1)[:, -5]
    pairs = keys(similar(frame(spark, x), "key", "v", k=5, bucket_rows=40))
    assert all(a != b and s[a, b] >= fifth[a] - 1e-3 for a, b in pairs)
    per = {}
    for a, _ in pairs:
        per[a] = per.get(a, 0) + 1
    assert set(per.values()) == {5}


def test_crowd_of_a_third_of_all_rows(spark):
    rng = np.random.default_rng(9)
    centre = rng.normal(size=64) / 8
    x = np.round(np.concatenate([centre + 0.03 * rng.normal(size=(1500, 64)), rng.normal(size=(3000, 64)) / 8]), 5)
    want = {p for p in brute(x, 5, 0.9) if p[0] < 1500}
    assert len(want) > 5000
    got = keys(similar(frame(spark, x), "key", "v", k=5, size=64, min_cosine=0.9, bucket_rows=100))
    assert len(want & got) >= 0.9 * len(want)


def test_without_threshold_full_lists(spark):
    x = clusters(400, 32, 3, 0.1)
    pairs = keys(similar(frame(spark, x), "key", "v", k=3))
    want = brute(x, 3, -1)
    assert len(want & pairs) >= 0.9 * len(want)


@pytest.mark.parametrize("depth", [1, 2])
def test_far_neighbours(spark, depth):
    x = np.random.default_rng(depth).normal(size=(3000, 64)) * 0.96 ** np.arange(64)  # the fifth neighbour is at a cosine of about 0.5
    got = similar(frame(spark, x), "key", "v", k=5, size=64, plan=FAR[depth]).toPandas()
    want = brute(x, 5, -1)
    assert len(want & set(zip(got.key.astype(int), got.neighbour.astype(int)))) >= 0.9 * len(want)
    assert got.groupby("key").size().eq(5).mean() > 0.99


def test_depth_follows_the_number_of_vectors():
    assert [far_plan(n, 64).depth for n in (0, 256_000, 256_001, 10**8)] == [1, 1, 2, 3] and isinstance(far_plan(1, 1), Plan)


def test_classes_of_identical_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8))
    x[:40] = x[0]
    got = similar(frame(spark, x), "key", "v", k=5, min_cosine=0.99).toPandas()
    got = got[got.key < "000040"]
    assert got.groupby("key").size().eq(5).all() and got.key.nunique() == 40 and (got.neighbour < "000040").all() and (got.key != got.neighbour).all()


def test_edge_cases(spark):
    rows = [("a", "[1, 0]"), ("a", "[1.0, 0.0]"), ("b", "[2, 0.01]"), ("c", "broken"), (None, "[1, 0]"), ("d", None), ("e", "[0, 0]"), ("f", "[1,0,0]")]
    df = spark.createDataFrame(rows, "key string, v string")
    got = {(r.key, r.neighbour, r["rank"]) for r in similar(df, "key", "v", size=2).collect()}
    assert got == {("a", "b", 1), ("b", "a", 1)}
    assert similar(df.limit(0), "key", "v", size=2).count() == 0
    assert similar(df.limit(1), "key", "v").count() == 0
