import numpy as np
import pytest

from skuflow.llm import collision_ann


def table(spark, ids, vectors, name="vec_id"):
    rows = [(int(i), [float(x) for x in v], 3, 1.0) for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>, rank int, score double")


def check(spark, ids, vectors, least=0.9, **options):
    vectors = vectors.astype(np.float32).astype(np.float64)
    exact = collision_ann.brute_force(ids, vectors, 10)
    got = collision_ann.nearest(table(spark, ids, vectors), query_modulus=10, **options).toPandas()
    both = exact.merge(got, on=["query_id", "vec_id"])
    assert len(both) / len(exact) >= least
    assert np.allclose(both.score_x, both.score_y, rtol=1e-12)
    for _, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, len(g) + 1))
        assert list(zip(g.score, g.vec_id, strict=True)) == sorted(zip(g.score, g.vec_id, strict=True))
    return got


@pytest.mark.parametrize("kind", ["gaussian", "clusters", "line"])
def test_recall_against_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    n = 2000
    if kind == "gaussian":
        v = rng.standard_normal((n, 32))
    elif kind == "clusters":
        v = rng.standard_normal((20, 32))[rng.integers(0, 20, n)] * 5 + 0.1 * rng.standard_normal((n, 32))
    else:
        v = np.outer(rng.random(n), np.ones(32)) + 1e-3 * rng.standard_normal((n, 32))
    check(spark, np.arange(n), v, 0.95, block=700, query_block=60)


def test_ties_copies_and_fewer_than_k(spark):
    v = np.ones((30, 4))
    v[20:] = 2
    got = check(spark, np.arange(30), v, 1.0)
    assert set(got[got.query_id == 0]["vec_id"]) == set(range(1, 11))
    few = collision_ann.nearest(table(spark, [0, 100, 3], np.eye(3)), k=10).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in few) == [(0, 1, 3), (0, 2, 100), (100, 1, 0), (100, 2, 3)]


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.5]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]),
            (6, [None, 1.0]), (7, [1.0, 3.0]), (7, [1.0, 3.0]), (8, [1.0, 2.0, 3.0]), (200, [0.0, 0.0]), (None, [1.0, 1.0]),
            (300, [5.0, 5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in collision_ann.nearest(df).collect())
    assert got == [(0, 1, 100), (0, 2, 7), (100, 1, 0), (100, 2, 7), (300, 1, 8)]
    assert collision_ann.nearest(df.limit(0)).collect() == []
    assert collision_ann.nearest(df.where("vec_id = 1")).collect() == []
