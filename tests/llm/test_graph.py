import random

from skuflow.llm.graph import components


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 300)]
    edges += [(rng.randint(500, 900), rng.randint(500, 900)) for _ in range(200)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    df = spark.createDataFrame([(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges], "a long, b long")
    got = {r.vertex: r.label for r in components(df).collect()}
    assert got == {v: find(v) for a, b in edges for v in (a, b) if a != b}
