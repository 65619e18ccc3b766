import hashlib
import random
import re

import pytest

from skuflow.llm import mixing
from tests.llm.conftest import sentence


def brute_targets(sizes):
    """Reshare by weight until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total = 1.5 * sum(sizes.values())
    capped = set()
    while True:
        rest = total - sum(2 * sizes[s] for s in capped)
        open_weight = sum(w for s, w in weight.items() if s not in capped)
        above = {s for s in names if s not in capped and weight[s] * rest / open_weight > 2 * sizes[s]}
        if not above:
            return {s: 2.0 * sizes[s] if s in capped else weight[s] * rest / open_weight for s in names}
        capped |= above


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def corpus(rng, n=3000):
    sources = ["hot"] * 12 + ["b", "Z", "é", "a", "", None, "tiny"]
    return [(i, rng.choice([None, "", " ", sentence(rng, rng.randint(1, 30)), sentence(rng, 8)]), rng.choice(sources))
            for i in range(n)]


def test_targets_and_copies(spark):
    rows = corpus(random.Random(1))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = brute_targets(sizes)
    plan = mixing.plan_copies(df).collect()
    taken = {}
    for r in plan:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        u = int(hashlib.md5(f"{mixing.SEED}:{r.id}".encode()).hexdigest()[:13], 16) / 2 ** 52
        assert r.copies == int(rate) + (u < rate - int(rate))
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(abs(taken[s] - want[s]) < 0.15 * want[s] + 40 for s in want)


def test_rows_of_the_mix_follow_the_plan(spark):
    rows = corpus(random.Random(2), 400)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counts = {r.id: r.copies for r in mixing.plan_copies(df).collect()}
    got = {}
    for r in mixing.mix(df).collect():
        assert (r.text, r.source) == rows[r.doc_id][1:]
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: c for i, c in counts.items() if c}


def test_defined_cases(spark, odd_docs, empty_docs):
    plan = mixing.plan_copies(odd_docs)
    assert plan.count() == odd_docs.count()
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert mixed.count() == plan.agg({"copies": "sum"}).first()[0]
    assert mixing.plan_copies(empty_docs).collect() == [] and mixing.mix(empty_docs).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.target, r.copies) for r in mixing.plan_copies(blank).collect()} == {(0.0, 0)}
