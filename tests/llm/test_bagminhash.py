import random
import re
from collections import Counter

import numpy as np
import pytest

from skuflow.llm import bagminhash
from tests.llm.conftest import paragraphs


def bag(text, k=5):
    words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return Counter(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))) if words else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values())) if a or b else 1.0


def brute_classes(rows):
    """Class per row index, by comparing all pairs."""
    bags = [bag(t) for _, t in rows]
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(bags[i], bags[j]) >= 0.8:
                a, b = of[i], of[j]
                of = [b if x == a else x for x in of]
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if of[j] == of[i] and rows[j][0] is not None]
        out.append((rows[i][0], min(ids) if ids else None))
    return out


def order(x):
    return [(-1 if v is None else v) for v in x]


def corpus(rng, groups=12):
    rows, n = [], 100
    for _ in range(groups):
        base = paragraphs(rng, 5, 2).split(" ")
        for _ in range(rng.randint(1, 6)):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 9])):
                words[rng.randrange(len(words))] = f"edit{rng.randint(0, 9999)}"
            rows.append((n, " ".join(words)))
            n += 1
    rng.shuffle(rows)
    return rows


def test_components_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    for _ in range(10):
        n = int(rng.integers(20, 300))
        items = np.sort(rng.integers(1, 1 << 62, n).astype(np.uint64))
        a = rng.integers(1, 9, n)
        b = np.maximum(0, a + rng.integers(-2, 4, n) * (rng.random(n) < 0.5))
        some = b > 0
        one = bagminhash.signatures(1, np.zeros(n, int), items, a, 2000)
        two = bagminhash.signatures(1, np.zeros(int(some.sum()), int), items[some], b[some], 2000)
        exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((one == two).mean() - exact) < 0.06


def test_signature_does_not_depend_on_the_batch():
    rng = np.random.default_rng(2)
    items = np.sort(rng.integers(1, 1 << 62, 50).astype(np.uint64))
    alone = bagminhash.signatures(1, np.zeros(50, int), items, np.ones(50, int), 140)
    others = rng.integers(1, 1 << 62, 5000).astype(np.uint64)
    text = np.concatenate([np.zeros(50, int), np.repeat(np.arange(1, 11), 500)])
    both = bagminhash.signatures(11, text, np.concatenate([items, others]), np.ones(5050, int), 140)
    assert (alone[0] == both[0]).all()


def test_similarities_are_exact():
    a = ["a b c d e f g", "a a a a a a a a", "", "x y", "p q r s t u v w"]
    b = ["A b c d e f h", "a a a a a a", "", "x z", "p q r s t u v w"]
    want = [jaccard(bag(x), bag(y)) for x, y in zip(a, b, strict=True)]
    assert np.allclose(bagminhash.similarities(a, b), want)


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_all_pairs(spark, seed):
    rows = corpus(random.Random(seed))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id) for r in bagminhash.near_duplicates(df).collect())
    assert got == sorted(brute_classes(rows))


def test_links_between_members_that_the_centre_misses(spark):
    """A chain: neighbours are similar, its ends are not, so no single centre links all."""
    rng = random.Random(5)
    words = paragraphs(rng, 6, 2).split(" ")
    rows = []
    for i in range(14):
        rows.append((i, " ".join(words)))
        words = list(words)
        words[8 * i % len(words)] = f"new{i}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.class_id for r in bagminhash.near_duplicates(df).collect()} == {c for _, c in brute_classes(rows)}


def test_defined_cases(spark, odd_docs, odd_rows, empty_docs):
    got = sorted(((r.doc_id, r.class_id) for r in bagminhash.near_duplicates(odd_docs).collect()), key=order)
    assert got == sorted(brute_classes(odd_rows), key=order)
    kept = bagminhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(order([r.doc_id for r in kept.collect()]))
    assert ids == sorted({c for _, c in brute_classes(odd_rows)})
    assert bagminhash.near_duplicates(empty_docs).collect() == []
    assert bagminhash.keep_one(empty_docs).collect() == []


def test_large_group_of_copies_is_not_expanded(spark):
    rng = random.Random(9)
    text = paragraphs(rng)
    df = spark.createDataFrame([(i, text) for i in range(3000)], "doc_id long, text string")
    got = bagminhash.near_duplicates(df).collect()
    assert {r.class_id for r in got} == {0} and sum(r.kept for r in got) == 1
