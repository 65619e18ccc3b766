import hashlib
import random

from pyspark.sql import functions as F

from skuflow.llm import fingerprints
from tests.llm.conftest import paragraphs


def blocks(text, n=fingerprints.BLOCK_WORDS):
    """Paragraphs, cut every n words (words of up to 200 characters)."""
    out = set()
    for line in text.split("\n"):
        words = [w[i:i + 200] for w in line.split() for i in range(0, len(w), 200)]
        out |= {tuple(words[i:i + n]) for i in range(0, len(words), n)}
    return out


def likeness(a, b):
    a, b = blocks(a), blocks(b)
    return 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0


def edited(text, following):
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def test_peeling_recovers_the_difference(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        both = [rng.getrandbits(63) for _ in range(rng.choice([0, 3, 40, 200]))]
        a = [rng.getrandbits(63) for _ in range(rng.choice([0, 1, 5, 30, 120]))]
        b = [rng.getrandbits(63) for _ in range(rng.choice([0, 1, 5, 30, 120]))]
        rows.append((i, both + a, b + both, sorted(a), sorted(b)))
    df = spark.createDataFrame(rows, "i int, a array<long>, b array<long>, x array<long>, y array<long>")
    long = df.select(F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda x: F.xxhash64(x)).alias("a"),
                     F.transform(F.sequence(F.lit(2001), F.lit(6000)), lambda x: F.xxhash64(x)).alias("b")).limit(1)
    assert fingerprints.with_difference(long, "a", "b", "d").select(F.size("d")).first()[0] == 4000
    for r in fingerprints.with_difference(df, "a", "b", "d").collect():
        assert r.d is not None
        assert sorted(d.d for d in r.d if d.sign == 1) == r.x and sorted(d.d for d in r.d if d.sign == -1) == r.y


def test_a_sketch_that_is_too_small_fails_and_a_larger_one_succeeds(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([([rng.getrandbits(63) for _ in range(300)], [rng.getrandbits(63) for _ in range(300)])],
                               "a array<long>, b array<long>")
    both = fingerprints.with_difference(df, "a", "b", "tight", (100,))
    row = fingerprints.with_difference(both, "a", "b", "again", (100, 8, 4, 2, 1)).first()
    assert row.tight is None and len(row.again) == 600


def test_versions_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i * 3, paragraphs(rng, rng.randint(1, 9), rng.randint(1, 4))) for i in range(90)]
    rows += [(1000, rows[5][1]), (1001, rows[5][1]), (1002, ""), (1003, "é中😀" * 5)]
    rows.append((1004, paragraphs(rng, 300, 4)))
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in fingerprints.compare_versions(df).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        e = edited(t, following)
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert abs(got[i].near_edited - likeness(t, e)) < 1e-12 and abs(got[i].near_next - likeness(t, following)) < 1e-12
    assert got[1000].fingerprint == got[1001].fingerprint and got[1000].near_next == 1.0
    assert got[0].fingerprint != got[3].fingerprint


def test_ranges_of_any_size_give_the_same_successors(spark):
    rng = random.Random(4)
    rows = [(rng.randint(-10 ** 12, 10 ** 12), f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows)
    want = {i: n for (i, _), (_, n) in zip(order, order[1:] + order[:1], strict=True)}
    for size in (1, 7, 1000):
        got = fingerprints.with_next(df, rows_per_range=size).select("id", "next_text").collect()
        assert {r.id: r.next_text for r in got} == want
    one = spark.createDataFrame([(5, "a b")], "doc_id long, text string")
    assert fingerprints.with_next(one).first().next_text == "a b"


def test_defined_cases(odd_docs, odd_rows, empty_docs):
    rows = fingerprints.compare_versions(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r.fingerprint, 0)
    plain = [r for r in rows if r.doc_id in (1, 2)]
    assert len({r.fingerprint for r in plain}) == 1 and {r.near_next for r in plain if r.doc_id == 1} == {1.0}
    loose = [r for r in rows if r.doc_id is None and r.n_chars]
    assert all(r.near_next == 0 for r in loose)
    assert fingerprints.compare_versions(empty_docs).collect() == []
