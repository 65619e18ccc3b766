import hashlib
import random
from collections import defaultdict

from skuflow.llm import sharding
from tests.llm.conftest import sentence


def brute(rows, limit):
    """Depth-first splitting of buckets of distinct records; ``{(id, text): bits}``."""
    items = defaultdict(int)
    for r in rows:
        items[r] += 1
    size = {r: len((r[1] or "").encode()) for r in items}

    def bits(r):
        text = "null" if r[1] is None else hashlib.md5(r[1].encode()).hexdigest()
        key = f"{'null' if r[0] is None else r[0]}|{text}"
        return bin(int(hashlib.md5(key.encode()).hexdigest()[:15], 16))[2:].zfill(60)

    out = {}

    def split(members, depth):
        if sum(size[r] * items[r] for r in members) <= limit or len(members) == 1:
            out.update({r: members and bits(members[0])[:depth] for r in members})
            return
        for b in "01":
            part = [r for r in members if bits(r)[depth] == b]
            if part:
                split(part, depth + 1)

    split(list(items), 0)
    return out


def test_shards_equal_recursive_splitting(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, rng.randint(1, 60))) for i in range(700)] + [(5000, "x" * 9000), (5001, None), (None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (1 << 30, 20_000, 1500):
        want = brute(rows, limit)
        got = sharding.assign_shards(df, limit=limit, step=4).collect()
        assert sorted((r.doc_id or -1, r.shard) for r in got) == sorted((i or -1, s) for (i, _), s in want.items())
        per_shard = defaultdict(int)
        for r in got:
            per_shard[r.shard] += r.n_bytes
            assert r.depth == len(r.shard)
        assert all(per_shard[r.shard] == r.shard_bytes for r in got)
        alone = {r.shard for r in got if r.n_bytes > limit}
        assert all(b <= limit or s in alone for s, b in per_shard.items())


def test_repeats_of_one_record_overflow_into_bounded_shards(spark):
    rows = [(1, "z" * 100)] * 950 + [(i, "w" * 50) for i in range(2, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    per_shard = defaultdict(int)
    got = sharding.assign_shards(df, limit=1000).collect()
    for r in got:
        per_shard[r.shard] += r.n_bytes
    assert len(got) == len(rows) and max(per_shard.values()) <= 1000
    assert sum("." in s for s in per_shard) == 95


def test_written_folders_hold_every_record(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, sentence(rng, 20)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sharding.write_shards(df, f"{tmp_path}/shards", limit=4000)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted((r.doc_id, r.text) for r in back.collect()) == rows
    assert len([p for p in (tmp_path / "shards").iterdir() if p.name.startswith("shard=p")]) > 3


def test_defined_cases(odd_docs, odd_rows, empty_docs):
    got = sharding.assign_shards(odd_docs, limit=10_000).collect()
    assert len(got) == len(odd_rows)
    assert sharding.assign_shards(empty_docs).collect() == []


def test_written_rows_equal_input_rows_with_repeats(spark, tmp_path):
    rows = [(1, "z" * 100, f"s{i % 3}", i) for i in range(400)] + [(i, "w" * 50, "s", i) for i in range(2, 60)]
    rows += [(7, None, "n", 1), (7, None, "n", 1), (None, "y", None, 2), (None, "y", None, 2), (8, "", "e", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, h long").repartition(5)
    sharding.write_shards(df, f"{tmp_path}/shards", limit=1000)
    back = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert sorted(map(repr, rows)) == sorted(repr((r.doc_id, r.text, r.source, r.h)) for r in back)
    written, size = defaultdict(int), defaultdict(int)
    for r in back:
        written[r.shard, r.doc_id] += 1
        size[r.shard] += len(r.text or "")
    assigned = defaultdict(int)
    for r in sharding.assign_shards(df, limit=1000).collect():
        assigned["p" + r.shard, r.doc_id] += 1
    assert written == assigned and max(size.values()) <= 1000 and sum("." in s for s in size) == 40


def test_written_rows_of_odd_tables(spark, odd_docs, odd_rows, empty_docs, tmp_path):
    sharding.write_shards(odd_docs, f"{tmp_path}/odd", limit=10_000)
    back = spark.read.parquet(f"{tmp_path}/odd")
    assert back.columns == [*odd_docs.columns, "shard"]
    assert sorted(repr((r.doc_id, r.text)) for r in back.collect()) == sorted(map(repr, odd_rows))
    sharding.write_shards(empty_docs, f"{tmp_path}/none")
