import hashlib
import random
import zlib

import duckdb
import pytest

from skuflow.llm import prefix_trie
from skuflow.llm.prefix_trie import nodes, rebuilt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """All prefixes of all rebuilt conversations in a dictionary."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h, head = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = own.get(head, [])[:h] + own[c][h:]
    found, kids = {}, {}
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            found.setdefault(tuple(whole[c][:d]), []).append(c)
    for p in found:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(found, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in kids.get(p, [])) or 1
        saved[p] = sum(saved[q] for q in kids.get(p, [])) + ((len(found[p]) - 1) * len(p[-1][1]) if p else 0)
        ends = ",".join(str(c) for c in found[p] if len(whole[c]) == len(p))
        out.append((found[p][0], len(p), found[p[:-1]][0] if p else None, len(found[p]), len(kids.get(p, [])), leaves[p],
                    saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return ordered(out)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[2] is not None, r))


def corpus(rng):
    rows = []
    for c in rng.sample(range(-250, 900), 400):
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "ccc", "", None, "ññ😀"]))
                 for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 9]))]
        if rng.random() < 0.5:  # copies and common beginnings
            turns = [("user", "hello")] * 3 + turns[:rng.randint(0, 3)]
        numbers = rng.sample(range(50), len(turns))
        numbers[0] = None if rng.random() < 0.2 else numbers[0]
        rows += [(c, n, *t) for n, t in zip(numbers, turns, strict=True)]
    rows += [(1000 + i, i % 3, "user", "hello") for i in range(60)] + [(1100, t, "user", f"t{t}") for t in range(300)]
    rows += [(1100 + i, t, "user", f"t{t}") for i in range(1, 30) for t in range(300 - i)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("partitions", "shard"), [(3, 200_000), (11, 1), (7, 40)])
def test_equals_all_prefixes(spark, partitions, shard):
    rows = corpus(random.Random(6))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = nodes(rebuilt(df), partitions, shard)
    assert out.columns == COLUMNS
    assert ordered(out.collect()) == brute(rows)


def test_copies_over_many_shards(spark):
    rows = [(100 * c, t, "user", f"t{t}") for c in range(1, 300) for t in range(6)]
    got = nodes(rebuilt(spark.createDataFrame(rows, SCHEMA)), 9, 20)
    assert ordered(got.collect()) == brute(rows)


def test_without_turns_at_all(spark):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(c, 0, "user", "gone")]
    assert ordered(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows)


def test_odd_and_empty_tables(spark):
    rows = [(1, 0, "u", "a"), (1, 0, "u", "a"), (1, None, None, None), (None, 1, "u", "x"), (0, 5, "", ""), (0, 4, "u", "y" * 40_000)]
    df = spark.createDataFrame([(*r, 1, "k", b"p", 2) for r in rows], SCHEMA + ", depth int, key string, path binary, head int")
    assert ordered(prefix_trie.prefix_trie(df).collect()) == brute(rows)
    none = prefix_trie.prefix_trie(df.limit(0))
    assert none.columns == COLUMNS and none.count() == 0


def test_sql_equals_all_prefixes():
    rows = [r for r in corpus(random.Random(7)) if r[0] < 1100]
    seen = {}
    rows = [r for r in rows if seen.setdefault(r[:2], r) is r]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert ordered(con.execute(prefix_trie.ORACLE).fetchall()) == brute(rows)
