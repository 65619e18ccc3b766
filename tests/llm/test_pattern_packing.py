import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from skuflow.llm import pattern_packing
from skuflow.llm.pattern_packing import Ids, Pattern, Places, best_fit, pack_documents, plan
from tests.llm.conftest import paragraphs

COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


TOKENIZER = Tokenizer.from_file(pattern_packing.default_vocabulary())


def encoded(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def want_pieces(rows, capacity):
    out = []
    for i, text in rows:
        ids = np.array(encoded(text), dtype="<u4")
        first = len(ids) % capacity or capacity
        edges = [0, *range(first, len(ids) + 1, capacity)]
        out += [(i, n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return out


def check(rows, out, capacity):
    got = [tuple(r) for r in out.collect()]
    assert out.columns == COLUMNS
    key = lambda r: (r[0] is None, r)
    assert sorted((r[:5] for r in got), key=key) == sorted(want_pieces(rows, capacity), key=key)
    held = {}
    for r in got:
        held.setdefault(r[5], []).append((r[6], r[3]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), sum(r[3] for r in got)


def test_whole_corpus(spark):
    rng = random.Random(8)
    rows = [(i, paragraphs(rng, rng.randint(0, 9), rng.randint(1, 3))) for i in range(300)]
    rows += [(500 + i, rows[7][1]) for i in range(200)] + [(800, paragraphs(rng, 90, 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sequences, tokens = check(rows, pack_documents(df), 2048)
    assert sequences <= 1.01 * tokens / 2048 + 1
    sequences, tokens = check(rows, pack_documents(df, 300), 300)
    assert sequences <= 1.03 * tokens / 300 + 1


def test_odd_and_empty_tables(spark, odd_docs, odd_rows, empty_docs):
    check(odd_rows, pack_documents(odd_docs), 2048)
    none = pack_documents(empty_docs)
    assert none.columns == COLUMNS and none.count() == 0
    texts = spark.createDataFrame([("a", "x y"), (None, "z")], "doc_id string, text string")
    assert sorted(r.doc_id or "" for r in pack_documents(texts).collect()) == ["", "a"]


def test_ids_equal_the_library():
    rng = random.Random(9)
    ids = Ids(pattern_packing.default_vocabulary(), pattern_packing.default_ranks())
    pool = [chr(c) for c in range(0x250)] + list("  \n\n\t'st'll…“”–’ 　\xa0中한😀") + ["<|endoftext|>"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    assert [ids.encode(t) for t in texts] == [np.array(encoded(t)[:-1], "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("name", ["mixed", "short", "long", "one length", "sparse", "full"])
def test_plans_hold_every_piece(name):
    rng = np.random.default_rng(4)
    lengths = {"mixed": rng.gamma(1.2, 600, 20_000).astype(int) % 2048 + 1, "short": rng.integers(1, 60, 30_000),
               "long": rng.integers(900, 2048, 4000), "one length": np.full(1000, 700), "sparse": np.array([1500, 600, 548] * 50),
               "full": np.full(9, 2048)}[name]
    patterns, held = plan(dict(Counter(lengths.tolist()))), Counter()
    for p in patterns:
        assert p.repeats > 0 and sum(a * n for a, n in p.runs) <= 2048
        for a, n in p.runs:
            held[a] += n * p.repeats
    assert held == Counter(lengths.tolist())
    left = np.bincount(lengths, minlength=2049)
    least = max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum()))
    used, greedy = sum(p.repeats for p in patterns), sum(p.repeats for p in best_fit(left, 2048))
    assert used <= (1.002 * least + 2 if name in ("mixed", "short", "sparse", "full") else 1.002 * greedy + 1)


def test_places_of_equal_pieces():
    places = Places([Pattern(((3, 2), (2, 1)), 2), Pattern(((3, 1),), 1)])
    sequence, offset = places.of(np.array([3, 3, 3, 3, 3, 2, 2]), np.array([4, 0, 1, 2, 3, 1, 0]))
    assert sequence.tolist() == [2, 0, 0, 1, 1, 1, 0] and offset.tolist() == [0, 0, 3, 0, 3, 6, 6]
    assert places.sequences == 3
