import hashlib

import numpy as np
import pytest

from skuflow.llm import piece_codec


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())


def expected(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return ids, library.decode(ids)


def test_ids_and_text_equal_the_library(spark, library, odd_docs, odd_rows):
    coded = piece_codec.decode(piece_codec.encode(odd_docs)).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids), r.decoded) for r in coded)
    want = []
    for i, t in odd_rows:
        ids, back = expected(library, t)
        want.append((i is None, i or 0, np.asarray(ids, "<u4").tobytes(), back))
    assert got == sorted(want)
    once = piece_codec.round_trip(odd_docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids), r.decoded) for r in once) == sorted(want)


def test_a_full_table_starts_afresh_with_equal_ids(library):
    texts = [f"word{i} and word{i + 1}  more" for i in range(300)]
    small, large = piece_codec.ChunkTable(piece_codec.default_model(), 10), piece_codec.ChunkTable(piece_codec.default_model())
    got = [b for t in texts for b in small.encode([t])]
    assert got == large.encode(texts)
    assert got[7] == np.asarray(expected(library, texts[7])[0], "<u4").tobytes()


def test_model_without_the_property_is_encoded_whole(library):
    table = piece_codec.ChunkTable(piece_codec.default_model())
    assert table.chunked
    table.chunked = False
    texts = ["a  b", "", " x"]
    assert table.encode(texts) == piece_codec.ChunkTable(piece_codec.default_model()).encode(texts)


def test_digests(spark, library):
    df = spark.createDataFrame([(1, "hello  world"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in piece_codec.digests(piece_codec.decode(piece_codec.encode(df))).collect()}
    ids, back = expected(library, "hello  world")
    assert rows[1].n_tokens == len(ids) and rows[2].n_tokens == 2
    assert rows[1].ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
    assert rows[1].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_empty_table(empty_docs):
    assert piece_codec.decode(piece_codec.encode(empty_docs)).collect() == []
