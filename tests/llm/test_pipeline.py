"""The pipeline's stages on a small corpus, against plain Python versions of each."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from skuflow.llm import mixing, piece_codec, unit_dedup
from skuflow.llm.common import STAGED
from tests.llm.conftest import paragraphs
from tests.llm.test_bagminhash import brute_classes
from tests.llm.test_mixing import brute_targets, size
from tests.llm.test_pu_quality import junk
from tests.llm.test_unit_dedup import check_removed, spans_of


def corpus(folder, spark):
    rng = random.Random(11)
    rows, labels = [], []
    passage = paragraphs(rng, 2, 3)
    for i in range(260):
        text, good = paragraphs(rng, 4, 1), int(rng.random() > 0.15)
        if i % 20 == 3 and good:
            text = text + "\n" + passage
        if i % 15 == 7 and rows:
            words = rows[rng.randrange(len(rows))][1].split(" ")
            words[rng.randrange(len(words))] = "changed"
            text, good = " ".join(words), None
        rows.append((i, text if good in (1, None) else junk(rng, text), "en", f"s{i % 4}", 0))
        if good is not None and rng.random() < 0.7:
            labels.append((i, good, 0))
    rows.append((900, "", "en", None, 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def rows_of(df):
    return sorted((r.doc_id, r.text, r.source) for r in df.collect())


def test_stages_against_plain_versions(spark, tmp_path):
    corpus(str(tmp_path), spark)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "source_mix", "token_ids"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns

    good = stages["quality"](spark, docs, str(tmp_path)).cache()
    assert good.columns == columns and 0 < good.count() < docs.count()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{tmp_path}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert sum(i in kept for i, q in truth.items() if q) / sum(truth.values()) > 0.97

    single = stages["near_duplicates"](spark, good, str(tmp_path)).cache()
    assert single.columns == columns
    classes = brute_classes([(i, t) for i, t, _ in rows_of(good)])
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, c in classes}) and single.count() < good.count()

    short = stages["repeated_passages"](spark, single, str(tmp_path)).cache()
    assert short.columns == columns
    before = [(i, t) for i, t, _ in rows_of(single)]
    spans, want = dict(spans_of(unit_dedup.remove_repeats(single, whole_lines=True))), {}
    assert check_removed(before, spans, True) > 100
    for i, t in before:
        for a, b in reversed(spans[i]):
            t = t[:a] + t[b:]
        want[i] = t
    assert {r.doc_id: r.text for r in short.collect()} == want and any(spans.values())
    assert all(r.n_chars == len(r.text) for r in short.collect())

    mixed = stages["source_mix"](spark, short, str(tmp_path)).cache()
    assert mixed.columns == columns
    sizes = {}
    for _, t, s in rows_of(short):
        sizes[s] = sizes.get(s, 0) + size(t)
    targets, copies = brute_targets(sizes), {}
    for i, _, s in rows_of(short):
        rate = targets[s] / sizes[s] if sizes[s] else 0
        u = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2 ** 52
        copies[i] = int(rate) + (u < rate - int(rate))
    taken = {}
    for i, _, _ in rows_of(mixed):
        taken[i] = taken.get(i, 0) + 1
    assert taken == {i: n for i, n in copies.items() if n}

    coded = stages["token_ids"](spark, mixed, str(tmp_path))
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    want = sorted((i, hashlib.sha256(np.asarray(library.encode(t, add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest())
                  for i, t, _ in rows_of(mixed))
    assert sorted((r.doc_id, r.ids_sha256) for r in coded.collect()) == want

    before = len(STAGED)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert len(STAGED) == before + 1 and "pipeline-token_ids" in STAGED[-1]  # all other folders are gone
    assert sorted((r.doc_id, r.ids_sha256) for r in whole.collect()) == want


def test_stages_on_odd_and_empty_tables(spark, tmp_path, odd_docs, empty_docs):
    odd_docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    empty_docs.write.parquet(f"{tmp_path}/none/documents.parquet")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd_docs), ("none", empty_docs)):
        labels.limit(3 if name == "odd" else 0).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, f"{tmp_path}/{name}")
            assert out.columns == docs.columns
            assert name == "odd" or out.count() == 0
            out.collect()
        run = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert name == "odd" or run.count() == 0


def test_registered_names():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_columns_named_like_those_inside_keep_their_values(spark, odd_docs):
    names = ["_key", "_row", "_kept", "_kept_id", "_kept_key", "whole", "row", "_mix_source", "_mix_rate", "_mix_copy", "rate", "draw", "of",
             "copies", "_text", "_rank", "removed", "_0", "_1", "first"]
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(f"mine {n}").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"mine {n}" for r in rows for n in names), name
