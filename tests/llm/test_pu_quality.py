import random
import zlib

import numpy as np
import pytest

from skuflow.llm import pu_quality
from tests.llm.conftest import paragraphs


def junk(rng, text):
    kind = rng.randint(0, 2)
    words = text.split(" ")
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 1:
        return " | ".join(words)
    return " ".join(w for w in words for _ in range(12))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        text, good = paragraphs(rng, 3, 1), int(i % 6 != 0)
        rows.append((i, text if good else junk(rng, text)))
        if rng.random() < 0.7:
            labels.append((i, good))
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int"), {i: int(i % 6 != 0) for i in range(900)})


def test_folds_follow_the_crc(spark):
    df = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long")
    got = {r[0]: r[1] for r in df.select("doc_id", pu_quality.held_out(df.doc_id)).collect()}
    assert got == {i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in [*range(50), None]}


def test_held_out_rows_are_told_apart(labelled):
    docs, labels, truth = labelled
    model = pu_quality.fit(docs, labels)
    rows = [r for r in pu_quality.score(docs, model).collect() if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in rows) / len(rows) > 0.95
    good = [r for r in rows if truth[r.doc_id]]
    assert sum(r.predicted for r in good) / len(good) > 0.98
    assert 0.7 < model.prior < 0.9


def test_risk_learns_without_negatives():
    rng = np.random.default_rng(1)
    positive = rng.normal(0, 1, (2000, 3))
    unlabelled = np.concatenate([rng.normal(0, 1, (1400, 3)), rng.normal(4, 1, (600, 3))])
    model = pu_quality.fit_nonnegative_pu(positive, unlabelled, 0.7)
    scores = model.score(unlabelled)
    assert (scores[:1400] >= 0.5).mean() > 0.95 and (scores[1400:] < 0.5).mean() > 0.95


def test_prior_where_only_positives_are_labelled(labelled):
    docs, labels, truth = labelled
    model = pu_quality.fit(docs, labels.where("quality = 1"))
    assert 0.65 < model.prior < 0.95
    rows = [r for r in pu_quality.score(docs, model).collect() if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in rows) / len(rows) > 0.9


def test_labels_of_held_out_rows_are_not_used(spark, labelled):
    from pyspark.sql import functions as F

    docs, labels, _ = labelled
    flipped = labels.withColumn("quality", F.when(
        pu_quality.held_out(labels.doc_id), 1 - labels.quality).otherwise(labels.quality).cast("int"))
    a, b = pu_quality.fit(docs, labels), pu_quality.fit(docs, flipped)
    assert np.allclose(a.weights, b.weights) and a.prior == b.prior


def test_statistics_of_counted_cases():
    import pyarrow as pa

    rows = pu_quality.text_statistics(pa.array(["AB ab\n!! 12", "", None, "a a a b"]))
    f = {n: rows[:, i] for i, n in enumerate(pu_quality.FEATURES)}
    assert np.isclose(f["upper"][0], 2 / 11) and np.isclose(f["digit"][0], 2 / 11) and np.isclose(f["bang"][0], 2 / 11)
    assert np.isclose(f["repeat_next"][3], 2 / 4) and np.isclose(f["distinct_pairs"][3], 2 / 3)
    assert not rows[1].any() or np.isclose(rows[1], rows[2]).all()
    assert np.isclose(f["words"], np.log1p([4, 0, 0, 4])).all()


def test_defined_cases(odd_docs, empty_docs, labelled):
    docs, labels, _ = labelled
    model = pu_quality.fit(docs, labels)
    rows = pu_quality.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert pu_quality.score(empty_docs, model).collect() == []
    none = pu_quality.fit(docs, labels.where("quality = 0"))
    assert none is None
    assert {(r.score, r.predicted) for r in pu_quality.score(odd_docs, none).collect()} == {(0.5, 1)}
    assert pu_quality.fit(empty_docs, labels) is None
    kept = pu_quality.keep_good(odd_docs, none)
    assert kept.schema.names == odd_docs.schema.names and kept.count() == odd_docs.count()
