import random

import pytest

WORDS = "stone river light garden window paper music number market silver bridge morning winter circle letter".split()


def sentence(rng, n=12):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(n)).capitalize() + "."


def paragraphs(rng, lines=4, sentences=2):
    return "\n".join(" ".join(sentence(rng) for _ in range(sentences)) for _ in range(lines))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a very long one, repeated rows, equal texts, marks and control characters."""
    rng = random.Random(1)
    plain = paragraphs(rng)
    return [
        (1, plain), (2, plain), (2, plain), (None, plain), (3, ""), (4, None), (5, "  \n\t "), (None, None), (None, ""),
        (6, "one"), (7, " lead  double   spaces \n and end "), (8, "▁mark ▁▁two"), (9, "emoji 😀 ñandú ß 中文字 \x00 end"),
        (10, paragraphs(rng, 400, 4)), (11, "x" * 50_000), (12, paragraphs(rng)), (13, paragraphs(rng)),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows with further columns whose names clash with those that operators use inside."""
    schema = ("doc_id long, text string, lang string, source string, n_chars long, id long, label string, score double, "
              "rank int, bag string, held_out boolean, size int, `drop` string, h long, key string, weight int")
    return spark.createDataFrame(
        [(i, t, "en", None if i is None else f"s{i % 3}", 0, 7, "x", 0.5, 1, "b", True, 3, "d", 9, "k", 2)
         for i, t in odd_rows], schema)


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.limit(0)
