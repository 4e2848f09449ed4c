import random

import pytest

ODD = "doc_id long, text string, lang string, source string, n_chars long, anchor string, run int, ids string, block int, slot int, _id int, digest string, media string, score double, n_tokens int, word string, a int, b int, key string, payload string"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names operators use."""
    rng = random.Random(1)
    base, passage = prose(rng, 120), prose(rng, 60)
    near = base.split()
    near[7], near[50] = "changed", "words"
    rows = [
        (1, base, "en", "s1"), (2, base, "en", "s1"), (3, " ".join(near), "de", None), (3, " ".join(near), "de", None), (None, "null id " + prose(rng, 60), None, "s2"),
        (None, None, None, None), (4, None, "en", "s1"), (5, "", "en", "s1"), (6, " \n\t ", "fr", "s3"), (7, prose(rng, 30000, 5000), "en", "s1"),
        (8, prose(rng, 40) + " " + passage + " " + prose(rng, 33), "en", "s2"), (9, prose(rng, 20) + "\n" + passage + " é ü " + prose(rng, 25), "en", "s2"),
        (10, "x " * 300, "en", "s1"), (11, "one", "en", "s1"), (12, " 中文 \x85 🎉 " + prose(rng, 80), "zh", "s1"), (13, "y" * 5000, "en", "s3"),
        (14, "# * $ % & | < > ## a\nb\na\nb\n" + prose(rng, 55), "en", "s1"),
    ]
    full = [(i, t, lang, source, len(t) if t else None, "x", 1, "i", 2, 3, 4, "d", "m", 0.5, 6, "w", 1, 2, "k", "p") for i, t, lang, source in rows]
    return spark.createDataFrame(full, ODD).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], ODD)
