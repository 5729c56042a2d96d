import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and is stone river light green house under winter paper silver morning ocean garden window letter music bridge".split()


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns of clashing names."""
    long = words(1, 60_000)
    rows = [
        (1, words(2, 80), "en", "a", 1), (2, words(2, 80), "en", "b", 1), (3, None, "en", "a", None), (4, "", None, None, 0), (5, long, "en", "a", 9), (6, "x", "en", "b", 1),
        (7, "é日本😀 \x00 tab\tend", "fr", "b", 3), (7, words(3, 50), "fr", "b", 3), (8, words(4, 40), "de", "c", 2), (8, words(4, 40), "de", "c", 2), (None, words(5, 40), "de", "c", 2), (9, "   \n\n ", "de", "c", 5),
        (10, "<|endoftext|> a<|endoftext|>", "de", "c", 5), (11, words(2, 40) + " " + words(6, 40), "en", "a", 1),
    ]
    extra = [(*r, b"k", 1, "x", "y", 3) for r in rows]
    return spark.createDataFrame(extra, DOCUMENTS + ", node binary, bucket int, key string, root string, copies int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
