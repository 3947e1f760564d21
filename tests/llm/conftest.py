import random

import pytest

from waybill.llm.common import bounded_batches


def random_text(rng: random.Random, n: int, letters: str = "abcdé \n") -> str:
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.fixture(params=[3, 2000], ids=["small-batches", "large-batches"])
def batches(spark, request):
    bounded_batches(spark, request.param)
    yield request.param
    bounded_batches(spark)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, repeated rows, one id with two texts."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(9_000))
    plain = "The quick brown fox walked over the old bridge and looked at the water below for a while. " * 3
    return [
        (1, plain, "en", "a"), (1, plain, "en", "a"), (2, None, "en", None), (3, "", None, "b"), (4, long, "en", "a"),
        (None, "a text without an id that has some twenty words in it so that rules can be asked about it at all, more "
               "or less", None, None),
        (5, "other text", "de", "b"), (5, "second text of five", "de", "b"), (6, " \n\t ", "de", "b"), (None, None, None, None),
        (7, plain + "one more", "en", "a"), (8, long + " tail", "en", "a"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    schema = "doc_id bigint, text string, lang string, source string"
    return spark.createDataFrame(odd_rows, schema).selectExpr(
        "*", "lang AS id", "source AS row", "1 AS n_words", "'x' AS label", "2.0 AS kept").repartition(3)
