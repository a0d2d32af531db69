import pytest

from .samples import words

#: Extra columns that have the names of results and of helper columns.
CLASHING = ("n_words", "kept", "score", "size", "fp", "n_lines", "id", "t", "copies", "length", "labels")


def odd_rows() -> list[tuple]:
    """(doc_id, text, lang, source): nulls, empty and long texts, copies, repeated rows, ties."""
    passage = words(1, 60)
    long = words(2, 9000)
    shared = "\n".join(["A line that many share", "  a LINE that many share\t"])
    rows = [
        (1, None, "en", "a"),
        (2, "", None, "a"),
        (3, " \n\t ", "en", None),
        (4, long, "en", "a"),
        (5, long, "en", "b"),
        (6, f"{words(3, 50)} {passage} {words(4, 30)}", "en", "b"),
        (7, f"{words(5, 20)}\n{passage}\n{words(6, 70)}", None, "b"),
        (8, "Released under the MIT License.", "en", "c"),
        (8, "Released under the MIT License.", "en", "c"),
        (None, "no id, é ñ ü 東京 \U0001f600 ẖH̱ " + words(7, 40), "fr", "c"),
        (None, None, None, None),
        (9, "a " * 600, "en", "a"),
        (10, "x" * 3000, "en", "a"),
    ]
    rows += [(100 + i, f"{shared}\n{words(50 + i, 25)}", "en", "d") for i in range(11)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    schema = "doc_id bigint, text string, lang string, source string"
    return spark.createDataFrame(odd_rows(), schema).repartition(3)


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.withColumns({name: F.lit("other") for name in CLASHING})


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
