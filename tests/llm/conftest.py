import pytest

#: Columns whose names the operators use for themselves.
CLASHING = ["score", "kept", "size", "target", "taken", "key", "listed", "passages", "evidence", "email", "phone", "rejected", "lang_pred", "h", "s", "node", "row", "at", "n_words", "ranges"]


def passage(n):
    """n different words."""
    w = "the quick brown fox jumps over lazy dog and runs away from old grey wolf near river bank".split()
    return " ".join(w[i % 18] + w[(i * 5 + i // 18) % 18] for i in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, ties, and columns with clashing names."""
    base = "the quick brown fox jumps over the lazy dog and runs away from the old grey wolf near the river bank"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base + " today", None, None), (4, None, "en", "b"), (5, "", None, None), (6, " \t\n ", "en", "b"),
        (None, base, "en", "a"), (None, None, None, None), (7, "one", "en", "a"), (8, "one two", "en", "b"), (9, " ".join(f"w{i % 977}" for i in range(30000)), "xx", "c"),
        (10, "é " * 60 + "café mail me at a.b@c.org or +49 30 1234567, 10.0.0.1", "fr", "c"), (2, "another text under the same id", "en", "a"), (11, "12345 67890", "en", "b"),
    ]
    rows += [(100 + i, passage(80) + f" tail{i}", "en", "a") for i in range(6)]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return frame.withColumns({name: F.lit("x") for name in CLASHING}).repartition(4)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
