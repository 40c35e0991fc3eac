import pytest

LONG = " ".join(f"word{i % 700} of the long text{i}" for i in range(6000))
PROSE = "The river was of great use to the town, and in spring it rose over the fields of barley that lay below the mill. "


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (0, None, "en", "a"), (1, "", "en", "a"), (2, " \n\t ", None, None), (3, "one", "en", "a"), (4, "ONE", "en", "a"), (5, "one two", "en", "b"), (6, "one two three", "en", "b"), (7, LONG, "en", "b"),
        (8, LONG + " end", "en", "b"), (9, PROSE * 3, "en", "a"), (9, PROSE * 3, "en", "a"), (10, PROSE * 3 + "extra words", "en", "a"), (12, "ÄÖ ünï 漢字 ✨ tail", "de", "c"), (14, PROSE + "Quite another ending here.", "en", "c"),
        (None, "no id at all", "en", "a"), (16, "a <|im_end|> \\ <\\| b", "en", "a"), (17, "the and of the and of the and of", "en", "a"),
    ]
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = {c: F.lit(-1) for c in ("n_words", "score", "ids", "n", "row", "host", "bucket", "sigs", "n_chars")}
    return docs.withColumns(clash)


@pytest.fixture(scope="session")
def nothing(spark, awkward):
    return spark.createDataFrame([], awkward.schema)


