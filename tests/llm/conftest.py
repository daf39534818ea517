import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty and long texts, ties, repeated rows and clashing column names."""
    words = "the small house stands by the river and its owner paints the door green every single spring morning"
    rows = [
        (1, words, "en", "a", 1), (2, words, "en", "b", 2), (2, words, "en", "b", 2), (3, None, "en", "a", 3),
        (4, "", None, "c", 4), (5, " \n\t ", "de", None, 5), (None, words + " twice", "en", "a", 6),
        (6, LONG, "de", "c", 7), (7, "...!!! 12", None, None, None), (8, "Straße é İ ñ ﬁ 你好 ́x", "de", "a", 8),
        (9, "one<|endoftext|>two <|startoftext|> Three", "en", "b", 9), (None, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for clash in ("_text", "key", "score", "n_tokens", "ids", "_row", "_key", "_removed", "fp", "word", "kept", "matches", "label"):
        frame = frame.withColumn(clash, frame["n_chars"].cast("string"))
    return frame


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
