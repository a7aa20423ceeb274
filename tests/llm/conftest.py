import pytest

#: Rows that every operator must bear: nulls, empty and blank texts, ties, repeats, odd white space, long text.
LONG = "long words go on and on here. " * 3000
ROWS = [
    (1, "One two three four five six seven. Then more words follow.\nA second line of it.", "en", "a", 80),
    (2, "One two three four five six seven. Then more words follow.\nA second line of it.", "en", "b", 80),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (5, "  \n\t ", "de", "a", 5),
    (6, "word", "fr", None, 4),
    (7, LONG, "en", "c", len(LONG)),
    (8, "Ünï códe 日本 text 😀 with\n\nblank  lines \n", "xx", "b", 1),
    (None, "A text without an id stands here for all to see.", "en", "a", 9),
    (9, "same row", "en", "a", 8),
    (9, "same row", "en", "a", 8),
    (10, "### $$$ *** |\n| a | b |\n### $$$", "en", "d", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators might use inside.
CLASHING = ["size", "row", "key", "id", "queue", "part_id", "digest", "n", "score", "block", "found", "row_key", "base", "place"]


@pytest.fixture(scope="session")
def docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit(f"{c}!").alias(c) for c in CLASHING]).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def write(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
