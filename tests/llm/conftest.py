import pytest

#: Two long passages for texts that share parts.
A = " ".join(f"alpha{i} beta{i % 17} gamma{i % 5}" for i in range(60))
B = " ".join(f"delta{i} epsilon{i % 13} zeta{i % 7}" for i in range(60))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns with clashing names."""
    rows = [
        (1, A, "en", "s1", 5, "x"),
        (2, A, "en", "s1", 5, "x"),
        (3, A + " and one more word", "en", None, 5, None),
        (4, B, None, "s2", None, "y"),
        (5, "", "de", "s2", 0, "y"),
        (6, None, "de", "s2", None, "y"),
        (None, B, "fr", "s3", 1, "z"),
        (None, None, None, None, None, None),
        (7, B + " " + A, "fr", "s3", 1, "z"),
        (7, B + " " + A, "fr", "s3", 1, "z"),
        (8, "é漢🙂 \t\n  \x0b x", "zh", "s3", 1, "z"),
        (9, "word " * 30000, "en", "s1", 1, "z"),
        (10, " \n\t ", "en", "s1", 1, "z"),
        (11, "one two three", "en", "s1", 1, "z"),
        (12, "ONE! TWO!! # $ % & | < > " * 8, "en", "s1", 1, "z"),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string"
    df = spark.createDataFrame(rows, schema)
    for name in ("label", "node", "id", "copies", "block", "score", "kept", "_place", "rule"):
        df = df.withColumn(name, df["size"])
    return df


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, 1, 1), (9, 0, 0), (12, 0, None), (5, None, 0), (None, 1, 0), (99, 0, 0), (7, 1, 0), (7, 1, 0)], "doc_id bigint, quality int, toxic int")
