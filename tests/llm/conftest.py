import json

import pytest

LONG = "lorem ipsum dolor sit amet " * 4000


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing extra columns."""
    rows = [
        (1, "The cat sat on the mat. It was warm there. Nobody saw it at all.", "en", "a", 10),
        (2, " The cat sat\ton the mat. It was warm there.\n Nobody saw it at all.", "en", "a", 11),
        (2, " The cat sat\ton the mat. It was warm there.\n Nobody saw it at all.", "en", "a", 11),
        (3, None, "en", "b", None),
        (4, "", None, "b", 0),
        (5, " \n\t ", "de", None, 4),
        (None, "a text without a number", "en", "c", 3),
        (None, "a text without a number", "en", "c", 3),
        (6, LONG, "fr", "d", len(LONG)),
        (7, LONG + "x", "fr", "d", None),
        (8, "ÄÖÜ 中文 😀 don't 'tis", "de", "d", 5),
        (9, "one", None, None, None),
        (10, "THE CAT sat on the mat. It was warm there. Nobody saw it at all.", "en", "a", 10),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["key", "id", "row", "sha", "block", "slot", "label", "kept", "span", "band", "bits", "copy", "size", "digest"]
    return df.selectExpr("*", *(f"'x' AS {c}" for c in clash))


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("1 = 0")


@pytest.fixture(scope="session")
def texts():
    """Rows of a frame as plain tuples, order-free."""

    def rows(df):
        return sorted((tuple(r) for r in df.collect()), key=lambda r: json.dumps(r, default=str))

    return rows
