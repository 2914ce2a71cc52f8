import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns that clash with names the operators use themselves.
CLASH = "key long, cls long, spans string, component_id long, shard int, range int, f long, doc string, score double"

LONG = " ".join(f"word{i} and{i % 7} thing{i % 11}" for i in range(9_000))


def rows_of(texts, first=1):
    return [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts, first)]


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts (ids from 1) or from whole rows."""
    def make(items, schema=DOC_SCHEMA):
        rows = items if items and isinstance(items[0], tuple) else rows_of(items)
        return spark.createDataFrame(rows, schema)
    return make


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and clashing extra columns."""
    body = "the same plain sentence stands here again and again for the test of ties " * 6
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n ", "en", None, 4), (4, "one", None, "s", 3),
            (5, LONG, "en", "s", len(LONG)), (6, body, "en", "s", len(body)), (7, body, "en", "s", len(body)),
            (8, body + "tail", "en", "s", len(body) + 4), (8, body + "tail", "en", "s", len(body) + 4),
            (9, "1234 5678 !!! 90", "en", "s", 16), (None, body, "en", "s", len(body)), (None, None, None, None, None),
            (10, "naïve café ŝtrange 漢字 text with é" * 9, "fr", "s", 300)]
    extra = (1, 2, "x", 3, 4, 5, 6, "y", 0.5)
    return spark.createDataFrame([r + extra for r in rows], f"{DOC_SCHEMA}, {CLASH}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
