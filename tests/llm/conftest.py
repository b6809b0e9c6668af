import pytest
from brute import prose


@pytest.fixture(scope="session")
def make(spark):
    """Documents with clashing extra columns from (doc_id, text) pairs."""
    schema = ("doc_id bigint, text string, lang string, source string, n_chars bigint, score string, kept string, key int, node int, "
              "blob string, spans string, first int, length string, content string")

    def build(rows):
        full = [(i, t, "en", "s", len(t) if t is not None else None, "x", "y", 1, 2, "b", "c", 3, "d", "e") for i, t in rows]
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture(scope="session")
def edge_rows():
    long = prose(1, 60_000)
    return [(1, prose(2, 80)), (2, prose(2, 80)), (2, prose(2, 80)), (3, None), (4, ""), (5, "   \n\t "), (None, prose(3, 70)),
            (None, None), (6, long), (7, "é" * 30_000), (8, "\U0001d4b3 ☃ !!!"), (9, "one two"), (10, "one two")]
