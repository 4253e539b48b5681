import pytest

DOCS = "doc_id long, text string, piece string, row string, word string, fp string, gram string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with further columns whose names the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty and long texts, null ids, repeated rows."""
    long = " ".join(f"word{k % 977} and{k % 31}" for k in range(20_000))
    return [
        (1, None), (2, ""), (3, " \t "), (None, "only a few words here"), (4, long), (5, long), (6, "éÉß ÄöÜ"),
        (7, "same row"), (7, "same row"), (8, "x"), (9, "\n\n"), (10, "a\x00b \x0b c\x0cd"),
    ]


def by_id(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, str(r)))


