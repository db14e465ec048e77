import pytest

DOCS = "doc_id long, text string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank and very long texts, ties, repeated rows, null ids, and clashing names."""
    long_text = "word " * 30_000 + "\n" + "x" * 20_000
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "same text here"), (5, "same text here"), (6, "same text here"), (7, long_text), (None, "no id"), (8, "😀 é ▁ \x00 end")]
    return spark.createDataFrame([(*r, "x", 1, "k") for r in rows], DOCS + ", source string, key_ long, host_ string")
