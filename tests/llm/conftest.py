import pytest

#: Texts for the edge cases every operator has to take: null, empty, blank, short, repeated, very long, no letters, other scripts.
TEXTS = [None, "", "  \n\t ", "one", "one two three four five six", "the the the the the the the the", "Zeile eins.\nZeile eins.\nZeile zwei. ", "12 345 !?", "日本語 текст é ﬁ İ Σς", "a" * 5000, " ".join(f"w{i % 977}" for i in range(30_000)), "x<|endoftext|>y"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """documents with every odd text, a null id, repeated rows, and extra columns whose names clash with results and helpers."""
    rows = [(i, t, "en" if i % 2 else "fr", "s", 0, "extra", 7) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (None, "one two three four five six", None, None, None, None, None), (4, "another text under the same id", None, "s", 0, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, row int")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.filter("false")


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
