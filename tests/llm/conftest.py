import pytest

#: Nulls, empty and very long texts, ties and repeated rows.
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu\n" * 3000
SHARED = "This line is shared by several documents here"
EDGES = [
    (1, None), (2, ""), (3, " \t\n "), (4, LONG), (5, "one"), (6, f"{SHARED}\nown line of document six is here"),
    (7, f"  {SHARED.upper()} \nanother"), (8, SHARED), (8, SHARED), (None, SHARED), (None, None), (9, "été 你好 \x85 \u2028 x"), (10, "<|endoftext|> a b"), (11, "a" * 20000),
]


@pytest.fixture
def edge_docs(spark):
    """Rows at the edges, with columns whose names clash with those operators make."""
    rows = [(i, t, "en", None, 1, "x", 2) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, n_lines int")


@pytest.fixture
def no_docs(edge_docs):
    return edge_docs.filter("doc_id < 0")
