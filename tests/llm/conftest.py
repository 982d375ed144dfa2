import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    """The smallest documents, dealt over several tasks."""
    return spark.read.parquet(f"{SF}/documents.parquet").repartition(5).persist()


ODD = [
    (1, None),
    (2, ""),
    (3, "   \t\n"),
    (4, "one"),
    (5, "one"),
    (5, "one"),
    (6, " one "),
    (None, "one"),
    (None, None),
    (7, "ONE two three four"),
    (8, "one TWO three four"),
    (9, "é🎉 ß\x0b\x0c\r x"),
    (10, "w " * 3000),
    (11, "".join(f"word{i} " for i in range(5000))),
    (12, "x" * 20000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empties, ties, repeated rows, long texts, and columns with clashing names."""
    rows = [(i, t, "u", 1, "fp", 2) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, uid int, fp string, chunk int").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture
def both(documents, odd):
    """Real and odd rows together."""
    return documents.select("doc_id", "text").union(odd.select("doc_id", "text"))
