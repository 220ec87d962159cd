import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table, with columns whose names clash with those the operators use inside."""

    def make(rows):
        extra = "n int, label string, digest string, cls long, token string, row long, secret string, at int"
        schema = f"{DOCS}, {extra}"
        return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), 1, "x", "y", 2, "z", 3, "s", 4) for i, t in rows], schema)

    return make


ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (5, "one"),
    (5, "one"),
    (None, "a text without an id " * 20),
    (6, "Ünïcode “quotes” <|endoftext|> 日本語 \u00a0 don't  stop\n\n"),
    (7, "long " * 60000),
    (8, "x" * 50000),
]


@pytest.fixture(scope="session")
def odd(docs):
    return docs(ODD)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs([])
