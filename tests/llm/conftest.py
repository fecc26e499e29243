import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) tuples, with an extra column."""
    def made(rows):
        return spark.createDataFrame([(r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "s")), len(r[1] or ""), "x") for r in rows], SCHEMA)
    return made


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in every column, empty and blank texts, repeated rows, a long text."""
    return make([(1, None), (2, ""), (3, " \n\t"), (None, "one two three", None, None), (5, "a b c " * 20000), (6, "the same words here"),
                 (6, "the same words here"), (7, "é ß 漢字 😀 x", "fr", None), (8, "12 34"), (None, None, None, None)])
