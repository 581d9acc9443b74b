import pytest

#: Cases that every operator must stand: nulls in any column, blanks, repeats, a long text, clashing extra columns.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, tie string, lang_ string, doc string, words string, queue string, `a.b` string, token_ids string, round_trip int, logit double, keep string, score string, `__1` string, text_ string"


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", None, "y", "d", "w", "q", "dot", "t", 7, 0.5, "k", "s", "u", "v")


@pytest.fixture(scope="session")
def odd(spark):
    long = "the of and river stone " * 20_000
    rows = [
        row(1, None), row(2, ""), row(3, "  \n\t "), row(None, "a text without an id, of seven words"), row(None, None, None, None),
        row(4, "same words in the same order here"), row(4, "same words in the same order here"), row(5, "same words in the same order here"),
        row(6, long), row(7, "?!. ..., --- !!!"), row(8, 'password = "S3cr3t!pw99"\nmail bob@site.org'), row(9, "ein kurzer Text über nichts", None, None), row(10, "x", "", ""),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark, sf_small):
    return spark.read.parquet(f"{sf_small}/documents.parquet")
