import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return SF


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, an empty and a very long text, ties, repeated rows and clashing extra columns."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    plain = "the quick brown fox jumps over the lazy dog and runs away from all of the other animals in that old wood"
    rows = [
        (1, plain, "en", "a", 10, 7, "x"), (2, plain, "en", "a", 10, 7, "x"), (3, plain + " again", None, None, None, None, None),
        (4, None, "en", "a", None, 1, ""), (5, "", "de", "b", 0, 2, "y"), (None, plain, "en", "b", 5, 3, "z"),
        (6, long, "en", "c", len(long), 4, "w"), (7, "short", "en", "c", 5, 5, "v"), (7, "short", "en", "c", 5, 5, "v"),
        (8, " \t\n ", "en", None, 4, 6, "u"), (9, "Ünï cödé 日本語 <|im_end|> \x00 don't", "xx", "d", 9, 8, "t"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                                       "n_words bigint, kept string")


CLASHES = "_id _u _place _times _cdf _clean _hit _gone _again _root _row _text c id row word key sig n side pivot salt size base spans candidates".split()


@pytest.fixture(scope="session")
def clashing(awkward):
    """The same documents with a column of every name that an operator might use itself."""
    return awkward.selectExpr("*", *[f"{i} AS `{n}`" for i, n in enumerate(CLASHES)])


@pytest.fixture(scope="session")
def no_documents(spark, awkward):
    return spark.createDataFrame([], awkward.schema)
