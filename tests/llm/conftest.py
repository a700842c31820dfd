import pytest

ODD_TEXTS = [None, "", "   \n\t ", "one", "one two", "The same text, said again and again by all of them here.",
             "The same text, said again and again by all of them here.", "ÄÖÜ ünïcode wörds, ñandú and 日本語 text\nwith lines",
             "long " * 30_000]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with awkward names."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"src{i % 2}", None if t is None else len(t),
             i, f"fp{i}") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], rows[5], (None, "text without an id", None, None, None, None, None), (None,) * 7]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long, "
                                       "fingerprint string").coalesce(2).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def sf01():
    return "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Small inputs: fewer tasks a job."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
