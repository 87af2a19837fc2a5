import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) of the small table, read without Spark."""
    return duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, clashing extra columns."""
    long = "alpha beta gamma delta. " * 30_000
    rows = [(1, "one two three four five six seven", "a"), (1, "one two three four five six seven", "a"),
            (2, None, "a"), (3, "", None), (4, " \t\n\x0b\f\r ", "b"), (5, long, "b"), (None, "no id here at all", None),
            (6, "naïve café x y ß İ 漢字 😀", "ü"), (6, "other text with the same id", "ü")]
    clash = ("fp", "root", "size", "u", "src", "rank", "length", "start", "bucket", "kept", "row", "x", "w", "code", "n")
    return spark.createDataFrame([(*r, None, *[f"{c}!" for c in clash]) for r in rows],
                                 "doc_id long, text string, source string, n_chars long, "
                                 + ", ".join(f"`{c}` string" for c in clash))


@pytest.fixture
def nothing(awkward):
    return awkward.limit(0)
