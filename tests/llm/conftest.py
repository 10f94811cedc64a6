import duckdb  # noqa: F401
import pyarrow.parquet as pq
import pytest

WORDS = "the of and in to a is that with for on as by at from this it an be or are was".split()


@pytest.fixture(scope="session")
def texts(sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and extra columns with clashing names."""
    long_text = " ".join(f"w{k % 977}x{k}" for k in range(60_000))
    line = "one two three four five six seven eight nine ten"
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, long_text), (5, line), (5, line), (6, line), (7, line.upper()), (8, "two words"), (9, "two words"),
        (10, "a" * 70_000), (11, "é 日本 😀   end"), (None, "no id here at all, it seems"), (None, None), (12, "mail x@y.zz +1 (415) 555-0134 10.1.2.3 4111 1111 1111 1111"),
    ]
    made = [(i, t, "blob", "row", "spans", 1.5, "x", "en", "s", None) for i, t in rows]
    return spark.createDataFrame(made, "doc_id long, text string, blob string, row string, spans string, score double, component string, lang string, source string, n_chars long")
