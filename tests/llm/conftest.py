"""Small tables with the defined cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import duckdb
import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG_LINE = "this very line is repeated in many documents of the corpus"
EDGE_TEXTS = [None, "", " ", "\n\n", "one", "one two three four", "a b c d e", "a b c d e", "Ünïcode ßtraße 漢字 😀 end",
              "x" * 20_000, " ".join(f"w{i}" for i in range(5_000))]


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(EDGE_TEXTS)]
    rows += [rows[6], (None, "no id here", None, None, None), (50, None, None, "s", None)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(2)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing_docs(edge_docs):
    """Extra columns named like columns the operators make."""
    from pyspark.sql import functions as F

    return edge_docs.withColumns({c: F.lit("mine") for c in (
        "h", "key", "node", "n", "pii", "row", "part", "extra", "n_lines", "kept_text", "toxic", "score", "shingles")})


@pytest.fixture(scope="session")
def texts(sf_dir):
    """doc_id: text of the smallest test table."""
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())
