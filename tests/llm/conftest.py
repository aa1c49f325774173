import os
from pathlib import Path

import pytest

os.environ["PYTHONPATH"] = os.pathsep.join(
    [str(Path(__file__).resolve().parents[2]), os.environ.get("PYTHONPATH", "")])

DATA = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def rows(sf_dir):
    """Rows of a table as plain tuples."""
    import duckdb

    def read(name, columns):
        return duckdb.sql(f"SELECT {columns} FROM '{sf_dir}/{name}.parquet' ORDER BY 1").fetchall()

    return read


ODD = [  # doc_id, text, lang, source, n_chars, extra columns with names the operators use
    (1, None, "en", "a", 0, "x"), (2, "", None, None, 0, None), (3, "one", "en", "a", 3, "x"),
    (4, "one", "en", "b", 3, "x"), (4, "one", "en", "b", 3, "x"), (None, "two words", None, "b", 9, None),
    (5, " \t\n ", "de", "a", 4, "x"), (6, "word " * 30_000, "en", "a", 150_000, "x"),
    (7, "word " * 30_000, "en", "a", 150_000, "x"), (8, "été \x1c naïve 漢字 <|endoftext|> Σίσυφος ΟΔΟΣ é", "fr", "c", 40, "x"),
    (9, "12345 !!! 678", "en", None, 13, "x"),
]


@pytest.fixture(scope="session")
def odd(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string"
    return spark.createDataFrame(ODD, schema)
