import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, null ids and sources, repeated rows, ties, one very long text."""
    prose = " ".join(f"word{k * 7919 % 997}" for k in range(300))
    long = "\n".join(" ".join(f"w{(k * j) % 1013}é" for k in range(20)) for j in range(1, 6000))
    return [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, prose, "a"), (4, prose, "a"), (5, prose + " tail", "b"), (None, prose, "b"), (6, long, "b"), (7, "one", "b"),
        (8, "password = abcdef123 and AKIA" + "A1B2" * 4 + " 0123456789abcdef01234567", "c"), (9, "This is under the MIT License. CC BY", "c"), (10, "nul \x00 byte <|endoftext|> 🙂", "c"),
    ]


@pytest.fixture(scope="session")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, source FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY 1").fetchall()
