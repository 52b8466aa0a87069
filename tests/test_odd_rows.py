"""Queries against DuckDB on documents that are null, empty or nothing but white space, beside usual ones."""

import duckdb
import pytest
from corpusloom.plans import catalogue

from test_queries import SF, shown

TEXTS = [None, "", "\n", "a\n", "  ", "x", "\r\nq\n\n", "é ü 中文 🎉\n  tab\t ", None, "don't  stop,   now!", "ab ab abc\n\n ab", "abc " * 700]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    con.execute(f"CREATE TABLE usual AS SELECT * FROM '{SF}/documents.parquet' WHERE doc_id < 20")
    for i, text in enumerate(TEXTS):
        con.execute("INSERT INTO usual BY NAME SELECT ? AS doc_id, ? AS text, ? AS lang, ? AS source", [900_000 + i, text, "en" if i % 3 else None, "a"])
    con.execute(f"COPY usual TO '{folder}/documents.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    return str(folder), con


def agrees(spark, odd, name):
    folder, con = odd
    df = catalogue.QUERIES[name](spark, folder)
    found = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    order = sorted(names)
    ours = sorted(tuple(shown(r[c]) for c in order) for r in df.collect())
    assert ours == sorted(tuple(shown(r[names.index(c)]) for c in order) for r in found.fetchall())


def test_lines_with_endings(spark, odd):
    """Texts without a line have a row all the same."""
    agrees(spark, odd, "lines_with_endings")


def test_stride_windows(spark, odd):
    """The part of a text without ids has no sum."""
    agrees(spark, odd, "stride_windows")


def test_strip_left_padding(spark, odd):
    agrees(spark, odd, "strip_left_padding")


@pytest.mark.parametrize("name", ["norm_bytelevel", "decode_bytelevel"])
def test_byte_alphabet(spark, odd, name):
    """Null texts are no error."""
    agrees(spark, odd, name)


def test_token_budget_batches(spark, odd):
    """Null texts come last, and count as no ids."""
    agrees(spark, odd, "token_budget_batches")
