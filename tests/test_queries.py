"""Every query with SQL against DuckDB, on the smallest tables."""

import math

import __spark_entry__ as entry
import duckdb
import pytest
from corpusloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 1 << 53 else str(v)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    ours = sorted(tuple(shown(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(shown(r[names.index(c)]) for c in order) for r in found.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["topdown_comp", "unigram_em"])
def test_trainers_have_their_defaults(spark, name):
    """Vocabularies of 8,000 from all seeds, with pieces of up to 16 characters."""
    tokens = [r["token"] for r in catalogue.QUERIES[name](spark, SF).collect()]
    assert len(tokens) == len(set(tokens)) == 8_000
    assert 8 < max(len(t) for t in tokens if not t.startswith("<|")) <= 16
