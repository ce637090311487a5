"""Every registered query of the engine against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lumenfind.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


def rows(names, table):
    text = lambda v: repr(round(v, 6)) if isinstance(v, float) else repr(v)
    return sorted(tuple(text(r[n]) for n in names) for r in table)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, str(DATA))
    got = df.collect()
    if name not in ORACLE_SQL:
        assert name in ("stem_vocab", "rank_stemmed") and df.columns
        return
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    rel = con.sql(ORACLE_SQL[name])
    names = rel.columns
    assert sorted(names) == sorted(df.columns)
    assert rows(names, got) == rows(names, [dict(zip(names, r)) for r in rel.fetchall()])


def test_entry(spark):
    assert len(entry.entry(spark).collect()) == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_subpackage():
    root = Path(entry.__file__).parent / "lumenfind"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert ".llm" not in p.read_text(), p
