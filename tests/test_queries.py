"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tallywise.queries.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t)}.parquet')")
    return c


def cell(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return repr(round(v, 5) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    order = sorted(df.columns)
    ours = sorted(tuple(cell(r[c]) for c in order) for r in df.collect())
    rel = duck.sql(ORACLES[name])
    at = [rel.columns.index(c) for c in order]
    assert sorted(rel.columns) == order
    assert ours == sorted(tuple(cell(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_the_library_stands_without_its_text_operators():
    import pathlib

    root = pathlib.Path(entry_module.__file__).parent / "tallywise"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "tallywise.llm" not in p.read_text(), p
