"""Every query with SQL gives DuckDB's rows."""

from __future__ import annotations

import numbers

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()
OWN = sorted(n for n in SQL if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def duck(small_sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_sf}/{t}.parquet'")
    return con


def shown(x: object) -> str:
    if not hasattr(x, "__len__") and pd.isna(x):
        return "null"
    if isinstance(x, numbers.Number) and not isinstance(x, bool):
        return repr(round(float(x), 6))
    return str(x)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(shown(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", OWN)
def test_query_gives_the_rows_of_its_sql(spark, small_sf, duck, name):
    got = entry.queries()[name](spark, small_sf).toPandas()
    true = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(true.columns)
    assert rows(got) == rows(true)


def test_every_query_of_the_engine_has_sql():
    assert {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"} == set(OWN)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_the_llm_subpackage():
    from pathlib import Path

    root = Path(entry.__file__).parent
    for path in (root / "priceengine").rglob("*.py"):
        if "llm" not in path.parts:
            assert "priceengine.llm" not in path.read_text(), path
