"""Queries on rows at the edges of their rules give the rows of their SQL."""

from __future__ import annotations

from datetime import datetime, timedelta

import duckdb

import __spark_entry__ as entry
from priceengine.plans.views import AT


def as_sql(spark, sf: str, name: str) -> tuple[list[tuple], list[tuple]]:
    """(rows of a query on a folder that has events alone, rows of its SQL)."""
    got = entry.queries()[name](spark, sf)
    columns = ", ".join(sorted(got.columns))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet/*.parquet'")
    return sorted(map(tuple, got.selectExpr(*sorted(got.columns)).collect()), key=str), sorted(con.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall(), key=str)


def put_events(spark, folder, at: list[datetime | None], users: int = 3, more: tuple = ()) -> str:
    rows = [(i, t, i % users, ("click", "view")[i % 2], 1.5 + i, f'{{"k": {i * 7 % 100}}}') for i, t in enumerate(at)] + list(more)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_age_counts_parts_of_a_second(spark, tmp_path):
    ends = [AT - timedelta(days=d) for d in (7, 14)]
    sf = put_events(spark, tmp_path, [end + timedelta(microseconds=us) for end in ends for us in (-1_000_000, -999_999, -500_000, -1, 0, 1, 500_000)])
    got, true = as_sql(spark, sf, "price_kind_freshness")
    assert got == true


def test_rows_without_time_or_price_are_shown_as_the_sql_shows_them(spark, tmp_path):
    lacking = [(10, None, 1, "click", 2.5, '{"k": 60}'), (11, AT, 1, "click", None, '{"k": 10}'), (12, AT, 1, "view", 2.5, None)]
    got, true = as_sql(spark, put_events(spark, tmp_path, [AT], more=tuple(lacking)), "price_kind_freshness")
    assert got == true
