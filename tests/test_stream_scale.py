"""Streams by event time: what they ask of the state grows with micro-batches, not with keys; stretches are written by all tasks."""

from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path
from types import SimpleNamespace

import pandas as pd

from priceengine.plans import state_queries
from priceengine.streaming import timers
from tests.test_timers import drained, put

T0 = datetime(2026, 7, 1)


class Handle:
    """State of one group in memory; counts what is asked of it."""

    def __init__(self):
        self.calls, self.rows, self.timers = 0, [], set()

    def getListState(self, name, schema):  # noqa: ANN001, ANN201, N802
        return self

    def get(self):  # noqa: ANN201
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):  # noqa: ANN001, ANN201
        self.calls, self.rows = self.calls + 1, list(rows)

    def clear(self):  # noqa: ANN201
        self.calls, self.rows = self.calls + 1, []

    def listTimers(self):  # noqa: ANN201, N802
        self.calls += 1
        return iter(set(self.timers))

    def registerTimer(self, at):  # noqa: ANN001, ANN201, N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: ANN001, ANN201, N802
        self.calls += 1
        self.timers.remove(at)


def now(ms: int) -> SimpleNamespace:
    return SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)


def test_sessions_end_in_few_calls_and_one_timer(spark):
    expiry, handle = timers._Expiry(), Handle()
    expiry.init(handle)
    rows = pd.DataFrame({"user_id": "u", "session_id": [str(i) for i in range(5000)], "expires_ms": range(5000)})
    early = pd.concat(expiry.handleInputRows((0,), iter([rows[:3000], rows[3000:]]), now(999)))
    assert sorted(early["expires_ms"]) == list(range(1000)) and handle.timers == {1000} and len(handle.rows) == 4000
    late = pd.concat(expiry.handleExpiredTimer((0,), now(3999), None))
    assert sorted(late["expires_ms"]) == list(range(1000, 4000)) and handle.timers == {4000} and len(handle.rows) == 1000
    assert handle.calls <= 10


def test_a_session_told_again_with_a_past_end_stays_open(spark, tmp_path):
    base, schema = str(tmp_path), "user_id string, session_id string, created_at timestamp, expires_at timestamp"
    hour = lambda n: T0 + timedelta(hours=n)
    drained(spark, timers.expired_sessions(put(spark, [("u", "a", T0, hour(50)), ("u", "b", hour(20), hour(60))], schema, base), "1 hour"), base)
    drained(spark, timers.expired_sessions(put(spark, [("u", "a", hour(21), hour(10))], schema, base), "1 hour"), base)
    got = drained(spark, timers.expired_sessions(put(spark, [("v", "c", hour(55), hour(90))], schema, base), "1 hour"), base)
    assert [tuple(r) for r in got.collect()] == [("u", "a", hour(50))]


def test_requests_of_a_window_are_counted_in_few_calls(spark):
    limit, handle = timers._Limit(2, 3_600_000), Handle()
    limit.init(handle)
    rows = pd.DataFrame({"bucket_key": [f"k{i % 500}" for i in range(2000)] + [None] * 4, "at_us": range(2004), "seq": range(2004)})
    for part, admitted in ((rows[:500], 500), (rows[500:], 502)):
        told = pd.concat(limit.handleInputRows((7, 0), iter([part[::2], part[1::2]]), now(0)))
        assert sorted(told["seq"]) == part["seq"].tolist()
        assert sorted(told["seq"][told["admitted"]]) == [i for i in part["seq"] if i < 1000 or i in (2000, 2001)] and told["admitted"].sum() == admitted
    assert handle.calls <= 6 and dict(handle.rows) == {f"k{i}": 4 for i in range(500)} | {None: 4}


def test_a_stretch_is_written_by_all_tasks_and_read_at_once(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 4).selectExpr("(id * 1009) % 4000 as id")
    folder, files = f"{tmp_path}/in", []
    for _ in state_queries._in_turns(spark, rows, "id", 2, folder):
        files.append(len(list(Path(folder).glob("*.parquet"))))
    assert files == [4, 8]
    assert spark.read.parquet(folder).count() == 4000
