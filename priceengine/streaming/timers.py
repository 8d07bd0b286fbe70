"""Streams whose state goes by event time: requests under a limit, sessions that expire. State is held in RocksDB, timers purge it."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
#: Windows that stay before they are purged: fixed value.
KEPT_WINDOWS = 2
#: Shares of a window's keys, and of all sessions. State written with others is not found again.
SHARES, SESSION_SHARES = 32, 512


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Within: streams started hold their state in RocksDB, which these operators need."""
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)


def share(*columns: str, n: int) -> Column:
    """A number below `n` by the hash of these columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(n))


class _Limit(StatefulProcessor):
    """Per window and share of the keys, how many requests each key has had."""

    def __init__(self, limit: int, width_ms: int):
        self.limit, self.width_ms = limit, width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getListState("counts", "bucket_key string, n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came: dict[str | None, int] = dict(self.counts.get())
        if not came:
            self.handle.registerTimer(int(key[0]) + KEPT_WINDOWS * self.width_ms)
        room: dict[str | None, int] = {}  # requests of each key that are still admitted
        first = None  # the earliest so far, no more than there is room for
        for part in rows:
            for name, n in zip(*self.sizes(part), strict=True):
                if name not in room:
                    room[name] = max(self.limit - came.get(name, 0), 0)
                came[name] = came.get(name, 0) + n
            part = (part if first is None else pd.concat([first, part])).sort_values(["at_us", "seq"], kind="stable")
            codes, names = self.coded(part)
            early = part.groupby(codes).cumcount().to_numpy() < np.array([room[n] for n in names], dtype="int64")[codes]
            first = part[early]
            yield self.told(key, part[~early], False)
        self.counts.put(list(came.items()))
        if first is not None:
            yield self.told(key, first, True)

    @staticmethod
    def coded(rows: pd.DataFrame) -> tuple[np.ndarray, list[str | None]]:
        codes, names = pd.factorize(rows["bucket_key"], use_na_sentinel=False)
        return codes, [None if pd.isna(n) else n for n in names]

    def sizes(self, rows: pd.DataFrame) -> tuple[list[str | None], list[int]]:
        codes, names = self.coded(rows)
        return names, np.bincount(codes, minlength=len(names)).tolist()

    @staticmethod
    def told(key: Any, rows: pd.DataFrame, admitted: bool) -> pd.DataFrame:
        return rows[["bucket_key", "seq"]].assign(window_ms=int(key[0]), admitted=admitted)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.counts.clear()
        return iter(())

    def close(self) -> None:
        pass


def admitted_stream(requests: DataFrame, width: timedelta, limit: int, late: str) -> DataFrame:
    """(bucket_key, seq, window_start, admitted): the first `limit` requests of a key in each fixed window, judged as they come.

    requests: a stream of (bucket_key string, at timestamp, seq long). A micro-batch is taken in order of (at, seq); of a hot key no more
    than the earliest `limit` requests of each window wait in memory, others are rejected as they stream by. A window's count goes once the
    watermark, `late` behind the newest request, is KEPT_WINDOWS windows past its start; later requests are dropped. Windows are cut in SHARES of
    their keys, so that the calls of a micro-batch grow with its windows, not with its keys.
    """
    ms = int(width.total_seconds() * 1000)
    rows = requests.withWatermark("at", late).select("at", "bucket_key", "seq", F.unix_micros("at").alias("at_us"), F.unix_millis(F.window("at", f"{ms} milliseconds")["start"]).alias("window_ms"))
    told = rows.withColumn("share", share("bucket_key", n=SHARES)).groupBy("window_ms", "share").transformWithStateInPandas(_Limit(limit, ms), "bucket_key string, seq long, window_ms long, admitted boolean", "Append", "EventTime")
    return told.select("bucket_key", "seq", F.timestamp_millis("window_ms").alias("window_start"), "admitted")


class _Expiry(StatefulProcessor):
    """Per share of the sessions, when each open one ends. One timer a share, at its earliest end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "user_id string, session_id string, expires_ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ends = self.stored()
        for part in rows:
            for user, session, end in zip(part["user_id"], part["session_id"], part["expires_ms"].tolist(), strict=True):
                ends[user, session] = max(end, ends.get((user, session), end))
        yield self.ended(ends, timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self.ended(self.stored(), timerValues)

    def stored(self) -> dict[tuple[str, str], int]:
        return {(user, session): end for user, session, end in self.open.get()}

    def ended(self, ends: dict[tuple[str, str], int], timer_values: Any) -> pd.DataFrame:
        """The sessions that have ended; the others are stored."""
        now = timer_values.getCurrentWatermarkInMs()
        stay = [(user, session, end) for (user, session), end in ends.items() if end > now]
        self.open.put(stay) if stay else self.open.clear()
        due = min((end for _, _, end in stay), default=None)
        timers = set(self.handle.listTimers())
        for other in timers - {due}:
            self.handle.deleteTimer(other)
        if due is not None and due not in timers:
            self.handle.registerTimer(due)
        return pd.DataFrame([(user, session, end) for (user, session), end in ends.items() if end <= now], columns=["user_id", "session_id", "expires_ms"]).astype({"expires_ms": "int64"})

    def close(self) -> None:
        pass


def expired_sessions(sessions: DataFrame, late: str) -> DataFrame:
    """(user_id, session_id, expires_at) of each session once, when the watermark, `late` behind the newest session, passes its end.

    sessions: a stream of (user_id string, session_id string, created_at timestamp, expires_at timestamp); a session told again lives until its latest end.
    State: the open sessions alone, in SESSION_SHARES by their hash, so that neither the calls of a micro-batch nor the largest group grow with a
    user's sessions. A share is read and written whole when one of its sessions comes or ends.
    """
    rows = sessions.withWatermark("created_at", late).select("created_at", "user_id", "session_id", F.unix_millis("expires_at").alias("expires_ms"))
    told = rows.withColumn("share", share("user_id", "session_id", n=SESSION_SHARES)).groupBy("share").transformWithStateInPandas(_Expiry(), "user_id string, session_id string, expires_ms long", "Append", "EventTime")
    return told.select("user_id", "session_id", F.timestamp_millis("expires_ms").alias("expires_at"))
