"""Streams whose state goes by event time."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

from priceengine.streaming import timers

T0 = datetime(2026, 7, 1)


def drained(spark, stream, base: str):
    with timers.keyed_state(spark):
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def put(spark, rows: list[tuple], schema: str, base: str):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")


def held(spark, base: str, name: str) -> int:
    return spark.read.format("statestore").option("path", f"{base}/log").option("stateVarName", name).load().count()


def test_requests_are_admitted_as_they_come_and_windows_are_purged(spark, tmp_path):
    rng, base, schema = random.Random(2), str(tmp_path), "bucket_key string, at timestamp, seq long"
    at = sorted(T0 + timedelta(minutes=rng.randrange(60 * 40)) for _ in range(400))
    rows = [(rng.choice("ab"), t, i) for i, t in enumerate(at)]
    sizes, got = [], None
    for k in range(4):  # the stream is started anew for each batch
        stream = put(spark, rows[100 * k : 100 * k + 100], schema, base)
        got = drained(spark, timers.admitted_stream(stream, timedelta(hours=1), 3, "10 minutes"), base)
        sizes.append(held(spark, base, "counts"))
    true, seen = {}, Counter()
    for key, t, i in rows:
        window = t.replace(minute=0)
        seen[key, window] += 1
        true[i] = (window, seen[key, window] <= 3)
    assert {r.seq: (r.window_start, r.admitted) for r in got.collect()} == true
    # no more than the windows that the watermark has not left two windows behind
    assert max(sizes) <= 2 * 5 and len(seen) > 40


def test_sessions_end_once_at_their_latest_end(spark, tmp_path):
    rng, base, schema = random.Random(3), str(tmp_path), "user_id string, session_id string, created_at timestamp, expires_at timestamp"
    rows, ends = [], defaultdict(lambda: T0)
    for i in range(120):
        t = T0 + timedelta(hours=i)
        session, end = f"s{i // 2}", t + timedelta(hours=rng.randrange(3, 40))
        rows.append((f"u{i // 2 % 7}", session, t, end))
        ends[session] = max(ends[session], end)
    got = None
    for k in range(3):
        got = drained(spark, timers.expired_sessions(put(spark, rows[40 * k : 40 * k + 40], schema, base), "1 hour"), base)
    last = rows[-1][2] - timedelta(hours=1)
    told = Counter((r.session_id, r.expires_at) for r in got.collect())
    assert told == {(s, e): 1 for s, e in ends.items() if e <= last}
    assert held(spark, base, "open") == sum(e > last for e in ends.values())
