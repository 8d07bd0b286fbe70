"""Queries on users' lists, limits, runs and streams."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceengine.operators import health, ingest, personal
from priceengine.plans.registry import query
from priceengine.plans.views import EVENTS, events, ntz, stream_folder, table
from priceengine.streaming import changes, timers


@query(f"""WITH {EVENTS}, w AS (SELECT *, time_bucket(INTERVAL 6 HOUR, observed_at) AS window_start FROM obs)
SELECT seq, window_start, row_number() OVER (PARTITION BY product_id, window_start ORDER BY observed_at, seq) <= 2 AS admitted FROM w""")
def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = events(spark, sf_dir).select("seq", F.col("product_id").alias("bucket_key"), F.col("observed_at").alias("at"))
    return personal.admitted(requests, "6 hours", 2).select("seq", "window_start", "admitted")


@query(f"""WITH {EVENTS} SELECT store_id AS bucket_key, time_bucket(INTERVAL 1 DAY, observed_at) AS window_start, count(*) AS requests, greatest(count(*) - 50, 0) AS rejected FROM obs GROUP BY ALL""")
def rate_limit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = events(spark, sf_dir).select("seq", F.col("store_id").alias("bucket_key"), F.col("observed_at").alias("at"))
    return personal.window_counts(requests, "1 day", 50)


@query(f"WITH {EVENTS} SELECT seq, product_id FROM obs WHERE observed_at + INTERVAL 1 DAY * (k // 10) > TIMESTAMP '2024-01-25 00:00:00'")
def session_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import datetime

    expires = F.col("observed_at") + F.make_dt_interval(days=F.expr("cast(k div 10 as int)"))
    return personal.active_sessions(events(spark, sf_dir).select("seq", "product_id", expires.alias("expires_at")), ntz(datetime(2024, 1, 25))).select("seq", "product_id")


_SESSIONS = """sess AS (SELECT CAST(seq AS VARCHAR) AS session_id, CAST(product_id AS BIGINT) AS user_id, observed_at + INTERVAL 1 DAY * (k // 10) AS expires_at, observed_at AS created_at FROM obs)"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    expires = F.col("observed_at") + F.make_dt_interval(days=F.expr("cast(k div 10 as int)"))
    return events(spark, sf_dir).select(F.col("seq").cast("string").alias("session_id"), F.col("product_id").cast("long").alias("user_id"), expires.alias("expires_at"), F.col("observed_at").alias("created_at"))


@query(f"WITH {EVENTS}, {_SESSIONS} SELECT session_id, user_id, expires_at, created_at, c_name AS username FROM sess JOIN customer ON c_custkey = user_id WHERE user_id % 3 <> 0")
def session_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions beside customers as users; a third of the sessions has a user who is gone."""
    users = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 3 != 0).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))
    return personal.sessions_of_users(_sessions(spark, sf_dir), users)


@query(f"WITH {EVENTS}, {_SESSIONS} SELECT count(*) FILTER (WHERE expires_at > TIMESTAMP '2024-01-25 00:00:00') AS left_over, count(*) FILTER (WHERE expires_at <= TIMESTAMP '2024-01-25 00:00:00') AS removed FROM sess")
def session_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import datetime

    stay, gone = personal.swept(_sessions(spark, sf_dir), ntz(datetime(2024, 1, 25)))
    return stay.agg(F.count(F.lit(1)).alias("left_over")).crossJoin(gone)  # one row each


@query(f"WITH {EVENTS} SELECT product_id AS user_id, CAST(k AS VARCHAR) AS target_id, observed_at AS created_at FROM obs WHERE product_id = '7' ORDER BY created_at DESC")
def watchlist_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.col("product_id").alias("user_id"), F.col("k").cast("string").alias("target_id"), F.col("observed_at").alias("created_at"))
    return personal.newest_first(rows, F.lit("7"))


@query(f"""WITH {EVENTS}, stored AS (SELECT product_id, min(observed_at) AS first_seen_at FROM obs WHERE observed_at < TIMESTAMP '2024-01-02 00:00:00' GROUP BY 1), seen AS (SELECT product_id, min(observed_at) AS first_seen_at FROM obs GROUP BY 1)
SELECT product_id, first_seen_at, false AS notified FROM seen WHERE product_id NOT IN (SELECT product_id FROM stored)""")
def notices_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices of the first day are notified; products seen later are not yet."""
    from datetime import datetime

    rows = events(spark, sf_dir)
    first = lambda df: df.groupBy("product_id").agg(F.min("observed_at").alias("first_seen_at"))
    none = first(rows.where("false")).withColumn("notified", F.lit(False))
    stored = personal.marked_notified(personal.new_notices(none, first(rows.where(F.col("observed_at") < ntz(datetime(2024, 1, 2))))))
    return personal.open_notices(personal.new_notices(stored, first(rows)))


_QUERY = "CASE WHEN k % 7 = 0 THEN '  ' WHEN k % 2 = 0 THEN '  Red   Milk ' || CAST(k % 4 AS VARCHAR) ELSE 'red milk ' || CAST(k % 4 AS VARCHAR) END"


@query(f"""WITH {EVENTS}, s AS (SELECT product_id AS user_id, {_QUERY} AS query, observed_at AS created_at, seq, nullif(trim(regexp_replace(lower({_QUERY}), '\\s+', ' ', 'g')), '') AS normalised FROM obs)
SELECT user_id, sha256(normalised) AS query_hash, arg_min(query, seq) AS query, normalised, arg_min(created_at, seq) AS created_at FROM s WHERE normalised IS NOT NULL GROUP BY user_id, normalised""")
def saved_search_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    text = F.when(k % 7 == 0, "  ").when(k % 2 == 0, F.concat(F.lit("  Red   Milk "), (k % 4).cast("string"))).otherwise(F.concat(F.lit("red milk "), (k % 4).cast("string")))
    return personal.saved_searches(events(spark, sf_dir).select(F.col("product_id").alias("user_id"), text.alias("query"), F.col("observed_at").alias("created_at"), "seq"))


@query(f"""WITH {EVENTS}, a AS (SELECT product_id AS user_id, CASE WHEN k % 3 = 0 THEN 'category' WHEN k % 3 = 1 THEN 'product' ELSE 'other' END AS target_kind, CAST(k AS VARCHAR) AS target_id, observed_at AS created_at, store_id FROM obs),
stored AS (SELECT user_id, target_kind, target_id, max(created_at) AS created_at FROM a WHERE store_id = 'click' AND target_kind <> 'other' GROUP BY ALL),
added AS (SELECT user_id, target_kind, target_id, min(created_at) AS created_at FROM a WHERE store_id = 'view' AND target_kind <> 'other' GROUP BY ALL),
removed AS (SELECT DISTINCT user_id, target_kind, target_id FROM a WHERE store_id = 'purchase')
SELECT * FROM (SELECT * FROM stored UNION ALL SELECT * FROM added n WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.user_id = n.user_id AND s.target_kind = n.target_kind AND s.target_id = n.target_id)) u
WHERE NOT EXISTS (SELECT 1 FROM removed r WHERE r.user_id = u.user_id AND r.target_kind = u.target_kind AND r.target_id = u.target_id)""")
def watchlist_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    kind = F.when(k % 3 == 0, "category").when(k % 3 == 1, "product").otherwise("other")
    rows = events(spark, sf_dir).select(F.col("product_id").alias("user_id"), kind.alias("target_kind"), k.cast("string").alias("target_id"), F.col("observed_at").alias("created_at"), "store_id")
    stored = rows.where((F.col("store_id") == "click") & (kind_of := F.col("target_kind") != "other")).groupBy("user_id", "target_kind", "target_id").agg(F.max("created_at").alias("created_at"))
    removed = rows.where(F.col("store_id") == "purchase").select("user_id", "target_kind", "target_id").distinct()
    return personal.watch_merge(stored, rows.where((F.col("store_id") == "view") & kind_of).drop("store_id"), removed)


@query(f"""WITH {EVENTS}, stored AS (SELECT product_id AS user_id, store_id AS context_id, CAST(max(k) AS BIGINT) AS rank FROM obs WHERE observed_at < TIMESTAMP '2024-01-15 00:00:00' GROUP BY ALL),
change AS (SELECT product_id AS user_id, store_id AS context_id, arg_max(CASE WHEN k < 30 THEN 0 ELSE k END, seq) AS rank FROM obs WHERE observed_at >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY ALL),
merged AS (SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM change c WHERE c.user_id = s.user_id AND c.context_id = s.context_id) UNION ALL SELECT * FROM change WHERE rank > 0)
SELECT user_id, context_id, rank, CAST(row_number() OVER (PARTITION BY user_id ORDER BY rank, context_id) AS INTEGER) AS position FROM merged""")
def prefs_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import datetime

    cut, k = ntz(datetime(2024, 1, 15)), F.col("k")
    rows = events(spark, sf_dir).select(F.col("product_id").alias("user_id"), F.col("store_id").alias("context_id"), "k", "seq", "observed_at")
    stored = rows.where(F.col("observed_at") < cut).groupBy("user_id", "context_id").agg(F.max("k").alias("rank"))
    changed = rows.where(F.col("observed_at") >= cut).select("user_id", "context_id", F.when(k < 30, F.lit(0).cast("long")).otherwise(k).alias("rank"), "seq")
    return personal.ranked_preferences(personal.preference_merge(stored, changed))


_RUNS = """runs AS (SELECT seq, store_id AS retailer, CAST(CASE k % 6 WHEN 0 THEN 0 WHEN 1 THEN 143 ELSE 1 END AS INTEGER) AS exit_code, k AS records,
CASE k % 6 WHEN 2 THEN 'HTTP 429 Too many' WHEN 3 THEN 'bad gateway 502 token=abcdef12' WHEN 4 THEN 'connect ECONNREFUSED' WHEN 5 THEN 'boom' END AS stderr FROM obs),
kinds AS (SELECT *, CASE WHEN exit_code = 0 THEN 'success' WHEN exit_code > 128 THEN 'timeout' WHEN contains(stderr, '429') THEN 'rate_limited' WHEN contains(stderr, '502') THEN 'server_error' WHEN contains(stderr, 'ECONN') THEN 'network' ELSE 'failure' END AS error_category FROM runs)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("k") % 6
    said = F.when(n == 2, "HTTP 429 Too many").when(n == 3, "bad gateway 502 token=abcdef12").when(n == 4, "connect ECONNREFUSED").when(n == 5, "boom")
    rows = events(spark, sf_dir).select(
        "seq", F.col("store_id").alias("retailer"), F.when(n == 0, 0).when(n == 1, 143).otherwise(1).alias("exit_code"), F.col("k").alias("records"), said.alias("stderr"),
        F.col("observed_at").cast("timestamp").alias("started_at"), (F.col("observed_at") + F.expr("INTERVAL 90 SECOND")).cast("timestamp").alias("ended_at"),
    )
    return health.run_records(rows)


@query(f"""WITH {EVENTS}, {_RUNS} SELECT retailer, error_category, count(*) AS runs, count(*) FILTER (WHERE exit_code = 0) AS succeeded, count(*) FILTER (WHERE exit_code <> 0) AS failed, CAST(sum(records) AS BIGINT) AS fetched, CAST(sum(records // 2) AS BIGINT) AS added FROM kinds GROUP BY ALL""")
def health_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _runs(spark, sf_dir).select("retailer", "error_category", (F.col("exit_code") == 0).alias("ok"), F.col("records").alias("fetched"), F.expr("records div 2").alias("added"))
    return health.summary(rows, "retailer", "error_category")


@query(f"""WITH {EVENTS}, {_RUNS} SELECT seq, retailer, CASE WHEN exit_code = 0 THEN 'success' ELSE 'failure' END AS status, error_category, CASE WHEN contains(stderr, 'token') THEN 'bad gateway 502token=**REDACTED**' ELSE coalesce(stderr, '') END AS error_message, 90000 AS duration_ms FROM kinds ORDER BY seq DESC LIMIT 1000""")
def health_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 1000 records: the operator's own retention."""
    return health.newest(_runs(spark, sf_dir)).select("seq", "retailer", "status", "error_category", "error_message", "duration_ms")


@query(f"WITH {EVENTS} SELECT seq FROM obs WHERE seq < (SELECT min(seq) FROM obs WHERE k = 99 AND store_id = 'error')")
def health_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader that stops at the first bad line sees."""
    broken = (F.col("k") == 99) & (F.col("store_id") == "error")
    return health.before_first_error(events(spark, sf_dir).select("seq", broken.alias("corrupt"))).select("seq")


def _drained(spark: SparkSession, stream: DataFrame, mode: str, base: str | None = None) -> DataFrame:
    """Run a stream over what there is, into a table in the shared folder, and read that. With the same `base` it goes on where it ended."""
    base = base or stream_folder(spark)
    writer = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").outputMode(mode).trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern: the table may be a file or a folder


@query("""SELECT CAST(user_id AS VARCHAR) AS product_id, event_type AS store_id, event_id AS seq, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) // 20 AS VARCHAR) AS value FROM events
QUALIFY CAST(json_extract_string(props, '$.k') AS BIGINT) // 20 IS DISTINCT FROM lag(CAST(json_extract_string(props, '$.k') AS BIGINT) // 20) OVER (PARTITION BY user_id, event_type ORDER BY event_id)""")
def stream_change_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change-only ingest of micro-batches, compared with the last stored values, gives what the batch operator gives."""
    rows = _event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("product_id"), F.col("event_type").alias("store_id"), F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    base, value = stream_folder(spark), F.expr("cast(k div 20 as string)")
    write = lambda batch, batch_id: changes.ingest_batch(batch, batch_id, f"{base}/offers", ["product_id", "store_id"], value)
    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/offers/changes").select("product_id", "store_id", "seq", "value")


def _in_turns(spark: SparkSession, rows: DataFrame, order: str, n: int, folder: str) -> Iterator[DataFrame]:
    """`n` times a stream of `folder`, each time with one more of `n` stretches of `order`, written by all tasks. A run over what there is takes it as one micro-batch."""
    ends = rows.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    place = F.lit(0) if ends.lo is None else F.least(F.floor((F.col(order) - ends.lo) / F.lit((ends.hi - ends.lo + 1) / n)), F.lit(n - 1))
    for k in range(n):
        rows.where(place == k).write.mode("append").parquet(folder)
        yield spark.readStream.schema(rows.schema).parquet(folder)


@query(f"""WITH {EVENTS} SELECT product_id, store_id, seq, CAST(k // 20 AS VARCHAR) AS value FROM obs
QUALIFY CAST(k // 20 AS VARCHAR) IS DISTINCT FROM lag(CAST(k // 20 AS VARCHAR)) OVER (PARTITION BY product_id, store_id ORDER BY seq)""")
def stream_change_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change-only ingest of four micro-batches, the stream started again for each: a batch touches the buckets of its keys alone."""
    rows, base = events(spark, sf_dir).select("product_id", "store_id", "seq", "k"), stream_folder(spark)
    write = lambda batch, batch_id: changes.ingest_batch(batch, batch_id, f"{base}/offers", ["product_id", "store_id"], F.expr("cast(k div 20 as string)"), 64)
    for stream in _in_turns(spark, rows, "seq", 4, f"{base}/in"):
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/offers/changes").select("product_id", "store_id", "seq", "value")


_WEEKS = """present AS (SELECT DISTINCT CASE WHEN event_id % 3 = 0 THEN 'catalogue' ELSE 'specials' END AS scope, event_type AS store_id, CAST(date_trunc('week', ts) AS DATE) AS snap, CAST(user_id AS VARCHAR) AS product_id FROM events WHERE NOT (event_type = 'click' AND day(ts) BETWEEN 8 AND 14)),
steps AS (SELECT scope, store_id, snap, lag(snap) OVER w AS before, lead(snap) OVER w AS after FROM (SELECT DISTINCT scope, store_id, snap FROM present) WINDOW w AS (PARTITION BY scope, store_id ORDER BY snap)),
deltas AS (
  SELECT p.*, 1 AS op FROM present p JOIN steps s USING (scope, store_id, snap) WHERE NOT EXISTS (SELECT 1 FROM present q WHERE q.scope = p.scope AND q.store_id = p.store_id AND q.snap = s.before AND q.product_id = p.product_id)
  UNION ALL
  SELECT p.scope, p.store_id, s.after, p.product_id, -1 FROM present p JOIN steps s USING (scope, store_id, snap)
  WHERE s.after IS NOT NULL AND NOT EXISTS (SELECT 1 FROM present q WHERE q.scope = p.scope AND q.store_id = p.store_id AND q.snap = s.after AND q.product_id = p.product_id)
)"""


def _weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scopes at each store, a listing a week; one store is not collected in the second week."""
    rows = table(spark, sf_dir, "events")
    rows = rows.where(~((F.col("event_type") == "click") & F.dayofmonth("ts").between(8, 14)))
    scope = F.when(F.col("event_id") % 3 == 0, "catalogue").otherwise("specials")
    return rows.select(
        scope.alias("scope"), F.col("event_type").alias("store_id"), F.to_date(F.date_trunc("week", "ts")).alias("snap"), F.col("user_id").cast("string").alias("product_id"),
        F.col("ts").alias("observed_at"), F.col("event_id").alias("seq"), F.sha2(F.get_json_object("props", "$.k"), 256).alias("hash"),
    )


def _listing_log(spark: SparkSession, sf_dir: str) -> tuple[str, list]:
    """The weeks fed as batches, one after the other; (folder, weeks)."""
    rows, path = _weeks(spark, sf_dir), f"{stream_folder(spark)}/listings"
    weeks = [r.snap for r in rows.select("snap").distinct().orderBy("snap").collect()]  # one for each batch
    for k, week in enumerate(weeks):
        changes.ingest_listings(rows.where(F.col("snap") == week).drop("snap"), k, path, every=3)
    return path, weeks


@query(f"WITH {_WEEKS} SELECT scope, store_id, CAST(snap AS VARCHAR) AS snap, product_id, op FROM deltas")
def listing_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks ingested as batches against the stored listing give the deltas of the whole history."""
    path, weeks = _listing_log(spark, sf_dir)
    of = F.array(*[F.lit(str(w)) for w in weeks])
    return spark.read.parquet(f"{path}/deltas").select("scope", "store_id", F.get(of, F.col("batch_id")).alias("snap"), "product_id", "op")


@query(f"""WITH {_WEEKS}, cut AS (SELECT scope, store_id, max(snap) AS snap FROM present WHERE snap <= DATE '2024-01-15' GROUP BY ALL)
SELECT scope, store_id, product_id FROM present JOIN cut USING (scope, store_id, snap)""")
def listing_scopes_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (scope, store) as listed on one day, replayed from deltas."""
    rows = _weeks(spark, sf_dir)
    snapshots = rows.select("scope", "store_id", "snap", F.col("snap").alias("snap_at")).distinct()
    deltas = ingest.snapshot_deltas(rows, ["scope", "store_id"])
    return ingest.listing_as_of(deltas, snapshots, F.lit("2024-01-15").cast("date"))[0]


@query(f"""WITH {_WEEKS}, raw AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'catalogue' ELSE 'specials' END AS scope, event_type AS store_id, CAST(date_trunc('week', ts) AS DATE) AS snap, ts, event_id FROM events WHERE NOT (event_type = 'click' AND day(ts) BETWEEN 8 AND 14))
SELECT scope, store_id, first_at AS observed_at, offer_count, added, removed FROM (SELECT scope, store_id, snap, arg_min(ts, event_id) AS first_at FROM raw GROUP BY ALL) JOIN
(SELECT scope, store_id, snap, count(*) AS offer_count FROM present GROUP BY ALL) USING (scope, store_id, snap) JOIN
(SELECT s.scope, s.store_id, s.snap, count(*) FILTER (WHERE op = 1) AS added, count(*) FILTER (WHERE op = -1) AS removed FROM steps s LEFT JOIN deltas d USING (scope, store_id, snap) GROUP BY ALL) USING (scope, store_id, snap)""")
def listing_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot of each (scope, store) in each batch: the time of its first row, and what it holds, adds and removes."""
    path, _ = _listing_log(spark, sf_dir)
    return spark.read.parquet(f"{path}/snapshots").select("scope", "store_id", "observed_at", "offer_count", "added", "removed")


@query(f"""WITH {EVENTS}, w AS (SELECT *, time_bucket(INTERVAL 6 HOUR, observed_at) AS window_start FROM obs)
SELECT seq, window_start, row_number() OVER (PARTITION BY product_id, window_start ORDER BY observed_at, seq) <= 2 AS admitted FROM w""")
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests judged as they come, in three micro-batches, the stream started again for each, give what the whole table gives."""
    given = events(spark, sf_dir).select(F.col("product_id").alias("bucket_key"), F.col("observed_at").cast("timestamp").alias("at"), "seq").withColumn("us", F.unix_micros("at"))
    base = stream_folder(spark)
    with timers.keyed_state(spark):
        for stream in _in_turns(spark, given, "us", 3, f"{base}/in"):
            out = _drained(spark, timers.admitted_stream(stream.drop("us"), timedelta(hours=6), 2, "1 hour"), "append", base)
    return out.select("seq", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "admitted")


@query(f"""WITH {EVENTS}, {_SESSIONS} SELECT session_id, CAST(user_id AS VARCHAR) AS user_id, date_trunc('millisecond', expires_at) AS expires_at FROM sess
WHERE date_trunc('millisecond', expires_at) <= (SELECT date_trunc('millisecond', max(created_at)) - INTERVAL 1 HOUR FROM sess)""")
def stream_sessions_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end while the stream runs, by timers."""
    given = _sessions(spark, sf_dir).select(F.col("user_id").cast("string").alias("user_id"), "session_id", F.col("created_at").cast("timestamp").alias("created_at"), F.col("expires_at").cast("timestamp").alias("expires_at"))
    base = stream_folder(spark)
    with timers.keyed_state(spark):
        for stream in _in_turns(spark, given.withColumn("us", F.unix_micros("created_at")), "us", 3, f"{base}/in"):
            out = _drained(spark, timers.expired_sessions(stream.drop("us"), "1 hour"), "append", base)
    return out.select("session_id", "user_id", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"))


@query("SELECT * FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2) WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling counts of the windows that the watermark has closed."""
    rows = _event_stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("at"), "event_type")
    out = _drained(spark, changes.tumbling_counts(rows, "at", "1 day", "1 hour", "event_type"), "append")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT CAST(user_id AS VARCHAR) AS product_id, event_type AS store_id, strftime(ts, '%Y-%m-%d') AS day FROM events GROUP BY ALL")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of (product, store, day) suppressed on a stream; the watermark spans the input."""
    rows = _event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("product_id"), F.col("event_type").alias("store_id"), F.col("ts").cast("timestamp").alias("at"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return _drained(spark, changes.once(rows, "at", "60 days", ["product_id", "store_id", "day"]), "append").select("product_id", "store_id", "day")
