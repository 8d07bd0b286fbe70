"""Queries on change-only ingest, listings and as-of reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceengine.operators import ingest
from priceengine.plans.registry import query
from priceengine.plans.views import EVENTS, LISTINGS, PRODUCT_EVENTS, events, listings, product_events

_BUCKET = "CAST(k // 20 AS VARCHAR)"


def _bucket() -> F.Column:
    return F.expr("cast(k div 20 as string)")


@query(f"""WITH {EVENTS} SELECT product_id, store_id, observed_at, seq, {_BUCKET} AS value FROM obs
QUALIFY {_BUCKET} IS DISTINCT FROM lag({_BUCKET}) OVER (PARTITION BY product_id, store_id ORDER BY seq)""")
def offer_change_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("value", _bucket())
    return ingest.changed_only(rows, ["product_id", "store_id"], F.col("value")).select("product_id", "store_id", "observed_at", "seq", "value")


@query(f"""WITH {EVENTS}, known AS (SELECT product_id, store_id, arg_max({_BUCKET}, seq) AS stored FROM obs WHERE observed_at < TIMESTAMP '2024-01-20 00:00:00' GROUP BY ALL),
late AS (SELECT product_id, store_id, seq, {_BUCKET} AS value, lag({_BUCKET}) OVER (PARTITION BY product_id, store_id ORDER BY seq) AS before FROM obs WHERE observed_at >= TIMESTAMP '2024-01-20 00:00:00')
SELECT product_id, store_id, seq, value FROM late LEFT JOIN known USING (product_id, store_id) WHERE value IS DISTINCT FROM coalesce(before, stored)""")
def offer_change_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later batch against what is stored already."""
    from datetime import datetime

    from priceengine.plans.views import ntz

    rows = events(spark, sf_dir).withColumn("value", _bucket())
    cut = ntz(datetime(2024, 1, 20))
    known = rows.where(F.col("observed_at") < cut).groupBy("product_id", "store_id").agg(F.max_by("value", F.col("seq")).alias("value"))
    return ingest.changed_only(rows.where(F.col("observed_at") >= cut), ["product_id", "store_id"], F.col("value"), known).select("product_id", "store_id", "seq", "value")


@query(f"WITH {EVENTS}, {PRODUCT_EVENTS} SELECT product_id, hash, arg_min(observed_at, seq) AS observed_at, min(seq) AS seq FROM pev GROUP BY ALL")
def revision_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = product_events(spark, sf_dir)
    return ingest.first_revisions(rows.withColumnRenamed("hash", "value"), "product_id", F.col("value"))


_RECORDS = f"""WITH {EVENTS}, records AS (
  SELECT CASE k % 4 WHEN 0 THEN 'offer' WHEN 1 THEN 'product' WHEN 2 THEN 'store' ELSE 'snapshot' END AS kind, store_id AS id, CAST(k // 8 AS VARCHAR) AS hash, date_trunc('day', observed_at) AS observed_at, 'specials' AS scope, seq FROM obs)
SELECT kind, id, hash, observed_at, scope, seq FROM records
QUALIFY kind = 'offer' OR row_number() OVER (PARTITION BY kind, id, hash, CASE WHEN kind = 'snapshot' THEN observed_at END ORDER BY seq) = 1"""


@query(_RECORDS)
def archive_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("offer", "product", "store", "snapshot")]), (F.col("k") % 4 + 1).cast("int"))
    day = F.date_trunc("day", "observed_at").cast("timestamp_ntz")
    rows = events(spark, sf_dir).select(kind.alias("kind"), F.col("store_id").alias("id"), F.expr("cast(k div 8 as string)").alias("hash"), day.alias("observed_at"), F.lit("specials").alias("scope"), "seq")
    return ingest.compacted(rows)


@query(f"WITH {EVENTS} SELECT * EXCLUDE (rn) FROM (SELECT product_id, store_id, strftime(observed_at, '%Y-%m-%d') AS day, regular_cents // 500 AS band, seq, row_number() OVER (PARTITION BY product_id, store_id, CAST(observed_at AS DATE), regular_cents // 500 ORDER BY seq) AS rn FROM obs) WHERE rn = 1")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("product_id", "store_id", F.date_format("observed_at", "yyyy-MM-dd").alias("day"), F.expr("regular_cents div 500").alias("band"), "seq")
    return ingest.without_repeats(rows, ["product_id", "store_id", "day", "band"])


@query(f"WITH {LISTINGS} SELECT store_id, CAST(snap AS VARCHAR) AS snap, product_id, op FROM deltas")
def snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.snapshot_deltas(listings(spark, sf_dir)).withColumn("snap", F.col("snap").cast("string"))


_CUT = "DATE '2024-01-21'"


@query(f"WITH {LISTINGS}, until AS (SELECT store_id, max(snap) AS snap FROM present WHERE snap <= {_CUT} GROUP BY store_id) SELECT store_id, product_id FROM present JOIN until USING (store_id, snap)")
def snapshot_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replaying the deltas gives the listing itself: the oracle reads the listing."""
    return ingest.listing_state(ingest.snapshot_deltas(listings(spark, sf_dir)), F.lit("2024-01-21").cast("date"))


@query(f"""WITH {EVENTS}, {LISTINGS}, until AS (SELECT store_id, max(snap) AS snap FROM present WHERE store_id <> 'error' GROUP BY store_id)
SELECT o.seq, CASE WHEN u.snap IS NOT NULL THEN p.product_id IS NOT NULL END AS is_on_special, CASE WHEN p.product_id IS NOT NULL THEN CAST(u.snap AS VARCHAR) END AS last_seen_at
FROM obs o LEFT JOIN until u USING (store_id) LEFT JOIN present p ON p.store_id = o.store_id AND p.snap = u.snap AND p.product_id = o.product_id""")
def listing_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One store's listing is unknown."""
    known = listings(spark, sf_dir).where(F.col("store_id") != "error")
    stores = ingest.store_state(known.select("store_id", "snap", F.col("snap").alias("snap_at")))
    offers = events(spark, sf_dir).select("seq", "store_id", "product_id")
    return ingest.listing_flags(offers, ingest.snapshot_deltas(known), stores).select("seq", "is_on_special", F.col("last_seen_at").cast("string").alias("last_seen_at"))


_REVISIONS = f"{PRODUCT_EVENTS}, revs AS (SELECT product_id, hash, arg_min(observed_at + INTERVAL 2 DAY, seq) AS rev_at, min(seq) AS rev_seq FROM pev GROUP BY ALL)"


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product revisions that become known two days late, so that early facts have none due."""
    late = F.col("observed_at") + F.expr("INTERVAL 2 DAY")
    return ingest.first_revisions(product_events(spark, sf_dir).withColumnRenamed("hash", "value").withColumn("observed_at", late), "product_id", F.col("value"))


@query(f"""WITH {EVENTS}, {_REVISIONS}
SELECT o.seq, coalesce(arg_max(r.hash, r.rev_seq) FILTER (WHERE r.rev_at <= o.observed_at), arg_min(r.hash, r.rev_seq)) AS rev_hash,
       coalesce(arg_max(r.rev_at, r.rev_seq) FILTER (WHERE r.rev_at <= o.observed_at), arg_min(r.rev_at, r.rev_seq)) AS rev_at
FROM obs o JOIN revs r USING (product_id) GROUP BY o.seq""")
def asof_product_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    revisions = _revisions(spark, sf_dir)
    facts = events(spark, sf_dir).select("seq", "product_id", "observed_at")
    return ingest.revision_as_of(facts, revisions, "product_id", "observed_at", ["seq"])


@query(f"WITH {EVENTS}, {_REVISIONS} SELECT product_id, hash, rev_at AS observed_at, rev_seq AS seq, lead(rev_at) OVER (PARTITION BY product_id ORDER BY rev_seq) AS valid_to FROM revs")
def revision_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.validity(_revisions(spark, sf_dir), "product_id")


@query(f"""WITH {EVENTS}, {LISTINGS}, {_REVISIONS},
cut AS (SELECT store_id, max(snap) AS snap FROM present WHERE snap <= {_CUT} GROUP BY store_id),
offers AS (SELECT * FROM obs WHERE observed_at <= TIMESTAMP '2024-01-21 00:00:00'),
shown AS (
  SELECT o.seq, o.product_id, p.product_id IS NOT NULL AS is_on_special, CASE WHEN p.product_id IS NOT NULL THEN CAST(c.snap AS TIMESTAMP) END AS last_seen_at,
         coalesce(CASE WHEN p.product_id IS NOT NULL THEN CAST(c.snap AS TIMESTAMP) END, o.observed_at) AS display_at
  FROM offers o JOIN cut c USING (store_id) LEFT JOIN present p ON p.store_id = o.store_id AND p.snap = c.snap AND p.product_id = o.product_id)
SELECT s.seq, s.is_on_special, s.last_seen_at, coalesce(arg_max(r.hash, r.rev_seq) FILTER (WHERE r.rev_at <= s.display_at), arg_min(r.hash, r.rev_seq)) AS product_hash
FROM shown s JOIN revs r USING (product_id) GROUP BY ALL""")
def observations_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing flags and product revisions as they were on one day."""
    from datetime import datetime

    from priceengine.plans.views import ntz

    days = listings(spark, sf_dir)
    products = _revisions(spark, sf_dir)
    rows = events(spark, sf_dir)
    stores = rows.groupBy("store_id").agg(F.min("observed_at").alias("observed_at"), F.min("seq").alias("seq")).withColumn("hash", F.lit("only"))
    snapshots = days.select("store_id", "snap", F.col("snap").cast("timestamp_ntz").alias("snap_at")).distinct()
    offers = rows.select("seq", "product_id", "store_id", "observed_at")
    out = ingest.observations_as_of(offers, products, stores, ingest.snapshot_deltas(days), snapshots, ntz(datetime(2024, 1, 21)))
    return out.select("seq", "is_on_special", "last_seen_at", "product_hash")


@query(f"""WITH {EVENTS}, {LISTINGS} SELECT o.seq, CAST(d.snap AS VARCHAR) AS snap_at FROM obs o LEFT JOIN deltas d
ON d.store_id = o.store_id AND d.product_id = o.product_id AND d.op = 1 AND CAST(d.snap AS TIMESTAMP) >= o.observed_at""")
def snapshot_view_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers beside every later snapshot that added them."""
    added = ingest.snapshot_deltas(listings(spark, sf_dir)).where(F.col("op") == 1)
    # as stored: one row for each snapshot with the list of what it added, unnested again for the join
    stored = added.groupBy("store_id", "snap").agg(F.to_json(F.collect_set("product_id")).alias("added"))
    listed = stored.select("store_id", "snap", F.explode(F.from_json("added", "array<string>")).alias("product_id"))
    offers = events(spark, sf_dir).select("seq", "store_id", "product_id", "observed_at")
    later = (offers["store_id"] == listed["store_id"]) & (offers["product_id"] == listed["product_id"]) & (listed["snap"].cast("timestamp_ntz") >= offers["observed_at"])
    return offers.join(listed, later, "left").select("seq", F.col("snap").cast("string").alias("snap_at"))


@query(f"""WITH {EVENTS} SELECT seq, sha256(concat_ws('|', coalesce('=' || CAST(regular_cents AS VARCHAR), '-'), coalesce('=' || CAST(promo_cents AS VARCHAR), '-'), coalesce('=' || CAST(member_cents AS VARCHAR), '-'),
CASE WHEN has_promotion THEN '=SPECIAL' ELSE '-' END, CASE WHEN has_promotion THEN '=' || CAST(k AS VARCHAR) || '.0' ELSE '-' END, coalesce('=' || starts_at, '-'), coalesce('=' || ends_at, '-'))) AS hash FROM obs""")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("seq", ingest.offer_hash().alias("hash"))


@query(f"WITH {LISTINGS} SELECT store_id, CAST(snap AS VARCHAR) AS snap, count(*) AS offer_count FROM present GROUP BY ALL")
def snapshot_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.snapshot_hashes(listings(spark, sf_dir)).drop("offers_hash").withColumn("snap", F.col("snap").cast("string"))


@query(f"""WITH {EVENTS}, known AS (SELECT DISTINCT product_id FROM obs WHERE observed_at < TIMESTAMP '2024-01-01 12:00:00')
SELECT product_id, arg_min(observed_at, seq) AS first_seen_at FROM obs WHERE observed_at >= TIMESTAMP '2024-01-01 12:00:00' AND product_id NOT IN (SELECT product_id FROM known) GROUP BY product_id""")
def new_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import datetime

    from priceengine.plans.views import ntz

    rows, cut = events(spark, sf_dir), ntz(datetime(2024, 1, 1, 12))
    return ingest.new_items(rows.where(F.col("observed_at") >= cut), rows.where(F.col("observed_at") < cut).select("product_id").distinct())
