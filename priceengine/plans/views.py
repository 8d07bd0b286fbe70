"""The driver's tables as observations, offers, products and listings, in DataFrames and in SQL."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceengine.functions.scalars import half_up

#: The evaluation time of all queries on events: the end of the month they cover.
AT = datetime(2024, 1, 31)
SQL_AT = "TIMESTAMP '2024-01-31 00:00:00'"
#: The same for line items.
LINE_AT = datetime(2001, 11, 5)
SQL_LINE_AT = "TIMESTAMP '2001-11-05 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_folder(spark: SparkSession) -> str:
    """A new folder where all executors can write: the checkpoint folder, or the warehouse where none is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"


def ntz(at: datetime):  # noqa: ANN201
    """`at` without a time zone, as the tables have their times."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: a user is a product, a kind of event a store and its retailer."""
    k = F.get_json_object("props", "$.k").cast("long")
    cents = half_up(F.col("value") * F.lit(100.0))
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", k.alias("k"), cents.alias("cents"))
    day = F.date_format("ts", "yyyy-MM-dd")
    return rows.select(
        F.col("user_id").cast("string").alias("product_id"), F.col("event_type").alias("store_id"), F.col("event_type").alias("retailer"), F.col("ts").alias("observed_at"), F.col("event_id").alias("seq"),
        F.col("cents").alias("regular_cents"), F.when(F.col("k") < 50, F.expr("cents * (100 - k) div 100")).alias("promo_cents"), F.when(F.col("k") % 3 == 0, F.expr("cents * 9 div 10")).alias("member_cents"),
        F.when(F.col("k") < 60, F.struct(
            F.lit("SPECIAL").alias("type"), F.col("k").cast("double").alias("save_percent"),
            F.when(F.col("k") % 7 == 1, "soon").when(F.col("k") % 7 != 0, day).alias("starts_at"),
            F.when(F.col("k") % 11 == 1, "n/a").when(F.col("k") % 4 != 0, F.date_format(F.col("ts") + F.expr("INTERVAL 3 DAY"), "yyyy-MM-dd")).alias("ends_at"),
        )).alias("promotion"),
        F.when(F.col("k") % 5 != 4, F.col("k") % 5 != 3).alias("is_on_special"), F.when(F.col("k") % 2 == 0, F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("last_seen_at"), "k",
    )


EVENTS = """
raw AS (
  SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents FROM events
), obs AS (
  SELECT CAST(user_id AS VARCHAR) AS product_id, event_type AS store_id, event_type AS retailer, ts AS observed_at, event_id AS seq, cents AS regular_cents,
         CASE WHEN k < 50 THEN cents * (100 - k) // 100 END AS promo_cents, CASE WHEN k % 3 = 0 THEN cents * 9 // 10 END AS member_cents,
         k < 60 AS has_promotion, CAST(k AS DOUBLE) AS save_percent,
         CASE WHEN k < 60 THEN CASE WHEN k % 7 = 1 THEN 'soon' WHEN k % 7 <> 0 THEN strftime(ts, '%Y-%m-%d') END END AS starts_at,
         CASE WHEN k < 60 THEN CASE WHEN k % 11 = 1 THEN 'n/a' WHEN k % 4 <> 0 THEN strftime(ts + INTERVAL 3 DAY, '%Y-%m-%d') END END AS ends_at,
         CASE WHEN k % 5 <> 4 THEN k % 5 <> 3 END AS is_on_special, CASE WHEN k % 2 = 0 THEN ts + INTERVAL 1 DAY END AS last_seen_at, k
  FROM raw
)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as observations: brands are products, suppliers' nations are stores. Rows are told apart by content only."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    cents = half_up(F.col("l_extendedprice") / F.col("l_quantity") * F.lit(100.0))
    rows = (
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_discount", cents.alias("cents"))
        .join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    return rows.select(
        F.col("p_brand").alias("product_id"), F.col("n_name").alias("store_id"), F.col("n_name").alias("retailer"), F.col("l_shipdate").alias("observed_at"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.col("cents").alias("regular_cents"),
        F.when(F.col("l_discount") > 0, F.expr("cents - cents * cast(floor(l_discount * 100 + 0.5) as bigint) div 100")).alias("promo_cents"),
        F.lit(None).cast("long").alias("member_cents"),
    )


ITEMS = """
obs AS (
  SELECT p_brand AS product_id, n_name AS store_id, n_name AS retailer, l_shipdate AS observed_at, cents AS regular_cents,
         CASE WHEN l_discount > 0 THEN cents - cents * CAST(floor(l_discount * 100 + 0.5) AS BIGINT) // 100 END AS promo_cents
  FROM (SELECT *, CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT) AS cents FROM lineitem)
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
)"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products of five retailers, some with unusable codes. No more than ten share a source id, or four a code, at any scale."""
    key = F.col("p_partkey")
    retailer = F.element_at(F.array(*[F.lit(r) for r in ("paknsave", "newworld", "woolworths", "freshchoice", "warehouse")]), (key % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        key.alias("seq"), F.concat(retailer, F.lit(":"), key.cast("string")).alias("id"), retailer.alias("retailer"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
        F.concat(F.col("p_size").cast("string"), F.when(key % 3 == 0, " kg").when(key % 3 == 1, "g").otherwise(" Lt")).alias("size"),
        F.when(key % 7 != 0, F.concat(F.expr("p_partkey div 10").cast("string"))).alias("source_id"),
        F.when(key % 11 == 0, F.lit("various")).when(key % 13 == 0, F.lit("12345")).otherwise(F.concat(F.lit("94 "), F.lpad(F.expr("p_partkey div 4").cast("string"), 11, "0"))).alias("gtin"),
    )


PRODUCTS = """
products AS (
  SELECT p_partkey AS seq, ['paknsave', 'newworld', 'woolworths', 'freshchoice', 'warehouse'][p_partkey % 5 + 1] || ':' || CAST(p_partkey AS VARCHAR) AS id,
         ['paknsave', 'newworld', 'woolworths', 'freshchoice', 'warehouse'][p_partkey % 5 + 1] AS retailer, p_name AS name, p_brand AS brand, p_type AS category,
         CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 3 = 0 THEN ' kg' WHEN p_partkey % 3 = 1 THEN 'g' ELSE ' Lt' END AS size,
         CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_partkey // 10 AS VARCHAR) END AS source_id,
         CASE WHEN p_partkey % 11 = 0 THEN 'various' WHEN p_partkey % 13 = 0 THEN '12345' ELSE '94 ' || lpad(CAST(p_partkey // 4 AS VARCHAR), 11, '0') END AS gtin
  FROM part
)"""


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(store_id, snap, product_id): each day's users of a kind of event are that store's listing."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("store_id"), F.to_date("ts").alias("snap"), F.col("user_id").cast("string").alias("product_id")).distinct()


LISTINGS = """
present AS (SELECT DISTINCT event_type AS store_id, CAST(ts AS DATE) AS snap, CAST(user_id AS VARCHAR) AS product_id FROM events),
steps AS (SELECT store_id, snap, lag(snap) OVER w AS before, lead(snap) OVER w AS after FROM (SELECT DISTINCT store_id, snap FROM present) WINDOW w AS (PARTITION BY store_id ORDER BY snap)),
deltas AS (
  SELECT p.store_id, p.snap, p.product_id, 1 AS op FROM present p JOIN steps s USING (store_id, snap)
  WHERE NOT EXISTS (SELECT 1 FROM present q WHERE q.store_id = p.store_id AND q.snap = s.before AND q.product_id = p.product_id)
  UNION ALL
  SELECT p.store_id, s.after, p.product_id, -1 FROM present p JOIN steps s USING (store_id, snap)
  WHERE s.after IS NOT NULL AND NOT EXISTS (SELECT 1 FROM present q WHERE q.store_id = p.store_id AND q.snap = s.after AND q.product_id = p.product_id)
)"""


def product_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_id, hash, observed_at, seq, name, brand, category): what is told of a product changes with the decade of k."""
    rows = events(spark, sf_dir)
    decade = F.expr("k div 25")
    return rows.select(
        "product_id", F.sha2(F.concat_ws("|", "product_id", decade.cast("string")), 256).alias("hash"), "observed_at", "seq",
        F.concat(F.lit("Item "), "product_id", F.lit(" v"), decade.cast("string")).alias("name"), F.concat(F.lit("Brand "), (F.col("seq") % 5).cast("string")).alias("brand"),
    )


PRODUCT_EVENTS = """
pev AS (
  SELECT product_id, sha256(concat_ws('|', product_id, CAST(k // 25 AS VARCHAR))) AS hash, observed_at, seq,
         'Item ' || product_id || ' v' || CAST(k // 25 AS VARCHAR) AS name, 'Brand ' || CAST(seq % 5 AS VARCHAR) AS brand
  FROM obs
)"""
