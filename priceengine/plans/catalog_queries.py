"""Queries on the projection, the catalogue and charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceengine.functions.scalars import RETAILERS
from priceengine.operators import catalog
from priceengine.plans.registry import query
from priceengine.plans.views import EVENTS, PRODUCT_EVENTS, PRODUCTS, events, product_events, products, stream_folder, table

_DIM = """dim AS (SELECT product_id, split_part(product_id, ':', 1) AS retailer, arg_max(hash, seq) AS hash, arg_max(name, seq) AS name, arg_max(brand, seq) AS brand, arg_max(observed_at, seq) AS updated_at, arg_min(observed_at, seq) AS first_seen_at FROM pev GROUP BY product_id)"""


@query(f"WITH {EVENTS}, {PRODUCT_EVENTS}, {_DIM} SELECT * FROM dim")
def dim_products_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.product_dimension(product_events(spark, sf_dir))


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("retailer", "store_id", "observed_at", "seq", F.concat(F.lit("Store "), "store_id", F.lit(" "), (F.col("k") % 3).cast("string")).alias("store_name"))
    return catalog.context_dimension(rows)


_CONTEXTS = """ctx AS (SELECT row_number() OVER (ORDER BY first_seq) AS context_id, retailer, store_id, store_name, 'physical-store' AS scope_kind, retailer AS retailer_name
FROM (SELECT retailer, store_id, arg_max('Store ' || store_id || ' ' || CAST(k % 3 AS VARCHAR), seq) AS store_name, min(seq) AS first_seq FROM obs GROUP BY ALL))"""


@query(f"WITH {EVENTS}, {_CONTEXTS} SELECT * FROM ctx")
def dim_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contexts(spark, sf_dir)


@query(f"WITH {EVENTS}, {_CONTEXTS} SELECT context_id, store_id, store_name, retailer_name FROM ctx ORDER BY retailer_name, store_name, context_id")
def stores_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.listed_stores(_contexts(spark, sf_dir)).select("context_id", "store_id", "store_name", "retailer_name")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _contexts(spark, sf_dir).where(F.col("store_id") != "error")
    offers = events(spark, sf_dir).select("product_id", "store_id", F.expr("cast(k div 10 as string)").alias("hash"), F.date_trunc("day", "observed_at").cast("timestamp_ntz").alias("observed_at"), "seq", "regular_cents", "promo_cents", "member_cents")
    return catalog.offer_facts(offers, known)


_FACTS = f"""{_CONTEXTS}, facts AS (SELECT * EXCLUDE (rn) FROM (
  SELECT o.product_id, o.store_id, CAST(k // 10 AS VARCHAR) AS hash, date_trunc('day', observed_at) AS observed_at, seq, regular_cents, promo_cents, member_cents, c.context_id,
         row_number() OVER (PARTITION BY o.product_id, c.context_id, k // 10, date_trunc('day', observed_at) ORDER BY seq) AS rn
  FROM obs o JOIN ctx c ON c.store_id = o.store_id WHERE c.store_id <> 'error' AND regular_cents >= 0) WHERE rn = 1)"""


@query(f"WITH {EVENTS}, {_FACTS} SELECT * FROM facts")
def offer_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir)


@query(f"""WITH {EVENTS}, {_CONTEXTS} SELECT o.seq, c.context_id, o.observed_at, 'specials' AS scope, CASE WHEN k % 3 = 0 THEN 0 ELSE k END AS offer_count, CASE WHEN k % 4 = 0 THEN 0 ELSE 2 END AS n_added, 0 AS n_removed
FROM obs o JOIN ctx c USING (store_id) WHERE store_id <> 'error'""")
def snapshot_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every snapshot of a known store, without repeats taken out; some lack their count or list."""
    known, k = _contexts(spark, sf_dir).where(F.col("store_id") != "error"), F.col("k")
    snapshots = events(spark, sf_dir).select(
        "seq", "store_id", "observed_at", F.lit("specials").alias("scope"), F.when(k % 3 != 0, k).alias("offer_count"),
        F.when(k % 4 != 0, F.array(F.col("product_id"), F.lit("x"))).alias("added"), F.lit(None).cast("array<string>").alias("removed"),
    )
    out = catalog.snapshot_facts(snapshots, known)
    return out.select("seq", "context_id", "observed_at", "scope", "offer_count", F.size("added").alias("n_added"), F.size("removed").alias("n_removed"))


@query(f"""WITH {EVENTS}, {_FACTS}, {PRODUCT_EVENTS}, {_DIM}
SELECT f.seq, f.product_id, f.observed_at, f.regular_cents, d.name, c.store_name, c.retailer_name FROM facts f JOIN dim d USING (product_id) JOIN ctx c USING (context_id) WHERE f.observed_at >= TIMESTAMP '2024-01-10 00:00:00'""")
def star_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import datetime

    from priceengine.plans.views import ntz

    facts = _facts(spark, sf_dir).where(F.col("observed_at") >= ntz(datetime(2024, 1, 10))).drop("store_id", "hash")
    dim = catalog.product_dimension(product_events(spark, sf_dir)).select("product_id", "name")
    return catalog.star(facts, dim, _contexts(spark, sf_dir).select("context_id", "store_name", "retailer_name")).select("seq", "product_id", "observed_at", "regular_cents", "name", "store_name", "retailer_name")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).select(F.col("id").alias("product_id"), "retailer", "name", "brand", "category", (F.col("seq") * 7 % 1000).alias("updated_at"))


_NAMED = f"{PRODUCTS}, named AS (SELECT id AS product_id, retailer, name, brand, category, seq * 7 % 1000 AS updated_at FROM products)"


@query(f"""WITH {_NAMED} SELECT * FROM named WHERE name ILIKE '%ring%' AND retailer = 'newworld'
ORDER BY CASE WHEN name = 'ring' THEN 0 WHEN name ILIKE '%ring%' THEN 1 ELSE 2 END, updated_at DESC, product_id LIMIT 42 OFFSET 5""")
def product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.by_relevance(catalog.search_products(_named(spark, sf_dir), "ring", "newworld"), "ring", limit=42, offset=5)


@query(f"WITH {_NAMED} SELECT count(*) AS total FROM named WHERE name ILIKE '%RED%' AND category = 'PROMO'")
def product_search_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search_products(_named(spark, sf_dir), "RED", category="PROMO").agg(F.count(F.lit(1)).alias("total"))


@query(f"WITH {_NAMED} SELECT DISTINCT name FROM named WHERE name ILIKE '%bo%' ORDER BY name LIMIT 10")
def search_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.suggestions(_named(spark, sf_dir), "bo")


@query(f"WITH {EVENTS}, {_FACTS} SELECT product_id, context_id, observed_at, seq, regular_cents, promo_cents FROM facts QUALIFY rank() OVER (PARTITION BY product_id, context_id ORDER BY observed_at DESC) = 1")
def product_detail_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.current_offers(_facts(spark, sf_dir)).select("product_id", "context_id", "observed_at", "seq", "regular_cents", "promo_cents")


@query(f"WITH {EVENTS}, {_FACTS} SELECT product_id, context_id, observed_at, seq, regular_cents FROM facts WHERE product_id = '7' ORDER BY observed_at DESC, seq DESC LIMIT 200")
def product_price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.price_history(_facts(spark, sf_dir), "7").select("product_id", "context_id", "observed_at", "seq", "regular_cents")


@query(f"WITH {EVENTS}, {PRODUCT_EVENTS} SELECT product_id, hash, arg_min(observed_at, seq) AS observed_at, min(seq) AS seq, arg_min(name, seq) AS name FROM pev GROUP BY product_id, hash")
def product_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product's metadata history."""
    rows = product_events(spark, sf_dir)
    return rows.groupBy("product_id", "hash").agg(F.min_by("observed_at", F.col("seq")).alias("observed_at"), F.min("seq").alias("seq"), F.min_by("name", F.col("seq")).alias("name"))


@query(f"""WITH {EVENTS}, p AS (SELECT product_id, observed_at, seq, row_number() OVER w - 1 AS point, lead(seq) OVER w AS nxt FROM obs WINDOW w AS (PARTITION BY product_id ORDER BY observed_at, seq))
SELECT product_id, seq, CAST(point AS INTEGER) AS point FROM p WHERE point % 5 = 0 OR nxt IS NULL""")
def chart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.chart_points(events(spark, sf_dir), "product_id", 5).select("product_id", "seq", "point")


_BOUNDS = """b AS (SELECT product_id, min(least(regular_cents, promo_cents, member_cents)) AS low_cents, max(greatest(regular_cents, promo_cents, member_cents)) AS high_cents, count(*) AS points FROM obs GROUP BY product_id)"""


@query(f"WITH {EVENTS}, {_BOUNDS} SELECT * FROM b")
def chart_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.chart_bounds(events(spark, sf_dir), "product_id")


@query(f"WITH {EVENTS}, {_BOUNDS} SELECT product_id, CAST(tick AS INTEGER) AS tick, CAST(floor(tick / 4.0e0 * CAST(points - 1 AS DOUBLE) + 0.5e0) AS BIGINT) AS point FROM b, range(0, 5) t(tick)")
def chart_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.axis_points(catalog.chart_bounds(events(spark, sf_dir), "product_id"), "product_id")


@query("""WITH l AS (SELECT CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'legacy' WHEN event_id % 5 = 1 THEN 'product' WHEN event_id % 5 = 2 THEN 'store' WHEN event_id % 5 = 3 THEN 'snapshot' ELSE 'offer' END AS kind FROM events)
SELECT count(*) AS lines, count(*) FILTER (WHERE kind = 'product') AS products, count(*) FILTER (WHERE kind = 'store') AS stores, count(*) FILTER (WHERE kind = 'offer') AS offers,
count(*) FILTER (WHERE kind = 'snapshot') AS snapshots, count(*) FILTER (WHERE kind = 'legacy') AS legacys, count(*) FILTER (WHERE kind IS NULL) AS errors, count(kind) AS records_imported FROM l""")
def import_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive lines made from events, parsed as the import does."""
    return catalog.import_counters(_archive_lines(spark, sf_dir))


@query("""SELECT count(*) AS errors, substr(string_agg('Line ' || (event_id + 1) || ': ' || CASE WHEN event_id % 34 = 0 THEN 'not JSON' ELSE 'no record of the archive' END, chr(10) ORDER BY event_id), 1, 10000) AS error_detail
FROM events WHERE event_id % 17 = 0""")
def import_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from priceengine.sources.archive import error_detail

    return error_detail(_archive_lines(spark, sf_dir))


def _archive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from priceengine.sources.archive import parsed

    i = F.col("event_id")
    record = lambda kind, **more: F.to_json(F.struct(F.lit(2).alias("version"), F.lit(kind).alias("type"), *[v.alias(k) for k, v in more.items()]))
    obj = F.struct(F.lit("a:b").alias("id"))
    old = F.to_json(F.struct(obj.alias("product"), obj.alias("store"), F.struct(F.lit(1).alias("regularCents")).alias("price"), F.struct(F.lit("1").alias("retailerProductId")).alias("source")))
    line = (
        F.when(i % 34 == 0, F.lit("{broken")).when(i % 17 == 0, F.lit('{"hello":"world"}')).when(i % 5 == 0, old).when(i % 5 == 1, record("product", productId=F.lit("a:b")))
        .when(i % 5 == 2, record("store", storeId=F.lit("a:s"))).when(i % 5 == 3, record("snapshot", storeId=F.lit("a:s"))).otherwise(record("offer", productId=F.lit("a:b"), storeId=F.lit("a:s")))
    )
    return parsed(table(spark, sf_dir, "events").select((i + 1).alias("line"), line.alias("value")))


_LABELS = "CASE id " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in RETAILERS.items()) + " ELSE id END"


@query(f"""WITH {PRODUCTS} SELECT id AS retailer, {_LABELS} AS retailer_name, n AS products FROM (SELECT retailer AS id, count(*) AS n FROM products GROUP BY retailer)""")
def dim_retailers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from priceengine.functions.scalars import retailer_label

    return products(spark, sf_dir).groupBy("retailer").agg(F.count(F.lit(1)).alias("products")).withColumn("retailer_name", retailer_label(F.col("retailer")))


@query(f"""WITH {PRODUCTS} SELECT id AS product_id, name, brand, {_LABELS.replace('CASE id', 'CASE retailer').replace('ELSE id', 'ELSE retailer')} AS retailer_name, strftime(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * seq, '%Y-%m-%dT%H:%M:%S.000Z') AS first_seen,
regexp_matches(id, '^[a-z]+:[a-zA-Z0-9_-]+$') AS valid_id FROM products""")
def product_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products as they are shown: labels, times as ISO text, whether the id is well formed."""
    from priceengine.functions.scalars import PRODUCT_ID, retailer_label

    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("seq").cast("int"))
    return products(spark, sf_dir).select(
        F.col("id").alias("product_id"), "name", "brand", retailer_label(F.col("retailer")).alias("retailer_name"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("first_seen"), F.col("id").rlike(PRODUCT_ID).alias("valid_id")
    )


@query(f"WITH {EVENTS} SELECT product_id, store_id, observed_at, seq, regular_cents FROM obs WHERE product_id = '7' AND observed_at >= TIMESTAMP '2024-01-10 00:00:00'")
def published_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers published in folders by month and in order of products within, of which a product's history reads a part."""
    from datetime import datetime

    from priceengine.sources import versions

    root = f"{stream_folder(spark)}/published"
    offers = events(spark, sf_dir).select("product_id", "store_id", "observed_at", "seq", "regular_cents")
    versions.publish(spark, {"offers": offers}, root, "events", layouts={"offers": versions.month_layout()}, checks={"offers": {"a price": F.col("regular_cents") >= 0}})
    return versions.product_history(spark, root, "7", since=datetime(2024, 1, 10)).drop("month")
