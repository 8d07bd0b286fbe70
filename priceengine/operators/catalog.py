"""Products, stores and their histories as a catalogue is asked for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceengine.functions.scalars import escaped_like, half_up, namespace, retailer_label
from priceengine.operators.ordering import numbered


def product_dimension(revisions: DataFrame) -> DataFrame:
    """One row for each product id: the last appended data, the first appended time as first_seen_at, the retailer from the id.

    revisions: (product_id, hash, observed_at, seq, data columns ...).
    """
    data = [c for c in revisions.columns if c not in ("product_id", "observed_at", "seq")]
    row = F.struct(*data, F.col("observed_at").alias("updated_at"))
    out = revisions.groupBy("product_id").agg(F.max_by(row, F.col("seq")).alias("last"), F.min_by("observed_at", F.col("seq")).alias("first_seen_at"))
    return out.select("product_id", namespace(F.col("product_id")).alias("retailer"), "last.*", "first_seen_at")


def context_dimension(revisions: DataFrame) -> DataFrame:
    """One row for each (retailer, store): the last appended data and context_id, numbered by the first appended row. seq: of any type that has an order."""
    data = [c for c in revisions.columns if c not in ("retailer", "store_id", "observed_at", "seq")]
    out = numbered(revisions.groupBy("retailer", "store_id").agg(F.max_by(F.struct(*data), F.col("seq")).alias("last"), F.min("seq").alias("first_seq")), "first_seq", "context_id")
    return out.select("context_id", "retailer", "store_id", "last.*", F.lit("physical-store").alias("scope_kind"), retailer_label(F.col("retailer")).alias("retailer_name"))


def offer_facts(offers: DataFrame, contexts: DataFrame) -> DataFrame:
    """Offers of known contexts, valid prices only, the first appended of equal (product, context, hash, time)."""
    met = offers.where(F.col("regular_cents") >= 0).join(contexts.select("context_id", "store_id"), "store_id")
    row = F.struct(*met.columns)
    return met.groupBy("product_id", "context_id", "hash", "observed_at").agg(F.min_by(row, F.col("seq")).alias("row")).select("row.*")


def snapshot_facts(snapshots: DataFrame, contexts: DataFrame) -> DataFrame:
    """Snapshots with the context_id of their store, each row kept; those of unknown stores go. Missing counts and lists are 0 and empty."""
    met = snapshots.join(contexts.select("context_id", "store_id"), "store_id").drop("store_id")
    none = F.array().cast("array<string>")
    return met.withColumns({"offer_count": F.coalesce("offer_count", F.lit(0).cast("long")), "added": F.coalesce("added", none), "removed": F.coalesce("removed", none)})


def star(facts: DataFrame, products: DataFrame, contexts: DataFrame) -> DataFrame:
    """Facts with the current columns of their product and context; those without either go. Small dimensions are broadcast by size."""
    return facts.join(products, "product_id").join(contexts, "context_id")


def listed_stores(contexts: DataFrame) -> DataFrame:
    """Contexts by retailer and store name, as a reader of any language sorts them."""
    return contexts.orderBy(F.collate("retailer_name", "UNICODE"), F.collate("store_name", "UNICODE"), "context_id")


def name_contains(query: str) -> Column:
    return F.col("name").ilike(f"%{escaped_like(query)}%")


def search_products(products: DataFrame, query: str = "", retailer: str = "", category: str = "") -> DataFrame:
    if query:
        products = products.where(name_contains(query))
    if retailer:
        products = products.where(F.col("retailer") == retailer)
    if category:
        products = products.where(F.col("category") == category)
    return products


def by_relevance(products: DataFrame, query: str = "", limit: int = 42, offset: int = 0) -> DataFrame:
    """A page: exact names first, then names that contain the query, newest first."""
    order = [F.desc("updated_at"), F.asc("product_id")]
    if query:
        rank = F.when(F.col("name") == query, 0).when(name_contains(query), 1).otherwise(2)
        order = [rank.asc(), *order]
    return products.orderBy(*order).offset(offset).limit(limit)


def suggestions(products: DataFrame, query: str, limit: int = 10) -> DataFrame:
    if not 2 <= len(query) <= 100:
        raise ValueError("a query has 2 to 100 characters")
    return products.where(name_contains(query)).select("name").distinct().orderBy("name").limit(limit)


def current_offers(facts: DataFrame, product: DataFrame | None = None) -> DataFrame:
    """The newest facts of each (product, context); equally new ones all stay."""
    if product is not None:
        facts = facts.join(product.select("product_id").distinct(), "product_id", "left_semi")
    newest = facts.groupBy("product_id", "context_id").agg(F.max("observed_at").alias("observed_at"))
    return facts.join(newest, ["product_id", "context_id", "observed_at"], "left_semi")


def price_history(facts: DataFrame, product_id: str, limit: int = 200, context_id: int | None = None) -> DataFrame:
    """A product's newest facts."""
    facts = facts.where(F.col("product_id") == product_id)
    if context_id is not None:
        facts = facts.where(F.col("context_id") == context_id)
    return facts.orderBy(F.desc("observed_at"), F.desc("seq")).limit(limit)


def chart_points(series: DataFrame, key: str, step: int) -> DataFrame:
    """Every step-th row of each series by (observed_at, seq), and its last."""
    by = Window.partitionBy(key).orderBy("observed_at", "seq")
    ranked = series.withColumns({"point": F.row_number().over(by) - 1, "__left": F.lead("seq").over(by)})
    return ranked.where((F.col("point") % step == 0) | F.col("__left").isNull()).drop("__left")


def chart_bounds(series: DataFrame, key: str) -> DataFrame:
    prices = ["regular_cents", "promo_cents", "member_cents"]
    return series.groupBy(key).agg(F.min(F.least(*prices)).alias("low_cents"), F.max(F.greatest(*prices)).alias("high_cents"), F.count(F.lit(1)).alias("points"))


def axis_points(bounds: DataFrame, key: str, ticks: int = 5) -> DataFrame:
    """`ticks` evenly spread indexes into each series' points, first and last included."""
    at = half_up(F.col("tick").cast("double") / F.lit(float(max(ticks - 1, 1))) * (F.col("points") - 1).cast("double"))
    return bounds.select(key, "points", F.explode(F.sequence(F.lit(0), F.lit(ticks - 1))).alias("tick")).select(key, "tick", at.alias("point"))


def import_counters(lines: DataFrame) -> DataFrame:
    """One row: records of each kind, errors. lines: (kind) with null for what could not be read."""
    kinds = ("product", "store", "offer", "snapshot", "legacy")
    return lines.agg(
        F.count(F.lit(1)).alias("lines"), *[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in kinds],
        F.count_if(F.col("kind").isNull()).alias("errors"), F.count_if(F.col("kind").isNotNull()).alias("records_imported"),
    )
