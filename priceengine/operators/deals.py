"""The public deal list: history-backed and advertised deals, one card an offer, ordered for a user."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceengine.functions.scalars import after_namespace, half_up, retailer_label
from priceengine.operators.prices import KEYS, days_before, history_sales, moment, ongoing_sales, select_history

BASELINE_DAYS, FRESH_DAYS, MIN_SAMPLES = 90, 7, 3
TIERS = ("watch-preferred", "watch-other", "all")


def with_reductions(obs: DataFrame) -> DataFrame:
    """is_on_special: a price under the regular one; without one the promotion does not count."""
    lower = F.coalesce(F.col("promo_cents") < F.col("regular_cents"), F.lit(False)) | F.coalesce(F.col("member_cents") < F.col("regular_cents"), F.lit(False))
    return obs.withColumns({"is_on_special": lower, "promotion": F.when(lower, F.col("promotion")), "last_seen_at": F.col("observed_at")})


def _percent_text(percent: Column) -> Column:
    return F.concat(half_up(percent).cast("string"), F.lit("% off"))


def public_deals(obs: DataFrame, at: datetime | Column, retailer: str | None = None, kind: str = "all") -> DataFrame:
    """One card for each offer with a deal: history-backed where it is, else advertised. kind: all, history-backed or advertised.

    Only the last BASELINE_DAYS are looked at, so an all-time low is the lowest of these.
    """
    if kind not in ("all", "history-backed", "advertised"):
        raise ValueError("kind must be all, history-backed or advertised")
    at = moment(at)
    seen = with_reductions(select_history(obs, retailer=retailer, since=days_before(at, BASELINE_DAYS), until=at))
    drop = F.coalesce("drop_percent", F.lit(0.0))
    backed = history_sales(seen, at, FRESH_DAYS, BASELINE_DAYS, MIN_SAMPLES).where((drop > 0) | F.col("is_all_time_low")).select(
        *KEYS, "retailer", F.when(F.col("is_all_time_low"), "all_time_low").otherwise("history_drop").alias("kind"), F.col("drop_percent").alias("percent"),
        F.col("average_cents").alias("reference_cents"), "current_cents", F.when(drop > 0, _percent_text(drop)).otherwise("All-time low").alias("savings_text"), F.col("observed_at").alias("calculated_at"),
    )
    advertised = ongoing_sales(seen, at, FRESH_DAYS).where(F.coalesce("save_percent", F.lit(0.0)) > 0).select(
        *KEYS, "retailer", F.lit("advertised_only").alias("kind"), F.col("save_percent").alias("percent"),
        F.col("regular_cents").alias("reference_cents"), "current_cents", _percent_text(F.col("save_percent")).alias("savings_text"), F.col("observed_at").alias("calculated_at"),
    )
    if kind == "history-backed":
        cards = backed
    elif kind == "advertised":
        cards = advertised
    else:
        # one pass over the few cards: the history-backed one of an offer wins
        card = F.struct("retailer", "kind", "percent", "reference_cents", "current_cents", "savings_text", "calculated_at")
        rank = F.when(F.col("kind") == "advertised_only", 1).otherwise(0)
        cards = backed.unionByName(advertised).groupBy(*KEYS).agg(F.min_by(card, rank).alias("card")).select(*KEYS, "card.*")
    return cards.withColumn("retailer_name", retailer_label(F.col("retailer")))


def deal_order() -> list[Column]:
    """History-backed first, then by percent, then by offer."""
    return [F.when(F.col("kind") == "advertised_only", 1).otherwise(0).asc(), F.desc(F.coalesce("percent", F.lit(0.0))), *[F.col(k).asc() for k in KEYS]]


def top_deals(cards: DataFrame, limit: int = 120) -> DataFrame:
    return cards.orderBy(*deal_order()).limit(limit)


def with_tiers(cards: DataFrame, watched: DataFrame, preferred: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """`cards` with tier: watched products at preferred stores, watched elsewhere, all others.

    watched: (target_kind, target_id) with product ids and categories (`namespace:category` or bare); preferred:
    (store_id). categories: (product_id, category). A user's own lists: Spark broadcasts them while small.
    """
    targets = watched.where(F.col("target_kind") == "product").select(F.col("target_id").alias("product_id")).distinct().withColumn("__watched", F.lit(True))
    out = cards.join(targets, "product_id", "left")
    hit = F.coalesce("__watched", F.lit(False))
    if categories is not None:
        kinds = watched.where(F.col("target_kind") == "category").select(after_namespace(F.col("target_id")).alias("category")).distinct().withColumn("__in", F.lit(True))
        in_category = categories.join(kinds, "category").select("product_id", "__in").distinct()
        out = out.join(in_category, "product_id", "left")
        hit = hit | F.coalesce("__in", F.lit(False))
    out = out.join(preferred.select("store_id").distinct().withColumn("__here", F.lit(True)), "store_id", "left")
    tier = F.when(~hit, TIERS[2]).when(F.coalesce("__here", F.lit(False)), TIERS[0]).otherwise(TIERS[1])
    return out.withColumn("tier", tier).drop("__watched", "__in", "__here")


def tier_counts(cards: DataFrame) -> DataFrame:
    return cards.groupBy("tier").agg(F.count(F.lit(1)).alias("deals"))


def tiered_deals(cards: DataFrame, limit: int = 120) -> DataFrame:
    """The first `limit` cards by tier, then as `top_deals`."""
    rank = F.when(F.col("tier") == TIERS[0], 0).when(F.col("tier") == TIERS[1], 1).otherwise(2)
    return cards.orderBy(rank.asc(), *deal_order()).limit(limit)


def coverage(contexts: DataFrame, offers: DataFrame) -> DataFrame:
    """One row: stores known, stores with offers, and their share in whole percent."""
    known = contexts.agg(F.count_distinct("context_id").alias("total_stores"))
    used = offers.agg(F.count_distinct("context_id").alias("stores_with_data"))
    share = F.try_divide(F.col("stores_with_data").cast("double"), F.col("total_stores").cast("double")) * F.lit(100.0)
    # both are one row
    return known.join(F.broadcast(used), F.lit(True)).select("total_stores", "stores_with_data", half_up(share).alias("coverage_percent"))
