"""What a price means: filters, effective prices, sales against history, ongoing sales, feeds.

All operators read the flat observation of `schema.OBSERVATION` and take the evaluation time `at` as an argument.
Order is (observed_at, seq). Groups are pre-aggregated before the shuffle, and where the current row of a group is
needed beside its past, it comes back in a join on the group (broadcast while small, split by adaptive execution
where one group is hot), not in a window that would gather the group.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceengine.functions.scalars import half_up, percent2, retailer_label, saved_percent

KEYS = ["product_id", "store_id"]
CURRENCY = "NZD"


def moment(at: datetime | Column) -> Column:
    return at if isinstance(at, Column) else F.lit(at)


def days_before(at: Column, days: int) -> Column:
    return at - F.expr(f"INTERVAL {int(days)} DAY")


def select_history(
    obs: DataFrame, product_id: str | None = None, store_id: str | None = None, retailer: str | None = None, since: datetime | Column | None = None, until: datetime | Column | None = None
) -> DataFrame:
    """Observations that fit all given bounds (inclusive). Plain comparisons, so that they reach the Parquet scan."""
    for name, value in (("product_id", product_id), ("store_id", store_id), ("retailer", retailer)):
        if value is not None:
            obs = obs.where(F.col(name) == value)
    if since is not None:
        obs = obs.where(F.col("observed_at") >= moment(since))
    if until is not None:
        obs = obs.where(F.col("observed_at") <= moment(until))
    return obs


def effective_price(policy: str = "public") -> Column:
    """struct<cents, kind>: the lowest price that the policy shows; of equal ones regular, then promo, then member."""
    kinds = ("regular", "promo", "member") if policy == "member" else ("regular", "promo")
    seen = [F.when(F.col(f"{k}_cents").isNotNull(), F.struct(F.col(f"{k}_cents").alias("cents"), F.lit(i).alias("rank"), F.lit(k).alias("kind"))) for i, k in enumerate(kinds)]
    best = F.least(*seen)
    return F.when(best.isNotNull(), F.struct(best["cents"].alias("cents"), best["kind"].alias("kind")))


def promotion_active(promotion: Column, at: Column) -> Column:
    """Bounds that are missing or unreadable do not bind."""
    starts, ends = promotion["starts_at"].try_cast("timestamp_ntz"), promotion["ends_at"].try_cast("timestamp_ntz")
    return F.coalesce(starts <= at, F.lit(True)) & F.coalesce(ends >= at, F.lit(True))


def latest(obs: DataFrame, keys: list[str], *extra: Column) -> DataFrame:
    """The last row of each key, as the struct `last`, with further aggregates; combined before the shuffle."""
    row = F.struct("observed_at", "seq", *[c for c in obs.columns if c not in ("observed_at", "seq")])
    return obs.groupBy(*keys).agg(F.max_by(row, F.struct("observed_at", "seq")).alias("last"), *extra)


def history_sales(
    obs: DataFrame,
    at: datetime | Column,
    fresh_days: int = 7,
    baseline_days: int = 90,
    min_samples: int = 2,
    min_drop: float = 0.0,
    include_all_time_lows: bool = True,
    policy: str = "public",
    products: DataFrame | None = None,
) -> DataFrame:
    """Offers whose current price lies under their own recent average, or under all they ever were.

    `products`: a table of product_id to which the search is bound (a semi join). An average of 0 has no drop: such
    rows are kept with a null drop.
    """
    if products is not None:
        obs = obs.join(products.select("product_id").distinct(), "product_id", "left_semi")
    at = moment(at)
    priced = obs.select(*KEYS, "retailer", "observed_at", "seq", effective_price(policy).alias("price"))
    current = (
        latest(priced, KEYS, F.count(F.lit(1)).alias("n"))
        .where((F.col("n") >= 2) & (F.col("last.observed_at") >= days_before(at, fresh_days)))
        .select(*[F.col(k).alias(f"c_{k}") for k in KEYS], F.col("last").alias("cur"))
    )
    in_baseline = F.col("observed_at") >= days_before(F.col("cur.observed_at"), baseline_days)
    past = (
        priced.join(current, (F.col("product_id") == F.col("c_product_id")) & (F.col("store_id") == F.col("c_store_id")))
        .where(F.struct("observed_at", "seq") < F.struct("cur.observed_at", "cur.seq"))
        .groupBy(*KEYS)
        .agg(
            F.first("cur").alias("cur"), F.min("price.cents").alias("previous_low_cents"),
            F.sum(F.when(in_baseline, F.col("price.cents"))).alias("total"), F.count_if(in_baseline).alias("sample_count"),
        )
        .where(F.col("sample_count") >= min_samples)
    )
    cents = F.col("cur.price.cents")
    average = F.col("total").cast("double") / F.col("sample_count").cast("double")
    drop = F.try_divide(average - cents.cast("double"), average) * F.lit(100.0)
    low = cents < F.col("previous_low_cents")
    keep = drop.isNull() | (drop >= F.lit(float(min_drop)))
    if include_all_time_lows:
        keep = keep | low
    return past.where(keep).select(
        *KEYS, F.col("cur.retailer").alias("retailer"), cents.alias("current_cents"), F.col("cur.price.kind").alias("price_kind"),
        F.col("cur.observed_at").alias("observed_at"), half_up(average).alias("average_cents"), "sample_count",
        percent2(F.try_divide(average - cents.cast("double"), average) * F.lit(100.0)).alias("drop_percent"), "previous_low_cents", low.alias("is_all_time_low"),
    )


def ongoing_sales(obs: DataFrame, at: datetime | Column, fresh_days: int = 7, policy: str = "public", retailer: str | None = None, store_id: str | None = None, products: DataFrame | None = None) -> DataFrame:
    """Offers whose last observation is a live advertised promotion."""
    at = moment(at)
    obs = select_history(obs, store_id=store_id, retailer=retailer, until=at)
    if products is not None:
        obs = obs.join(products.select("product_id").distinct(), "product_id", "left_semi")
    last = latest(obs, KEYS).select("last.*")
    seen = F.coalesce("last_seen_at", "observed_at")
    offered = F.col("promo_cents").isNotNull()
    if policy == "member":
        offered = offered | F.col("member_cents").isNotNull()
    live = last.where(
        (seen >= days_before(at, fresh_days)) & F.coalesce("is_on_special", F.lit(True)) & F.col("promotion").isNotNull() & promotion_active(F.col("promotion"), at) & offered
    ).withColumn("price", effective_price(policy))
    cents = F.col("price.cents")
    return live.select(
        *KEYS, "retailer", cents.alias("current_cents"), F.col("price.kind").alias("price_kind"), seen.alias("observed_at"), "regular_cents",
        F.when(F.col("regular_cents") > cents, saved_percent(F.col("regular_cents"), cents)).otherwise(F.col("promotion.save_percent")).alias("save_percent"),
        F.col("promotion.type").alias("promotion_type"),
    )


def agent_feed(obs: DataFrame, at: datetime | Column, limit: int | None = None, **options: object) -> DataFrame:
    """Both kinds of sales as one table of flat cards; `limit` counts for each kind. Options are those of both searches."""
    shared = {k: v for k, v in options.items() if k in ("fresh_days", "policy", "products")}
    ongoing = ongoing_sales(obs, at, **shared).select(
        F.lit("ongoing").alias("feed"), *KEYS, "retailer", "current_cents", "price_kind", "observed_at", "regular_cents", F.col("save_percent").alias("percent"),
        F.lit(None).cast("long").alias("baseline_average_cents"), F.lit(None).cast("long").alias("baseline_sample_count"), F.lit(None).cast("boolean").alias("is_all_time_low"),
    )
    backed = history_sales(select_history(obs, until=at), at, **options).select(
        F.lit("history").alias("feed"), *KEYS, "retailer", "current_cents", "price_kind", "observed_at", F.lit(None).cast("long").alias("regular_cents"), F.col("drop_percent").alias("percent"),
        F.col("average_cents").alias("baseline_average_cents"), F.col("sample_count").alias("baseline_sample_count"), "is_all_time_low",
    )
    if limit is not None:
        order = (F.desc(F.coalesce("percent", F.lit(0.0))), *KEYS)
        ongoing, backed = ongoing.orderBy(*order).limit(limit), backed.orderBy(*order).limit(limit)
    return ongoing.unionByName(backed).withColumn("currency", F.lit(CURRENCY))


def archive_stats(obs: DataFrame) -> DataFrame:
    """One row: rows, products, stores, retailers, first and last time."""
    return obs.agg(
        F.count(F.lit(1)).alias("observations"), F.count_distinct("product_id").alias("products"), F.count_distinct("store_id").alias("stores"),
        F.count_distinct("retailer").alias("retailers"), F.min("observed_at").alias("earliest"), F.max("observed_at").alias("latest"),
    )


def latest_by_product(obs: DataFrame, search: str | None = None) -> DataFrame:
    """Each product's newest row, the first of equally new ones; `search` looks in name and brand."""
    row = F.struct("retailer", "store_id", "product_name", "brand", F.col("observed_at").alias("last_seen"))
    found = obs.groupBy("product_id").agg(F.max_by(row, F.struct("observed_at", -F.col("seq"))).alias("last")).select("product_id", "last.*")
    if search:
        wanted = F.lit(search.lower())
        found = found.where(F.contains(F.lower("product_name"), wanted) | F.coalesce(F.contains(F.lower("brand"), wanted), F.lit(False)))
    return found


def distinct_stores(obs: DataFrame) -> DataFrame:
    """Each (store, retailer) with the time of its first row."""
    return obs.groupBy("store_id", "retailer").agg(F.min_by("observed_at", F.col("seq")).alias("first_at")).withColumn("retailer_name", retailer_label(F.col("retailer")))
