"""What a caller gets: the feed with the defaults of the command line, and answers in the server's envelope."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceengine.operators.prices import KEYS, agent_feed, select_history

#: The defaults of the command line, and the longest page of an answer.
DEFAULTS = {"min_drop": 20.0, "min_samples": 2, "baseline_days": 90, "fresh_days": 7, "include_all_time_lows": True}
MAX_PAGE = 200


def feed(obs: DataFrame, at: datetime | Column, only: str | None = None, retailer: str | None = None, store_id: str | None = None, products: DataFrame | None = None, member_prices: bool = False, limit: int | None = None, **changed: object) -> DataFrame:
    """Price drops behind histories and live promotions, as one table; `only`: `ongoing` or `history`. `changed` replaces defaults by name."""
    unknown = changed.keys() - DEFAULTS.keys()
    if unknown:
        raise TypeError(f"no option {', '.join(sorted(unknown))}")
    rows = agent_feed(select_history(obs, store_id=store_id, retailer=retailer), at, limit, policy="member" if member_prices else "public", products=products, **(DEFAULTS | changed))
    return rows if only is None else rows.where(F.col("feed") == only)


def array_body(rows: DataFrame, order: list[Column | str], limit: int = MAX_PAGE) -> DataFrame:
    """One row, `body`: a JSON array of the first rows. No more than MAX_PAGE rows come together."""
    if not 0 <= limit <= MAX_PAGE:
        raise ValueError(f"a page has up to {MAX_PAGE} rows")
    page = rows.orderBy(*order).limit(limit).withColumn("__n", F.monotonically_increasing_id())
    item = F.struct(*[c for c in rows.columns])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__n", item.alias("item")))), lambda x: x["item"])
    return page.agg(F.to_json(listed, {"ignoreNullFields": "false"}).alias("body"))


def object_body(rows: DataFrame, order: list[Column | str], request_id: str, manifest: dict | None, name: str = "items", limit: int = MAX_PAGE, **more: Column) -> DataFrame:
    """One row, `body`: a JSON object of the page under `name`, the request and how fresh the published tables are; `more` are further members, made from no row."""
    told = manifest or {}
    fresh = F.struct(
        F.lit(manifest is not None).alias("exists"), F.lit(told.get("fingerprint")).cast("string").alias("fingerprint"), F.lit(told.get("built_at")).cast("string").alias("builtAt"),
        F.lit(told.get("records")).cast("long").alias("recordsImported"),
    )
    page = array_body(rows, order, limit)
    head = F.struct(F.lit(request_id).alias("_requestId"), fresh.alias("_freshness"), *[c.alias(k) for k, c in more.items()])
    start = F.to_json(head, {"ignoreNullFields": "false"})
    return page.select(F.concat(F.substring(start, 1, F.char_length(start) - 1), F.lit(f',"{name}":'), "body", F.lit("}")).alias("body"))


def percent_order() -> list[Column]:
    return [F.desc(F.coalesce("percent", F.lit(0.0))), F.asc("feed"), *[F.asc(k) for k in KEYS]]
