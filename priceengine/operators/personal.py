"""A user's own lists as keyed merges: watch list, preferred stores, saved searches, rate limits, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceengine.functions.scalars import plain


def watch_merge(stored: DataFrame, added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """(user_id, target_kind, target_id, created_at): entries added once, the stored one stays; a user removes own entries only."""
    keys = ["user_id", "target_kind", "target_id"]
    new = added.where(F.col("target_kind").isin("product", "category")).groupBy(*keys).agg(F.min("created_at").alias("created_at"))
    out = stored.select(*keys, "created_at").unionByName(new.join(stored, keys, "left_anti").select(*keys, "created_at"))
    return out if removed is None else out.join(removed, keys, "left_anti")


def preference_merge(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """(user_id, context_id, rank): the last change of a key counts; rank 0 takes it out. changes have seq."""
    keys = ["user_id", "context_id"]
    last = changes.groupBy(*keys).agg(F.max_by("rank", F.col("seq")).alias("rank"))
    return stored.select(*keys, "rank").join(last, keys, "left_anti").unionByName(last.where(F.col("rank") > 0))


def ranked_preferences(stored: DataFrame) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("rank", "context_id")
    return stored.withColumn("position", F.row_number().over(by))


def saved_searches(rows: DataFrame) -> DataFrame:
    """One search for each user and normalised query, the first made. rows: (user_id, query, created_at, seq)."""
    text = plain(F.col("query"))
    keyed = rows.where(text.isNotNull()).select("user_id", "query", "created_at", "seq", text.alias("normalised"), F.sha2(text, 256).alias("query_hash"))
    first = keyed.groupBy("user_id", "query_hash").agg(F.min_by(F.struct("query", "normalised", "created_at"), F.col("seq")).alias("row"))
    return first.select("user_id", "query_hash", "row.*")


def admitted(requests: DataFrame, window: str, limit: int, key: str = "bucket_key", time: str = "at") -> DataFrame:
    """`requests` with window_start and admitted: the first `limit` of a key in each fixed window."""
    out = requests.withColumn("window_start", F.window(time, window)["start"])
    by = Window.partitionBy(key, "window_start").orderBy(time, "seq")
    return out.withColumn("admitted", F.row_number().over(by) <= limit)


def window_counts(requests: DataFrame, window: str, limit: int, key: str = "bucket_key", time: str = "at") -> DataFrame:
    """(key, window_start, requests, rejected) by counting alone: how many the limit lets through needs no order."""
    counted = requests.groupBy(key, F.window(time, window)["start"].alias("window_start")).agg(F.count(F.lit(1)).alias("requests"))
    return counted.withColumn("rejected", F.greatest(F.col("requests") - limit, F.lit(0).cast("long")))


def active_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.where(F.col("expires_at") > now)


def swept(sessions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(sessions that stay, one row: how many have expired and go). A session goes at the moment it expires."""
    gone = sessions.agg(F.count_if(F.col("expires_at") <= now).alias("removed"))
    return sessions.where(~F.coalesce(F.col("expires_at") <= now, F.lit(False))), gone


def sessions_of_users(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions (session_id, user_id, expires_at, created_at) with their user's name; those without a user go."""
    return sessions.join(users.select(F.col("id").alias("user_id"), "username"), "user_id").select("session_id", "user_id", "expires_at", "created_at", "username")


def newest_first(rows: DataFrame, user_id: Column | None = None) -> DataFrame:
    """A user's watch list or saved searches, the newest first; without a user, all users' lists one after the other."""
    mine = rows if user_id is None else rows.where(F.col("user_id") == user_id)
    return mine.orderBy("user_id", F.desc("created_at"))


def new_notices(stored: DataFrame, products: DataFrame) -> DataFrame:
    """(product_id, first_seen_at, notified): notices with those of products that had none; a stored notice stays as it is."""
    fresh = products.select("product_id", "first_seen_at").join(stored.select("product_id"), "product_id", "left_anti")
    return stored.select("product_id", "first_seen_at", "notified").unionByName(fresh.withColumn("notified", F.lit(False)))


def open_notices(stored: DataFrame) -> DataFrame:
    return stored.where(~F.col("notified")).orderBy(F.desc("first_seen_at"))


def marked_notified(stored: DataFrame) -> DataFrame:
    """The one flag is global: what was open is notified for all users."""
    return stored.withColumn("notified", F.lit(True))
