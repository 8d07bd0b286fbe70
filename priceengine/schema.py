"""Types of the archive's records and of an observation."""

from __future__ import annotations

from pyspark.sql import types as T

PROMOTION = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("savePercent", T.DoubleType()),
    T.StructField("saveCents", T.LongType()), T.StructField("memberOnly", T.BooleanType()), T.StructField("startsAt", T.StringType()), T.StructField("endsAt", T.StringType()),
])
PRICE = T.StructType([
    T.StructField("currency", T.StringType()), T.StructField("regularCents", T.LongType()),
    T.StructField("promoCents", T.LongType()), T.StructField("memberCents", T.LongType()),
])
SOURCE = T.StructType([T.StructField(c, T.StringType()) for c in ("retailerProductId", "adapter", "url")])
#: What the four kinds of records carry under `data`, in one struct; images stay JSON text as they come in three shapes.
DATA = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("id", "retailer", "name", "brand", "size", "image_url", "source_id", "gtin", "address", "region")],
    T.StructField("categories", T.ArrayType(T.StringType())), T.StructField("images", T.StringType()),
    T.StructField("price", PRICE), T.StructField("promotion", PROMOTION), T.StructField("source", SOURCE),
])
#: A line of the archive: a version 2 record of any kind, or a bare observation of version 1.
RECORD = T.StructType([
    T.StructField("version", T.IntegerType()),
    *[T.StructField(c, T.StringType()) for c in ("type", "productId", "storeId", "offerId", "hash", "observedAt", "scope", "offersHash")],
    T.StructField("offerCount", T.LongType()), T.StructField("added", T.ArrayType(T.StringType())), T.StructField("removed", T.ArrayType(T.StringType())),
    T.StructField("data", DATA), T.StructField("product", DATA), T.StructField("store", DATA),
    T.StructField("price", PRICE), T.StructField("promotion", PROMOTION), T.StructField("source", SOURCE),
])
#: The flat observation that all operators read.
OBSERVATION = (
    "product_id string, store_id string, retailer string, observed_at timestamp, seq long, regular_cents long, promo_cents long, member_cents long, "
    "promotion struct<type:string,save_percent:double,starts_at:string,ends_at:string>, is_on_special boolean, last_seen_at timestamp"
)
