"""Captured pages as a source: a folder for each capture, a file for each page, or packs of many pages, checked before anything of them is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priceengine.functions.markup import page_count

OK, INCOMPLETE, FOREIGN, UNNAMED = "complete", "incomplete", "foreign store", "store not named"


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """(capture, page, payload) of files such as `path`/<capture>/page-3.json or `path`/capture=<capture>/page=3/...: each file is read whole, by one task."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload"))
    page = F.regexp_extract("file", r"page[-=](\d+)(?:[./]|$)", 1)
    capture = F.regexp_extract("file", r"([^/]+)/page[-=]\d+[^/]*(?:/[^/]*)?$", 1)
    return files.where(page != "").select(F.regexp_replace(capture, "^capture=", "").alias("capture"), page.cast("int").alias("page"), "payload")


def pack(pages: DataFrame, path: str) -> None:
    """Pages (capture, page, payload) as packs: each task writes one file for all its pages, so that files to make, move and list do not grow with the pages."""
    pages.select(F.col("capture").cast("string"), F.col("page").cast("int"), "payload").write.parquet(path)


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """(capture, page, payload) of packs, payloads as they were captured."""
    return spark.read.schema("capture string, page int, payload string").parquet(path)


def item_pages(payload: Column, size: int) -> tuple[Column, Column]:
    """(pages that a JSON page says there are, the store that it names)."""
    total = F.get_json_object(payload, "$.products.totalItems").cast("long")
    return F.greatest(F.ceil(total / size), F.lit(1)).cast("int"), F.nullif(F.get_json_object(payload, "$.context.fulfilment.fulfilmentStoreId"), F.lit(""))


def counted_pages(payload: Column, store: Column) -> tuple[Column, Column]:
    """(pages that a JSON page says there are, by either of two names, `store`); such pages are numbered from 0."""
    total = F.coalesce(F.get_json_object(payload, "$.numberOfPages"), F.get_json_object(payload, "$.totalPages")).cast("int")
    return F.greatest(total, F.lit(1)), store


def link_pages(html: Column, store: Column) -> tuple[Column, Column]:
    """(pages that an HTML page links to, `store`)."""
    return page_count(html).cast("int"), store


def judged(pages: DataFrame, expected: Column, store: Column, first: int = 1) -> DataFrame:
    """(capture, pages, expected, missing, stores, status): a capture is complete if all pages, from `first` on, that its last page tells of are there and all name one store.

    A page that tells no number does not count for it; a capture without any is incomplete. `missing` has the numbers of the pages that lack.
    """
    told = pages.select("capture", "page", expected.alias("expected"), store.alias("store"))
    seen = told.groupBy("capture").agg(
        F.count_distinct("page").alias("pages"), F.max_by("expected", F.when(F.col("expected").isNotNull(), F.col("page"))).alias("expected"), F.collect_set("page").alias("seen"),
        F.count_distinct("store").alias("stores"), F.count_if(F.col("store").isNull()).alias("unnamed"),
    )
    missing = F.when(F.col("expected").isNotNull(), F.array_except(F.sequence(F.lit(first), F.col("expected") + (first - 1)), "seen"))
    status = F.when(F.col("unnamed") > 0, UNNAMED).when(F.col("stores") > 1, FOREIGN).when(F.coalesce(F.size("missing"), F.lit(1)) != 0, INCOMPLETE).otherwise(OK)
    return seen.withColumn("missing", missing).withColumn("status", status).select("capture", "pages", "expected", "missing", "stores", "status")


def complete(pages: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The pages of complete captures."""
    return pages.join(verdicts.where(F.col("status") == OK), "capture", "left_semi")


def strict(pages: DataFrame, verdicts: DataFrame) -> DataFrame:
    """All pages, or an error that names the capture, raised where a page of one that is not complete is met."""
    met = pages.join(verdicts.select("capture", "status"), "capture")
    stop = F.raise_error(F.concat(F.lit("capture "), F.col("capture"), F.lit(": "), F.col("status")))
    return met.withColumn("capture", F.when(F.col("status") == OK, F.col("capture")).otherwise(stop.cast("string"))).drop("status")


def items(pages: DataFrame, at: str = "$.products.items") -> DataFrame:
    """(capture, seq, payload): a row for each item of the list that stands `at` this place of JSON pages, in order of page and place."""
    each = pages.select("capture", "page", F.posexplode(F.from_json(F.get_json_object("payload", at), "array<variant>")).alias("place", "item"))
    return each.select("capture", (F.col("page").cast("long") * 100_000 + F.col("place")).alias("seq"), F.to_json("item").alias("payload"))


def store_results(verdicts: DataFrame, fetched: DataFrame, added: DataFrame) -> DataFrame:
    """(store, ok, fetched, added, error) of each capture: one that fails does not keep the others from counting. fetched, added: rows with their capture."""
    counts = [rows.groupBy("capture").agg(F.count(F.lit(1)).alias(name)) for rows, name in ((fetched, "fetched"), (added, "added"))]
    met = verdicts.select("capture", "status").join(counts[0], "capture", "left").join(counts[1], "capture", "left")
    ok, none = F.col("status") == OK, F.lit(0).cast("long")
    return met.select(
        F.col("capture").alias("store"), ok.alias("ok"), F.when(ok, F.coalesce("fetched", none)).otherwise(none).alias("fetched"), F.when(ok, F.coalesce("added", none)).otherwise(none).alias("added"),
        F.when(~ok, F.col("status")).alias("error"),
    )


def exit_code(results: DataFrame) -> DataFrame:
    """One row: 0 if any store succeeded, else 1."""
    return results.agg(F.when(F.count_if("ok") > 0, 0).otherwise(1).alias("exit_code"))


STORE = "struct<id:string,name:string,address:string,region:string,banner:string>"


def store_list(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """(store_id, name, address, region, banner) of JSON lists of stores, each store once."""
    told = payloads.select(F.explode(F.from_json(F.get_json_object(payload, "$.stores"), f"array<{STORE}>")).alias("s"))
    return told.select(F.col("s.id").alias("store_id"), "s.name", "s.address", "s.region", "s.banner").distinct()


def search_stores(stores: DataFrame, banner: str, query: str | None = None) -> DataFrame:
    """The stores of a banner, in any case, whose name or address contains the query."""
    found = stores.where(F.upper("banner") == banner.upper())
    wanted = (query or "").strip().lower()
    if wanted:
        holds = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(wanted)), F.lit(False))
        found = found.where(holds("name") | holds("address"))
    return found
