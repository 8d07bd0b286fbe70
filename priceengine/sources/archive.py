"""The JSONL archive as tables: reading, demultiplexing, projecting. Publishing is in `versions`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priceengine.functions.markup import best_image
from priceengine.operators.catalog import context_dimension, import_counters, offer_facts, product_dimension, snapshot_facts
from priceengine.schema import RECORD
from priceengine.sources.versions import current, open_table, publish  # noqa: F401

KINDS = ("product", "store", "offer", "snapshot")
ERROR_DETAIL_CHARS = 10_000  # fixed value


def read_lines(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """(file, place, value) of the lines that are not blank, with `numbered` also `line`, the number in the file. place rises with a line's place.

    place is made on the scan itself, before any shuffle: the block's first byte and the row within the task, so it is the
    same on every run over the same files and split size. Line numbers count blank lines too: one more pass counts each block's.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    kept = lines.where(F.trim("value") != "").select("file", F.struct("file", "block", "row").alias("place"), "value")
    if not numbered:
        return kept
    blocks = lines.groupBy("file", "block").agg(F.min("row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = blocks.select(F.col("file").alias("__file"), F.col("block").alias("__block"), (before - F.col("__first") + 1).alias("__shift"))
    met = kept.join(start, (F.col("file") == F.col("__file")) & (F.col("place.block") == F.col("__block")))
    return met.select("file", "place", (F.col("place.row") + F.col("__shift")).alias("line"), "value")


def parsed(lines: DataFrame) -> DataFrame:
    """Lines with `record` and `kind`: product, store, offer, snapshot, legacy, unknown (other version 2 records) or null for what cannot be read."""
    record = F.from_json("value", RECORD, {"mode": "PERMISSIVE"})
    valid = F.try_parse_json("value").isNotNull()
    r = F.col("record")
    v2 = (r["version"] == 2) & r["type"].isNotNull()
    legacy = r["product"].isNotNull() & r["store"].isNotNull() & r["price"].isNotNull() & r["source"].isNotNull()
    kind = F.when(~valid | r.isNull(), None).when(v2 & r["type"].isin(*KINDS), r["type"]).when(v2, "unknown").when(legacy, "legacy")
    return lines.withColumn("record", record).withColumn("kind", kind)


def strict(records: DataFrame) -> DataFrame:
    """The records, or an error raised in the task that meets a bad line; it names the file, and the line where the lines are numbered."""
    where = F.concat_ws(":", F.col("file"), F.col("line").cast("string")) if "line" in records.columns else F.col("file")
    text = "Unreadable line at " if "line" in records.columns else "Unreadable line in "
    # filters may be put together in any order, so blank lines are let through here, too
    bad = F.col("kind").isNull() & (F.trim("value") != "")
    checked = F.when(bad, F.raise_error(F.concat(F.lit(text), where))).otherwise(F.col("kind"))
    return records.withColumn("kind", checked.cast("string"))


def error_detail(records: DataFrame) -> DataFrame:
    """(errors, error_detail): one row; the first ERROR_DETAIL_CHARS characters of what is wrong with the numbered lines, null without errors.

    No more lines are brought together than can stand in so many characters: each takes ten or more.
    """
    bad = records.where(F.col("kind").isNull())
    said = F.concat(F.lit("Line "), F.col("line").cast("string"), F.lit(": "), F.when(F.try_parse_json("value").isNull(), "not JSON").otherwise("no record of the archive"))
    first = bad.select("line", said.alias("said")).orderBy("line").limit(ERROR_DETAIL_CHARS // 10)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "said"))), lambda x: x["said"]), "\n")
    detail = first.agg(F.nullif(F.substring(text, 1, ERROR_DETAIL_CHARS), F.lit("")).alias("error_detail"))
    return bad.agg(F.count(F.lit(1)).alias("errors")).crossJoin(F.broadcast(detail))  # one row each


def observations(records: DataFrame, *more: str) -> DataFrame:
    """Offers and legacy lines as flat observations without listing flags (see operators.ingest.observations_as_of); `more`: columns that stay."""
    r = F.col("record")
    legacy = F.col("kind") == "legacy"
    price = F.when(legacy, r["price"]).otherwise(r["data"]["price"])
    promotion = F.when(legacy, r["promotion"]).otherwise(r["data"]["promotion"])
    return records.where(F.col("kind").isin("offer", "legacy")).select(
        F.when(legacy, r["product"]["id"]).otherwise(r["productId"]).alias("product_id"), F.when(legacy, r["store"]["id"]).otherwise(r["storeId"]).alias("store_id"),
        F.coalesce(F.when(legacy, r["store"]["retailer"]), F.substring_index(F.when(legacy, r["store"]["id"]).otherwise(r["storeId"]), ":", 1)).alias("retailer"),
        F.to_timestamp(r["observedAt"]).alias("observed_at"), "place", r["hash"].alias("hash"),
        price["regularCents"].alias("regular_cents"), price["promoCents"].alias("promo_cents"), price["memberCents"].alias("member_cents"),
        F.when(promotion.isNotNull(), F.struct(promotion["type"].alias("type"), promotion["savePercent"].alias("save_percent"), promotion["startsAt"].alias("starts_at"), promotion["endsAt"].alias("ends_at"))).alias("promotion"),
        F.lit(None).cast("boolean").alias("is_on_special"), F.lit(None).cast("timestamp").alias("last_seen_at"), *more,
    )


def demultiplexed(records: DataFrame, order: str | None = None) -> dict[str, DataFrame]:
    """One table for each kind of record; `order` is the column that tells their append order: `seq`, where there is one, or else `place` as `read_lines` gives it."""
    r, seq = F.col("record"), F.col(order or ("seq" if "seq" in records.columns else "place")).alias("seq")
    at = F.to_timestamp(r["observedAt"]).alias("observed_at")
    of = lambda kind: records.where(F.col("kind") == kind)
    d = r["data"]
    product = of("product").select(
        r["productId"].alias("product_id"), r["hash"].alias("hash"), at, seq, d["name"].alias("name"), d["brand"].alias("brand"), F.try_element_at(d["categories"], F.lit(1)).alias("category"),
        F.coalesce(F.nullif(d["image_url"], F.lit("")), best_image(F.coalesce(F.when(F.try_parse_json(d["images"]).isNotNull(), d["images"]), F.to_json(F.array(d["images"]))))).alias("image_url"),
        d["size"].alias("size"), d["source_id"].alias("source_id"), d["gtin"].alias("gtin"),
    )
    store = of("store").select(
        F.coalesce(d["retailer"], F.substring_index(r["storeId"], ":", 1)).alias("retailer"), F.coalesce(d["id"], r["storeId"]).alias("store_id"), r["hash"].alias("hash"), at, seq,
        d["name"].alias("store_name"), d["address"].alias("address"), d["region"].alias("region"),
    )
    offer = of("offer").select(
        r["productId"].alias("product_id"), r["storeId"].alias("store_id"), r["hash"].alias("hash"), at, seq, d["price"]["regularCents"].alias("regular_cents"),
        d["price"]["promoCents"].alias("promo_cents"), d["price"]["memberCents"].alias("member_cents"), F.to_json(d["promotion"]).alias("promotion_data"), F.to_json(d["source"]).alias("source_data"),
    )
    snapshot = of("snapshot").select(r["scope"].alias("scope"), r["storeId"].alias("store_id"), at, seq, r["offersHash"].alias("offers_hash"), r["offerCount"].alias("offer_count"), r["added"].alias("added"), r["removed"].alias("removed"))
    return {"product": product, "store": store, "offer": offer, "snapshot": snapshot}


def projection(records: DataFrame, order: str | None = None) -> dict[str, DataFrame]:
    """The star schema of an archive: products, contexts, offers, snapshots, and the counts of the import; `order` as in `demultiplexed`.

    Of numbered lines the errors are told, too. An archive of which no line can be read is an error, raised when the counts are.
    """
    run = import_counters(records)
    none = (F.col("lines") > 0) & (F.col("records_imported") == 0)
    stop = F.raise_error(F.concat(F.lit("No line of the archive can be read ("), F.col("errors").cast("string"), F.lit(" bad lines)"))).cast("long")
    run = run.withColumn("records_imported", F.when(none, stop).otherwise(F.col("records_imported")))
    if "line" in records.columns:
        run = run.crossJoin(F.broadcast(error_detail(records).select("error_detail")))  # one row each
    kinds = demultiplexed(records, order)
    contexts = context_dimension(kinds["store"])
    return {
        "products": product_dimension(kinds["product"]), "contexts": contexts, "offers": offer_facts(kinds["offer"], contexts),
        "snapshots": snapshot_facts(kinds["snapshot"], contexts), "import_run": run,
    }


def fingerprint(lines: DataFrame) -> str:
    """A hash of the archive's contents: sums of line hashes, so it is made in one pass and needs no order."""
    total = lines.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.xxhash64(F.lit(k), F.col("value")).cast("decimal(20,0)")).alias(f"h{k}") for k in (1, 2)]).first()
    return f"{total.n}-{total.h1 or 0}-{total.h2 or 0}"
