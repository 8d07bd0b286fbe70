"""The archive's incremental work on streams: change-only ingest, listings, tumbling counts, duplicate suppression."""

from __future__ import annotations

from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from priceengine.operators.ingest import changed_only, listing_changes, listing_state


#: Parts of the stored values; a batch rewrites those that it touches.
BUCKETS = 256


def _versions(spark: SparkSession, path: str) -> tuple[Any, dict[int, dict[int, str]]]:
    """(file system, {bucket: {batch: folder}}) of the stored values: a few folders for each bucket."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/last/batch_id=*/bucket=*")
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[int, dict[int, str]] = {}
    for f in fs.globStatus(pattern) or []:
        at = f.getPath()
        out.setdefault(int(at.getName().split("=")[1]), {})[int(at.getParent().getName().split("=")[1])] = at.toString()
    return fs, out


def stored_values(spark: SparkSession, path: str, schema: StructType, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The last value of each key as of the newest batch (before batch `before`), of all buckets or of those given."""
    _, versions = _versions(spark, path)
    wanted = {b: [i for i in v if before is None or i < before] for b, v in versions.items() if buckets is None or b in buckets}
    folders = [versions[b][max(i)] for b, i in wanted.items() if i]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def ingest_batch(batch: DataFrame, batch_id: int, path: str, keys: list[str], value: Column, buckets: int = BUCKETS) -> None:
    """For foreachBatch: write the batch's changes to `path`/changes, compared with the last stored value of each key.

    The values stand in buckets by the hash of their key. A batch reads and writes those buckets alone that hold a key of
    its own, and never the history. It has folders of its own, overwritten if it runs again, and compares with the values that
    stood before it, so a batch that runs twice is stored once; of a bucket the version before stays until a later one replaces it. `path` keeps
    the number of buckets it was begun with. A hot key is sorted and streamed through, not gathered.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    batch = batch.withColumns({"value": value, "bucket": bucket}).persist(StorageLevel.DISK_ONLY)
    try:
        schema = batch.select(*keys, "value").schema
        touched = [r.bucket for r in batch.select("bucket").distinct().collect()]  # as many as there are buckets
        stored = stored_values(spark, path, schema, batch_id, touched)
        changed_only(batch.drop("bucket"), keys, F.col("value"), stored).write.mode("overwrite").parquet(f"{path}/changes/batch_id={batch_id}")
        new = batch.groupBy(*keys).agg(F.max_by(F.struct("value"), F.col("seq"))["value"].alias("value"))
        kept = stored.join(new.select(*keys), keys, "left_anti").unionByName(new).withColumn("bucket", bucket)
        kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/last/batch_id={batch_id}")
        fs, versions = _versions(spark, path)
        for b in touched:
            for i in sorted(i for i in versions.get(b, {}) if i < batch_id)[:-1]:
                fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(versions[b][i]), True)
    finally:
        batch.unpersist()


#: Batches between two full states of the listings.
FULL_EVERY = 8
LISTED = "scope string, store_id string, product_id string"


def _batches(spark: SparkSession, folder: str, before: int | None) -> list[int]:
    """The numbers of whole batches in a folder."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{folder}/batch_id=*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(i for i in (int(f.getPath().getParent().getName().split("=")[1]) for f in found) if before is None or i < before)


def stored_listings(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """(scope, store_id, product_id) listed after the newest batch (before batch `before`): the last full state and the deltas behind it."""
    full = _batches(spark, f"{path}/full", before)
    since = [i for i in _batches(spark, f"{path}/deltas", before) if not full or i > full[-1]]
    rows = spark.createDataFrame([], f"{LISTED}, op int, snap long")
    if full:
        rows = spark.read.schema(LISTED).parquet(f"{path}/full/batch_id={full[-1]}").select("*", F.lit(1).alias("op"), F.lit(full[-1]).cast("long").alias("snap"))
    for i in since:  # FULL_EVERY at most
        rows = rows.unionByName(spark.read.schema(f"{LISTED}, op int").parquet(f"{path}/deltas/batch_id={i}").withColumn("snap", F.lit(i).cast("long")))
    return listing_state(rows, store=["scope", "store_id"])


def ingest_listings(batch: DataFrame, batch_id: int, path: str, every: int = FULL_EVERY) -> None:
    """For foreachBatch: full listings of some stores become deltas and snapshots against what is stored; stores without a row keep their listing.

    batch: (scope, store_id, product_id, observed_at, seq, hash). `path`/deltas and `path`/snapshots grow by a folder for each batch, which is overwritten
    if the batch runs again; every few batches the whole state is written, so reading it never takes more than `every` deltas.
    """
    spark = batch.sparkSession
    batch = batch.persist(StorageLevel.DISK_ONLY)
    try:
        deltas, snapshots = listing_changes(batch, stored_listings(spark, path, batch_id))
        deltas.write.mode("overwrite").parquet(f"{path}/deltas/batch_id={batch_id}")
        snapshots.write.mode("overwrite").parquet(f"{path}/snapshots/batch_id={batch_id}")
        if batch_id % every == every - 1:
            stored_listings(spark, path, batch_id + 1).write.mode("overwrite").parquet(f"{path}/full/batch_id={batch_id}")
    finally:
        batch.unpersist()


def tumbling_counts(rows: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """(window_start, by, n): counts in fixed windows; state of a window goes once it is `late` behind."""
    counted = rows.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), *by, "n")


def once(rows: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    """Exact repeats within the watermark go."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
