"""Records of collection runs: kinds of failure, summaries, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceengine.functions.scalars import redacted, run_kind

KEPT_RECORDS = 1000  # fixed value
MESSAGE = 500  # fixed value


def run_records(runs: DataFrame) -> DataFrame:
    """runs: (retailer, started_at, ended_at, exit_code, records, stderr). Adds status, error_category, error_message and duration_ms."""
    return runs.select(
        "*", F.when(F.col("exit_code") == 0, "success").otherwise("failure").alias("status"), run_kind(F.col("exit_code"), F.col("stderr")).alias("error_category"),
        F.substring(redacted(F.col("stderr")), 1, MESSAGE).alias("error_message"), F.coalesce(F.unix_millis("ended_at") - F.unix_millis("started_at"), F.lit(0)).alias("duration_ms"),
    )


def newest(records: DataFrame, keep: int = KEPT_RECORDS) -> DataFrame:
    """The last `keep` records by seq: a top-k, not a sort of all."""
    return records.orderBy(F.desc("seq")).limit(keep)


def before_first_error(records: DataFrame, broken: str = "corrupt") -> DataFrame:
    """What a tolerant reader sees: the records before the first broken one."""
    first = records.where(F.col(broken)).agg(F.min("seq").alias("__first"))
    # one row
    return records.join(F.broadcast(first), F.lit(True)).where(F.col("__first").isNull() | (F.col("seq") < F.col("__first"))).drop("__first")


def summary(results: DataFrame, *by: str) -> DataFrame:
    """Runs, successes, failures, records fetched and added. results: (ok, fetched, added)."""
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("ok")).alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.sum("fetched").alias("fetched"), F.sum("added").alias("added")
    )


def last_runs(records: DataFrame) -> DataFrame:
    """The record with the highest seq of each retailer."""
    return records.groupBy("retailer").agg(F.max_by(F.struct(*records.columns), F.col("seq")).alias("row")).select("row.*")
