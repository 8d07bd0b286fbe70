"""The session the engine is meant for: UTC, adaptive execution, skewed joins split."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a hot (product, store) is split even where an aggregate on the same key follows the join
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def builder(app: str = "priceengine", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession.Builder:
    """A session builder. On a cluster leave `master` and `shuffle_partitions` to its settings."""
    out = SparkSession.builder.appName(app).config(map=SETTINGS)
    if master:
        out = out.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        out = out.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return out
