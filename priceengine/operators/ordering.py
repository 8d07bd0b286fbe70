"""Global order without a global sort: numbers over any orderable key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: About as many rows give the bounds between stretches.
BOUNDS = 1024


def numbered(df: DataFrame, order: str, name: str, bounds: int = BOUNDS) -> DataFrame:
    """`df` with `name`, 1 for the row with the lowest `order`, 2 for the next, and so on. `order` is unique, and of any type that has an order, structs too.

    Keys drawn by their hash cut the order in stretches of like size, however the keys lie; each is numbered for itself behind
    the rows counted before it. The bounds are one row of about `bounds` keys. The draw depends on the keys alone, so a task
    that runs again finds the same stretches.
    """
    total = df.agg(F.greatest(F.ceil(F.count(F.lit(1)) / bounds), F.lit(1)).alias("__every"))  # one row
    drawn = df.crossJoin(F.broadcast(total)).where(F.pmod(F.xxhash64(order), F.col("__every")) == 0)
    cut = drawn.agg(F.array_sort(F.collect_list(order)).alias("__bounds"))  # one row
    placed = df.crossJoin(F.broadcast(cut)).withColumn("__block", F.size(F.filter("__bounds", lambda b: b <= F.col(order)))).drop("__bounds")
    counts = placed.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"))  # a row for each bound
    before = counts.select("__block", (F.sum("__n").over(Window.orderBy("__block")) - F.col("__n")).alias("__before"))
    number = F.row_number().over(Window.partitionBy("__block").orderBy(order)) + F.col("__before")
    return placed.join(F.broadcast(before), "__block").withColumn(name, number.cast("long")).drop("__block", "__before")
