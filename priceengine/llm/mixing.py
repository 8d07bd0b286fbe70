"""Operator 7: mixing sources to target weights by Poisson replication.

Every document draws its own number of copies: a hash of (seed, doc_id) gives a uniform number, and the Poisson
distribution with the source's mean repetition rate is inverted at it. A rate beyond MAX_RATE is split into equal parts
below it, each with a hash and a draw of its own: a sum of Poisson numbers is one with the summed rate. The copies are exploded and dealt out in the
order of another hash, so the output is shuffled globally and comes out the same on every run and after lost tasks.

Cases: very long texts are carried whole. The order of rows with one hash is that of doc_id and copy; repeated rows stand in any
order, as they are alike in both. A null source is a source of its own. A null doc_id is hashed as the text 'null'. Repeated rows draw the same
count. A source without a target weight keeps weight 0 if `weights` is given, and so goes. Empty and null texts are
replicated like others. An empty table gives an empty table. Input columns are kept; `copy`, `rate` and `order_key` are added (a
clashing input column is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceengine.llm.staging import small, staged

#: A source has a row of up to MAX_COPIES numbers.
MAX_BROADCAST_SOURCES = 10_000
#: The Poisson sum of one draw ends here: with rates up to MAX_RATE, the mass beyond is under 2**-60.
MAX_RATE, MAX_COPIES = 64.0, 192


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of SHA-256 over the parts, joined by colons."""
    digest = F.sha2(F.concat_ws(":", *parts), 256)
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_thresholds(rate: Column) -> Column:
    """The distribution function at 0, 1, 2, ...: an array to count up."""
    step = lambda s, k: F.struct(
        (s["p"] * rate / k).alias("p"), (s["c"] + s["p"] * rate / k).alias("c"),
        F.concat(s["all"], F.array(s["c"] + s["p"] * rate / k)).alias("all"),
    )
    first = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))
    last = F.least(F.lit(MAX_COPIES), F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), last), first, step)["all"]


def source_rates(docs: DataFrame, weights: dict[str, float] | None, alpha: float, epochs: float) -> DataFrame:
    """(source, rate): target share times the rows to be made, over the rows there are."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("__n"))
    if weights is None:
        raw = F.pow(F.col("__n").cast("double"), F.lit(alpha))
    else:
        raw = F.lit(0.0)
        for name, weight in sorted(weights.items()):
            raw = F.when(F.col("source") == name, F.lit(float(weight))).otherwise(raw)
    counts = counts.withColumn("__raw", raw)
    total = counts.agg(F.sum("__raw").alias("__w"), F.sum("__n").alias("__all"))
    rate = F.col("__raw") / F.col("__w") * F.col("__all") * F.lit(float(epochs)) / F.col("__n")
    # total is one row by construction
    return counts.join(F.broadcast(total), F.lit(True)).select(
        F.col("source").alias("__source"), F.when(F.col("__w") > 0, rate).otherwise(F.lit(0.0)).alias("rate")
    )


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """Rows of `docs`, each `copy` times as drawn, ordered by a hash. weights: by source; None: shares proportional to rows ** alpha."""
    parts = F.greatest(F.ceil(F.col("rate") / MAX_RATE), F.lit(1)).cast("int")
    rates = source_rates(docs, weights, alpha, epochs).withColumn("__parts", parts).withColumn("__cdf", poisson_thresholds(F.col("rate") / F.col("__parts")))
    ident = F.col("__ident")

    def drawn_at(u: Column) -> Column:
        return F.size(F.filter("__cdf", lambda c: c <= u))

    # the first part is drawn as a rate below MAX_RATE is
    further = F.when(F.col("__parts") > 1, F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.col("__parts") - 1, F.lit(1))), F.lit(0), lambda n, k: n + drawn_at(uniform(F.lit(str(seed)), ident, k.cast("string")))
    )).otherwise(0)
    # input columns travel in a struct, so that no name of theirs can clash
    kept = [c for c in docs.columns if c not in ("copy", "rate", "order_key")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("source").alias("__of"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__ident"))
    # counted: broadcast while sources are few, else both sides are dealt out (AQE splits a hot source)
    drawn = (
        rows.join(small(staged(rates, "rates"), MAX_BROADCAST_SOURCES), F.col("__of").eqNullSafe(F.col("__source")))
        .withColumn("__u", uniform(F.lit(str(seed)), ident))
        .withColumn("__count", drawn_at(F.col("__u")) + further)
        .where(F.col("__count") > 0)
    )
    copies = drawn.select("row", "rate", "__ident", F.explode(F.sequence(F.lit(1), F.col("__count"))).alias("copy"))
    key = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(f"{seed}s"), ident, F.col("copy").cast("string")), 256), 1, 13), 16, 10).cast("long")
    made = copies.select(*[F.col("row")[c].alias(c) for c in kept], "rate", "copy", key.alias("order_key"))
    return made.orderBy("order_key", "doc_id", "copy")
