"""From observations to the change-only archive, and back: revisions, deltas, listing states, as-of joins.

`seq` is the order in which rows were appended and decides wherever the archive's order does.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceengine.functions.scalars import content_hash
from priceengine.operators.prices import moment


def offer_hash() -> Column:
    """What makes an offer another one: its prices and its promotion."""
    return content_hash(F.col("regular_cents"), F.col("promo_cents"), F.col("member_cents"), F.col("promotion.type"), F.col("promotion.save_percent"), F.col("promotion.starts_at"), F.col("promotion.ends_at"))


def changed_only(rows: DataFrame, keys: list[str], value: Column, known: DataFrame | None = None) -> DataFrame:
    """Rows whose value differs from the one before it of the same key (A, B, A keeps all three).

    `known`: (keys, value) last stored for each key; without it the first row of a key is a change. A hot key is
    sorted and streamed through in one task (its state is one value), as each row depends on the one before.
    """
    rows = rows.withColumn("__value", value)
    in_order = Window.partitionBy(*keys).orderBy("seq")
    before = F.lag("__value").over(in_order)
    if known is None:
        return rows.withColumn("__before", before).where(~F.col("__value").eqNullSafe(F.col("__before"))).drop("__value", "__before")
    stored = known.select(*keys, F.col("value").alias("__stored"))
    out = rows.join(stored, keys, "left").withColumn("__before", F.when(F.row_number().over(in_order) == 1, F.col("__stored")).otherwise(before))
    return out.where(~F.col("__value").eqNullSafe(F.col("__before"))).drop("__value", "__before", "__stored")


def first_revisions(rows: DataFrame, key: str, value: Column, known: DataFrame | None = None) -> DataFrame:
    """(key, hash, observed_at, seq): each different value of a key once, where it first stands (A, B, A keeps two)."""
    out = rows.groupBy(key, value.alias("hash")).agg(F.min_by("observed_at", F.col("seq")).alias("observed_at"), F.min("seq").alias("seq"))
    return out if known is None else out.join(known.select(key, "hash"), [key, "hash"], "left_anti")


def without_repeats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The first row, by seq, of rows that agree in `columns`."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(*columns).agg(F.min_by(whole, F.col("seq")).alias("__row")).select("__row.*")


def compacted(records: DataFrame) -> DataFrame:
    """An archive without repeated product and store revisions and snapshots; offers stay as they are.

    records: (kind, id, hash, observed_at, scope, seq).
    """
    offers = records.where(F.col("kind") == "offer")
    others = records.where(F.col("kind") != "offer")
    once = F.when(F.col("kind") == "snapshot", F.concat_ws("|", F.col("scope"), F.col("observed_at").cast("string")))
    kept = others.withColumn("__once", F.coalesce(once, F.lit(""))).groupBy("kind", "id", "hash", "__once").agg(F.min_by(F.struct(*records.columns), F.col("seq")).alias("__row"))
    return kept.select("__row.*").unionByName(offers)


def snapshot_deltas(listings: DataFrame, store: str | list[str] = "store_id", item: str = "product_id", number: str = "snap") -> DataFrame:
    """(store, snap, item, op): what each full listing adds (+1) to the store's listing before it and what it removes (-1).

    listings: (store, snap, item), any rows repeated; `store` may be several columns, such as scope and store. The listing
    before is the store's previous snapshot, whichever number it has. Works by item: an item present in one snapshot and
    not in the next was removed by the next.
    """
    stores = [store] if isinstance(store, str) else store
    present = listings.select(*stores, number, item).distinct()
    order = present.select(*stores, number).distinct()
    by_store = Window.partitionBy(*stores).orderBy(number)
    steps = order.select(*stores, number, F.lag(number).over(by_store).alias("__prev"), F.lead(number).over(by_store).alias("__next"))
    by_item = Window.partitionBy(*stores, item).orderBy(number)
    seen = present.withColumns({"__was": F.lag(number).over(by_item), "__will": F.lead(number).over(by_item)}).join(steps, [*stores, number])
    added = seen.where(F.col("__was").isNull() | ~F.col("__was").eqNullSafe(F.col("__prev"))).select(*stores, number, item, F.lit(1).alias("op"))
    removed = seen.where(F.col("__next").isNotNull() & ~F.col("__will").eqNullSafe(F.col("__next"))).select(*stores, F.col("__next").alias(number), item, F.lit(-1).alias("op"))
    return added.unionByName(removed)


def listing_state(deltas: DataFrame, until: Column | None = None, store: str | list[str] = "store_id", item: str = "product_id", number: str = "snap") -> DataFrame:
    """(store, item): what is listed after all deltas up to `until`. The last operation of an item decides."""
    stores = [store] if isinstance(store, str) else store
    seen = deltas if until is None else deltas.where(F.col(number) <= until)
    return seen.groupBy(*stores, item).agg(F.max_by("op", F.col(number)).alias("op")).where(F.col("op") > 0).select(*stores, item)


def store_state(snapshots: DataFrame, until: Column | None = None, store: str | list[str] = "store_id", number: str = "snap", time: str = "snap_at") -> DataFrame:
    """(store, last_seen_at): stores with any snapshot up to `until`, and their last snapshot's time."""
    stores = [store] if isinstance(store, str) else store
    seen = snapshots if until is None else snapshots.where(F.col(number) <= until)
    return seen.groupBy(*stores).agg(F.max_by(time, F.col(number)).alias("last_seen_at"))


def listing_as_of(deltas: DataFrame, snapshots: DataFrame, at: Column, scope: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(listing, stores) as they were at `at`, of one scope or of all.

    The replay of a (scope, store) ends at its first snapshot, in append order, that is later than `at`: what is
    appended behind it does not count, whatever its time. deltas: (scope, store_id, product_id, snap, op); snapshots:
    (scope, store_id, snap, snap_at); both may lack the scope.
    """
    stores = [c for c in ("scope", "store_id") if c in snapshots.columns]
    if scope is not None:
        deltas, snapshots = deltas.where(F.col("scope") == scope), snapshots.where(F.col("scope") == scope)
    # one row for each store, beside which its snapshots are read once more
    cut = snapshots.groupBy(*stores).agg(F.min(F.when(F.col("snap_at") > at, F.col("snap"))).alias("__cut"))
    before = F.col("__cut").isNull() | (F.col("snap") < F.col("__cut"))
    known = deltas.join(cut, stores).where(before).drop("__cut")
    return listing_state(known, store=stores), store_state(snapshots.join(cut, stores).where(before), store=stores)


def listing_changes(batch: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(deltas, snapshots) of one batch of full listings against the stored ones.

    batch: (scope, store_id, product_id, observed_at, seq, hash); listed: (scope, store_id, product_id). A (scope, store)
    that the batch does not name keeps its listing. deltas: (scope, store_id, product_id, op); snapshots: (scope, store_id,
    observed_at, offer_count, offers_hash, added, removed), observed_at being the time of the store's first row. The
    listings meet item by item, so a store of any size gathers nowhere.
    """
    stores, item = ["scope", "store_id"], ["scope", "store_id", "product_id"]
    now = batch.groupBy(*item).agg(F.max_by("hash", F.col("seq")).alias("hash"), F.min(F.struct("seq", "observed_at")).alias("__first")).withColumn("__now", F.lit(True))
    named = batch.select(*stores).distinct()
    was = listed.join(named, stores, "left_semi").select(*item).distinct().withColumn("__was", F.lit(True))
    met = now.join(was, item, "full_outer")
    added, removed = F.col("__was").isNull(), F.col("__now").isNull()
    deltas = met.where(added | removed).select(*item, F.when(added, 1).otherwise(-1).alias("op"))
    half = [F.sum(F.when(~removed, F.xxhash64(F.lit(salt), "product_id", "hash")).cast("decimal(20,0)")) for salt in (1, 2)]
    snapshots = met.groupBy(*stores).agg(
        F.min("__first")["observed_at"].alias("observed_at"), F.count_if(~removed).alias("offer_count"), F.sha2(F.concat_ws(":", *[h.cast("string") for h in half]), 256).alias("offers_hash"),
        F.count_if(added).alias("added"), F.count_if(removed).alias("removed"),
    )
    return deltas, snapshots


def snapshot_hashes(listings: DataFrame, store: str = "store_id", item: str = "product_id", number: str = "snap") -> DataFrame:
    """(store, snap, offer_count, offers_hash): the hash of a snapshot's sorted items, so that equal listings have equal hashes.

    Each item is hashed and the hashes are added up (two 64-bit sums modulo 2**64), so a store with very many items
    gathers nowhere.
    """
    present = listings.select(store, number, item).distinct()
    half = [F.sum(F.xxhash64(F.lit(salt), F.col(item)).cast("decimal(20,0)")) for salt in (1, 2)]
    return present.groupBy(store, number).agg(F.count(F.lit(1)).alias("offer_count"), F.sha2(F.concat_ws(":", *[h.cast("string") for h in half]), 256).alias("offers_hash"))


def flagged_by(offers: DataFrame, listing: DataFrame, stores: DataFrame) -> DataFrame:
    """`offers` with is_on_special (true: listed; false: the store's listing is known and lacks it; null: unknown) and last_seen_at. Both sides of one scope."""
    active = listing.select("store_id", "product_id", F.lit(True).alias("__listed"))
    known = stores.select("store_id", F.col("last_seen_at").alias("__seen"))
    out = offers.drop("is_on_special", "last_seen_at").join(active, ["store_id", "product_id"], "left").join(known, "store_id", "left")
    listed = F.coalesce("__listed", F.lit(False))
    return out.withColumns({"is_on_special": F.when(F.col("__seen").isNotNull(), listed), "last_seen_at": F.when(listed, F.col("__seen"))}).drop("__listed", "__seen")


def listing_flags(offers: DataFrame, deltas: DataFrame, stores: DataFrame) -> DataFrame:
    """`offers` flagged by what is listed after all deltas."""
    return flagged_by(offers, listing_state(deltas), stores)


def revision_as_of(facts: DataFrame, revisions: DataFrame, key: str, at: str, fact_id: list[str]) -> DataFrame:
    """`fact_id` columns with rev_hash and rev_at: of the key's revisions with rev_at <= at the one appended last, else the first appended.

    No fact meets all revisions of its key. The different (key, at) and the revisions stand in one order of time, in
    which a running maximum finds the revision; days cut it, so a hot key is many short runs, and what a day begins with is the running
    maximum over the days before it, one row each. Every step has no more rows than facts and revisions together. Then facts
    look up their (key, at), a side with unique keys, so that adaptive execution can split a hot one. Facts whose key has no
    revision are dropped; a fact without a time, or before all revisions, has the first one.
    """
    time = facts.schema[at].dataType
    revision = F.struct(F.col("seq").alias("__seq"), F.col("hash").alias("rev_hash"), F.col("observed_at").alias("rev_at"))
    told = revisions.select(key, F.col("observed_at").cast(time).alias("__at"), revision.alias("__rev"), F.lit(False).alias("__asked"))
    asked = facts.select(key, F.col(at).alias("__at")).distinct().withColumns({"__rev": F.lit(None).cast(told.schema["__rev"].dataType), "__asked": F.lit(True)})
    both = told.unionByName(asked).withColumn("__day", F.coalesce(F.to_date("__at"), F.lit("0001-01-01").cast("date")))
    due = F.when(F.col("__at").isNotNull(), F.col("__rev"))
    days = both.groupBy(key, "__day").agg(F.max(due).alias("__last"), F.min("__rev").alias("__least"))
    of_key = Window.partitionBy(key)
    earlier = of_key.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(key, "__day", F.max("__last").over(earlier).alias("__carry"), F.min("__least").over(of_key).alias("__first")).where(F.col("__first").isNotNull())
    # equal times are peers: a revision of the very moment is due
    running = F.max(due).over(Window.partitionBy(key, "__day").orderBy("__at"))
    found = both.join(carried, [key, "__day"]).withColumn("__now", running).where("__asked")
    known = F.when(F.col("__at").isNotNull(), F.greatest("__carry", "__now"))
    found = found.select(F.col(key).alias("__key"), "__at", F.coalesce(known, "__first").alias("__r"))
    met = facts.select(*fact_id, key, at).join(found, (F.col(key) == F.col("__key")) & F.col(at).eqNullSafe(F.col("__at")))
    return met.select(*fact_id, "__r.rev_hash", "__r.rev_at")


def validity(revisions: DataFrame, key: str) -> DataFrame:
    """Revisions with valid_to: the time of the revision appended next, or null."""
    return revisions.withColumn("valid_to", F.lead("observed_at").over(Window.partitionBy(key).orderBy("seq")))


def observations_as_of(offers: DataFrame, products: DataFrame, stores: DataFrame, deltas: DataFrame, snapshots: DataFrame, at: datetime | Column) -> DataFrame:
    """Offers up to `at` with the listing flags and with the product and store revisions that counted then.

    offers: (product_id, store_id, observed_at, seq, ...); products and stores: revisions with hash, observed_at and
    seq; deltas: (store_id, product_id, snap, op); snapshots: (store_id, snap, snap_at), of one scope.
    """
    at = moment(at)
    active, stores_seen = listing_as_of(deltas, snapshots, at)
    flagged = flagged_by(offers.where(F.col("observed_at") <= at), active, stores_seen)
    shown = flagged.withColumn("display_at", F.coalesce("last_seen_at", "observed_at"))
    of_product = revision_as_of(shown, products, "product_id", "display_at", ["seq"]).select("seq", F.col("rev_hash").alias("product_hash"))
    of_store = revision_as_of(shown, stores, "store_id", "display_at", ["seq"]).select("seq", F.col("rev_hash").alias("store_hash"))
    return shown.join(of_product, "seq").join(of_store, "seq")


def new_items(rows: DataFrame, known: DataFrame, key: str = "product_id") -> DataFrame:
    """(key, first_seen_at) of what no earlier batch holds."""
    return rows.groupBy(key).agg(F.min_by("observed_at", F.col("seq")).alias("first_seen_at")).join(known.select(key), key, "left_anti")
