"""The archive as one object: record observations, ask for histories, sales and feeds, rebuild the projection.

    archive = PriceArchive(spark, "s3a://bucket/prices")
    archive.record(observations, scope="specials")
    archive.agent_feed(at=datetime(2026, 7, 1))

`path` is a folder of JSONL: each call of `record` adds a folder `batch-<number>`, and what was there before may stand in it as
`batch-000000000000.jsonl`. The order of names, then of lines, is the append order. A single file can be read, not recorded to.

Every question here reads the log itself, once for each kind of record; `build` publishes tables for those who ask often.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from priceengine.functions.documents import json_fingerprint
from priceengine.operators import feeds, ingest, prices
from priceengine.sources import archive, versions

SCOPE = "specials"  # fixed value: the listing that tells what is on special
NUL = "\x00"


class PriceArchive:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def records(self) -> DataFrame:
        """All lines, parsed, with their place; a line that cannot be read is an error that names its file."""
        return archive.strict(archive.parsed(archive.read_lines(self.spark, self.path)))

    def _revisions(self, kind: str) -> DataFrame:
        """(id, hash, observed_at, seq, data): revisions of products or stores, those of bare observations among them; each content of an id once, where it first stands."""
        r = F.col("record")
        data = F.coalesce(F.get_json_object("value", "$.data"), F.get_json_object("value", f"$.{kind}"))
        rows = self.records().where(F.col("kind").isin(kind, "legacy")).select(F.coalesce(r[f"{kind}Id"], r[kind]["id"]).alias("id"), json_fingerprint(data).alias("hash"), F.to_timestamp(r["observedAt"]).alias("observed_at"), F.col("place").alias("seq"), data.alias("data"))
        return ingest.without_repeats(rows, ["id", "hash"])

    def _offers(self) -> DataFrame:
        """Offer records; of bare observations those that change what the offer was."""
        r = F.col("record")
        whole = self.records().where(F.col("kind").isin("offer", "legacy"))
        data = F.when(F.col("kind") == "legacy", _offer_data(*(F.get_json_object("value", f"$.{k}") for k in ("price", "promotion", "source")))).otherwise(F.get_json_object("value", "$.data"))
        flat = archive.observations(whole.select("kind", "record", "place", json_fingerprint(data).alias("__hash"), data.alias("__data")), "__hash", "__data", "kind")
        rows = flat.drop("hash", "is_on_special", "last_seen_at", "retailer").withColumnsRenamed({"place": "seq", "__hash": "hash", "__data": "data"})
        before = F.lag("hash").over(Window.partitionBy("product_id", "store_id").orderBy("seq"))
        return rows.withColumn("__same", (F.col("kind") == "legacy") & F.coalesce(F.col("hash") == before, F.lit(False))).where(~F.col("__same")).drop("__same", "kind")

    def _snapshots(self) -> tuple[DataFrame, DataFrame]:
        """(deltas, snapshots) of the listings, item by item."""
        told = archive.demultiplexed(self.records(), "place")["snapshot"]
        snapshots = told.select("scope", "store_id", F.col("seq").alias("snap"), F.col("observed_at").alias("snap_at"))
        item = F.substring_index("offer", NUL, 1).alias("product_id")
        parts = [told.select("scope", "store_id", F.col("seq").alias("snap"), F.explode(c).alias("offer"), F.lit(op).alias("op")) for c, op in (("added", 1), ("removed", -1))]
        return parts[0].unionByName(parts[1]).select("scope", "store_id", item, "snap", "op"), snapshots

    def record(self, observations: DataFrame, scope: str | None = None) -> int:
        """Append what is new: revisions of products and stores never seen, offers that differ from their last, and, with `scope`, the stores' listings. Returns how many records.

        observations: product and store (structs with id), price, promotion (may be null), source (structs), observed_at (ISO
        text) and seq, their order. One writer at a time, by a lease.
        """
        rows = observations.select(
            F.col("product.id").alias("product_id"), F.col("store.id").alias("store_id"), "observed_at", "seq", *[F.to_json(c).alias(c) for c in ("product", "store")],
            _offer_data(*(F.to_json(c) for c in ("price", "promotion", "source"))).alias("offer"),
        )
        with versions.lease(self.spark, self.path) as check:
            parts = [self._new_revisions(rows, kind) for kind in ("product", "store")]
            offers = rows.withColumn("hash", json_fingerprint(F.col("offer")))
            known = self._if_any(lambda: self._offers().groupBy("product_id", "store_id").agg(F.max_by("hash", F.col("seq")).alias("value")), "product_id string, store_id string, value string")
            changed = ingest.changed_only(offers, ["product_id", "store_id"], F.col("hash"), known)
            offer_id = F.concat("product_id", F.lit(NUL), "store_id")
            parts.append(changed.select(F.lit(2).alias("turn"), "seq", _line("offer", "offer", offerId=offer_id, productId=F.col("product_id"), storeId=F.col("store_id"), hash=F.col("hash")).alias("value")))
            if scope is not None:
                parts.append(self._new_snapshots(offers.withColumn("scope", F.lit(scope))))
            lines = parts[0]
            for p in parts[1:]:
                lines = lines.unionByName(p)
            number = 1 + max((n for n, _ in versions.numbered(self.spark, self.path, "batch-*")), default=0)
            seen = Observation()
            check()
            ordered = lines.repartitionByRange("turn", "seq", "value").sortWithinPartitions("turn", "seq", "value")
            ordered.select("value").observe(seen, F.count(F.lit(1)).alias("n")).write.text(f"{self.path}/batch-{number:012d}")
            return seen.get["n"]

    def _if_any(self, made, schema: str) -> DataFrame:  # noqa: ANN001
        """What is stored, or an empty table where nothing is yet."""
        return made() if versions.numbered(self.spark, self.path, "batch-*") else self.spark.createDataFrame([], schema)

    def _new_revisions(self, rows: DataFrame, kind: str) -> DataFrame:
        key = f"{kind}_id"
        known = self._if_any(lambda: self._revisions(kind).select(F.col("id").alias(key), "hash"), f"{key} string, hash string")
        hashed = rows.select(key, F.col(kind).alias("data"), "observed_at", "seq", json_fingerprint(F.col(kind)).alias("hash"))
        new = ingest.without_repeats(hashed, [key, "hash"]).join(known, [key, "hash"], "left_anti")
        return new.select(F.lit(0 if kind == "product" else 1).alias("turn"), "seq", _line(kind, "data", **{f"{kind}Id": F.col(key)}, hash=F.col("hash")).alias("value"))

    def _new_snapshots(self, offers: DataFrame) -> DataFrame:
        """A record for each store named: what its listing gains and loses. The lists stand in one record each, as the format has it."""
        listed = self._if_any(lambda: ingest.listing_state(self._snapshots()[0], store=["scope", "store_id"]), "scope string, store_id string, product_id string")
        deltas, snapshots = ingest.listing_changes(offers.select("scope", "store_id", "product_id", "observed_at", "seq", "hash"), listed)
        ids = F.concat("product_id", F.lit(NUL), "store_id")
        lists = deltas.groupBy("scope", "store_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("op") == op, ids))).alias(name) for op, name in ((1, "adds"), (-1, "drops"))])
        met = snapshots.join(lists, ["scope", "store_id"], "left")
        none = F.array().cast("array<string>")
        told = F.to_json(F.struct(
            F.lit(2).alias("version"), F.lit("snapshot").alias("type"), "scope", F.col("store_id").alias("storeId"), F.col("observed_at").alias("observedAt"), F.col("offer_count").alias("offerCount"),
            F.col("offers_hash").alias("offersHash"), F.coalesce("adds", none).alias("added"), F.coalesce("drops", none).alias("removed"),
        ))
        return met.select(F.lit(3).alias("turn"), F.lit(0).cast("long").alias("seq"), told.alias("value"))

    def history(self, product_id: str | None = None, store_id: str | None = None, retailer: str | None = None, since: datetime | Column | None = None, until: datetime | Column | None = None) -> DataFrame:
        """Observations as they were known at `until` (now, if not given): offers with their listing flags, and the product and store as of the time shown; JSON texts `product`, `store` and `source`."""
        offers = self._offers()
        for name, value in (("product_id", product_id), ("store_id", store_id)):
            if value is not None:
                offers = offers.where(F.col(name) == value)
        products, stores = self._revisions("product"), self._revisions("store")
        deltas, snapshots = (df.where(F.col("scope") == SCOPE).drop("scope") for df in self._snapshots())
        at = F.current_timestamp() if until is None else until
        keyed = [df.select(F.col("id").alias(k), "hash", "observed_at", "seq") for df, k in ((products, "product_id"), (stores, "store_id"))]
        shown = ingest.observations_as_of(offers, keyed[0], keyed[1], deltas, snapshots, at)
        out = shown.drop("display_at", "hash")
        for df, k in ((products, "product"), (stores, "store")):
            out = out.join(df.select(F.col("id").alias(f"{k}_id"), F.col("hash").alias(f"{k}_hash"), F.col("data").alias(k)), [f"{k}_id", f"{k}_hash"])
        told = out.withColumn("retailer", F.coalesce(F.get_json_object("store", "$.retailer"), F.substring_index("store_id", ":", 1))).withColumn("source", F.get_json_object("data", "$.source")).drop("data", "product_hash", "store_hash")
        return prices.select_history(told, retailer=retailer, since=since)

    def product_history(self, product_id: str) -> DataFrame:
        """(seq, hash, observed_at, product): the revisions of a product, `seq` telling their order."""
        return self._revisions("product").where(F.col("id") == product_id).select("seq", "hash", "observed_at", F.col("data").alias("product"))

    def find_sales(self, at: datetime | Column, retailer: str | None = None, store_id: str | None = None, **options: object) -> DataFrame:
        return prices.history_sales(self.history(store_id=store_id, retailer=retailer, until=at), at, **options)

    def ongoing_sales(self, at: datetime | Column, retailer: str | None = None, store_id: str | None = None, **options: object) -> DataFrame:
        return prices.ongoing_sales(self.history(store_id=store_id, retailer=retailer, until=at), at, **options)

    def agent_feed(self, at: datetime | Column, retailer: str | None = None, store_id: str | None = None, products: Sequence[str] | None = None, **options: object) -> DataFrame:
        """Both kinds of sales, with the defaults of the command line."""
        wanted = None if products is None else self.spark.createDataFrame([(p,) for p in products], "product_id string")
        return feeds.feed(self.history(store_id=store_id, retailer=retailer, until=at), at, products=wanted, **options)

    def stats(self, retailer: str | None = None) -> DataFrame:
        return prices.archive_stats(self.history(retailer=retailer))

    def build(self, root: str, force: bool = False) -> dict:
        """Publish the projection; skipped if the archive's lines are those that the published one was made from."""
        lines = archive.read_lines(self.spark, self.path, numbered=True)
        tables = archive.projection(archive.parsed(lines))
        return versions.publish(self.spark, tables, root, archive.fingerprint(lines), force, layouts={"offers": versions.month_layout()})

    def compact(self, into: str) -> None:
        """Write the archive without repeated revisions and snapshots to another folder."""
        r = F.col("record")
        rows = self.records().select(
            F.col("kind"), F.coalesce(r["productId"], r["storeId"]).alias("id"), F.coalesce(r["hash"], r["offersHash"]).alias("hash"), r["observedAt"].alias("observed_at"), r["scope"].alias("scope"),
            F.col("place").alias("seq"), "value",
        )
        once = rows.where(F.col("kind").isin("product", "store", "snapshot"))
        rest = rows.where(~F.col("kind").isin("product", "store", "snapshot"))
        kept = ingest.compacted(once).unionByName(rest)
        kept.repartitionByRange("seq").sortWithinPartitions("seq").select("value").write.text(f"{into.rstrip('/')}/batch-{1:012d}")


def _offer_data(price: Column, promotion: Column, source: Column) -> Column:
    """The data of an offer record from JSON texts; without a promotion the member is left out."""
    told = F.when(promotion.isNotNull() & (promotion != "null"), F.concat(F.lit(',"promotion":'), promotion)).otherwise("")
    return F.concat(F.lit('{"price":'), price, told, F.lit(',"source":'), source, F.lit("}"))


def _line(kind: str, data: str, **members: Column) -> Column:
    """A record as a JSON line; `data` is JSON text already."""
    head = F.to_json(F.struct(F.lit(2).alias("version"), F.lit(kind).alias("type"), *[v.alias(k) for k, v in members.items()], F.col("observed_at").alias("observedAt")))
    return F.concat(F.substring(head, 1, F.char_length(head) - 1), F.lit(',"data":'), F.col(data), F.lit("}"))
