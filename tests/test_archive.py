"""The archive: reading, projecting, publishing, ingest and its inverse, as-of reading, streams."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from priceengine.operators import catalog, ingest
from priceengine.sources import archive
from priceengine.streaming import changes

T0 = datetime(2026, 7, 1)


def line(kind: str, day: int, **more) -> str:
    return json.dumps({"version": 2, "type": kind, "observedAt": (T0 + timedelta(days=day)).isoformat() + "Z"} | more)


LINES = [
    line("product", 0, productId="paknsave:1", hash="p1", data={"id": "paknsave:1", "name": "Milk", "categories": ["Dairy", "x"], "images": {"200": "small", "800": "large"}, "gtin": "12345678"}),
    line("store", 0, storeId="paknsave:s", hash="s1", data={"id": "paknsave:s", "retailer": "paknsave", "name": "Royal Oak"}),
    line("offer", 0, productId="paknsave:1", storeId="paknsave:s", offerId="o", hash="o1", data={"price": {"regularCents": 500}, "source": {"retailerProductId": "1"}}),
    line("offer", 1, productId="paknsave:1", storeId="paknsave:s", offerId="o", hash="o2", data={"price": {"regularCents": 500, "promoCents": 400}, "promotion": {"type": "SPECIAL", "savePercent": 20}, "source": {}}),
    line("offer", 1, productId="paknsave:1", storeId="paknsave:s", offerId="o", hash="o2", data={"price": {"regularCents": 500, "promoCents": 400}, "source": {}}),
    line("offer", 1, productId="paknsave:1", storeId="unknown:s", offerId="q", hash="o3", data={"price": {"regularCents": 1}, "source": {}}),
    line("offer", 2, productId="paknsave:1", storeId="paknsave:s", offerId="o", hash="o4", data={"price": {"regularCents": -5}, "source": {}}),
    line("product", 3, productId="paknsave:1", hash="p2", data={"id": "paknsave:1", "name": "Milk 2L", "images": "one"}),
    line("snapshot", 3, scope="specials", storeId="paknsave:s", offerCount=1, offersHash="h", added=["o"], removed=[]),
    json.dumps({"product": {"id": "a:9"}, "store": {"id": "a:s", "retailer": "a"}, "price": {"regularCents": 7}, "source": {"retailerProductId": "9"}, "observedAt": T0.isoformat() + "Z"}),
]
BAD = ["{oops", '{"hello":"world"}']


def records(spark, lines: list[str]):
    return archive.parsed(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, seq long, value string"))


def test_kinds(spark):
    got = [r.kind for r in records(spark, [*LINES, *BAD, line("other", 0)]).orderBy("seq").collect()]
    assert got == ["product", "store", "offer", "offer", "offer", "offer", "offer", "product", "snapshot", "legacy", None, None, "unknown"]


def test_strict_reading_stops_at_a_bad_line(spark):
    assert archive.strict(records(spark, LINES)).select("kind").count() == len(LINES)
    with pytest.raises(Exception, match="Unreadable line in f"):
        archive.strict(records(spark, [*LINES, *BAD])).select("kind").collect()


def test_projection(spark):
    tables = archive.projection(records(spark, [*LINES, *BAD]))
    (p,) = tables["products"].collect()
    assert (p.product_id, p.retailer, p.name, p.image_url, p.hash, p.first_seen_at, p.updated_at) == ("paknsave:1", "paknsave", "Milk 2L", "one", "p2", T0, T0 + timedelta(days=3))
    (c,) = tables["contexts"].collect()
    assert (c.context_id, c.store_id, c.store_name, c.retailer_name) == (1, "paknsave:s", "Royal Oak", "PAK'nSAVE")
    assert sorted(r.hash for r in tables["offers"].collect()) == ["o1", "o2"]
    (i,) = tables["import_run"].collect()
    assert (i.errors, i.offers, i.legacys, i.records_imported) == (2, 5, 1, 10)


def test_images_of_all_shapes(spark):
    first = archive.demultiplexed(records(spark, LINES))["product"].orderBy("seq").collect()
    assert [r.image_url for r in first] == ["large", "one"]


def test_observations_of_offers_and_legacy_lines(spark):
    rows = archive.observations(records(spark, LINES).withColumn("place", F.col("seq"))).orderBy("place").collect()
    assert len(rows) == 6 and rows[-1].product_id == "a:9" and rows[1].promotion.save_percent == 20.0 and rows[0].promotion is None


def test_files_are_read_in_order_and_published_once(spark, tmp_path):
    (tmp_path / "prices.jsonl").write_text("\n".join(["", *LINES, "  "]) + "\n")
    lines = archive.read_lines(spark, str(tmp_path / "prices.jsonl"))
    assert [r.value for r in lines.orderBy("place").collect()] == LINES
    mark = archive.fingerprint(lines)
    tables = archive.projection(archive.parsed(lines).withColumn("seq", F.col("place.row")))
    root = f"file://{tmp_path}/db"
    assert archive.current(spark, root) is None
    first = archive.publish(spark, tables, root, mark)
    assert first["status"] == "built" and archive.publish(spark, tables, root, mark)["status"] == "skipped"
    assert archive.open_table(spark, root, "offers").count() == 2
    again = archive.publish(spark, tables, root, mark, force=True)
    assert again["version"] != first["version"] and archive.open_table(spark, root, "products").count() == 1


def test_projection_in_file_order(spark, tmp_path):
    """Two files in many splits, in the order that the reader itself gives: each table of the projection."""
    (tmp_path / "a.jsonl").write_text("\n".join(LINES) + "\n")
    later = [line("store", 9, storeId=f"woolworths:{i}", hash=f"w{i}", data={"id": f"woolworths:{i}", "retailer": "woolworths", "name": f"W {i}"}) for i in range(40)]
    later.insert(3, line("product", 9, productId="paknsave:1", hash="p3", data={"id": "paknsave:1", "name": "Milk 3L"}))
    later.append(line("offer", 9, productId="paknsave:1", storeId="woolworths:39", offerId="z", hash="o9", data={"price": {"regularCents": 3}, "source": {}}))
    (tmp_path / "b.jsonl").write_text("\n".join([*later, *BAD]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 900)
    try:
        tables = archive.projection(archive.parsed(archive.read_lines(spark, str(tmp_path), numbered=True)))
        contexts = {r.store_id: r.context_id for r in tables["contexts"].collect()}
        assert contexts == {"paknsave:s": 1} | {f"woolworths:{i}": i + 2 for i in range(40)}
        (p,) = tables["products"].collect()
        assert (p.name, p.hash, p.first_seen_at) == ("Milk 3L", "p3", T0)
        assert sorted((r.hash, r.context_id) for r in tables["offers"].collect()) == [("o1", 1), ("o2", 1), ("o9", 41)]
        (snap,) = tables["snapshots"].collect()
        assert (snap.context_id, snap.added, snap.offer_count) == (1, ["o"], 1)
        (run,) = tables["import_run"].collect()
        assert (run.errors, run.stores, run.products, run.records_imported) == (2, 41, 3, 52) and run.error_detail.startswith("Line 43: ")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_numbers_follow_any_order(spark):
    from priceengine.operators.ordering import numbered

    rng = random.Random(1)
    keys = [(f"f{rng.randrange(3)}", i * i) for i in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys], "k struct<a:string,b:long>")
    assert {tuple(r.k): r.n for r in numbered(df, "k", "n", bounds=16).collect()} == {k: n for n, k in enumerate(sorted(keys), 1)}
    assert numbered(df.where("false"), "k", "n").collect() == []


def test_change_only_keeps_returns(spark):
    rows = spark.createDataFrame([("p", i, v) for i, v in enumerate(["A", "A", "B", "A", None, None, "A"])], "k string, seq long, v string")
    assert [r.seq for r in ingest.changed_only(rows, ["k"], F.col("v")).orderBy("seq").collect()] == [0, 2, 3, 4, 6]
    known = spark.createDataFrame([("p", "A")], "k string, value string")
    assert [r.seq for r in ingest.changed_only(rows, ["k"], F.col("v"), known).orderBy("seq").collect()] == [2, 3, 4, 6]


def test_first_revisions_do_not(spark):
    rows = spark.createDataFrame([("p", i, v, T0) for i, v in enumerate("ABA")], "k string, seq long, v string, observed_at timestamp")
    assert sorted((r.hash, r.seq) for r in ingest.first_revisions(rows, "k", F.col("v")).collect()) == [("A", 0), ("B", 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_replaying_deltas_gives_the_listing(spark, seed):
    rng = random.Random(seed)
    rows = [(s, d, f"p{p}") for s in "ab" for d in range(6) if rng.random() < 0.8 for p in range(8) if rng.random() < 0.5]
    listed = spark.createDataFrame(rows, "store_id string, snap int, product_id string")
    deltas = ingest.snapshot_deltas(listed).cache()
    for day in range(6):
        got = {(r.store_id, r.product_id) for r in ingest.listing_state(deltas, F.lit(day)).collect()}
        last = {s: max((d for x, d, _ in rows if x == s and d <= day), default=None) for s in "ab"}
        assert got == {(s, p) for s, d, p in rows if d == last[s]}


def plan_rows(df) -> list[int]:
    """The output rows of every operator of the plan as it was run."""
    df.write.format("noop").mode("overwrite").save()
    text, seen = [], []
    df.collect()

    def walk(node) -> None:
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        found = node.metrics().get("numOutputRows")
        if found.isDefined():
            seen.append(found.get().value())
            text.append(name)
        for k in range(node.children().size()):
            walk(node.children().apply(k))
        return None

    walk(df._jdf.queryExecution().executedPlan())
    assert text
    return seen


def test_as_of_rows_are_linear_in_facts_and_revisions(spark):
    """One key of very many facts and revisions: nothing between the operators has more rows than both together."""
    facts = spark.range(100_000).select("id", F.lit("p").alias("product_id"), F.timestamp_seconds(F.col("id") * 97 % 900_000).alias("at"))
    revisions = spark.range(1_000).select(F.lit("p").alias("product_id"), F.concat(F.lit("h"), "id").alias("hash"), F.timestamp_seconds(F.col("id") * 811 % 900_000).alias("observed_at"), "id").withColumnRenamed("id", "seq")
    got = ingest.revision_as_of(facts, revisions, "product_id", "at", ["id"])
    assert max(plan_rows(got)) <= 101_000
    by_time = sorted((i * 811 % 900_000, i) for i in range(1_000))
    true, best, k = {}, None, 0
    for at, i in sorted((i * 97 % 900_000, i) for i in range(100_000)):
        while k < len(by_time) and by_time[k][0] <= at:
            best, k = max(best if best is not None else -1, by_time[k][1]), k + 1
        true[i] = best if best is not None else 0
    assert {r.id: int(r.rev_hash[1:]) for r in got.collect()} == true


def test_as_of_of_ties_and_missing_times(spark):
    facts = spark.createDataFrame([(1, "p", T0), (2, "p", None), (3, "p", T0 - timedelta(days=1)), (1, "p", T0), (4, None, T0)], "id long, product_id string, at timestamp")
    revisions = spark.createDataFrame([("p", "a", T0, 5), ("p", "b", T0, 6), ("p", "c", None, 9), (None, "d", T0, 1)], "product_id string, hash string, observed_at timestamp, seq long")
    got = sorted((r.id, r.rev_hash) for r in ingest.revision_as_of(facts, revisions, "product_id", "at", ["id"]).collect())
    assert got == [(1, "b"), (1, "b"), (2, "a"), (3, "a")]


def test_as_of_falls_back_to_the_first_revision(spark):
    facts = spark.createDataFrame([(1, "p", T0), (2, "p", T0 + timedelta(days=5)), (3, "q", T0)], "id long, product_id string, at timestamp")
    revisions = spark.createDataFrame([("p", "new", T0 + timedelta(days=4), 1), ("p", "old", T0 + timedelta(days=2), 2), ("p", "late", T0 + timedelta(days=9), 3)], "product_id string, hash string, observed_at timestamp, seq long")
    got = {r.id: r.rev_hash for r in ingest.revision_as_of(facts, revisions, "product_id", "at", ["id"]).collect()}
    assert got == {1: "new", 2: "old"}  # appended last wins over the later time; a product without revisions goes


def test_replay_ends_at_the_first_later_snapshot(spark):
    """Snapshots out of order: what is appended behind a later one does not count."""
    offers = spark.createDataFrame([("p", "s", T0, 1)], "product_id string, store_id string, observed_at timestamp, seq long")
    revision = spark.createDataFrame([("p", "h", T0, 1)], "product_id string, hash string, observed_at timestamp, seq long")
    store = spark.createDataFrame([("s", "h", T0, 1)], "store_id string, hash string, observed_at timestamp, seq long")
    deltas = spark.createDataFrame([("s", "p", 1, 1), ("s", "p", 3, -1)], "store_id string, product_id string, snap int, op int")
    snapshots = spark.createDataFrame([("s", 1, T0), ("s", 2, T0 + timedelta(days=9)), ("s", 3, T0)], "store_id string, snap int, snap_at timestamp")
    (r,) = ingest.observations_as_of(offers, revision, store, deltas, snapshots, F.lit(T0 + timedelta(days=1))).collect()
    assert r.is_on_special is True and r.last_seen_at == T0


def test_compaction_keeps_offers(spark):
    rows = [("product", "a", "h", T0, None, 1), ("product", "a", "h", T0, None, 2), ("offer", "o", "h", T0, None, 3), ("offer", "o", "h", T0, None, 4), ("snapshot", "s", "h", T0, "x", 5), ("snapshot", "s", "h", T0 + timedelta(days=1), "x", 6)]
    got = ingest.compacted(spark.createDataFrame(rows, "kind string, id string, hash string, observed_at timestamp, scope string, seq long"))
    assert sorted(r.seq for r in got.collect()) == [1, 3, 4, 5, 6]


def test_snapshot_hashes_tell_listings_apart(spark):
    rows = [("a", 1, "p"), ("a", 1, "q"), ("a", 2, "q"), ("a", 2, "p"), ("a", 3, "p")]
    got = {r.snap: (r.offer_count, r.offers_hash) for r in ingest.snapshot_hashes(spark.createDataFrame(rows, "store_id string, snap int, product_id string")).collect()}
    assert got[1] == got[2] != got[3] and got[3][0] == 1


def test_batches_and_stream_give_what_one_batch_gives(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"p{rng.randrange(3)}", f"s{rng.randrange(2)}", i, rng.choice("AB")) for i in range(120)]
    schema = "product_id string, store_id string, seq long, v string"
    whole = spark.createDataFrame(rows, schema)
    true = sorted(r.seq for r in ingest.changed_only(whole, ["product_id", "store_id"], F.col("v")).collect())
    stored = str(tmp_path / "offers")
    for k in range(3):
        for _ in range(2):  # a batch that runs twice is stored once
            changes.ingest_batch(spark.createDataFrame(rows[40 * k : 40 * k + 40], schema), k, stored, ["product_id", "store_id"], F.col("v"))
    assert sorted(r.seq for r in spark.read.parquet(f"{stored}/changes").collect()) == true
    def put(k: int) -> None:
        spark.createDataFrame(rows[40 * k : 40 * k + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def ingest_one(batch, batch_id: int) -> None:
        if batch_id == 1 and not lost:
            lost.append(batch_id)
            changes.ingest_batch(batch, batch_id, str(tmp_path / "streamed"), ["product_id", "store_id"], F.col("v"))
            raise InterruptedError  # after the batch was written, before the stream knows
        changes.ingest_batch(batch, batch_id, str(tmp_path / "streamed"), ["product_id", "store_id"], F.col("v"))

    def run() -> None:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(ingest_one).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()

    lost: list[int] = []
    put(0)
    put(1)
    with pytest.raises(Exception, match="InterruptedError"):
        run()
    put(2)
    run()
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "streamed/changes")).collect()) == true


def test_a_batch_rewrites_the_buckets_of_its_keys_alone(spark, tmp_path):
    schema, path = "k string, seq long, v string", str(tmp_path / "t")
    many = spark.createDataFrame([(f"k{i}", i, "A") for i in range(200)], schema)
    changes.ingest_batch(many, 0, path, ["k"], F.col("v"), 16)
    changes.ingest_batch(spark.createDataFrame([("k7", 300, "B"), ("new", 301, None)], schema), 1, path, ["k"], F.col("v"), 16)
    written = {p.name for p in (tmp_path / "t/last/batch_id=1").glob("bucket=*")}
    assert 1 <= len(written) <= 2 and len(list((tmp_path / "t/last/batch_id=0").glob("bucket=*"))) == 16
    values = {r.k: r.value for r in changes.stored_values(spark, path, "k string, value string").collect()}
    assert len(values) == 201 and values["k7"] == "B" and values["new"] is None and values["k8"] == "A"
    for i in (2, 3):
        changes.ingest_batch(spark.createDataFrame([("k7", 300 + i, f"B{i}")], schema), i, path, ["k"], F.col("v"), 16)
    (bucket,) = {p.name for p in (tmp_path / "t/last/batch_id=3").glob("bucket=*")}
    assert sorted(p.parent.name for p in (tmp_path / "t/last").glob(f"batch_id=*/{bucket}")) == ["batch_id=2", "batch_id=3"]


def test_listings_are_compared_with_the_stored_ones(spark, tmp_path):
    """Scopes and stores apart; a store that a batch does not name keeps its listing; a batch may run twice."""
    schema, path = "scope string, store_id string, product_id string, observed_at timestamp, seq long, hash string", str(tmp_path / "l")
    rng = random.Random(4)
    true, seq, told = {}, 0, []
    for day in range(7):
        rows, before = [], {k: set(v) for k, v in true.items()}
        for key in [("a", "s"), ("b", "s"), ("a", "t")]:
            if rng.random() < 0.7:
                true[key] = {f"p{p}" for p in range(9) if rng.random() < 0.5} or {"p0"}
                for p in sorted(true[key]):
                    rows.append((*key, p, T0 + timedelta(days=day, hours=seq % 3), seq, "h"))
                    seq += 1
        batch = spark.createDataFrame(rows, schema)
        for _ in range(2):
            changes.ingest_listings(batch, day, path, every=3)
        got = {(r.scope, r.store_id, r.product_id) for r in changes.stored_listings(spark, path).collect()}
        assert got == {(*k, p) for k, v in true.items() for p in v}
        named = {r[:2] for r in rows}
        told += [(day, *k, p, 1) for k in named for p in true[k] - before.get(k, set())] + [(day, *k, p, -1) for k in named for p in before.get(k, set()) - true[k]]
        snaps = {(r.scope, r.store_id): r for r in spark.read.parquet(f"{path}/snapshots/batch_id={day}").collect()}
        assert snaps.keys() == named
        for k, r in snaps.items():
            first = min((x for x in rows if x[:2] == k), key=lambda x: x[4])
            assert (r.observed_at, r.offer_count, r.added, r.removed) == (first[3], len(true[k]), len(true[k] - before.get(k, set())), len(before.get(k, set()) - true[k]))
    deltas = spark.read.parquet(f"{path}/deltas").select("batch_id", "scope", "store_id", "product_id", "op")
    assert sorted(map(tuple, deltas.collect())) == sorted(told)


def test_a_listing_is_replayed_by_scope(spark):
    deltas = spark.createDataFrame([("a", "s", "p", 1, 1), ("a", "s", "q", 2, 1), ("b", "s", "p", 1, 1), ("b", "s", "p", 2, -1), ("a", "s", "p", 3, -1)], "scope string, store_id string, product_id string, snap int, op int")
    days = [("a", "s", 1, T0), ("a", "s", 2, T0 + timedelta(days=9)), ("a", "s", 3, T0), ("b", "s", 1, T0), ("b", "s", 2, T0)]
    snapshots = spark.createDataFrame(days, "scope string, store_id string, snap int, snap_at timestamp")
    listed, stores = ingest.listing_as_of(deltas, snapshots, F.lit(T0 + timedelta(days=1)))
    assert {tuple(r) for r in listed.collect()} == {("a", "s", "p")} and stores.count() == 2
    assert ingest.listing_as_of(deltas, snapshots, F.lit(T0 + timedelta(days=1)), "b")[0].collect() == []


def test_ingest_keeps_nulls_apart(spark, tmp_path):
    schema = "k string, seq long, v string"
    for i, v in enumerate([None, None, "A", None]):
        changes.ingest_batch(spark.createDataFrame([("p", i, v)], schema), i, str(tmp_path / "t"), ["k"], F.col("v"))
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "t/changes")).collect()) == [2, 3]


def test_readers_see_a_version_while_another_is_published(spark, tmp_path):
    import threading

    root = f"file://{tmp_path}/db"
    one = {"t": spark.range(3)}
    archive.publish(spark, one, root, "a")
    seen, stop = [], threading.Event()

    def read() -> None:
        while not stop.is_set():
            seen.append(archive.current(spark, root))

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(4):
        archive.publish(spark, {"t": spark.range(k)}, root, f"b{k}")
    stop.set()
    reader.join()
    assert seen and all(x and x["tables"] == ["t"] for x in seen)
    assert archive.open_table(spark, root, "t").count() == 3


def test_two_writers_do_not_publish_at_once(spark, tmp_path):
    root = f"file://{tmp_path}/db"
    archive.publish(spark, {"t": spark.range(1)}, root, "a")
    (tmp_path / "db/LEASE-000000000004").write_text("")
    with pytest.raises(BlockingIOError, match="LEASE"):
        archive.publish(spark, {"t": spark.range(2)}, root, "b")
    (tmp_path / "db/LEASE-000000000004").unlink()
    assert archive.open_table(spark, root, "t").count() == 1 and archive.publish(spark, {"t": spark.range(2)}, root, "b")["status"] == "built"


def test_lines_are_numbered_as_in_the_file(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.jsonl").write_text("\n".join(["", *LINES, "", *BAD, ""]) + "\n")
    whole = archive.read_lines(spark, str(tmp_path), numbered=True)
    assert sorted((r.file[-7:], r.line) for r in whole.collect()) == [(f"{x}.jsonl", n) for x in "ab" for n in [*range(2, len(LINES) + 2), len(LINES) + 3, len(LINES) + 4]]
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    try:
        split = archive.read_lines(spark, str(tmp_path), numbered=True)
        assert sorted(map(tuple, split.select("line", "value").collect())) == sorted(map(tuple, whole.select("line", "value").collect()))
        with pytest.raises(Exception, match=f"Unreadable line at .*.jsonl:{len(LINES) + 3}"):
            archive.strict(archive.parsed(split)).select("kind").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (run,) = archive.projection(archive.parsed(whole).withColumn("seq", F.col("place.row")))["import_run"].collect()
    assert run.errors == 4 and run.error_detail.startswith(f"Line {len(LINES) + 3}: ")


def test_an_archive_of_bad_lines_is_an_error(spark):
    with pytest.raises(Exception, match="No line of the archive"):
        archive.projection(records(spark, BAD))["import_run"].collect()


def test_contexts_are_numbered_over_all_stretches(spark):
    rows = [("r", f"s{i}", T0, i * i * 1000, "n") for i in range(300)]
    contexts = catalog.context_dimension(spark.createDataFrame(rows, "retailer string, store_id string, observed_at timestamp, seq long, store_name string"))
    assert {r.store_id: r.context_id for r in contexts.collect()} == {f"s{i}": i + 1 for i in range(300)}


def test_current_offers_keep_ties(spark):
    rows = [("p", 1, T0, 1), ("p", 1, T0, 2), ("p", 1, T0 - timedelta(days=1), 3), ("p", 2, T0, 4)]
    facts = spark.createDataFrame(rows, "product_id string, context_id long, observed_at timestamp, seq long")
    assert sorted(r.seq for r in catalog.current_offers(facts).collect()) == [1, 2, 4]
