"""Published versions: leases, checks, migrations, layouts; JSON documents; captured pages; answers."""

from __future__ import annotations

import json
import random
import re
import time
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from priceengine.functions import documents
from priceengine.operators import feeds
from priceengine.sources import captures, versions

T0 = datetime(2026, 1, 1)


def test_a_dead_writer_is_taken_over(spark, tmp_path):
    root = f"file://{tmp_path}"
    versions.publish(spark, {"t": spark.range(1)}, root, "a")
    old = tmp_path / "LEASE-000000000000"
    old.write_text("")
    with pytest.raises(BlockingIOError):
        versions.publish(spark, {"t": spark.range(2)}, root, "b", lease_seconds=3600)
    time.sleep(1.2)
    assert versions.publish(spark, {"t": spark.range(2)}, root, "b", lease_seconds=1)["status"] == "built"
    assert not list(tmp_path.glob("LEASE-*")) and versions.open_table(spark, root, "t").count() == 2


def test_a_writer_that_was_taken_over_publishes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}"
    versions.publish(spark, {"t": spark.range(1)}, root, "a")
    with pytest.raises(TimeoutError), versions.lease(spark, root, 1000) as check:
        check()
        (tmp_path / "LEASE-000000000001").write_text("")  # another writer, to whom this one looked dead
        check()
    assert [p.name for p in tmp_path.glob("LEASE-*")] == ["LEASE-000000000001"]


def test_a_bad_stage_is_not_published(spark, tmp_path):
    root = f"file://{tmp_path}"
    good = spark.createDataFrame([(1, 5), (2, 7)], "id long, cents long")
    checks = {"t": {"a price": F.col("cents") >= 0}}
    versions.publish(spark, {"t": good}, root, "a", checks=checks, least={"t": 2})
    for rows, said in (([(1, -5), (2, None)], "a price: 2 rows"), ([(1, 5)], "only 1 rows")):
        with pytest.raises(ValueError, match=said):
            versions.publish(spark, {"t": spark.createDataFrame(rows, "id long, cents long")}, root, "b", checks=checks, least={"t": 2})
    assert versions.current(spark, root)["fingerprint"] == "a" and versions.open_table(spark, root, "t").count() == 2
    assert len([p for p in tmp_path.iterdir() if p.is_dir()]) == 1


def test_migrations_are_applied_once_and_must_not_change(spark, tmp_path):
    root = f"file://{tmp_path}"
    one = versions.Migration("001_dollars", {"t": "SELECT *, cents / 100 AS dollars FROM {t}"})
    two = versions.Migration("002_names", {"t": "SELECT t.*, n.name FROM {t} t LEFT JOIN {n} n USING (id)"})
    versions.publish(spark, {"t": spark.createDataFrame([(1, 50)], "id long, cents long"), "n": spark.createDataFrame([(1, "x")], "id long, name string")}, root, "a")
    kept = versions.current(spark, root)["paths"]["n"]
    assert versions.migrate(spark, root, [two, one]) == ["001_dollars", "002_names"] and versions.migrate(spark, root, [one, two]) == []
    (r,) = versions.open_table(spark, root, "t").collect()
    assert (r.id, r.dollars, r.name) == (1, 0.5, "x") and versions.current(spark, root)["paths"]["n"] == kept
    changed = versions.Migration("001_dollars", {"t": "SELECT * FROM {t}"})
    bad = versions.Migration("003_bad", {"t": "SELECT nothing FROM {t}"})
    for steps, error in (([changed, two], "must not change"), ([one, two, bad], "nothing"), ([one, one], "one name")):
        with pytest.raises(Exception, match=error):
            versions.migrate(spark, root, steps)
    with pytest.raises(ValueError, match="must not change"):
        versions.publish(spark, {"t": spark.range(1)}, root, "b", migrations=[changed])
    assert [m["name"] for m in versions.current(spark, root)["migrations"]] == ["001_dollars", "002_names"]
    # a new build goes through all of them again
    tables = {"t": spark.createDataFrame([(1, 70)], "id long, cents long"), "n": spark.createDataFrame([(1, "y")], "id long, name string")}
    versions.publish(spark, tables, root, "b", migrations=[one, two])
    (r,) = versions.open_table(spark, root, "t").collect()
    assert (r.dollars, r.name) == (0.7, "y")


def test_old_versions_retire(spark, tmp_path):
    root = f"file://{tmp_path}"
    for k in range(4):
        versions.publish(spark, {"t": spark.range(k)}, root, f"m{k}")
    (tmp_path / "of-a-dead-writer").mkdir()
    assert versions.retire(spark, root) == 3
    assert versions.open_table(spark, root, "t").count() == 3 and len(list(tmp_path.glob("MANIFEST-*"))) == 2


def scanned(df) -> tuple[int, int]:
    """(files, rows) that the scans of a plan read."""
    df.collect()
    seen = []

    def walk(node) -> None:
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            walk(node.plan())
        elif name == "FileSourceScanExec":
            seen.append((node.metrics().apply("numFiles").value(), node.metrics().apply("numOutputRows").value()))
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return sum(f for f, _ in seen), sum(r for _, r in seen)


def test_a_history_reads_a_small_part_of_the_published_offers(spark, tmp_path):
    root, n = f"file://{tmp_path}", 240_000
    day = F.timestamp_seconds(F.lit(1767225600) + (F.col("id") % 360) * 86400)
    offers = spark.range(n).select(F.concat(F.lit("p"), (F.xxhash64("id") % 1000 + 1000).cast("string")).alias("product_id"), day.alias("observed_at"), F.col("id").alias("seq"))
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.page.row.count.limit", "500")
    try:
        versions.publish(spark, {"offers": offers}, root, "m", layouts={"offers": versions.month_layout()})
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.page.row.count.limit")
    all_files, all_rows = scanned(versions.open_table(spark, root, "offers"))
    one = versions.product_history(spark, root, "p777")
    files, rows = scanned(one)
    assert rows < all_rows / 10 and all_rows == n
    assert sorted(r.seq for r in one.collect()) == sorted(r.seq for r in offers.where("product_id = 'p777'").collect())
    since, until = T0 + timedelta(days=65), T0 + timedelta(days=70)
    month = versions.product_history(spark, root, "p777", since, until)
    files, rows = scanned(month)
    assert files <= all_files / 10 and rows < all_rows / 100
    assert sorted(r.seq for r in month.collect()) == sorted(r.seq for r in offers.where(F.col("product_id") == "p777").where(F.col("observed_at").between(F.lit(since), F.lit(until))).collect())


SECRET = re.compile("(authorization|cookie|token|secret|password|api[-_]?key)", re.I)
NAMES = st.sampled_from(["a", "b", "tokens", "Api-Key", "x\"token", "secret\\", "é", "Set-Cookie", ",", "{\"password\":1}", "token", ""])
JSON = st.recursive(
    st.one_of(st.none(), st.booleans(), st.integers(-9, 9), st.sampled_from(["", "token", "\"}", "\\\"", "{[", "a,\"password\":\"x\"", "é\n", "\x01\x02"])),
    lambda inner: st.one_of(st.lists(inner, max_size=3), st.dictionaries(NAMES, inner, max_size=3)), max_leaves=12,
)


def blanked(x: object) -> object:
    if isinstance(x, list):
        return [blanked(y) for y in x]
    return {k: "[REDACTED]" if SECRET.search(k) else blanked(v) for k, v in x.items()} if isinstance(x, dict) else x


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(JSON, min_size=8, max_size=40))
def test_secrets_are_blanked_at_any_level(spark, values):
    rows = [(i, json.dumps(v, ensure_ascii=i % 2 == 0, indent=i % 3 or None)) for i, v in enumerate(values)]
    got = spark.createDataFrame(rows, "i long, text string").select("i", documents.redacted_json(F.col("text")).alias("x"), documents.canonical_json(F.col("text")).alias("c")).collect()
    for r in got:
        assert json.loads(r.x) == blanked(values[r.i])
        assert r.c == json.dumps(values[r.i], sort_keys=True, ensure_ascii=False, separators=(",", ":")) or json.loads(r.c) == values[r.i]


def test_long_and_deep_documents_are_redacted(spark):
    long = json.dumps({"a": ["x,\"{" * 200_000, {"token": ["s" * 100_000, {"k": 1}] * 20}], "b": [{"password": i} for i in range(20_000)]})
    deep = '{"a":' * 60 + '{"token":"s"}' + "}" * 60
    deeper = '{"token":' * 200 + "1" + "}" * 200
    rows = [(0, long), (1, deep), (2, deeper), (3, "{bad"), (4, None), (5, ""), (6, '{"a":1,"a":2}'), (7, "a=1&secret=x%20y&b=2&API-KEY=")]
    got = {r.i: (r.x, r.y) for r in spark.createDataFrame(rows, "i long, t string").select("i", documents.redacted_json(F.col("t")).alias("x"), documents.redacted_body(F.col("t")).alias("y")).collect()}
    assert json.loads(got[0][0]) == blanked(json.loads(long)) and json.loads(got[1][0]) == blanked(json.loads(deep)) and got[2][0] == '"[REDACTED]"'
    assert [got[i][0] for i in (3, 4, 5, 6, 7)] == [None] * 5 and got[7][1] == "a=1&secret=[REDACTED]&b=2&API-KEY=[REDACTED]" and got[4][1] is None


def test_fingerprints_of_values(spark):
    texts = ['{"a":1,"b":[1,2]}', '{ "b" : [1.0, 2], "a" : 1 }', '{"a":1,"b":[2,1]}', '{"a":1,"b":[1,2],"c":null}', '{"a":1,"b":["1",2]}', "{"]
    got = [r.f for r in spark.createDataFrame(list(enumerate(texts)), "i long, t string").orderBy("i").select(documents.json_fingerprint(F.col("t")).alias("f")).collect()]
    assert got[0] == got[1] and len({*got[1:]}) == 5 and got[5] is None


def page(store: str | None, total: int, skus: list[str]) -> str:
    return json.dumps({"context": {"fulfilment": {"fulfilmentStoreId": store}}, "products": {"items": [{"sku": s, "price": {"salePrice": 1.5}} for s in skus], "totalItems": total}})


def test_captures_are_checked(spark, tmp_path):
    pages = {
        "good": [page("s", 5, ["a", "b"]), page("s", 5, ["c", "d"]), page("s", 5, ["b"])], "short": [page("s", 5, ["a", "b"]), None, page("s", 5, ["e"])], "end": [page("s", 5, ["a", "b"]), page("s", 5, ["c", "d"])],
        "mixed": [page("s", 3, ["a", "b"]), page("t", 3, ["c"])], "nameless": [page(None, 1, ["a"])], "empty": [page("s", 0, [])], "grown": [page("s", 1, ["a"]), page("s", 3, ["b"])], "broken": ["{"],
    }
    for name, told in pages.items():
        (tmp_path / name).mkdir()
        for k, text in enumerate(told, 1):
            if text:
                (tmp_path / name / f"page-{k}.json").write_text(text)
    (tmp_path / "good" / "notes.txt").write_text("no page")
    read = captures.read_captures(spark, str(tmp_path))
    verdicts = captures.judged(read, *captures.item_pages(F.col("payload"), 2))
    got = {r.capture: r for r in verdicts.collect()}
    assert {k: r.status for k, r in got.items()} == {
        "good": captures.OK, "short": captures.INCOMPLETE, "end": captures.INCOMPLETE, "mixed": captures.FOREIGN, "nameless": captures.UNNAMED, "empty": captures.OK, "grown": captures.OK, "broken": captures.UNNAMED
    }
    assert (got["short"].missing, got["end"].missing, got["good"].expected) == ([2], [3], 3)
    whole = captures.items(captures.complete(read, verdicts)).where("capture = 'good'").orderBy("seq")
    assert [json.loads(r.payload)["sku"] for r in whole.collect()] == ["a", "b", "c", "d", "b"]
    with pytest.raises(Exception, match="capture mixed: foreign store"):
        captures.strict(read.where("capture = 'mixed'"), verdicts).collect()
    assert captures.strict(read.where("capture = 'good'"), verdicts).count() == 3


def test_html_captures_tell_their_pages_by_their_links(spark, tmp_path):
    (tmp_path / "shop").mkdir()
    for k in (1, 3):
        (tmp_path / "shop" / f"page-{k}.html").write_text('<a aria-label="Page 3">3</a>')
    read = captures.read_captures(spark, str(tmp_path))
    (r,) = captures.judged(read, *captures.link_pages(F.col("payload"), F.col("capture"))).collect()
    assert (r.status, r.missing, r.expected) == (captures.INCOMPLETE, [2], 3)


def test_answers_have_an_envelope(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else f"n{i}") for i in range(10)], "id long, name string")
    (r,) = feeds.object_body(rows, ["id"], "q", None, limit=3, total=F.lit(10)).collect()
    assert json.loads(r.body) == {"_requestId": "q", "_freshness": {"exists": False, "fingerprint": None, "builtAt": None, "recordsImported": None}, "total": 10, "items": [{"id": 0, "name": "n0"}, {"id": 1, "name": None}, {"id": 2, "name": "n2"}]}
    (r,) = feeds.array_body(rows, [F.desc("id")], 2).collect()
    assert json.loads(r.body) == [{"id": 9, "name": None}, {"id": 8, "name": "n8"}]
    (r,) = feeds.array_body(rows.where("false"), ["id"]).collect()
    assert r.body == "[]"
    with pytest.raises(ValueError, match="200"):
        feeds.array_body(rows, ["id"], 1000)


def test_the_feed_has_the_defaults_of_the_command_line(spark):
    rng = random.Random(1)
    schema = "product_id string, store_id string, retailer string, observed_at timestamp, seq long, regular_cents long, promo_cents long, member_cents long, promotion struct<type:string,save_percent:double,starts_at:string,ends_at:string>, is_on_special boolean, last_seen_at timestamp"
    rows = [(f"p{rng.randrange(5)}", f"s{rng.randrange(2)}", "r", T0 + timedelta(days=i), i, rng.randrange(100, 900), None, None, None, None, None) for i in range(60)]
    obs, at = spark.createDataFrame(rows, schema), F.lit(T0 + timedelta(days=60))
    told = feeds.feed(obs, at)
    assert all(r.percent >= 20 or r.is_all_time_low for r in told.collect()) and feeds.feed(obs, at, store_id="none").count() == 0
    assert feeds.feed(obs, at, only="ongoing").count() == 0 and feeds.feed(obs, at, min_drop=0.0).count() >= told.count()
    with pytest.raises(TypeError, match="drop"):
        feeds.feed(obs, at, drop=1)


def test_pages_from_zero_and_results_of_stores(spark, tmp_path):
    for store, n, given in (("a", 3, (0, 1, 2)), ("b", 3, (0, 2)), ("c", 0, (0,))):
        (tmp_path / store).mkdir()
        for k in given:
            (tmp_path / store / f"page-{k}.json").write_text(json.dumps({"numberOfPages" if store != "a" else "totalPages": n, "products": [{"productId": f"{store}{k}"}]}))
    read = captures.read_captures(spark, str(tmp_path))
    verdicts = captures.judged(read, *captures.counted_pages(F.col("payload"), F.col("capture")), first=0)
    rows = captures.items(read, "$.products")
    results = captures.store_results(verdicts, rows, rows.where("payload like '%0%'"))
    assert sorted((r.store, r.ok, r.fetched, r.added, r.error) for r in results.collect()) == [("a", True, 3, 1, None), ("b", False, 0, 0, captures.INCOMPLETE), ("c", True, 1, 1, None)]
    assert [captures.exit_code(x).first().exit_code for x in (results, results.where("not ok"), results.where("false"))] == [0, 1, 1]


def test_stores_are_searched_by_name_and_address(spark):
    told = json.dumps({"stores": [{"id": "1", "name": "Royal Oak", "address": "Mt Smart Rd", "banner": "MNW"}, {"id": "2", "name": "Kaitaia", "address": None, "banner": "mnw"}, {"id": "3", "name": "Oak", "banner": "PNS"}]})
    stores = captures.store_list(spark.createDataFrame([(told,), ("{}",), (None,)], "payload string"))
    found = lambda *a: sorted(r.store_id for r in captures.search_stores(stores, *a).collect())
    assert found("mnw") == ["1", "2"] and found("MNW", " OAK ") == ["1"] and found("MNW", "smart") == ["1"] and found("PNS", "x") == []
