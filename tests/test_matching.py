"""Matching, review states, users' lists, payloads."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from priceengine.operators import health, matching, personal
from priceengine.sources import payloads

PRODUCT = "seq long, id string, retailer string, name string, brand string, size string, source_id string, gtin string"


def products(spark, *rows: dict):
    return spark.createDataFrame([(i, *[({"id": f"x:{i}"} | r).get(c) for c in ("id", "retailer", "name", "brand", "size", "source_id", "gtin")]) for i, r in enumerate(rows)], PRODUCT)


def test_equal_codes(spark):
    assert matching.gtin_matches(products(spark, *[{"gtin": "12345678"}] * 3)).count() == 3
    assert matching.gtin_matches(products(spark, {"gtin": "012345678"}, {"gtin": "12345678"}, {"gtin": None})).collect() == []
    (r,) = matching.gtin_matches(products(spark, {"id": "b:1", "gtin": "12345678"}, {"id": "a:1", "gtin": "1234 5678"})).collect()
    assert (r.a_id, r.b_id, r.review_state, r.confidence) == ("a:1", "b:1", "confirmed", 1.0)


def test_source_ids_need_both_retailers(spark):
    pak, new, other = ({"retailer": r, "source_id": "7"} for r in ("paknsave", "newworld", "woolworths"))
    assert matching.source_id_matches(products(spark, pak, new)).count() == 1
    assert matching.source_id_matches(products(spark, pak, pak, new)).count() == 3
    assert matching.source_id_matches(products(spark, pak, pak)).collect() == []
    assert matching.source_id_matches(products(spark, pak, other)).collect() == []


def test_fuzzy_candidates(spark):
    same = {"name": "Blue Top Milk", "brand": "Anchor", "size": "2L"}
    (r,) = matching.fuzzy_candidates(products(spark, same, same | {"brand": " ANCHOR "})).collect()
    assert (r.confidence, r.review_state) == (1.0, "candidate")
    assert matching.fuzzy_candidates(products(spark, same, {"name": "Red Jam", "brand": "Anchor", "size": "1L"})).collect() == []
    assert matching.fuzzy_candidates(products(spark, *[same] * 21)).collect() == []
    assert matching.fuzzy_candidates(products(spark, *[same] * 20)).count() == 190
    assert matching.fuzzy_candidates(products(spark, *[same] * 20), cap=10).count() == 10
    assert matching.fuzzy_candidates(products(spark, {"name": "a"}, {"name": "a"})).collect() == []


def test_upsert_rules(spark):
    stored = spark.createDataFrame(
        [("a", "b", "m", 1.0, "confirmed", "user", "e", "1"), ("a", "c", "m", 1.0, "confirmed", "system", "e", "1"), ("a", "d", "m", 1.0, "rejected", "system", "e", "1"), ("a", "e", "m", 1.0, "rejected", "system", "e", "0"), ("a", "f", "m", 1.0, "confirmed", "system", "old", "1")],
        "a_id string, b_id string, match_method string, confidence double, review_state string, provenance string, evidence_hash string, algorithm_version string",
    )
    found = spark.createDataFrame([("a", x, "fuzzy", 0.5, "candidate", "system", "e") for x in "bcdefg"], "a_id string, b_id string, match_method string, confidence double, review_state string, provenance string, evidence_hash string")
    got = {r.b_id: r.action for r in matching.upsert_actions(stored, found).collect()}
    assert got == {"b": "skip", "c": "skip", "d": "skip", "e": "update", "f": "update", "g": "insert"}
    once = matching.upserted(stored, found)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, matching.upserted(once, found).collect()))
    assert {r.b_id: r.review_state for r in once.collect()}["f"] == "candidate"


def test_reviews_and_split(spark):
    pairs = spark.createDataFrame([("a", "b", "candidate", "system", 0.5), ("a", "c", "candidate", "system", 0.9)], "a_id string, b_id string, review_state string, provenance string, confidence double")
    reviews = spark.createDataFrame([("a", "b", "rejected")], "a_id string, b_id string, review_state string")
    out = matching.reviewed(pairs, reviews)
    assert {(r.b_id, r.review_state, r.provenance) for r in out.collect()} == {("b", "rejected", "user"), ("c", "candidate", "system")}
    assert {(r.product_id, r.other_id, r.shown_as) for r in matching.match_split(out).collect()} == {("a", "c", "candidates"), ("c", "a", "candidates")}
    assert [(r.other_id, r.rank) for r in matching.ranked_matches(pairs).where("product_id = 'a'").orderBy("rank").collect()] == [("c", 1), ("b", 2)]


def test_limits(spark):
    at = datetime(2026, 7, 1, 12)
    rows = spark.createDataFrame([("k", at, i) for i in range(5)] + [("k", datetime(2026, 7, 1, 12, 1), 5)], "bucket_key string, at timestamp, seq long")
    assert [r.admitted for r in personal.admitted(rows, "1 minute", 3).orderBy("seq").collect()] == [True] * 3 + [False] * 2 + [True]
    assert sorted((r.requests, r.rejected) for r in personal.window_counts(rows, "1 minute", 3).collect()) == [(1, 0), (5, 2)]


def test_run_records(spark):
    rows = spark.createDataFrame([("a", datetime(2026, 7, 1), datetime(2026, 7, 1, 0, 0, 2), 1, 5, "token=abcdef 503")], "retailer string, started_at timestamp, ended_at timestamp, exit_code int, records int, stderr string")
    (r,) = health.run_records(rows).collect()
    assert (r.status, r.error_category, r.duration_ms, r.error_message) == ("failure", "server_error", 2000, "token=**REDACTED** 503")
    log = spark.createDataFrame([(i, i == 3) for i in range(6)], "seq long, corrupt boolean")
    assert health.before_first_error(log).count() == 3 and [r.seq for r in health.newest(log, 2).collect()] == [5, 4]


def test_json_payloads(spark):
    a = {"productId": "5000-EA", "name": "Milk", "displayName": "2L", "price": 450, "promotions": [{"promoId": "x", "bestPromotion": False}, {"promoId": "y", "bestPromotion": True, "rewardType": "NEW_PRICE", "threshold": 2}], "categoryTrees": [{"level0": "Fridge", "level1": "", "level2": "Milk"}]}
    (r,) = payloads.shape_a(spark.createDataFrame([(json.dumps(a),)], "payload string")).collect()
    assert (r.product_id, r.name, r.regular_cents, r.promo_cents, r.promotion.id, r.promotion.threshold, r.categories) == ("foodstuffs:5000-ea", "Milk 2L", 450, 450, "y", 2, ["Fridge", "Milk"])
    b = {"sku": "12", "name": "Bread", "price": {"originalPrice": 4.55, "salePrice": 3.5, "isClubPrice": True, "savePrice": 1.05}, "size": {"volumeSize": "700g", "cupPrice": 0.5, "cupMeasure": "100g"}, "departments": [{"name": "Bakery"}]}
    (r,) = payloads.shape_b(spark.createDataFrame([(json.dumps(b),)], "payload string")).collect()
    assert (r.name, r.regular_cents, r.promo_cents, r.member_cents, r.promotion.type, r.promotion.save_cents, r.comparative, r.categories) == ("Bread 700g", 455, None, 350, "MEMBER_PRICE", 105, "$0.50 / 100g", ["Bakery"])


def test_html_payloads(spark):
    line = '<x><div class="talker talker--Special" data-talker id="line_9"><span class="talker__product-name">Tea <b>Bags</b></span><strong class="price__sell">$3.00</strong><span class="talker__prices__was">$4.00</span></div><div class="talker" data-talker id="line_10"></div>'
    (r,) = payloads.storefront(spark.createDataFrame([(line,)], "html string")).collect()
    assert (r.product_id, r.name, r.regular_cents, r.promo_cents, r.promotion.save_percent) == ("freshchoice:9", "Tea Bags", 400, 300, 25.0)
    tile = '<div class="product-tile" data-gtm-product="{&quot;id&quot;:&quot;R1&quot;,&quot;name&quot;:&quot;Soap&quot;,&quot;price&quot;:&quot;5.00&quot;,&quot;productThenPrice&quot;:&quot;na&quot;,&quot;brand&quot;:&quot;na&quot;,&quot;category&quot;:&quot;Home/Bath/&quot;,&quot;promotionCallOutMessage&quot;:&quot;2 for $8&quot;}"></div><div class="product-tile" data-gtm-product="{bad">'
    (r,) = payloads.tiles(spark.createDataFrame([(tile,)], "html string")).collect()
    assert (r.product_id, r.brand, r.regular_cents, r.promo_cents, r.promotion.type, r.promotion.threshold, r.categories) == ("warehouse:R1", None, 500, 400, "MULTIBUY", 2, ["Home", "Bath"])
    last = payloads.last_by_id(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "product_id string, seq long, name string")).collect()
    assert [x.name for x in last] == ["y"]


def test_store_cards(spark):
    card = '<div class="StoreCard"><span class="StoreCard__Name">Queenstown</span><span class="StoreCard__Details">1 Main St<br>Town<br>Open till 9</span><a href="https://queenstown.shop.example/"></a></div>'
    pages = spark.createDataFrame([(card + card,), ("https://royal-oak.shop.example",)], "html string")
    got = {r.slug: r for r in payloads.store_cards(pages, "shop.example").collect()}
    assert (got["queenstown"].name, got["queenstown"].address) == ("FreshChoice Queenstown", "1 Main St, Town")
    assert (got["royal-oak"].name, got["royal-oak"].address, got["royal-oak"].origin) == ("FreshChoice Royal Oak", None, "https://royal-oak.shop.example")
    assert pages.select(F.count("*")).first()[0] == 2
