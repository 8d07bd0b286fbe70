"""Sales, feeds and deals on hand-made observations."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from priceengine.operators import deals, prices
from priceengine.schema import OBSERVATION

NOW = datetime(2026, 7, 15, 12)


def seen(spark, *rows: dict):
    """Rows with defaults; `days` before NOW."""
    out = []
    for i, r in enumerate(rows):
        r = {"product": "test:1", "store": "store:1", "retailer": "testretailer", "promo": None, "member": None, "promotion": None, "special": None, "last": None} | r
        out.append((r["product"], r["store"], r["retailer"], NOW - timedelta(days=r["days"]), i, r["regular"], r["promo"], r["member"], r["promotion"], r["special"], r["last"]))
    return spark.createDataFrame(out, OBSERVATION)


def at():
    return F.lit(NOW)


PROMOTION = ("SPECIAL", 20.0, None, None)


def test_one_observation_is_no_sale(spark):
    assert prices.history_sales(seen(spark, {"days": 1, "regular": 1000}), at()).collect() == []


def test_a_drop_against_the_baseline(spark):
    obs = seen(spark, *[{"days": d, "regular": 1000} for d in (30, 25, 20)], {"days": 1, "regular": 800})
    (r,) = prices.history_sales(obs, at(), baseline_days=60, min_samples=2, min_drop=5).collect()
    assert (r.current_cents, r.average_cents, r.sample_count, r.drop_percent, r.is_all_time_low) == (800, 1000, 3, 20.0, True)


def test_a_small_drop_needs_the_all_time_low_rule(spark):
    obs = seen(spark, {"days": 30, "regular": 1000}, {"days": 20, "regular": 1000}, {"days": 1, "regular": 995})
    assert prices.history_sales(obs, at(), min_drop=5, include_all_time_lows=False).collect() == []
    assert prices.history_sales(obs, at(), min_drop=5).count() == 1


def test_the_promotional_price_is_the_effective_one(spark):
    obs = seen(spark, {"days": 30, "regular": 1000}, {"days": 20, "regular": 1000}, {"days": 1, "regular": 1000, "promo": 750})
    (r,) = prices.history_sales(obs, at()).collect()
    assert (r.current_cents, r.price_kind, r.drop_percent) == (750, "promo", 25.0)


@pytest.mark.parametrize(("regular", "promo", "member", "policy", "want"), [
    (500, None, None, "public", (500, "regular")), (500, 500, None, "public", (500, "regular")), (500, 400, 300, "public", (400, "promo")),
    (500, 400, 300, "member", (300, "member")), (500, 300, 300, "member", (300, "promo")),
])
def test_ties_keep_the_earlier_kind(spark, regular, promo, member, policy, want):
    obs = seen(spark, {"days": 1, "regular": regular, "promo": promo, "member": member})
    (r,) = obs.select(prices.effective_price(policy).alias("p")).collect()
    assert tuple(r.p) == want


def test_the_sample_gate_counts_the_baseline_only(spark):
    obs = seen(spark, {"days": 200, "regular": 1000}, {"days": 150, "regular": 1000}, {"days": 20, "regular": 1000}, {"days": 1, "regular": 500})
    assert prices.history_sales(obs, at(), min_samples=2).collect() == []
    assert prices.history_sales(obs, at(), min_samples=1).count() == 1


def test_rises_round_half_up_and_zero_averages_stay(spark):
    obs = seen(spark, {"days": 9, "regular": 1000}, {"days": 8, "regular": 1000}, {"days": 1, "regular": 1025})
    (r,) = prices.history_sales(obs, at(), min_drop=-10).collect()
    assert r.drop_percent == -2.5
    free = seen(spark, {"days": 9, "regular": 0}, {"days": 8, "regular": 0}, {"days": 1, "regular": 10})
    (r,) = prices.history_sales(free, at()).collect()
    assert r.drop_percent is None


def test_equal_times_are_ordered_by_seq(spark):
    obs = seen(spark, {"days": 5, "regular": 1000}, {"days": 5, "regular": 900}, {"days": 5, "regular": 700})
    (r,) = prices.history_sales(obs, at()).collect()
    assert (r.current_cents, r.sample_count, r.average_cents) == (700, 2, 950)


def test_ongoing_sales(spark):
    live = {"days": 1, "regular": 1000, "promo": 700, "promotion": PROMOTION}
    (r,) = prices.ongoing_sales(seen(spark, live), at()).collect()
    assert (r.current_cents, r.save_percent) == (700, 30.0)
    for other in ({"promo": None}, {"days": 30}, {"special": False}, {"promotion": None}, {"promotion": ("SPECIAL", 1.0, "2026-07-16", None)}, {"promotion": ("SPECIAL", 1.0, None, "2026-07-01")}):
        assert prices.ongoing_sales(seen(spark, live | other), at()).collect() == [], other
    for other in ({"special": True}, {"promotion": ("SPECIAL", 1.0, "garbage", "")}, {"days": 30, "last": NOW - timedelta(days=2)}):
        assert prices.ongoing_sales(seen(spark, live | other), at()).count() == 1, other


def test_member_policy_and_the_promotions_own_percent(spark):
    obs = seen(spark, {"days": 1, "regular": 1000, "member": 900, "promotion": PROMOTION})
    assert prices.ongoing_sales(obs, at()).collect() == []
    (r,) = prices.ongoing_sales(obs, at(), policy="member").collect()
    assert (r.current_cents, r.price_kind, r.save_percent) == (900, "member", 10.0)
    (r,) = prices.ongoing_sales(seen(spark, {"days": 1, "regular": 500, "promo": 500, "promotion": PROMOTION}), at()).collect()
    assert r.save_percent == 20.0


def milk(spark):
    at_royaloak = [{"days": d, "regular": c, "product": "a:milk", "store": "s:royaloak"} for d, c in ((44, 599), (30, 589), (14, 579), (0, 499))]
    at_chartwell = [{"days": d, "regular": c, "product": "a:milk", "store": "s:chartwell"} for d, c in ((44, 599), (30, 589), (14, 579), (0, 509))]
    bread = {"days": 1, "regular": 450, "promo": 350, "promotion": ("S", 22.0, "2026-07-14", None), "product": "a:bread", "store": "s:royaloak"}
    butter = {"days": 1, "regular": 800, "promo": 600, "promotion": ("S", 25.0, None, None), "product": "a:butter", "store": "s:chartwell"}
    same = {"days": 1, "regular": 500, "promo": 500, "promotion": ("S", None, None, None), "product": "a:eggs", "store": "s:royaloak"}
    return seen(spark, *at_royaloak, *at_chartwell, bread, butter, same)


def test_public_deals(spark):
    cards = {(r.product_id, r.store_id): r for r in deals.public_deals(milk(spark), at()).collect()}
    assert {k: r.kind for k, r in cards.items()} == {
        ("a:milk", "s:royaloak"): "all_time_low", ("a:milk", "s:chartwell"): "all_time_low", ("a:bread", "s:royaloak"): "advertised_only", ("a:butter", "s:chartwell"): "advertised_only"
    }
    assert cards["a:bread", "s:royaloak"].savings_text == "22% off"
    assert deals.public_deals(milk(spark), at(), kind="advertised").count() == 2
    with pytest.raises(ValueError, match="kind"):
        deals.public_deals(milk(spark), at(), kind="other")


def test_an_offer_with_both_kinds_is_one_card(spark):
    rows = [{"days": d, "regular": c} for d, c in ((44, 599), (30, 589), (14, 579))] + [{"days": 0, "regular": 600, "promo": 499, "promotion": PROMOTION}]
    (r,) = deals.public_deals(seen(spark, *rows), at()).collect()
    assert r.kind == "all_time_low"


def test_tiers(spark):
    watched = spark.createDataFrame([("product", "a:milk"), ("category", "a:Dairy")], "target_kind string, target_id string")
    preferred = spark.createDataFrame([("s:royaloak",)], "store_id string")
    categories = spark.createDataFrame([("a:butter", "Dairy")], "product_id string, category string")
    cards = deals.with_tiers(deals.public_deals(milk(spark), at()), watched, preferred, categories)
    tiers = {(r.product_id, r.store_id): r.tier for r in cards.collect()}
    assert tiers == {("a:milk", "s:royaloak"): "watch-preferred", ("a:milk", "s:chartwell"): "watch-other", ("a:butter", "s:chartwell"): "watch-other", ("a:bread", "s:royaloak"): "all"}
    assert [r.tier for r in deals.tiered_deals(cards, 3).collect()] == ["watch-preferred", "watch-other", "watch-other"]


def test_feed_has_both_kinds(spark):
    feed = prices.agent_feed(milk(spark), at()).collect()
    assert {r.feed for r in feed} == {"ongoing", "history"} and {r.currency for r in feed} == {"NZD"}


def test_empty_tables(spark):
    none = seen(spark)
    for df in (prices.history_sales(none, at()), prices.ongoing_sales(none, at()), deals.public_deals(none, at()), prices.agent_feed(none, at())):
        assert df.collect() == []
