"""Scalars and markup."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from priceengine.functions import markup as M
from priceengine.functions import scalars as S


def over(spark, values: list, f, kind: str = "string") -> list:
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_half_up(spark):
    assert over(spark, [2.5, -2.5, 2.49, -2.51, None], S.half_up, "double") == [3, -2, 2, -3, None]


def test_gtin(spark):
    assert over(spark, ["941 2345 6789 01", "1234567", "123456789012345", "12345678a", "00012345", None], S.gtin) == ["941234567890" + "1", None, None, None, "00012345", None]


def test_quantity(spark):
    got = over(spark, ["1.5 kg", "2lt", "various", "500G", " 6 Pack ", "1. kg", None], S.quantity)
    assert [None if q is None else (q.value, q.unit) for q in got] == [(1.5, "kg"), (2.0, "l"), None, (500.0, "g"), (6.0, "pack"), None, None]


def test_tokens_and_jaccard(spark):
    assert over(spark, ["The Milk & Honey of  a Cow's milk", "", None, "a b"], S.name_tokens) == [["milk", "honey", "cow's", "milk"], [], [], []]
    df = spark.createDataFrame([(["a", "b"], ["b", "a", "a"]), (["a"], ["b"]), ([], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(S.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, pytest.approx(1 / 3)]


def test_money(spark):
    assert over(spark, ["now $1,234.50 each", "$ 3", "free", None, "$0.07"], S.money) == [123450, 300, None, None, 7]


def test_range():
    assert [S.in_range(v, 1, 200, 42) for v in (5, "7.9", 0, 201, None, "x")] == [5, 7, 42, 42, 42, 42]


def test_redaction(spark):
    got = over(spark, ["Authorization: Bearer abcdefgh1234", "x (token=abcd1234)", "session_id: 12345 ok", "fine", None, "x" * 2000], S.redacted)
    assert "abcdefgh" not in got[0] and got[1] == "x token=**REDACTED**)" and "12345" not in got[2] and got[3] == "fine" and got[4] == "" and len(got[5]) == 1000


def test_run_kinds(spark):
    df = spark.createDataFrame([(0, "429"), (143, None), (1, "Too Many Requests"), (1, "503"), (1, "ENOTFOUND"), (1, "TimeoutError 429"), (1, None)], "c int, s string")
    assert [r[0] for r in df.select(S.run_kind(F.col("c"), F.col("s"))).collect()] == ["success", "timeout", "rate_limited", "server_error", "network", "timeout", "failure"]


def test_slugs_and_labels(spark):
    assert over(spark, ["royal-oak", "mcDonald--s"], S.title_slug) == ["Royal Oak", "McDonald S"]
    assert over(spark, ["newworld", "x"], S.retailer_label) == ["New World", "x"]
    assert over(spark, ["a:b:c", "plain"], S.after_namespace) == ["b:c", "plain"]


def test_decoding(spark):
    assert over(spark, ["&amp;lt;b&gt; &#233;&#x1F600;&nbsp;&quot;", "&#1114112; &#0;", None], M.decoded) == ['<b> é\U0001f600 "', "&#1114112; &#0;", None]


def test_best_image(spark):
    values = ['"u"', '["", "v"]', '{"90": "a", "400": "b", "x": "c"}', '{"x": "c"}', "[]", '""', "oops{", None, "5"]
    assert over(spark, values, M.best_image) == ["u", "v", "b", None, None, None, None, None, None]


def test_multibuy_and_counters(spark):
    got = over(spark, ["3 for $10.00", "Any 2 FOR $ 1,005", "0 for $5", "na"], M.multibuy)
    assert [None if g is None else tuple(g) for g in got] == [(3, 1000, 333), (2, 100500, 50250), None, None]
    assert over(spark, ['aria-label="Page 3" aria-label="Page 12"', ""], M.page_count) == [12, 1]
    assert over(spark, ["of 1,204 products", "of 7 Results", "none"], M.item_count) == [1204, 7, None]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), max_size=5), st.lists(st.sampled_from("abcd"), max_size=5)), min_size=1, max_size=5))
def test_jaccard_is_symmetric(spark, pairs):
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    for r in df.select(S.jaccard(F.col("a"), F.col("b")).alias("x"), S.jaccard(F.col("b"), F.col("a")).alias("y"), "a", "b").collect():
        both, either = len(set(r.a) & set(r.b)), len(set(r.a) | set(r.b))
        assert r.x == r.y == (both / either if either else 0)


def test_shown_times_and_prices(spark):
    from datetime import datetime, timedelta

    now = datetime(2026, 7, 15, 12)
    ages = [timedelta(seconds=30), timedelta(minutes=5), timedelta(hours=3, minutes=59), timedelta(days=29), timedelta(days=30)]
    df = spark.createDataFrame([(i, now - a) for i, a in enumerate(ages)] + [(9, None)], "i int, at timestamp")
    assert [r[0] for r in df.orderBy("i").select(S.relative_text(F.col("at"), F.lit(now))).collect()] == ["just now", "5m ago", "3h ago", "29d ago", "15 Jun 2026", ""]
    assert over(spark, [123450, 7, None], S.cents_text, "long") == ["$1,234.50", "$0.07", ""]


def test_addresses(spark):
    from priceengine.sources.payloads import details_path, product_page

    assert over(spark, ["/p/1.html", "x", "https://b.example/y"], lambda c: product_page("https://a.example/", c)) == ["https://a.example/p/1.html", "https://a.example/x", "https://b.example/y"]
    assert over(spark, ["It's (ok)! a/b~", None], lambda c: details_path(F.lit("7"), c)) == ["/shop/productdetails?stockcode=7&name=It's%20(ok)!%20a%2Fb~", "/shop/productdetails?stockcode=7&name=product"]
