"""The archive from recording to reading, against a plain model of what it is to hold."""

from __future__ import annotations

import json
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from priceengine import __main__ as command_line
from priceengine.archive import PriceArchive

T0 = datetime(2026, 7, 1)
SCHEMA = (
    "product struct<id:string,name:string,size:string>, store struct<id:string,retailer:string,name:string>, price struct<currency:string,regularCents:long,promoCents:long>, "
    "promotion struct<type:string,savePercent:double,endsAt:string>, source struct<retailerProductId:string,adapter:string>, observed_at string, seq long"
)


class Held:
    """Records in order, as a list."""

    def __init__(self):
        self.products, self.stores, self.offers, self.snapshots, self.listed = {}, {}, {}, {}, {}

    def record(self, rows: list[tuple], scope: str | None) -> int:
        new, named = 0, {}
        for product, store, price, promotion, source, at, _ in rows:
            for held, x in ((self.products, product), (self.stores, store)):
                if all(r[1] != x for r in held.setdefault(x[0], [])):
                    held[x[0]].append((at, x))
                    new += 1
            key, data = (product[0], store[0]), (price, promotion, source)
            if not self.offers.setdefault(key, []) or self.offers[key][-1][1] != data:
                self.offers[key].append((at, data))
                new += 1
            named.setdefault(store[0], (at, set()))[1].add(product[0])
        if scope:
            for store, (at, now) in named.items():
                before = self.listed.get((scope, store), set())
                self.snapshots.setdefault((scope, store), []).append((at, now - before, before - now))
                self.listed[scope, store] = now
                new += 1
        return new

    def history(self, until: str) -> list[tuple]:
        out = []
        for (product, store), offers in self.offers.items():
            known, seen, active = False, None, set()
            for at, adds, drops in self.snapshots.get(("specials", store), []):
                if at > until:
                    break
                known, seen, active = True, at, (active | adds) - drops
            for at, data in offers:
                if at > until:
                    continue
                shown = seen if product in active else at
                last = lambda held, shown=shown: next((x for t, x in reversed(held) if t <= shown), held[0][1])
                out.append((product, store, at, data[0][1], data[0][2], data[1][0] if data[1] else None, (product in active) if known else None, seen if product in active else None, last(self.products[product])[1], last(self.stores[store])[2]))
        return sorted(out, key=repr)


def iso(t: datetime) -> str:
    return t.strftime("%Y-%m-%dT%H:%M:%SZ")


def batch(rng: random.Random, day: int, start: int) -> list[tuple]:
    rows = []
    for i in range(rng.randrange(4, 14)):
        p, s = rng.randrange(5), rng.randrange(2)
        at = iso(T0 + timedelta(days=day + rng.choice([0, 0, -2]), hours=i))
        promotion = ("SPECIAL", 10.0, "2026-08-01") if rng.random() < 0.4 else None
        rows.append(((f"paknsave:{p}", f"Item {p} v{rng.randrange(2)}", None), (f"paknsave:s{s}", "paknsave", f"Store {s}{rng.choice('ab')}"), ("NZD", rng.choice([100, 200]), 90 if promotion else None), promotion, (str(p), "x"), at, start + i))
    return rows


def shown(df) -> list[tuple]:
    rows = df.select("product_id", "store_id", "observed_at", "regular_cents", "promo_cents", F.col("promotion.type").alias("kind"), "is_on_special", "last_seen_at", F.get_json_object("product", "$.name").alias("p"), F.get_json_object("store", "$.name").alias("s")).collect()
    return sorted(((r.product_id, r.store_id, iso(r.observed_at), r.regular_cents, r.promo_cents, r.kind, r.is_on_special, r.last_seen_at and iso(r.last_seen_at), r.p, r.s) for r in rows), key=repr)


def test_what_is_recorded_is_read_as_of_any_time(spark, tmp_path):
    rng, held, archive = random.Random(5), Held(), PriceArchive(spark, f"file://{tmp_path}/a")
    (tmp_path / "a").mkdir()
    for day in range(3):
        rows, scope = batch(rng, 3 * day, 100 * day), rng.choice(["specials", "specials", "catalogue", None])
        assert archive.record(spark.createDataFrame(rows, SCHEMA), scope) == held.record(rows, scope)
    for day in (4,):
        until = T0 + timedelta(days=day)
        assert shown(archive.history(until=until)) == held.history(iso(until))
    assert [json.loads(r.product)["name"] for r in archive.product_history("paknsave:1").orderBy("seq").collect()] == [x[1] for _, x in held.products["paknsave:1"]]
    until = T0 + timedelta(days=20)
    assert shown(archive.history(store_id="paknsave:s1", retailer="paknsave", until=until)) == [r for r in held.history(iso(until)) if r[1] == "paknsave:s1"]
    assert archive.history(retailer="other", until=until).count() == 0
    # the same again: nothing is new but the snapshot
    assert archive.record(spark.createDataFrame(rows[-1:], SCHEMA)) == held.record(rows[-1:], None) == 0
    feed = archive.agent_feed(until, products=["paknsave:1", "paknsave:2"], min_samples=1)
    assert {r.product_id for r in feed.collect()} <= {"paknsave:1", "paknsave:2"}
    # the archive twice over, then compacted, is the archive
    for k, folder in enumerate(sorted(p for p in (tmp_path / "a").iterdir() if p.is_dir())):
        lines = "".join(f.read_text() for f in sorted(folder.glob("part-*")))
        (tmp_path / "b").mkdir(exist_ok=True)
        (tmp_path / "b" / f"batch-{k:012d}.jsonl").write_text(lines + "".join(x + "\n" for x in lines.splitlines() if '"type":"offer"' not in x))
    PriceArchive(spark, str(tmp_path / "b")).compact(str(tmp_path / "c"))
    read = lambda folder: sorted(r.value for r in spark.read.option("recursiveFileLookup", True).text(str(tmp_path / folder)).collect())
    assert read("c") == read("a") and len(read("b")) > len(read("a"))
    built = archive.build(f"file://{tmp_path}/db")
    assert built["status"] == "built" and archive.build(f"file://{tmp_path}/db")["status"] == "skipped"


def test_bare_observations_are_read_as_revisions_and_changes(spark, tmp_path):
    def bare(day: int, cents: int, name: str) -> str:
        return json.dumps({"product": {"id": "a:9", "name": name}, "store": {"id": "a:s", "retailer": "a"}, "price": {"regularCents": cents}, "source": {"retailerProductId": "9"}, "observedAt": iso(T0 + timedelta(days=day))})

    (tmp_path / "old.jsonl").write_text("\n".join([bare(0, 5, "x"), bare(1, 5, "y"), bare(2, 7, "x"), "", bare(3, 7, "x"), bare(4, 5, "x")]) + "\n")
    archive = PriceArchive(spark, str(tmp_path / "old.jsonl"))
    got = sorted((r.observed_at, r.regular_cents, json.loads(r.product)["name"]) for r in archive.history(until=T0 + timedelta(days=9)).collect())
    # revisions are told once, so a name that comes back does not count again
    assert got == [(T0, 5, "x"), (T0 + timedelta(days=2), 7, "y"), (T0 + timedelta(days=4), 5, "y")]
    assert archive.product_history("a:9").count() == 2


def test_an_unreadable_archive_is_an_error(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("{bad\n")
    with pytest.raises(Exception, match="Unreadable line"):
        PriceArchive(spark, str(tmp_path)).history().collect()


def test_the_command_line(spark, tmp_path):
    archive = PriceArchive(spark, f"file://{tmp_path}/a")
    rows = batch(random.Random(1), 0, 0)
    archive.record(spark.createDataFrame(rows, SCHEMA), "specials")
    ask = lambda *given: command_line.answer(archive, command_line.arguments(list(given)))
    assert ask("stats").first().products == len({r[0][0] for r in rows})
    assert ask("history", rows[0][0][0]).count() >= 1 and ask("product", rows[0][0][0]).count() >= 1
    (tmp_path / "mine.json").write_text(json.dumps({"productIds": ["q", "p"]}))
    args = command_line.arguments(["feed", "--product", "p", "--favorites", str(tmp_path / "mine.json"), "--at", "2026-07-03"])
    assert command_line.wanted(args) == ["p", "q"] and (args.drop, args.samples, args.baseline_days, args.fresh_days) == (20.0, 2, 90, 7)
    assert ask("ongoing", "--at", "2026-07-02").count() == len([r for r in archive.agent_feed(datetime(2026, 7, 2)).collect() if r.feed == "ongoing"])
    assert datetime.now(UTC) and ask("feed", "--product", "none").count() == 0
    (tmp_path / "mine.json").write_text('"p"')
    with pytest.raises(TypeError):
        command_line.wanted(args)
