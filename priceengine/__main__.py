"""The command line: python -m priceengine feed --file prices --drop 20"""

from __future__ import annotations

import argparse
import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame

from priceengine.archive import PriceArchive
from priceengine.operators.feeds import DEFAULTS
from priceengine.session import builder


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="priceengine")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("feed", "ongoing", "history", "product", "stats", "build", "compact"):
        sub = commands.add_parser(name)
        sub.add_argument("--file", default="data/prices", help="the archive: a folder of JSONL, or one file")
        if name in ("history", "product"):
            sub.add_argument("product_id")
        if name in ("feed", "ongoing", "history"):
            sub.add_argument("--store")
        if name in ("feed", "ongoing", "stats"):
            sub.add_argument("--retailer")
        if name in ("feed", "ongoing"):
            sub.add_argument("--drop", type=float, default=DEFAULTS["min_drop"])
            sub.add_argument("--samples", type=int, default=DEFAULTS["min_samples"])
            sub.add_argument("--baseline-days", type=int, default=DEFAULTS["baseline_days"])
            sub.add_argument("--fresh-days", type=int, default=DEFAULTS["fresh_days"])
            sub.add_argument("--product", action="append", default=[])
            sub.add_argument("--favorites", help="a JSON array of product ids, or an object with productIds")
            sub.add_argument("--member-prices", action="store_true")
            sub.add_argument("--at", type=datetime.fromisoformat, help="the evaluation time; now, if not given")
        if name in ("build", "compact"):
            sub.add_argument("--output", required=True)
        if name == "build":
            sub.add_argument("--force", action="store_true")
    return parser.parse_args(given)


def wanted(args: argparse.Namespace) -> list[str] | None:
    """The product ids asked for, each once, or None for all."""
    if not args.favorites:
        return args.product or None
    with open(args.favorites, encoding="utf-8") as f:
        told = json.load(f)
    ids = told if isinstance(told, list) else told.get("productIds") if isinstance(told, dict) else None
    if not isinstance(ids, list):
        raise TypeError("favourites are a JSON array or an object with productIds")
    return list(dict.fromkeys([*args.product, *ids]))


def answer(archive: PriceArchive, args: argparse.Namespace) -> DataFrame | dict:
    if args.command in ("feed", "ongoing"):
        at = args.at or datetime.now(UTC)
        options = {"min_drop": args.drop, "min_samples": args.samples, "baseline_days": args.baseline_days, "fresh_days": args.fresh_days}
        only = "ongoing" if args.command == "ongoing" else None
        return archive.agent_feed(at, args.retailer, args.store, wanted(args), only=only, member_prices=args.member_prices, **options)
    if args.command == "history":
        return archive.history(args.product_id, args.store).orderBy("observed_at", "seq")
    if args.command == "product":
        return archive.product_history(args.product_id).orderBy("seq").drop("seq")
    if args.command == "stats":
        return archive.stats(args.retailer)
    if args.command == "build":
        return archive.build(args.output, args.force)
    archive.compact(args.output)
    return {"output": args.output}


def main() -> None:
    args = arguments()
    out = answer(PriceArchive(builder().getOrCreate(), args.file), args)
    if isinstance(out, dict):
        print(json.dumps(out, indent=2))
        return
    for row in out.toJSON().toLocalIterator():  # a partition at a time
        print(row)


if __name__ == "__main__":
    main()
