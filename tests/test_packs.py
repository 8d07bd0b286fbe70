"""Packs hold many captured pages in few files."""

from __future__ import annotations

from pyspark.sql import functions as F

from priceengine.plans import text_queries
from priceengine.sources import captures


def test_files_do_not_grow_with_pages(spark, tmp_path):
    spark.range(1, 8001).select(F.col("id").alias("p_partkey"), F.concat(F.lit("part "), "id").alias("p_name")).write.parquet(f"{tmp_path}/part.parquet")
    pages = text_queries._captures(spark, str(tmp_path))
    assert pages.count() == 5 * 40 - 1 and len(pages.inputFiles()) <= 8
    verdicts = {r.capture: (r.pages, r.expected, r.missing, r.status) for r in text_queries._verdicts(pages).collect()}
    assert verdicts == {
        "0": (40, 40, [], captures.OK), "1": (39, 40, [1], captures.INCOMPLETE), "2": (40, 40, [], captures.FOREIGN), "3": (40, 40, [], captures.UNNAMED), "4": (40, 40, [], captures.OK)
    }
    skus = [int(r.sku) for r in captures.items(pages.where("capture = '4'")).selectExpr("capture", "get_json_object(payload, '$.sku') as sku").collect()]
    assert sorted(skus) == list(range(4, 8001, 5))


def test_packed_payloads_stay_as_they_were(spark, tmp_path):
    (tmp_path / "shop").mkdir()
    for k, text in ((1, '{\n "a": "é"\r\n}'), (2, "")):
        (tmp_path / "shop" / f"page-{k}.json").write_bytes(text.encode())
    read = captures.read_captures(spark, str(tmp_path / "*"))
    captures.pack(read, f"{tmp_path}/packs")
    packed = captures.read_packs(spark, f"{tmp_path}/packs")
    assert packed.columns == read.columns and sorted(map(tuple, packed.collect())) == sorted(map(tuple, read.collect())) and packed.count() >= 1
