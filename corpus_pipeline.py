"""A training corpus from raw documents: reject junk, drop common lines, keep one of near copies, take out benchmark leaks, mix sources.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's `docs`. All stages but the last return the columns of `documents`; the last adds `copy`, `rate` and `order_key`.

Cases: null, empty and very long texts run through all stages as the operators say; a document whose lines are all dropped stays
with an empty text; of equally near copies the smallest doc_id stays, and repeated rows of one doc_id stay or go together;
empty tables give empty results; other columns are kept, but those called `copy`, `rate` or `order_key` are replaced by the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceengine.llm.decontaminate import decontaminate
from priceengine.llm.line_dedup import dedup_lines
from priceengine.llm.mixing import mix_sources
from priceengine.llm.near_dedup import drop_near_copies
from priceengine.llm.quality import keep_good
from priceengine.llm.queries import table
from priceengine.llm.staging import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents that are likely junk go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; n_chars follows."""
    left = dedup_lines(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return drop_near_copies(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies by source, shuffled."""
    return mix_sources(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("decontaminate", leaks), ("mix", mix)]
#: A classifier fitted by Newton's method and hashed signatures are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
