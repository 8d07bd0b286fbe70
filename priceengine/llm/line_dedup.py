"""Operator 6: exact line dedup, with DataFrame functions only.

Lines are exploded once into (doc, position, 128-bit key hash), counted per key after a map-side combine, and joined
back as the positions to drop; a hot line costs one partial row per task in the count, and its many rows on the probe
side of the join can be split by AQE, as the other side has one row for each key.

Cases: very long texts are read whole, in time linear in their lines. Null and empty texts are one empty line, kept. A null doc_id takes no part in the counts and keeps all lines.
Repeated rows of one doc_id count as one document; each row comes back, with the same lines gone. Ties cannot occur:
the largest doc_id is unique. An empty table gives an empty table. All input columns are kept, whatever their
names, but n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceengine.llm.staging import small, staged

SPACE = " \t\n\x0b\x0c\r"
#: Common lines are broadcast up to so many counted rows of 24 bytes; beyond, both sides are dealt out.
MAX_BROADCAST_KEYS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Trim ASCII white space and lower-case A-Z. lower() is the faster way where a line is pure ASCII."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with `text_col` rebuilt from the lines that stay, and n_lines and n_dropped added."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    one = (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("__id"), F.posexplode(lines).alias("__pos", "__line"))
        .select("__id", "__pos", line_key(F.col("__line")).alias("__key"))
        .where(F.char_length("__key") >= min_chars)
        .select("__id", "__pos", F.xxhash64("__key").alias("__k1"), F.xxhash64(F.lit(7), "__key").alias("__k2"))
    )
    one = staged(one, "lines")
    common = (
        one.groupBy("__k1", "__k2", "__id").agg(F.lit(1).alias("__one"))
        .groupBy("__k1", "__k2").agg(F.count("__one").alias("__n"), F.max("__id").alias("__last"))
        .where(F.col("__n") >= min_docs).select("__k1", "__k2", "__last")
    )
    # written first, so that the join meets plain exchanges: AQE then splits a hot key of `one`
    common = small(staged(common, "common"), MAX_BROADCAST_KEYS)
    drops = (
        one.join(common, ["__k1", "__k2"]).where(F.col("__id") < F.col("__last"))
        .groupBy("__id").agg(F.collect_set("__pos").alias("__drop"))
    )
    # input columns travel in a struct, so that no name of theirs can clash
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    joined = docs.select(row, F.col(id_col).cast("long").alias("__doc"), F.col(text_col).alias("__text")).join(drops, F.col("__doc") == F.col("__id"), "left")
    lines = F.split(F.coalesce(F.col("__text"), F.lit("")), "\n", -1)
    gone = F.coalesce(F.col("__drop"), F.array().cast("array<int>"))
    # one pass over the lines and one over those that stay, however many there are
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    rest = F.transform(F.array(lines), lambda own: F.array_join(F.transform(stay, lambda i: F.get(own, i)), "\n"))[0]
    kept = F.when(F.size(gone) == 0, F.coalesce(F.col("__text"), F.lit(""))).otherwise(rest)
    return joined.select(*[kept.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names], F.size(lines).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"))
