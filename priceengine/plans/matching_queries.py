"""Queries on product matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceengine.functions import scalars as S
from priceengine.operators import matching
from priceengine.plans.registry import query
from priceengine.plans.views import PRODUCTS, products, table

_GTIN = "CASE WHEN regexp_full_match(regexp_replace(gtin, '\\s+', '', 'g'), '[0-9]{8,14}') THEN regexp_replace(gtin, '\\s+', '', 'g') END"
_PLAIN = "nullif(trim(regexp_replace(lower({0}), '\\s+', ' ', 'g')), '')"
_STOP = "[" + ", ".join(f"'{w}'" for w in S.STOP_WORDS) + "]"


def _tokens(name: str) -> str:
    words = f"string_split_regex(regexp_replace({_PLAIN.format(name)}, '[^\\w\\s'']', ' ', 'g'), '\\s+')"
    return f"coalesce(list_filter({words}, lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w)), [])"


_UNITS = "|".join(S.UNITS)
_VALUE = f"TRY_CAST(nullif(regexp_extract(trim({{0}}), '(?i)^(\\d+(?:\\.\\d+)?)\\s*({_UNITS})$', 1), '') AS DOUBLE)"
_UNIT = f"replace(lower(nullif(regexp_extract(trim({{0}}), '(?i)^(\\d+(?:\\.\\d+)?)\\s*({_UNITS})$', 2), '')), 'lt', 'l')"


@query(f"WITH {PRODUCTS} SELECT id, {_GTIN} AS code FROM products")
def gtin_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).select("id", S.gtin(F.col("gtin")).alias("code"))


_GTIN_PAIRS = f"""coded AS (SELECT seq, id, {_GTIN} AS code FROM products),
gtin_pairs AS (SELECT least(a.id, b.id) AS a_id, greatest(a.id, b.id) AS b_id, 'auto_gtin' AS match_method, 1.0e0 AS confidence, 'confirmed' AS review_state, 'system' AS provenance, sha256(a.code || chr(0) || a.code) AS evidence_hash
FROM coded a JOIN coded b ON a.code = b.code AND a.seq < b.seq)"""
_SOURCE_PAIRS = """src AS (SELECT seq, id, retailer, source_id FROM products WHERE source_id <> '' AND retailer IN ('paknsave', 'newworld')),
both_of AS (SELECT source_id FROM src GROUP BY source_id HAVING count(DISTINCT retailer) = 2),
source_pairs AS (SELECT least(a.id, b.id) AS a_id, greatest(a.id, b.id) AS b_id, 'auto_source_id' AS match_method, 1.0e0 AS confidence, 'confirmed' AS review_state, 'system' AS provenance, sha256(a.source_id || chr(0) || a.source_id) AS evidence_hash
FROM src a JOIN src b ON a.source_id = b.source_id AND a.seq < b.seq JOIN both_of s ON s.source_id = a.source_id)"""


@query(f"WITH {PRODUCTS}, {_GTIN_PAIRS} SELECT * FROM gtin_pairs")
def gtin_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.gtin_matches(products(spark, sf_dir))


@query(f"WITH {PRODUCTS}, {_SOURCE_PAIRS} SELECT * FROM source_pairs")
def source_id_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.source_id_matches(products(spark, sf_dir))


_AUTO = f"{_GTIN_PAIRS}, {_SOURCE_PAIRS}, auto AS (SELECT * FROM source_pairs UNION ALL SELECT * FROM gtin_pairs g WHERE NOT EXISTS (SELECT 1 FROM source_pairs s WHERE s.a_id = g.a_id AND s.b_id = g.b_id))"


@query(f"WITH {PRODUCTS}, {_AUTO} SELECT * FROM auto")
def auto_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.auto_matches(products(spark, sf_dir))


_BLOCKS = f"""rows_ AS (SELECT seq, id, name, brand, size, {_PLAIN.format("brand || ' ' || category || ' ' || size")} AS block, {_tokens('name')} AS tokens, {_PLAIN.format('brand')} AS plain_brand, {_VALUE.format('size')} AS qty, {_UNIT.format('size')} AS unit FROM products),
blocks AS (SELECT block, min(seq) AS block_seq FROM rows_ GROUP BY block HAVING count(*) BETWEEN 2 AND 20),
scorable AS (SELECT r.*, b.block_seq FROM rows_ r JOIN blocks b USING (block) WHERE len(tokens) > 0),
scored AS (
  SELECT a.id AS id_1, b.id AS id_2, a.seq AS seq_1, b.seq AS seq_2, a.block_seq, a.name AS name_1, b.name AS name_2, a.brand AS brand_1, b.brand AS brand_2, a.size AS size_1, b.size AS size_2,
         CAST(len(list_intersect(list_distinct(a.tokens), list_distinct(b.tokens))) AS DOUBLE) / CAST(len(list_distinct(list_concat(a.tokens, b.tokens))) AS DOUBLE)
         + CASE WHEN a.plain_brand = b.plain_brand THEN 0.15e0 ELSE 0.0e0 END + CASE WHEN a.qty = b.qty AND a.unit = b.unit THEN 0.1e0 ELSE 0.0e0 END AS score
  FROM scorable a JOIN scorable b ON a.block = b.block AND a.seq < b.seq)"""


@query(f"""WITH {PRODUCTS}, {_BLOCKS} SELECT least(id_1, id_2) AS a_id, greatest(id_1, id_2) AS b_id, 'fuzzy_candidate' AS match_method, least(score, 1.0e0) AS confidence, 'candidate' AS review_state, 'system' AS provenance,
sha256(concat_ws(chr(0), coalesce(name_1, ''), coalesce(brand_1, ''), coalesce(size_1, ''), coalesce(name_2, ''), coalesce(brand_2, ''), coalesce(size_2, ''))) AS evidence_hash
FROM scored WHERE score >= 0.4e0 ORDER BY block_seq, seq_1, seq_2 LIMIT 1000""")
def fuzzy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand, category and size make the block, as brands alone are over the block size in this table."""
    block = S.plain(F.concat_ws(" ", "brand", "category", "size"))
    return matching.fuzzy_candidates(products(spark, sf_dir), block=block)


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pairs: those code pairs whose second product has a label, which tells the state."""
    n = F.substring_index("b_id", ":", -1).cast("long")
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    pairs = matching.gtin_matches(products(spark, sf_dir)).withColumn("n", n).join(marks, F.col("n") == F.col("doc_id"))
    return pairs.withColumns({
        "review_state": F.when(F.col("quality") == 1, F.when(F.col("n") % 2 == 0, "candidate").otherwise("confirmed")).otherwise("rejected"),
        "provenance": F.when(F.col("toxic") == 1, "user").otherwise("system"),
        "evidence_hash": F.when(F.col("n") % 3 == 0, "old").otherwise(F.col("evidence_hash")), "algorithm_version": F.when(F.col("n") % 7 == 0, "0").otherwise("1"),
    }).drop("n", "doc_id", "quality", "toxic")


_STORED = """stored AS (SELECT a_id, b_id, match_method, confidence, CASE WHEN quality = 1 THEN CASE WHEN n % 2 = 0 THEN 'candidate' ELSE 'confirmed' END ELSE 'rejected' END AS review_state, CASE WHEN toxic = 1 THEN 'user' ELSE 'system' END AS provenance,
CASE WHEN n % 3 = 0 THEN 'old' ELSE evidence_hash END AS evidence_hash, CASE WHEN n % 7 = 0 THEN '0' ELSE '1' END AS algorithm_version
FROM (SELECT *, CAST(split_part(b_id, ':', 2) AS BIGINT) AS n FROM gtin_pairs) JOIN labels ON doc_id = n)"""


@query(f"""WITH {PRODUCTS}, {_AUTO}, {_STORED} SELECT f.a_id, f.b_id, CASE WHEN s.provenance IS NULL THEN 'insert' WHEN s.provenance = 'user' OR (s.review_state = 'confirmed' AND s.evidence_hash = f.evidence_hash)
OR (s.review_state = 'rejected' AND s.algorithm_version = '1' AND s.evidence_hash = f.evidence_hash) THEN 'skip' ELSE 'update' END AS action FROM auto f LEFT JOIN stored s ON s.a_id = f.a_id AND s.b_id = f.b_id""")
def match_upsert_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.upsert_actions(_stored(spark, sf_dir), matching.auto_matches(products(spark, sf_dir))).select("a_id", "b_id", "action")


@query(f"""WITH {PRODUCTS}, {_AUTO}, {_STORED}, acts AS (SELECT f.*, s.algorithm_version AS old_version, s.provenance IS NULL OR NOT (s.provenance = 'user' OR (s.review_state = 'confirmed' AND s.evidence_hash = f.evidence_hash)
OR (s.review_state = 'rejected' AND s.algorithm_version = '1' AND s.evidence_hash = f.evidence_hash)) AS written FROM auto f LEFT JOIN stored s ON s.a_id = f.a_id AND s.b_id = f.b_id)
SELECT a_id, b_id, match_method, confidence, review_state, provenance, evidence_hash, coalesce(old_version, '1') AS algorithm_version FROM acts WHERE written
UNION ALL SELECT a_id, b_id, match_method, confidence, review_state, provenance, evidence_hash, algorithm_version FROM stored s WHERE NOT EXISTS (SELECT 1 FROM acts a WHERE a.written AND a.a_id = s.a_id AND a.b_id = s.b_id)""")
def match_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.upserted(_stored(spark, sf_dir), matching.auto_matches(products(spark, sf_dir)))


@query(f"""WITH {PRODUCTS}, {_GTIN_PAIRS}, {_STORED}, sides AS (SELECT a_id AS product_id, b_id AS other_id, review_state FROM stored UNION ALL SELECT b_id, a_id, review_state FROM stored)
SELECT product_id, other_id, CASE review_state WHEN 'confirmed' THEN 'matches' ELSE 'candidates' END AS shown_as FROM sides WHERE review_state IN ('confirmed', 'candidate')""")
def match_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_split(_stored(spark, sf_dir)).select("product_id", "other_id", "shown_as")


@query(f"""WITH {PRODUCTS}, {_GTIN_PAIRS}, {_STORED} SELECT a_id, b_id, match_method, review_state FROM stored WHERE match_method = 'auto_gtin' AND review_state IN ('confirmed', 'candidate')""")
def pairs_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _stored(spark, sf_dir).withColumn("created_at", F.substring_index("b_id", ":", -1).cast("long"))
    return matching.listed_pairs(pairs, ["auto_gtin"], ["confirmed", "candidate"]).select("a_id", "b_id", "match_method", "review_state")


@query(f"""WITH {PRODUCTS}, {_GTIN_PAIRS}, {_STORED} SELECT a_id, b_id, review_state FROM stored WHERE review_state <> 'rejected'""")
def pairs_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected pairs are deleted, named in the other order."""
    pairs = _stored(spark, sf_dir)
    gone = pairs.where(F.col("review_state") == "rejected").select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"))
    return matching.without_pairs(pairs, gone).select("a_id", "b_id", "review_state")


@query(f"""WITH {PRODUCTS}, {_GTIN_PAIRS}, {_STORED}, lab AS (SELECT doc_id, quality FROM labels)
SELECT a_id, b_id, CASE WHEN l.quality IS NULL THEN review_state WHEN l.quality = 1 THEN 'confirmed' ELSE 'rejected' END AS review_state, CASE WHEN l.quality IS NULL THEN provenance ELSE 'user' END AS provenance
FROM stored LEFT JOIN lab l ON l.doc_id = CAST(split_part(a_id, ':', 2) AS BIGINT)""")
def match_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as a user's reviews of the pairs."""
    pairs = _stored(spark, sf_dir)
    said = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "confirmed").otherwise("rejected").alias("review_state"))
    reviews = pairs.select("a_id", "b_id").join(said, F.substring_index("a_id", ":", -1).cast("long") == F.col("doc_id")).select("a_id", "b_id", "review_state")
    return matching.reviewed(pairs, reviews).select("a_id", "b_id", "review_state", "provenance")


@query(f"WITH {PRODUCTS} SELECT id, {_VALUE.format('size')} AS value, {_UNIT.format('size')} AS unit FROM products")
def parse_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = S.quantity(F.col("size"))
    return products(spark, sf_dir).select("id", q["value"].alias("value"), q["unit"].alias("unit"))


@query(f"""WITH t AS (SELECT doc_id, {_tokens("text")} AS a, {_tokens("source || ' ' || lang || ' of the la le de que und sch'")} AS b FROM documents)
SELECT doc_id, CAST(len(a) AS INTEGER) AS n, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0e0 ELSE CAST(len(list_intersect(list_distinct(a), list_distinct(b))) AS DOUBLE) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) END AS similarity FROM t""")
def tokens_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name scorer on whole texts."""
    b = S.name_tokens(F.concat(F.col("source"), F.lit(" "), F.col("lang"), F.lit(" of the la le de que und sch")))
    rows = table(spark, sf_dir, "documents").select("doc_id", S.name_tokens(F.col("text")).alias("a"), b.alias("b"))
    return rows.select("doc_id", F.size("a").alias("n"), S.jaccard(F.col("a"), F.col("b")).alias("similarity"))
