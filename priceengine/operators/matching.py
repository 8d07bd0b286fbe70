"""The same product at several retailers: pairs by equal codes, by similar names, and what a review keeps of them.

products: (seq, id, retailer, name, brand, size, source_id, gtin). Pairs are (a_id, b_id) with a_id < b_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceengine.functions.scalars import FUZZY_THRESHOLD, evidence, gtin, name_score, name_tokens, plain

# Retailers that number their products alike, largest block of names, most candidates, version of the rules.
SHARED_SOURCE_RETAILERS = ("paknsave", "newworld")
BLOCK_SIZE, CANDIDATE_CAP, VERSION = 20, 1000, "1"
NO_BRAND = "__no_brand__"


def _self_pairs(rows: DataFrame, key: str) -> DataFrame:
    """All unordered pairs of rows with an equal key. Every pair is a result row of the operator (contract of exact matching)."""
    a = rows.select(F.col(key), *[F.col(c).alias(f"{c}_1") for c in rows.columns if c != key])
    b = rows.select(F.col(key), *[F.col(c).alias(f"{c}_2") for c in rows.columns if c != key])
    return a.join(b, key).where(F.col("seq_1") < F.col("seq_2"))


def _pairs(met: DataFrame, method: str, state: str, confidence: Column, proof: Column) -> DataFrame:
    return met.select(
        F.least("id_1", "id_2").alias("a_id"), F.greatest("id_1", "id_2").alias("b_id"), F.lit(method).alias("match_method"),
        confidence.alias("confidence"), F.lit(state).alias("review_state"), F.lit("system").alias("provenance"), proof.alias("evidence_hash"), "seq_1", "seq_2",
    )


def gtin_matches(products: DataFrame) -> DataFrame:
    """Pairs with an equal valid code, within a retailer too. Keys that stand alone never reach the join."""
    coded = products.select("seq", "id", gtin(F.col("gtin")).alias("code")).where(F.col("code").isNotNull())
    met = _self_pairs(coded, "code")
    return _pairs(met, "auto_gtin", "confirmed", F.lit(1.0), evidence(F.col("code"), F.col("code"))).drop("seq_1", "seq_2")


def source_id_matches(products: DataFrame) -> DataFrame:
    """Pairs with an equal source id, at retailers that share their numbers, where both of these are in the group."""
    rows = products.where((F.col("source_id") != "") & F.col("retailer").isin(*SHARED_SOURCE_RETAILERS)).select("seq", "id", "retailer", "source_id")
    both = rows.groupBy("source_id").agg(F.count_distinct("retailer").alias("n")).where(F.col("n") == len(SHARED_SOURCE_RETAILERS)).select("source_id")
    met = _self_pairs(rows.join(both, "source_id", "left_semi"), "source_id")
    return _pairs(met, "auto_source_id", "confirmed", F.lit(1.0), evidence(F.col("source_id"), F.col("source_id"))).drop("seq_1", "seq_2")


def fuzzy_candidates(products: DataFrame, threshold: float = FUZZY_THRESHOLD, block_size: int = BLOCK_SIZE, cap: int | None = CANDIDATE_CAP, block: Column | None = None) -> DataFrame:
    """Pairs within a block (the brand, if not given) whose score reaches the threshold, the first `cap` in order of discovery.

    Blocks over `block_size` are left out, as the contract of this search says, so a block makes 190 pairs at most.
    Names are cut into tokens once, before the join.
    """
    key = F.coalesce(plain(F.col("brand")) if block is None else block, F.lit(NO_BRAND))
    rows = products.select("seq", "id", "name", "brand", "size", key.alias("block"), name_tokens(F.col("name")).alias("tokens"))
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("block_seq")).where(F.col("n").between(2, block_size)).select("block", "block_seq")
    scorable = rows.where(F.size("tokens") > 0).join(sizes, "block")
    score = name_score(F.col("tokens_1"), F.col("tokens_2"), F.col("brand_1"), F.col("brand_2"), F.col("size_1"), F.col("size_2"))
    met = _self_pairs(scorable, "block").withColumn("score", score).where(F.col("score") >= threshold)
    proof = evidence(*[F.col(f"{c}_{k}") for k in (1, 2) for c in ("name", "brand", "size")])
    if cap is not None:
        met = met.orderBy("block_seq_1", "seq_1", "seq_2").limit(cap)
    return _pairs(met, "fuzzy_candidate", "candidate", F.least(F.col("score"), F.lit(1.0)), proof).drop("seq_1", "seq_2")


def auto_matches(products: DataFrame) -> DataFrame:
    """Pairs by code and by source id; a pair found by both is the latter's."""
    found = gtin_matches(products).withColumn("__turn", F.lit(1)).unionByName(source_id_matches(products).withColumn("__turn", F.lit(2)))
    return found.groupBy("a_id", "b_id").agg(F.max_by(F.struct(*[c for c in found.columns if c not in ("a_id", "b_id", "__turn")]), F.col("__turn")).alias("p")).select("a_id", "b_id", "p.*")


def upsert_actions(stored: DataFrame, found: DataFrame, version: str = VERSION) -> DataFrame:
    """What becomes of each found pair: insert, update or skip; a user's word stands, and so does what rests on the same evidence."""
    old = stored.select("a_id", "b_id", *[F.col(c).alias(f"old_{c}") for c in ("review_state", "provenance", "evidence_hash", "algorithm_version")])
    same = F.col("old_evidence_hash").eqNullSafe(F.col("evidence_hash"))
    skip = (
        (F.col("old_provenance") == "user")
        | ((F.col("old_review_state") == "confirmed") & same)
        | ((F.col("old_review_state") == "rejected") & (F.col("old_algorithm_version") == version) & same)
    )
    action = F.when(F.col("old_provenance").isNull(), "insert").when(F.coalesce(skip, F.lit(False)), "skip").otherwise("update")
    return found.join(old, ["a_id", "b_id"], "left").withColumn("action", action)


def upserted(stored: DataFrame, found: DataFrame, version: str = VERSION) -> DataFrame:
    """The pair table after the upsert."""
    columns = ["a_id", "b_id", "match_method", "confidence", "review_state", "provenance", "evidence_hash", "algorithm_version"]
    written = upsert_actions(stored, found, version).where(F.col("action") != "skip").withColumn("algorithm_version", F.coalesce("old_algorithm_version", F.lit(version))).select(*columns)
    return stored.select(*columns).join(written, ["a_id", "b_id"], "left_anti").unionByName(written)


def reviewed(pairs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Pairs with the states that users gave them; reviews: (a_id, b_id, review_state)."""
    said = reviews.select("a_id", "b_id", F.col("review_state").alias("__said"))
    out = pairs.join(said, ["a_id", "b_id"], "left")
    return out.withColumns({"review_state": F.coalesce("__said", "review_state"), "provenance": F.when(F.col("__said").isNotNull(), "user").otherwise(F.col("provenance"))}).drop("__said")


def pairs_by_product(pairs: DataFrame) -> DataFrame:
    """Each pair twice, once under either product: (product_id, other_id, ...)."""
    sides = F.explode(F.array(F.struct(F.col("a_id").alias("product_id"), F.col("b_id").alias("other_id")), F.struct(F.col("b_id").alias("product_id"), F.col("a_id").alias("other_id"))))
    return pairs.withColumn("__side", sides).select("__side.*", *[c for c in pairs.columns if c not in ("a_id", "b_id")])


def match_split(pairs: DataFrame) -> DataFrame:
    """Confirmed pairs as matches, candidates as candidates; rejected ones are not shown."""
    shown = pairs_by_product(pairs).where(F.col("review_state").isin("confirmed", "candidate"))
    return shown.withColumn("shown_as", F.when(F.col("review_state") == "confirmed", "matches").otherwise("candidates"))


def listed_pairs(pairs: DataFrame, methods: list[str] | None = None, states: list[str] | None = None) -> DataFrame:
    """Pairs by method and state (none given: all), the newest first."""
    if methods:
        pairs = pairs.where(F.col("match_method").isin(*methods))
    if states:
        pairs = pairs.where(F.col("review_state").isin(*states))
    return pairs.orderBy(F.desc("created_at"))


def without_pairs(pairs: DataFrame, deleted: DataFrame) -> DataFrame:
    """Pairs but those of `deleted` (a_id, b_id), in either order of the two."""
    gone = deleted.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")).distinct()
    return pairs.join(gone, ["a_id", "b_id"], "left_anti")


def ranked_matches(pairs: DataFrame) -> DataFrame:
    by = Window.partitionBy("product_id").orderBy(F.desc("confidence"), "other_id")
    return pairs_by_product(pairs).withColumn("rank", F.row_number().over(by))
