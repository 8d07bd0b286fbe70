"""Operator 2: benchmark decontamination by spaced seeds, with DataFrame functions only.

Words are hashed once in their array. A seed is four words in a row or two and two around one that is left out. Wherever
one word of five is replaced in 8 to 15 words, a seed stays whole (by enumeration, see the tests); more words split into
such stretches, and one of them has no more than its share of the replaced ones. So every leak by the default
`min_overlap` and `min_agree`, or greater ones, has a seed; `fewest_seeds` counts how many the worst placement of n words has (one
if they are 10, two or more if they are others). Seeds of all documents meet those of the benchmark in a join; the hits of one
(document, item) with the same shift are one candidate if they are that many for the words that lie on each other there, so a phrase of
four words that stands in very many documents and items makes none but where just 10 words do. The item is then
laid over the document's words at that shift and compared word by word. A candidate is a leak if at least `min_overlap` words lie on each other and the
agreeing ones are `min_agree` of them, or `min_agree` of SPAN words in a row: a part of an item is a leak, too.

With a lower `min_overlap`, items shorter than FEWEST words are matched whole by one hash over all their words, for each such length.

Cases: null and empty texts have no words and never match; very long ones are read whole. Of equally good shifts the least
is told. Items of fewer than `min_overlap` words are not
searched for, as they are no passages. Repeated rows of one doc_id are judged as one; null doc_ids are left alone.
Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceengine.llm.staging import small, staged

SPAN = 13
#: 1: the word counts.
SEEDS = ("1111", "11011")
#: From so many words on, a seed stays whole under any accepted replacement.
FEWEST = 8

#: Tables are broadcast up to so many rows (counted first); beyond, Spark deals out both sides.
MAX_BROADCAST_SEEDS, MAX_BROADCAST_HITS, MAX_BROADCAST_ITEMS = 1_000_000, 20_000, 20_000


def words(text: Column) -> Column:
    """Lower-cased words as 64-bit hashes, in order."""
    plain = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.transform(plain, lambda w: F.xxhash64(w))


def seeds(hashes: Column) -> Column:
    """array<struct<pos, seed>>: for each position and mask, a hash of the words under the mask."""
    least = min(map(len, SEEDS))
    places = F.when(F.size(hashes) >= least, F.sequence(F.lit(0), F.size(hashes) - least)).otherwise(F.array().cast("array<int>"))

    def at(i: Column, m: int, mask: str) -> Column:
        seed = F.xxhash64(F.lit(m), *[F.get(hashes, i + k) for k, c in enumerate(mask) if c == "1"])
        return seed if len(mask) == least else F.when(i + len(mask) <= F.size(hashes), seed)

    return F.transform(places, lambda i: F.struct(i.alias("pos"), F.array(*[at(i, m, mask) for m, mask in enumerate(SEEDS)]).alias("seeds")))


def whole_keys(hashes: Column, lengths: list[int]) -> Column:
    """For items shorter than FEWEST: a hash of every run of so many words."""
    def runs(n: int) -> Column:
        places = F.when(F.size(hashes) >= n, F.sequence(F.lit(0), F.size(hashes) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(i.alias("pos"), F.array(F.xxhash64(F.lit(-n), *[hashes[i + k] for k in range(n)])).alias("seeds")))

    return F.concat(*[runs(n) for n in lengths])


def exploded(df: DataFrame, ids: str, hashes: str, lengths: list[int]) -> DataFrame:
    found = seeds(F.col(hashes))
    if lengths:
        found = F.concat(found, whole_keys(F.col(hashes), lengths))
    rows = df.select(ids, F.size(hashes).alias("__size"), F.explode(found).alias("__s")).select(ids, "__size", F.col("__s.pos").alias("__pos"), F.col("__s.seeds").alias("__seeds"))
    return rows.select(ids, "__size", "__pos", F.explode("__seeds").alias("__seed")).where(F.col("__seed").isNotNull())


def fewest_seeds(min_agree: float) -> list[int]:
    """For n words laid over each other, the least number of whole seeds if min_agree of them, or of SPAN in a row, agree; the last number holds for all more words.

    Up to 2 * FEWEST - 1 words by enumeration of what may not agree. More words are two stretches, of which one has no more
    than its share of those, so they have as many as the poorer of the two, however they are cut.
    """
    def whole(n: int, gone: tuple[int, ...]) -> int:
        return sum(all(c == "0" or i + k not in gone for k, c in enumerate(mask)) for mask in SEEDS for i in range(n - len(mask) + 1))

    out = [1] * FEWEST
    for n in range(FEWEST, 4 * FEWEST):
        if n < 2 * FEWEST:
            out.append(min(whole(n, gone) for gone in combinations(range(n), int(n - n * min_agree + 1e-9))))
        else:
            out.append(max(min(out[k], out[n - k]) for k in range(FEWEST, n - FEWEST + 1)))
    out.append(min(out[2 * FEWEST :]))  # more words are stretches of such lengths
    return [max(1, min(k, out[SPAN]) if n >= SPAN else k) for n, k in enumerate(out)]


def laid_over(text: Column, item: Column) -> Column:
    """struct<n_agree, n_run> of as many words of a text as of an item; in time linear in them."""
    agree = F.zip_with(text, item, lambda a, b: F.when(a == b, 1).otherwise(0))
    total = lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + x)

    def counted(agree: Column) -> Column:
        run = F.transform(F.sequence(F.lit(1), F.greatest(F.size(agree) - SPAN + 1, F.lit(1))), lambda i: total(F.slice(agree, i, SPAN)))
        return F.struct(total(agree).alias("n_agree"), F.array_max(run).alias("n_run"))

    return F.transform(F.array(agree), counted)[0]


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_overlap: int = 8, min_agree: float = 0.8) -> DataFrame:
    """(doc_id, item_id, shift, n_overlap, n_agree, n_run) of every leak: the best shift of each document and item. n_run: most agreeing words among SPAN in a row."""
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    items = staged(
        benchmark.where(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("__item")).where(F.size("__item") >= min_overlap), "items"
    )
    lengths = sorted(r[0] for r in items.where(F.size("__item") < FEWEST).select(F.size("__item")).distinct().collect())  # fewer than FEWEST numbers
    doc_seeds = exploded(docs.select("doc_id", words(F.col("text")).alias("__w")), "doc_id", "__w", lengths)
    item_seeds = exploded(items, "item_id", "__item", lengths).withColumnsRenamed({"__pos": "__ipos", "__size": "__len"})
    shift = F.col("__pos") - F.col("__ipos")
    seen = doc_seeds.join(small(item_seeds, MAX_BROADCAST_SEEDS), "__seed").groupBy("doc_id", "item_id", shift.alias("shift"), "__size", "__len").agg(F.count(F.lit(1)).alias("__n"))
    # repeated rows of a document count twice here, which lets more through and nothing less
    lie = F.least(F.col("__size") - F.greatest("shift", F.lit(0)), F.col("__len") - F.greatest(-F.col("shift"), F.lit(0)))
    least = fewest_seeds(min_agree)
    hits = seen.where((F.col("__len") < FEWEST) | (F.col("__n") >= F.get(F.array(*[F.lit(k) for k in least]), F.least(lie, F.lit(len(least) - 1)))))
    # a document's own candidates, as numbers; its words stand once beside them
    near = hits.groupBy("doc_id").agg(F.collect_set(F.struct("item_id", "shift", "__len")).alias("__hits"))
    met = docs.join(small(staged(near, "hits"), MAX_BROADCAST_HITS), "doc_id").select(words(F.col("text")).alias("__w"), "doc_id", "__hits")
    # of each candidate only the words under the item go on
    under = lambda w, h: F.slice(w, F.greatest(h["shift"], F.lit(0)) + 1, h["__len"])
    cut = met.select("doc_id", F.explode(F.transform("__hits", lambda h: F.struct(h["item_id"].alias("item_id"), h["shift"].alias("shift"), under(F.col("__w"), h).alias("__words")))).alias("h"))
    laid = cut.select("doc_id", "h.*").join(small(items, MAX_BROADCAST_ITEMS), "item_id")
    skip = F.greatest(-F.col("shift"), F.lit(0))
    n = F.least(F.size("__words"), F.size("__item") - skip)
    judged = laid.withColumn("n_overlap", n).where(F.col("n_overlap") >= min_overlap).withColumn("r", laid_over(F.slice("__words", F.lit(1), F.col("n_overlap")), F.slice("__item", skip + 1, F.col("n_overlap"))))
    share = F.lit(min_agree)
    return (
        judged.select("doc_id", "item_id", "shift", "n_overlap", "r.*").where((F.col("n_agree") >= F.col("n_overlap") * share) | (F.col("n_run") >= SPAN * share))
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("n_agree", "n_overlap", (-F.col("shift")).alias("back"), "n_run")).alias("__best"))
        .select("doc_id", "item_id", (-F.col("__best.back")).alias("shift"), F.col("__best.n_overlap").alias("n_overlap"), F.col("__best.n_agree").alias("n_agree"), F.col("__best.n_run").alias("n_run"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_overlap: int = 8, min_agree: float = 0.8) -> DataFrame:
    """`docs` without those that hold a leak."""
    leaks = find_leaks(docs, benchmark, min_overlap, min_agree).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti")

