"""Operator 12: how far the sources of a language differ in their words, and in which.

Terms are counted in Arrow batches, by bytes: each task gives one row for a (language, source, term) of a few MB of text,
and Spark adds them up. Kept are the terms of a language that enough of its documents hold. A term's share p in a group
is an integer, so every sum is exact, in any order.

The distance of two sources is the sum of |p - p'| over all kept terms, most of which most sources lack. A source that
lacks a term has its absent share p0, so |p0 - p0'| is taken for every term and corrected for those that either holds, in a heavy-light
split by the number of sources m that hold a term, of the S of the language:

* heavy (m * `DENSE` >= S): dense tiles. Terms are dealt by hash in about `TILE_TERMS`, sources in blocks of `TILE_SOURCES`; a task
  gets the shares of one lot of terms in two blocks, fills the rest with p0 and adds up |p - p'| - |p0 - p0'| with numpy.
* light, sparse:
  - for each term that only one of two surely holds, |p - p0'| - |p0 - p0'|: over sorted shares and their running sums, for all other sources at once;
  - for each pair in a term's postings, the correction |p - p'| - |p - p0'| - |p0 - p'| + |p0 - p0'|.
Both partial sums are added, so no term is left out and none is counted twice.

The pairs of sources of a language are the result itself; a term's postings are no longer than them. Nothing is gathered by
language or source: tiles, postings and a source's different shares are.

Cases: null text, lang and source are empty strings. Every row is a document, repeated ones too. Groups without kept terms
have the shares of absent terms; without any kept term all distances are 0. Ties in value are ordered by item. Very long texts
are read whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceengine.llm.kernels import FOLD, slices, text_rows, tokens
from priceengine.llm.staging import map_arrow, staged

MIN_DOCS, TOP, SCALE, PRIOR = 30, 50, 1_000_000_000, 5
DENSE, TILE_TERMS, TILE_SOURCES, LIGHT_TERMS = 8, 2048, 256, 16_384
PIECE_BYTES = 8 << 20
#: Bytes that are in no term: fixed values.
BETWEEN = np.zeros(256, bool)
BETWEEN[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
PAIR = "lang string, g int, h int, value long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source, for each piece of text."""
    for batch in batches:
        langs, sources = (batch.column(k).dictionary_encode() for k in (0, 1))
        group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        for i, j, data, offsets in text_rows(batch, "text", PIECE_BYTES):
            starts, ends, rows = tokens(data, offsets, BETWEEN)
            if not len(starts):
                continue
            told = slices(FOLD[data], starts, ends).dictionary_encode()
            code, wide = told.indices.to_numpy().astype(np.int64), len(told.dictionary)
            in_row, times = np.unique(rows * wide + code, return_counts=True)
            key, place, docs = np.unique(group[i:j][in_row // wide] * wide + in_row % wide, return_inverse=True, return_counts=True)
            n = np.bincount(place, times, len(key)).astype(np.int64)
            of, term = key // wide, key % wide
            yield pa.RecordBatch.from_arrays([
                langs.dictionary.take(pa.array(of // len(sources.dictionary))), sources.dictionary.take(pa.array(of % len(sources.dictionary))),
                told.dictionary.take(pa.array(term)).cast(pa.string()), pa.array(n), pa.array(docs.astype(np.int64)),
            ], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, m): occurrences of the kept terms where they occur; m is the number of sources that hold a term."""
    none = F.lit("")
    texts = docs.select(*[F.coalesce(F.col(c), none).alias(c) for c in ("lang", "source", "text")])
    counts = map_arrow(texts, _count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    seen = counts.withColumns({"lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("docs").over(of_term), "m": F.count(F.lit(1)).over(of_term)})
    return seen.where(F.col("lang_docs") >= min_docs).drop("docs", "lang_docs")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    whole = F.call_function("div", wide(n + PRIOR) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + F.lit(PRIOR) * terms))
    return whole.cast("long") + 1


def groups_of(docs: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, source, g, n, v, lang_n, s, p0) of every group, numbered within its language, and (lang, v, lang_n) of every language."""
    all_ = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    terms = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n"))
    langs = all_.select("lang").distinct().join(terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_n")), "lang", "left").na.fill(0, ["v", "lang_n"])
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    numbers = all_.withColumns({"g": F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1, "s": F.count(F.lit(1)).over(Window.partitionBy("lang"))})
    whole = numbers.join(totals, ["lang", "source"], "left").na.fill(0, ["n"]).join(langs, "lang")
    return staged(whole.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.col("v"))).otherwise(F.lit(0))), "groups"), langs


def _pairs(lang: str, g: np.ndarray, h: np.ndarray, value: np.ndarray) -> pa.Table:
    low, high = np.minimum(g, h), np.maximum(g, h)
    return pa.table({"lang": pa.array([lang] * len(g), pa.string()), "g": pa.array(low, pa.int32()), "h": pa.array(high, pa.int32()), "value": pa.array(value, pa.int64())})


def _tile(width: int) -> Callable:
    """Sums of |p - p'| - |p0 - p0'| over the terms that a tile holds, for sources of two blocks of `width`. Rows without a term give p0."""

    def task(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        term, g, p = rows["term"].combine_chunks(), rows["g"].to_numpy(), rows["p"].to_numpy()
        base = rows["term"].is_null().to_numpy()
        order = np.argsort(g[base])
        sources, absent = g[base][order], p[base][order]
        told = term.filter(pa.array(~base)).dictionary_encode()
        dense = np.repeat(absent[:, None], len(told.dictionary), 1)
        dense[np.searchsorted(sources, g[~base]), told.indices.to_numpy()] = p[~base]
        one, other = (np.flatnonzero(sources // width == key[k].as_py()) for k in (2, 3))
        out = []
        for k, i in enumerate(one):
            met = other[k + 1 :] if key[2] == key[3] else other
            apart = np.abs(absent[met] - absent[i]) * dense.shape[1]
            out.append((np.full(len(met), sources[i]), sources[met], np.abs(dense[met] - dense[i]).sum(1) - apart))
        return _pairs(key[0].as_py(), *(np.concatenate(c) for c in zip(*out, strict=True)))

    return task


def _postings(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Corrections of the pairs of sources that share light terms, added up."""
    code = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy()
    g, p, p0 = (rows[c].to_numpy().astype(np.int64) for c in ("g", "p", "p0"))
    order = np.argsort(code, kind="stable")
    g, p, p0 = g[order], p[order], p0[order]
    size = np.bincount(code)
    first = np.cumsum(size) - size
    wide = int(g.max()) + 1
    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for m in np.unique(size[size > 1]):
        a, b = np.triu_indices(m, 1)
        per = max(1, (1 << 20) // len(a))
        at = first[size == m]
        for lo in range(0, len(at), per):
            i, j = (at[lo : lo + per, None] + a).ravel(), (at[lo : lo + per, None] + b).ravel()
            fix = np.abs(p[i] - p[j]) - np.abs(p[i] - p0[j]) - np.abs(p0[i] - p[j]) + np.abs(p0[i] - p0[j])
            keys, place = np.unique(np.append(keys, np.minimum(g[i], g[j]) * wide + np.maximum(g[i], g[j])), return_inverse=True)
            sums = _added(place, np.append(sums, fix), len(keys))
    return _pairs(key[0].as_py(), keys // wide, keys % wide, sums)


def _added(place: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Integer sums by place; bincount would go through doubles."""
    out = np.zeros(n, np.int64)
    np.add.at(out, place, values)
    return out


def _one_sided(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """For one source, the sum over its light terms of |p - p0'| - |p0 - p0'|, for every other source's p0'."""
    h, p, times = (rows[c].to_numpy() for c in ("h", "p", "times"))
    other = h >= 0
    order = np.argsort(p[~other])
    own, count = p[~other][order], times[~other][order]
    ends, sums = np.append(0, np.cumsum(count)), np.append(0, np.cumsum(own * count))
    me, x = key[1].as_py(), p[other]
    at = np.searchsorted(own, x)
    total = x * ends[at] - sums[at] + (sums[-1] - sums[at]) - x * (ends[-1] - ends[at])
    mine = x[h[other] == me][0]
    met = h[other] != me
    return _pairs(key[0].as_py(), np.full(int(met.sum()), me), h[other][met], (total - ends[-1] * np.abs(mine - x))[met])


def distances(kept: DataFrame, groups: DataFrame, dense_share: int = DENSE, tile_sources: int = TILE_SOURCES) -> DataFrame:
    """(lang, g, h, value) of every pair g < h of sources of a language. kept: (lang, term, g, p, p0, m, s)."""
    heavy = F.col("m") * dense_share >= F.col("s")
    lots = lambda per: F.ceil(F.col("terms") / per).cast("long")
    sizes = staged(kept.groupBy("lang", "term").agg(F.first(heavy).alias("heavy")).groupBy("lang").agg(F.count_if("heavy").alias("heavy"), F.count_if(~F.col("heavy")).alias("light")), "sizes")
    block, blocks = F.expr(f"g div {tile_sources}").cast("int"), F.expr(f"(s - 1) div {tile_sources}").cast("int")

    def tiles(rows: DataFrame) -> DataFrame:
        """A row for each pair of blocks that its source is in."""
        each = rows.withColumn("o", F.explode(F.sequence(F.lit(0), blocks)))
        return each.select("lang", "lot", F.least(block, "o").alias("one"), F.greatest(block, "o").alias("other"), "term", "g", "p")

    lot = F.pmod(F.xxhash64("term"), lots(TILE_TERMS))
    filled = kept.where(heavy).join(sizes.select("lang", F.col("heavy").alias("terms")), "lang").withColumn("lot", lot)
    absent = groups.join(sizes.where(F.col("heavy") > 0).select("lang", F.col("heavy").alias("terms")), "lang")
    absent = absent.withColumns({"lot": F.explode(F.sequence(F.lit(0).cast("long"), lots(TILE_TERMS) - 1)), "term": F.lit(None).cast("string"), "p": F.col("p0")})
    dense = tiles(filled).unionByName(tiles(absent)).groupBy("lang", "lot", "one", "other").applyInArrow(_tile(tile_sources), PAIR)

    light = kept.where(~heavy)
    lot = F.pmod(F.xxhash64("term"), lots(LIGHT_TERMS))
    posted = light.where(F.col("m") > 1).join(sizes.select("lang", F.col("light").alias("terms")), "lang").withColumn("lot", lot)
    sparse = posted.select("lang", "lot", "term", "g", "p", "p0").groupBy("lang", "lot").applyInArrow(_postings, PAIR)

    own = light.groupBy("lang", "g", "p").agg(F.count(F.lit(1)).alias("times")).select("lang", "g", F.lit(-1).alias("h"), "p", "times")
    some = own.select("lang", "g").distinct().join(groups.select("lang", F.col("g").alias("h"), F.col("p0").alias("p"), F.lit(0).cast("long").alias("times")), "lang")
    alone = own.unionByName(some).groupBy("lang", "g").applyInArrow(_one_sided, PAIR)

    second = groups.select("lang", F.col("g").alias("h"), F.col("p0").alias("q0"))
    pairs = groups.select("lang", "g", "p0", "v").join(second, "lang").where("g < h")
    every = pairs.select("lang", "g", "h", (F.abs(F.col("p0") - F.col("q0")) * F.col("v")).alias("value"))
    return every.unionByName(dense).unionByName(sparse).unionByName(alone).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, dense_share: int = DENSE, tile_sources: int = TILE_SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` ranks the other sources by distance, part `term` the terms above their language's share."""
    terms = staged(term_counts(docs, min_docs), "terms")
    groups, langs = groups_of(docs, terms)
    p = share(F.col("n"), F.col("group_n"), F.col("v"))
    known = groups.select("lang", "source", "g", "s", "p0", "v", F.col("n").alias("group_n"), F.col("lang_n").alias("all_n"))
    kept = terms.join(known, ["lang", "source"]).withColumns({"p": p, "q": share(F.col("lang_n"), F.col("all_n"), F.col("v"))})
    by_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = kept.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    above = above.withColumn("rank", F.row_number().over(by_group)).where(F.col("rank") <= top)

    far = distances(kept.select("lang", "term", "g", "p", "p0", "m", "s"), groups, dense_share, tile_sources)
    both = far.select("lang", F.explode(F.array(F.struct("g", "h"), F.struct(F.col("h").alias("g"), F.col("g").alias("h")))).alias("x"), "value").select("lang", "x.g", "x.h", "value")
    named = both.join(groups.select("lang", "g", "source"), ["lang", "g"]).join(groups.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"])
    pairs = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_group))
    return pairs.unionByName(above)
