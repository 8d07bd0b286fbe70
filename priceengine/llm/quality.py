"""Operator 4: a quality classifier by hierarchical empirical Bayes.

Level 0, the document: features of the whole text are cut into bins; grouped counts of (feature, bin, label) give
each bin a log likelihood ratio, shrunk to none where few documents were counted. As features overlap, a logistic
regression on no more than FIT_ROWS labelled rows (the lowest by a hash of doc_id) weighs the ratios; a document's
evidence is their weighted sum.
Level 1, the host (`source`), and level 2, the path (source and lang): Beta posteriors of the share of good labels. The
global prior's strength is fitted to the spread of the hosts by moments, the hosts' strength to the spread of the paths
about them, both held within STRENGTHS (2 to 10,000 documents: hosts that differ not at all, or wholly, would give none or no
end of it); a host's posterior mean is the prior of its paths. A sparse or unseen site so falls back to its host and then
to the global rate.
The score is the posterior probability of good quality: the path's prior log odds plus the evidence.

The model is a bounded number of bins and is broadcast; counts use all labelled rows. Site tables grow with the
number of sites and are joined (Spark broadcasts them while small).

Cases: null and empty texts have the features of an empty text; very long ones are read whole. Null source or lang is a site
of its own. Documents without label, those with a null doc_id among them, only get scores; repeated rows of a doc_id are
scored alike, and each counts in the fit. Labels other than 0 and 1, or null, are not used; of contradictory labels of one
doc_id the good one counts. Ties do not arise: equal documents of one site have equal scores. Without any label every score is 0.5 and nothing is rejected. An empty table
gives an empty one. Input columns are kept; those with the names of results or helpers are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceengine.llm.kernels import row_bytes, row_counts, text_rows, token_hashes
from priceengine.llm.staging import hash_sample, map_arrow, small, staged, with_field

FEATURES = ("chars", "upper", "symbol", "digit", "repeat", "distinct", "wordlen", "marked", "bare", "space")
BINS = 32
MAX_SITES, MAX_BROADCAST_LABELS = 50_000, 1_000_000
#: Bounds of a fitted Beta prior's strength, in documents.
STRENGTHS = (2.0, 10_000.0)
#: The bound of the labelled sample on which the features' weights are fitted.
FIT_ROWS = 20_000
#: Documents under this probability of being good are rejected.
THRESHOLD = 0.3

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if chr(c) not in ".,;:?'\"-()" and not chr(c).isalnum()]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows by FEATURES, each as a bin number from 0 to BINS - 1."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    starts, ends, rows, hashed = token_hashes(data, offsets)
    words = np.maximum(row_counts(rows, n), 1)
    same = np.zeros(len(rows), bool)
    same[1:] = (hashed[1:] == hashed[:-1]) & (rows[1:] == rows[:-1])
    order = np.lexsort((hashed, rows))
    new = np.ones(len(rows), bool)
    new[1:] = (hashed[order][1:] != hashed[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    symbol = _SYMBOL[data]
    ends_marked = symbol[ends - 1] if len(ends) else np.zeros(0, bool)
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LETTER[data], out=letters[1:])
    bare = letters[ends] == letters[starts]
    share = lambda x, of: np.clip((np.asarray(x) / of * (BINS - 1) + 0.999).astype(np.int64), 0, BINS - 1)  # noqa: E731  0 only for none
    log2 = lambda x: np.clip((np.log2(np.maximum(x, 1)) * 1.5).astype(np.int64), 0, BINS - 1)
    return np.stack([
        log2(np.diff(offsets)), share(row_bytes(_UPPER[data], offsets), size), share(row_bytes(symbol, offsets), size), share(row_bytes(_DIGIT[data], offsets), size),
        share(row_counts(rows, n, same), words), share(row_counts(rows[order], n, new), words), np.clip((row_counts(rows, n, ends - starts) / words).astype(np.int64), 0, BINS - 1),
        share(row_counts(rows, n, ends_marked), words), share(row_counts(rows, n, bare), words), share(size - row_counts(rows, n, ends - starts), size),
    ], 1)


def with_bins(docs: DataFrame) -> DataFrame:
    """`docs` with the column __bins, made from the whole text in the same pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(data, off) for _, _, data, off in text_rows(batch, "text")]
            flat = np.concatenate(found).astype(np.int8).ravel() if found else np.zeros(0, np.int8)
            bins = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(FEATURES)), pa.int32()), pa.array(flat, pa.int8()))
            yield pa.RecordBatch.from_arrays([*batch.columns, bins], [*batch.schema.names, "__bins"])

    return map_arrow(docs, run, with_field(docs, "__bins", T.ArrayType(T.ByteType())))


def fit_bins(labelled: DataFrame) -> dict[tuple[int, int], float]:
    """Log likelihood ratios by (feature, bin): grouped counts, no more than FEATURES times BINS rows."""
    counts = (
        labelled.select("quality", F.posexplode("__bins").alias("f", "b")).groupBy("f", "b")
        .agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad")).collect()
    )
    per = {f: (sum(r.good for r in counts if r.f == f), sum(r.bad for r in counts if r.f == f)) for f in range(len(FEATURES))}
    out = {}
    for r in counts:
        good, bad = per[r.f]
        if good and bad:  # half a document of either class in each bin, split by the overall rate: the prior says nothing
            rate = good / (good + bad)
            out[r.f, r.b] = float(np.log((r.good + rate) / (good + rate)) - np.log((r.bad + 1 - rate) / (bad + 1 - rate)))
    return out


def bin_table(ratios: dict[tuple[int, int], float]) -> np.ndarray:
    table = np.zeros((len(FEATURES), BINS))
    for (f, b), w in ratios.items():
        table[f, b] = w
    return table


def fit_weights(bins: np.ndarray, good: np.ndarray, table: np.ndarray, ridge: float = 3.0) -> tuple[np.ndarray, float]:
    """(weights, intercept) of a logistic regression on the ratios by Newton's method; the ridge draws the weights to 1 / 2, the intercept is free."""
    x = np.column_stack([table[np.arange(len(FEATURES)), bins], np.ones(len(bins))])
    centre = np.append(np.full(len(FEATURES), 0.5), 0.0)
    pull = np.diag(np.append(np.full(len(FEATURES), ridge), 1e-3))
    w = centre.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (good - p) - pull @ (w - centre))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def beta_strength(spread: float, noise: float, weight: float, variance: float) -> float:
    """Of a Beta prior, in documents: `spread`, the weighted squares about the mean, is `noise` by chance and `weight` times the variance between sites."""
    between = max((spread - noise) / weight, 1e-9) if weight > 0 else variance / 101.0  # a single site says nothing: 100 documents
    return float(np.clip(variance / between - 1, *STRENGTHS))


def site_posteriors(labelled: DataFrame) -> tuple[float, DataFrame, DataFrame]:
    """(global rate, (__host, __host_rate), (__psource, __plang, __path_rate)) from (quality, source, lang): posterior means of the share of good labels."""
    per_host = labelled.groupBy("source").agg(F.sum("quality").alias("good"), F.count(F.lit(1)).alias("n"))
    per_path = labelled.groupBy("source", "lang").agg(F.sum("quality").alias("good"), F.count(F.lit(1)).alias("n"))
    # sums over all hosts, one row
    m = per_host.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(name) for name, x in (
        ("k", F.col("good")), ("n", F.col("n")), ("h", F.lit(1)), ("sq", F.col("good") * F.col("good") / F.col("n")), ("n2", F.col("n") * F.col("n")),
    )]).first()
    mean = (m.k + 1) / (m.n + 2)
    variance = mean * (1 - mean)
    strength = beta_strength(m.sq - 2 * mean * m.k + mean * mean * m.n, variance * (m.h - 1), m.n - m.n2 / max(m.n, 1), variance)
    host = per_host.select(
        F.col("source").alias("__host"), ((F.col("good") + mean * strength) / (F.col("n") + strength)).alias("__host_rate"), F.col("good").alias("__hgood"), F.col("n").alias("__hn")
    )
    path = per_path.join(host, F.col("source").eqNullSafe(F.col("__host")))
    # how far the paths of a host lie from it: sums over all paths, one row
    raw, own = F.col("__hgood") / F.col("__hn"), F.col("__host_rate") * (1 - F.col("__host_rate"))
    rest = 1 - F.col("n") / F.col("__hn")
    p = path.agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(name) for name, x in (
        ("s", (F.col("good") - F.col("n") * raw) * (F.col("good") - F.col("n") * raw) / F.col("n")), ("noise", own * rest), ("w", F.col("n") * rest), ("v", F.col("n") * rest * own),
    )]).first()
    below = beta_strength(p.s, p.noise, p.w, p.v / p.w if p.w > 0 else variance)
    path = path.select(F.col("source").alias("__psource"), F.col("lang").alias("__plang"), ((F.col("good") + F.col("__host_rate") * below) / (F.col("n") + below)).alias("__path_rate"))
    return mean, host.select("__host", "__host_rate"), path


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` with evidence, prior and quality_score (0 to 1, higher: better)."""
    clean = docs.drop("__bins", "evidence", "prior", "quality_score", "__host", "__host_rate", "__psource", "__plang", "__path_rate")
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    marks = staged(marks, "marks")
    # features of the labelled rows: where labels are few, only those texts are read closely; else small numbers meet the labels, not the texts
    seen = docs.select("doc_id", "source", "lang", "text")
    if (few := marks.count()) <= MAX_BROADCAST_LABELS:
        seen = seen.join(F.broadcast(marks.select("doc_id")), "doc_id", "left_semi")
    seen = with_bins(seen).select("doc_id", "source", "lang", "__bins")
    labelled = seen.join(F.broadcast(marks) if few <= MAX_BROADCAST_LABELS else marks, "doc_id").select("doc_id", "quality", "source", "lang", "__bins")
    labelled = staged(labelled, "labelled")
    table = bin_table(fit_bins(labelled))
    fit = hash_sample(labelled, "doc_id", labelled.count(), FIT_ROWS).select("quality", "__bins").collect()
    evidence_at, shift = table, 0.0
    if {r.quality for r in fit} == {0, 1}:
        weights, shift = fit_weights(np.array([r["__bins"] for r in fit]), np.array([r.quality for r in fit], float), table)
        rate = np.mean([r.quality for r in fit])
        evidence_at, shift = table * weights[:, None], shift - float(np.log(rate / (1 - rate)))  # the prior comes from the site
    mean, host, path = site_posteriors(labelled)
    spark = clean.sparkSession
    model = spark.sparkContext.broadcast((evidence_at, shift))
    names = clean.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, shift = model.value
        for batch in batches:
            found = [shift + table[np.arange(len(FEATURES)), features(data, off)].sum(1) for _, _, data, off in text_rows(batch, "text")]
            evidence = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(evidence)], [*batch.schema.names, "evidence"])

    logit = lambda p: F.ln(p / (1 - p))
    site = logit(F.coalesce("__path_rate", "__host_rate", F.lit(mean)))
    scored = (
        map_arrow(clean, run, with_field(clean, "evidence", T.DoubleType()))
        .join(small(host, MAX_SITES), F.col("source").eqNullSafe(F.col("__host")), "left")
        .join(small(path, MAX_SITES), F.col("source").eqNullSafe(F.col("__psource")) & F.col("lang").eqNullSafe(F.col("__plang")), "left")
        .withColumn("prior", 1 / (1 + F.exp(-site)))
    )
    return scored.withColumn("quality_score", 1 / (1 + F.exp(-(site + F.col("evidence"))))).select(*names, "evidence", "prior", "quality_score")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without those scored under `threshold`: only documents that are likely junk go."""
    return score_quality(docs, labels).where(F.col("quality_score") >= threshold).drop("evidence", "prior", "quality_score")
