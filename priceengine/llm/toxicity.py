"""Operator 1: toxicity from a learned lexicon, matched through Levenshtein automata.

Learning. Of the labelled training rows, no more than PER_CLASS, the lowest by a hash of doc_id, are taken of either class (the
documented bound), and the different words before each word are counted per class, so that copies count once. Words
that a G test finds far more often in toxic documents form the lexicon, each weighted by its log odds; it is bounded by
the words of the bounded rows. Two parameters hold it: words of fewer than MIN_TERM characters are no terms, as they are within an edit
of too many others, and no term weighs more than MAX_WEIGHT, so that one word alone does not decide.

Matching. The terms of five letters or more are a trie. A Levenshtein automaton of one edit (insertion, deletion,
substitution, or swap of neighbours) runs over the trie: its states are sets of (trie node, edits so far), made when
first met and kept (forgotten once there are STATES of them), so a word costs one step a letter. Words that the training rows use without offence are let
through by exact match before that.

Context. A hit counts more the more hits stand within WINDOW words, and only QUOTED of its weight if it stands within
quotation marks. A document's evidence is the sum of its hits and its densest window; a logistic regression on the
same bounded rows, corrected to the class shares of all labelled training rows, gives the score.

Cases: null and empty texts have no evidence and get the score of none. Labels that are null or neither 0 nor 1 are
not used; of repeated labels the toxic one counts. Without both classes in the labels there is no lexicon and the
score is the smoothed share of toxic labels. Repeated rows and ties are scored alike. Null doc_ids are never trained
on. Very long texts are read whole. An empty table gives an empty one; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceengine.llm.kernels import BASE, FOLD, mix, prefix_hash, row_counts, slices, span_hash, text_rows, tokens
from priceengine.llm.staging import hash_sample, map_arrow, staged, with_field

PER_CLASS, STATES = 10_000, 200_000
MIN_G, MIN_ODDS, MAX_WEIGHT, MIN_TERM = 25.0, 3.0, 8.0, 3
WINDOW, QUOTED, MISSPELLED, MIN_FUZZY = 8, 0.25, 0.7, 5
#: Words are runs of ASCII letters and digits, apostrophes and bytes of other characters.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = False
CACHE = 1_000_000


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters."""
    out = FOLD[data]
    if len(out) > 1:
        upper = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][upper] += 0x20
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, start, end, row, hash) of the words."""
    low = folded(data)
    starts, ends, rows = tokens(low, offsets, BETWEEN)
    return low, starts, ends, rows, span_hash(prefix_hash(low), starts, ends)


class TrieAutomaton:
    """The Levenshtein automaton of one edit, intersected with the trie of `terms` and made deterministic as it is used."""

    def __init__(self, terms: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.value: dict[int, float] = {}
        for term, weight in terms.items():
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            self.value[node] = weight
        #: A longer word is more than one edit from all terms.
        self.longest = max(map(len, terms), default=-1) + 1
        self._forget()

    def _forget(self) -> None:
        start = frozenset([(0, 0, ""), *((n, 1, "") for n in self.children[0].values())])
        self.sets, self.number = [start], {start: 0}
        self.steps: list[dict[str, int]] = [{}]
        self.final = [self._final(start)]

    def _final(self, states: frozenset) -> float:
        return max((self.value[n] for n, _, due in states if not due and n in self.value), default=0.0)

    def _step(self, state: int, c: str) -> int:
        out: set[tuple[int, int, str]] = set()
        for node, edits, due in self.sets[state]:
            if due:  # the second letter of a swap
                if due == c:
                    out.add((node, 1, ""))
                continue
            below = self.children[node]
            if c in below:
                out.add((below[c], edits, ""))
            if not edits:
                out.add((node, 1, ""))  # c was inserted
                for other, child in below.items():
                    if other != c:
                        out.add((child, 1, ""))  # c stands for another letter
                        if c in self.children[child]:
                            out.add((self.children[child][c], 1, other))  # swapped with the next
        for node, edits, due in [s for s in out if not s[1]]:
            out.update((child, 1, "") for child in self.children[node].values())  # the next letter of the term is missing
        made = frozenset(out)
        if made not in self.number:
            self.number[made] = len(self.sets)
            self.sets.append(made)
            self.steps.append({})
            self.final.append(self._final(made))
        return self.number[made]

    def match(self, word: str) -> float:
        """The largest weight of a term within one edit of `word`, or 0."""
        if len(word) > self.longest:
            return 0.0
        if len(self.sets) > STATES:
            self._forget()
        state, sets, steps = 0, self.sets, self.steps
        for c in word:
            to = steps[state].get(c)
            if to is None:
                to = steps[state][c] = self._step(state, c)
            state = to
            if not sets[state]:
                return 0.0
        return self.final[state]


@dataclass
class Model:
    """terms: lexicon with weights; harmless: words near a term that clean documents use; the logistic parameters."""

    terms: dict[str, float]
    harmless: frozenset[str] = frozenset()
    weights: tuple[float, float] = (0.0, 0.0)
    bias: float = -3.0
    _state: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_state"} | {"_state": {}}

    def matcher(self) -> dict:
        if not self._state:
            words = list(self.terms)
            raw = [w.encode() for w in words]
            off = np.cumsum([0, *map(len, raw)])
            hashes = span_hash(prefix_hash(np.frombuffer(b"".join(raw), np.uint8)), off[:-1], off[1:]) if raw else np.zeros(0, np.uint64)
            order = np.argsort(hashes)
            self._state.update(
                hashes=hashes[order], weights=np.array([self.terms[w] for w in words])[order],
                automaton=TrieAutomaton({w: x for w, x in self.terms.items() if len(w) >= MIN_FUZZY}), cache={},
            )
        return self._state


def hit_weights(model: Model, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """The weight of each word as a hit: exact, misspelled, or 0."""
    state = model.matcher()
    known = state["hashes"]
    out = np.zeros(len(hashed))
    if not len(known):
        return out
    at = np.minimum(np.searchsorted(known, hashed), len(known) - 1)
    exact = known[at] == hashed
    out[exact] = state["weights"][at[exact]]
    # words of more bytes than the longest term and one letter can have are no terms
    rest = np.flatnonzero(~exact & (ends - starts >= MIN_FUZZY - 1) & (ends - starts <= 4 * state["automaton"].longest))
    kinds, first, which = np.unique(hashed[rest], return_index=True, return_inverse=True)
    cache, match = state["cache"], state["automaton"].match
    if len(cache) > CACHE:
        cache.clear()
    found = np.zeros(len(kinds))
    raw = low.tobytes()
    for i, (h, k) in enumerate(zip(kinds.tolist(), rest[first].tolist(), strict=True)):
        w = cache.get(h)
        if w is None:
            word = raw[starts[k] : ends[k]].decode("utf-8", "replace")
            w = match(word)
            if w and word in model.harmless:
                w = 0.0
            cache[h] = w
        found[i] = w
    out[rest] = found[which] * MISSPELLED
    return out


def evidence(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log of the hits' weights, log of the densest window, hits) of each row."""
    n = len(offsets) - 1
    low, starts, ends, rows, hashed = word_hashes(data, offsets)
    weight = hit_weights(model, low, starts, ends, hashed)
    hits = np.flatnonzero(weight)
    count = row_counts(rows[hits], n)
    if not len(hits):
        return np.zeros(n), np.zeros(n), count
    marks = data == 0x22  # straight quotation marks open and close in turn
    if len(data) > 1:  # guillemets, and the curly and low ones by their three bytes
        marks[1:] |= (data[:-1] == 0xC2) & ((data[1:] == 0xAB) | (data[1:] == 0xBB))
    if len(data) > 2:
        marks[2:] |= (data[:-2] == 0xE2) & (data[1:-1] == 0x80) & (data[2:] >= 0x9C) & (data[2:] <= 0x9F)
    so_far = np.zeros(len(data) + 1, np.int64)
    np.cumsum(marks, out=so_far[1:])
    row = rows[hits]
    line_breaks = np.flatnonzero(data == 0x0A)
    before = np.searchsorted(line_breaks, starts[hits])
    line_start = np.maximum(offsets[row], np.where(before > 0, line_breaks[np.maximum(before - 1, 0)] if len(line_breaks) else 0, 0))
    inside = (so_far[starts[hits]] - so_far[line_start]) % 2 == 1
    after = np.searchsorted(line_breaks, starts[hits])
    line_end = np.minimum(offsets[row + 1], np.where(after < len(line_breaks), line_breaks[np.minimum(after, len(line_breaks) - 1)] if len(line_breaks) else len(data), len(data)))
    closed = so_far[line_end] > so_far[ends[hits]]
    own = weight[hits] * np.where(inside & closed, QUOTED, 1.0)
    total = np.concatenate([[0.0], np.cumsum(own)])
    key = row * (int(len(starts)) + 2 * WINDOW + 2) + hits  # words of another row are never within the window
    lo, hi = np.searchsorted(key, key - WINDOW), np.searchsorted(key, key + WINDOW, "right")
    dense = np.zeros(n)
    np.maximum.at(dense, row, total[hi] - total[lo])
    return np.log1p(np.bincount(row, own, n)), np.log1p(dense), count


def word_counts(train: DataFrame) -> DataFrame:
    """(word, a, b) over (text, toxic): after how many different words it stands in toxic and in other documents. Copies so count once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = np.asarray(batch.column(1).to_pylist(), np.int64)
            for i, j, data, off in text_rows(batch, "text"):
                low, starts, ends, rows, hashed = word_hashes(data, off)
                if not len(rows):
                    continue
                before = np.zeros(len(hashed), np.uint64)
                before[1:] = np.where(rows[1:] == rows[:-1], hashed[:-1], np.uint64(0))
                toxic = marked[i:j][rows]
                pair = mix(hashed + before * BASE) ^ toxic.astype(np.uint64)
                _, first = np.unique(pair, return_index=True)
                word = slices(low, starts[first], ends[first]).cast(pa.string(), safe=False)
                yield pa.RecordBatch.from_arrays([word, pa.array(before[first].view(np.int64)), pa.array(toxic[first]), pa.array(1 - toxic[first])], ["word", "before", "a", "b"])

    pairs = map_arrow(train.select("text", "toxic"), run, "word string, before long, a long, b long")
    return pairs.groupBy("word", "before").agg(F.max("a").alias("a"), F.max("b").alias("b")).groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def g_test(a: Column, b: Column, n1: int, n0: int) -> Column:
    """Twice the log likelihood gained by letting the word's share differ by class."""
    part = lambda k, n: F.when(k > 0, k * F.ln(k / F.lit(float(n)))).otherwise(0.0) + F.when(k < n, (n - k) * F.ln((n - k) / F.lit(float(n)))).otherwise(0.0)
    return 2 * (part(a, n1) + part(b, n0) - part(a + b, n1 + n0))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    pull = np.diag([*[ridge * 10] * (x.shape[1] - 1), ridge])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (y - p) - pull @ w)
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from `labels` (doc_id, toxic); pass only those that may be learnt from."""
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    marks = staged(marks, "marks")
    share = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    prior = (share.get(1, 0) + 0.5) / (sum(share.values()) + 1.0)
    if len(share) < 2:
        return Model({}, bias=float(np.log(prior / (1 - prior))))
    chosen = [hash_sample(marks.where(F.col("toxic") == t), "doc_id", share[t], PER_CLASS) for t in (0, 1)]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * PER_CLASS rows at most
    train = staged(docs.select("doc_id", "text").join(sample, "doc_id"), "toxic-train")
    size = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return Model({}, bias=float(np.log(prior / (1 - prior))))
    counts = staged(word_counts(train), "toxic-words")
    t = counts.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    m1, m0 = max(t.a or 0, 1), max(t.b or 0, 1)
    odds = F.ln((F.col("a") + 0.5) / F.lit(m1 + 1.0)) - F.ln((F.col("b") + 0.5) / F.lit(m0 + 1.0))
    judged = counts.withColumn("g", g_test(F.col("a"), F.col("b"), m1, m0)).withColumn("odds", F.least(odds, F.lit(MAX_WEIGHT)))
    found = judged.where((F.col("g") >= MIN_G) & (F.col("odds") >= MIN_ODDS) & (F.char_length("word") >= MIN_TERM)).select("word", "odds").collect()
    model = Model({r.word: float(r.odds) for r in found})

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = model.matcher()["automaton"].match
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in batch.column(0).to_pylist() if len(w) >= MIN_FUZZY - 1 and w not in model.terms and match(w)], pa.string())], ["word"])

    # words of the bounded training rows only
    model.harmless = frozenset(r.word for r in map_arrow(counts.where(F.col("b") >= 1).select("word"), near, "word string").collect())
    rows = with_evidence(train, model).select("toxic", "__total", "__dense").collect()
    x, y = np.array([(r["__total"], r["__dense"]) for r in rows]), np.array([r.toxic for r in rows], float)
    w = fit_logistic(x, y)
    shift = np.log(prior / (1 - prior)) - np.log(n1 / n0)  # the sample holds the classes in other shares
    model.weights, model.bias = (float(w[0]), float(w[1])), float(w[2] + shift)
    return model


def with_evidence(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [evidence(shared.value, data, off) for _, _, data, off in text_rows(batch, "text")]
            cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0), np.zeros(0), np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.int64))], [*batch.schema.names, "__total", "__dense", "toxic_hits"])

    schema = with_field(docs, "__total", T.DoubleType())
    schema = T.StructType([*schema.fields, T.StructField("__dense", T.DoubleType()), T.StructField("toxic_hits", T.LongType())])
    return map_arrow(docs, run, schema)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with toxic_hits and toxicity (0 to 1)."""
    scored = with_evidence(docs.drop("__total", "__dense", "toxic_hits", "toxicity"), model)
    z = F.col("__total") * model.weights[0] + F.col("__dense") * model.weights[1] + model.bias
    return scored.withColumn("toxicity", 1 / (1 + F.exp(-z))).drop("__total", "__dense")
