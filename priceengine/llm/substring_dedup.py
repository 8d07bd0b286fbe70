"""Operator 5: removal of long repeated substrings, with a hash-compared suffix sort.

A byte goes if some WINDOW-byte string over it also starts anywhere else, in the same text or in another. Every window
has an anchor: the leftmost of its GRAM-byte strings with the smallest hash. Equal windows have equal anchors at equal
offsets, so only texts' windows that share an anchor need to be compared, and a text has few anchors.

1. Anchors that occur once have no repeated window. They go in one grouped count.
2. Of the others, all windows of one anchor together are its span. Spans that occur more than once (exact copies, the
   inside of shared passages) are repeated as a whole, and one of each stands for all from here on.
3. What is left are anchors whose spans differ: the edges of shared passages. The suffixes at these anchors are
   sorted by a mergesort that compares two suffixes by their prefix hashes: a binary search finds the length of what
   they have in common, in steps of the logarithm of the window. The lengths between neighbours are verified byte by
   byte; if a hash lied, the group is sorted by its bytes. For every offset of a window before its anchor, suffixes
   with enough in common and with equal bytes before the anchor, which are compared too, are repeated windows.
   An anchor with more than GROUP different spans is not gathered in a task: its windows are hashed one by one and
   counted by Spark, two rounds with a map-side combine.

Beside that, `shared_passages` counts the windows of PASSAGE words that stand in another text, too, however many bytes
they have: words are what stands between ASCII white space, A-Z as a-z. Windows have anchors of PASSAGE_GRAM words in the
same way; spans that occur in one text only and share their anchor with other spans are told apart window by window. It
removes nothing: it tells which texts hold a passage of over 50 words that is found elsewhere.

Cases: a null text is an empty one. Texts under WINDOW bytes keep everything, texts under PASSAGE words share nothing. Repeated rows are texts of their own and
so remove each other, a null doc_id included. Empty tables give empty ones. Very long texts are cut nowhere; a text's
own spans come together in one row. Other columns are dropped by `repeated_spans` and kept by `without_repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceengine.llm.kernels import BASE, BYTE_VALUE, mix, powers, prefix_hash, span_hash, text_rows, token_hashes, utf8
from priceengine.llm.staging import map_arrow, release, small, staged

WINDOW, GRAM = 400, 64
REACH = WINDOW - GRAM  # an anchor starts so many bytes after its window at most
PASSAGE, PASSAGE_GRAM = 51, 12
GROUP, CHUNK = 1500, 4000
MAX_BROADCAST_TEXTS = 300_000
_POSITION = np.uint64(0xFFFFFFFF)


def minimizers(grams: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of each anchor: of every `window` symbols the leftmost `gram` of them with the smallest hash."""
    size = np.diff(offsets)
    long = np.flatnonzero(size >= window)
    if not len(long):
        return (np.zeros(0, np.int64),) * 3
    # the upper half of the hash decides, the position breaks ties to the left
    least = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    width, need = 1, window - gram + 1
    while width * 2 <= need:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (need - width)], least[need - width :])
    edge = np.zeros(len(least) + 1, np.int64)
    np.add.at(edge, offsets[long], 1)
    np.add.at(edge, np.minimum(offsets[long] + size[long] - window + 1, len(least)), -1)
    at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    chosen = (least[at] & _POSITION).astype(np.int64)
    first = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)))
    return chosen[first], at[first], at[np.append(first[1:], len(at)) - 1]


def anchors(prefix: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, anchor hash, span hash) of each anchor, as positions in what `prefix` hashes."""
    if not (np.diff(offsets) >= window).any():
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    _, down = powers(len(prefix) - 1)
    grams = mix((prefix[gram:] - prefix[:-gram]) * down[: len(prefix) - gram])
    a, lo, hi = minimizers(grams, offsets, window, gram)
    shape = ((a - lo) * window + (a - hi)).astype(np.uint64)
    return a, lo, hi, grams[a], mix(span_hash(prefix, lo, hi + window) + mix(shape))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, off in text_rows(batch, "text"):
            a, lo, hi, h, s = anchors(prefix_hash(data), off)
            row = np.searchsorted(off, a, "right") - 1
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(i, j - i).take(take), batch.column(1).slice(i, j - i).take(take), pa.array(h.view(np.int64)), pa.array(s.view(np.int64)),
                pa.array((a - off[row])), pa.array((a - hi).astype(np.int32)), pa.array((a - lo).astype(np.int32)),
            ], ["t1", "t2", "h", "s", "a", "lo", "hi"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around the wanted anchors of a text: REACH before, WINDOW from the anchor on, as far as the text goes."""
    for batch in batches:
        want = batch.column(1)
        each, parts = np.asarray(want.value_lengths().fill_null(0)), want.flatten()
        begin = np.concatenate([[0], np.cumsum(each)])
        data, off = utf8(batch.column(0))
        for i in range(0, batch.num_rows, 64):
            j = min(i + 64, batch.num_rows)
            mine = parts.slice(begin[i], begin[j] - begin[i])
            row = i + np.repeat(np.arange(j - i), each[i:j])
            a = np.asarray(mine.field("a"))
            left, right = np.minimum(a, REACH), np.minimum(off[row + 1] - off[row] - a, WINDOW)
            lengths = left + right
            out = np.zeros(len(a) + 1, np.int32)
            np.cumsum(lengths, out=out[1:])
            at = np.repeat(off[row] + a - left - out[:-1], lengths) + np.arange(out[-1])
            text = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(out.tobytes()), pa.py_buffer(data[at].tobytes())])
            yield pa.RecordBatch.from_arrays([*[mine.field(c) for c in ("h", "s", "lo", "hi", "n", "k")], pa.array(left.astype(np.int32)), text], ["h", "s", "lo", "hi", "n", "k", "left", "text"])


def matrices(data: np.ndarray, off: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes by WINDOW, reversed bytes before them by REACH, suffix lengths), padded with zeros."""
    n = len(left)
    length = np.diff(off) - left
    k = np.arange(WINDOW)
    after = np.where(k < length[:, None], data[np.minimum(off[:-1, None] + left[:, None] + k, len(data) - 1)], 0).astype(np.uint8)
    k = np.arange(REACH)
    before = np.where(k < left[:, None], data[np.maximum(off[:-1, None] + left[:, None] - 1 - k, 0)], 0).astype(np.uint8)
    return after.reshape(n, WINDOW), before.reshape(n, REACH), length


def row_prefix_hashes(m: np.ndarray) -> np.ndarray:
    """For each row and length, the polynomial hash of so many first bytes."""
    up, _ = powers(m.shape[1])
    out = np.zeros((m.shape[0], m.shape[1] + 1), np.uint64)
    np.cumsum(BYTE_VALUE[m] * up[: m.shape[1]], 1, out=out[:, 1:])
    return out


def common_lengths(hashes: np.ndarray, length: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many first bytes rows x and y share: a binary search on their prefix hashes."""
    lo, hi = np.zeros(len(x), np.int64), np.minimum(length[x], length[y])
    while (open_ := lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = hashes[x, mid] == hashes[y, mid]
        lo = np.where(open_ & same, mid, lo)
        hi = np.where(open_ & ~same, mid - 1, hi)
    return lo


def suffix_order(group: np.ndarray, m: np.ndarray, length: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A bottom-up mergesort by (group, suffix): all merges of a level at once, each element finding its rank in the other run."""
    n = len(group)

    def before(x: np.ndarray, y: np.ndarray, ties: bool) -> np.ndarray:
        lcp = common_lengths(hashes, length, x, y)
        ended = (lcp == length[x]) | (lcp == length[y])
        at = np.minimum(lcp, WINDOW - 1)
        less = np.where(ended, (length[x] < length[y]) | (ties & (length[x] == length[y])), m[x, at] < m[y, at])
        return np.where(group[x] == group[y], less, group[x] < group[y])

    order, width = np.arange(n), 1
    while width < n:
        place = np.arange(n)
        start = place // (2 * width) * (2 * width)
        mine_right = place - start >= width
        a = np.where(mine_right, start, np.minimum(start + width, n))
        lo, hi = a.copy(), np.where(mine_right, start + width, np.minimum(start + 2 * width, n))
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            x, y = order[mid], order[open_]
            # elements of the left run come first among equals
            goes = np.where(mine_right[open_], before(x, y, True), before(x, y, False))
            lo[open_] = np.where(goes, mid + 1, lo[open_])
            hi[open_] = np.where(goes, hi[open_], mid)
        to = np.where(mine_right, start + (place - start - width) + (lo - a), place + (lo - a))
        merged = np.empty(n, np.int64)
        merged[to] = order
        order, width = merged, width * 2
    return order


def repeated_offsets(group: np.ndarray, data: np.ndarray, off: np.ndarray, left: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows by offsets 0 .. REACH: does the window that starts so far before the anchor occur again? Rows of one group share an anchor."""
    m, back, length = matrices(data, off, left)
    hashes = row_prefix_hashes(m)
    order = suffix_order(group, m, length, hashes)
    x, y = order[:-1], order[1:]
    lcp = np.where(group[x] == group[y], common_lengths(hashes, length, x, y), 0)
    real = np.where(m[x] == m[y], WINDOW + 1, np.arange(WINDOW)).min(1) if len(x) else lcp
    real = np.where(group[x] == group[y], np.minimum(real, np.minimum(length[x], length[y])), 0)
    sorted_ok = (lcp == real).all() and all(m[p].tobytes()[: length[p]] <= m[q].tobytes()[: length[q]] for p, q in zip(x, y, strict=True) if group[p] == group[q])
    if not sorted_ok:  # a hash lied: by the bytes themselves
        order = np.array(sorted(range(len(group)), key=lambda i: (group[i], m[i, : length[i]].tobytes())), np.int64)
        x, y = order[:-1], order[1:]
        same = np.where(m[x] == m[y], WINDOW + 1, np.arange(WINDOW)).min(1)
        lcp = np.where(group[x] == group[y], np.minimum(same, np.minimum(length[x], length[y])), 0)
    lcp = np.concatenate([[0], lcp])
    before = row_prefix_hashes(back)[order]
    back, lo, hi, n = back[order], lo[order], hi[order], n[order]
    found = np.zeros((len(order), REACH + 1), bool)
    for o in range(REACH + 1):
        rows = np.flatnonzero((lo <= o) & (o <= hi))
        if len(rows) < 2:
            continue
        run = np.cumsum(lcp < WINDOW - o)[rows].astype(np.uint64)
        kinds, first, which = np.unique(before[rows, o] ^ mix(run), return_index=True, return_inverse=True)
        twice = np.bincount(which, n[rows]) >= 2
        hit = rows[twice[which]]
        with_ = rows[first[which]][twice[which]]
        if o and len(hit):
            lied = (back[hit, :o] != back[with_, :o]).any(1)
            if lied.any():  # told apart by the bytes themselves
                texts = [(int(r), back[i, :o].tobytes()) for i, r in zip(rows, run, strict=True)]
                count: dict = {}
                for t, k in zip(texts, n[rows], strict=True):
                    count[t] = count.get(t, 0) + k
                hit = rows[np.array([count[t] >= 2 for t in texts])]
        found[hit, o] = True
    out = np.zeros_like(found)
    out[order] = found
    return out


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts ordered by anchor hash come in, repeated runs of offsets go out; a batch may end inside a group."""
    def judged(table: pa.Table) -> pa.RecordBatch:
        h = table.column("h").to_numpy()
        data, off = utf8(table.column("text"))
        lo, hi, n, left = (table.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi", "n", "left"))
        group = np.cumsum(np.append(0, h[1:] != h[:-1])) if len(h) else h
        # spans that occur twice count as partners here; they are repeated as a whole, which is told already
        found = repeated_offsets(group, data, off, left, lo, hi, n) & (n == 1)[:, None]
        edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, first = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        return pa.RecordBatch.from_arrays([pa.array(h[row]), table.column("s").take(pa.array(row)).combine_chunks(), pa.array(first.astype(np.int32)), pa.array((end - 1).astype(np.int32))], ["h", "s", "o1", "o2"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= CHUNK:
            table = pa.Table.from_batches(held)
            h = table.column("h").to_numpy()
            starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            cut = starts[starts <= CHUNK][-1] or (starts[1] if len(starts) > 1 else 0)
            if not cut or (cut == starts[-1] and len(starts) == 1):
                break
            yield judged(table.slice(0, cut))
            held = table.slice(cut).to_batches()
    if held:
        yield judged(pa.Table.from_batches(held))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of each context as a row of its own."""
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            data, off = utf8(part.column("text"))
            prefix = prefix_hash(data)
            lo, hi, left = (np.asarray(part.column(c)).astype(np.int64) for c in ("lo", "hi", "left"))
            each = hi - lo + 1
            row = np.repeat(np.arange(part.num_rows), each)
            o = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            start = off[row] + left[row] - o
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([part.column("h").take(take), part.column("s").take(take), part.column("n").take(take), pa.array(o.astype(np.int32)), pa.array(span_hash(prefix, start, start + WINDOW).view(np.int64))], ["h", "s", "n", "o", "w"])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(t1, t2, spans) over (t1, t2, text), where t1 and t2 hash the text: byte ranges [start, stop) that repeat, not merged."""
    found = staged(map_arrow(texts.select("t1", "t2", "text"), _anchors, "t1 long, t2 long, h long, s long, a long, lo int, hi int"), "anchors")
    spans = found.groupBy("h", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t1", "t2", "a", "lo", "hi")).alias("one"))
    spans = staged(spans, "spans")
    groups = spans.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("all")).where("all > 1").select("h", "k")
    shared = staged(spans.join(groups, "h"), "shared")
    whole = shared.where("n > 1").select("h", "s", F.col("one.lo").alias("o1"), F.col("one.hi").alias("o2"))
    wanted = staged(
        shared.where("k > 1").select("one.t1", "one.t2", F.struct("h", "s", "one.a", "one.lo", "one.hi", F.least("n", F.lit(2)).alias("n"), "k").alias("w"))
        .groupBy("t1", "t2").agg(F.collect_list("w").alias("want")), "wanted",
    )
    near = texts.select("t1", "t2", "text").join(small(wanted.select("t1", "t2"), MAX_BROADCAST_TEXTS), ["t1", "t2"], "left_semi")
    contexts = map_arrow(near.join(wanted, ["t1", "t2"]).select("text", "want"), _contexts, "h long, s long, lo int, hi int, n long, k long, left int, text binary")
    contexts = staged(contexts.dropDuplicates(["h", "s"]), "contexts")
    sorted_ = map_arrow(contexts.where(F.col("k") <= GROUP).repartition("h").sortWithinPartitions("h"), _sort_groups, "h long, s long, o1 int, o2 int")
    single = staged(map_arrow(contexts.where(F.col("k") > GROUP), _windows, "h long, s long, n long, o int, w long"), "windows")
    again = staged(single.groupBy("h", "o", "w").agg(F.sum("n").alias("times")).where("times > 1").select("h", "o", "w"), "again")
    by_window = single.where("n = 1").join(again, ["h", "o", "w"]).select("h", "s", F.col("o").alias("o1"), F.col("o").alias("o2"))
    edges = whole.unionByName(sorted_).unionByName(by_window)
    verdict = staged(edges.groupBy("h", "s").agg(F.collect_set(F.struct("o1", "o2")).alias("runs")), "verdict")
    span = lambda r: F.struct((F.col("a") - r["o2"]).alias("start"), (F.col("a") - r["o1"] + WINDOW).alias("stop"))
    ranges = found.join(verdict, ["h", "s"]).select("t1", "t2", F.transform("runs", span).alias("spans"))
    return ranges.groupBy("t1", "t2").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def word_prefix(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix hashes over the words of all texts, offsets of the texts in words)."""
    _, _, rows, hashed = token_hashes(data, offsets)
    up, _ = powers(len(hashed))
    prefix = np.zeros(len(hashed) + 1, np.uint64)
    np.cumsum(hashed * up[: len(hashed)], out=prefix[1:])
    return prefix, np.searchsorted(rows, np.arange(len(offsets)))


def _word_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of each text's windows of PASSAGE words; equal spans of one text are one row, which stands for `times`."""
    for batch in batches:
        for i, j, data, off in text_rows(batch, "text"):
            prefix, first = word_prefix(data, off)
            a, lo, hi, h, s = anchors(prefix, first, PASSAGE, PASSAGE_GRAM)
            row = np.searchsorted(first, a, "right") - 1
            _, one, times = np.unique(mix(s + row.astype(np.uint64) * BASE), return_index=True, return_counts=True)
            a, lo, hi, h, s, row = (x[one] for x in (a, lo, hi, h, s, row))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(i, j - i).take(take), batch.column(1).slice(i, j - i).take(take), pa.array(h.view(np.int64)), pa.array(s.view(np.int64)),
                pa.array((a - first[row]).astype(np.int32)), pa.array((a - hi).astype(np.int32)), pa.array((a - lo).astype(np.int32)), pa.array(times.astype(np.int32)),
            ], ["t1", "t2", "h", "s", "a", "lo", "hi", "times"])


def _word_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of the wanted anchors of a text as a row of its own."""
    for batch in batches:
        want = batch.column(3)
        begin, parts = np.concatenate([[0], np.cumsum(np.asarray(want.value_lengths().fill_null(0)))]), want.flatten()
        for i, j, data, off in text_rows(batch, "text"):
            prefix, first = word_prefix(data, off)
            mine = parts.slice(begin[i], begin[j] - begin[i])
            a, lo, hi = (np.asarray(mine.field(c)).astype(np.int64) for c in ("a", "lo", "hi"))
            row = np.repeat(np.arange(j - i), np.diff(begin[i : j + 1]))
            each = hi - lo + 1
            which = np.repeat(np.arange(len(a)), each)
            o = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
            start = first[row[which]] + a[which] - o
            text, take = pa.array(i + row[which]), pa.array(which)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(text), batch.column(1).take(text), *[mine.field(c).take(take) for c in ("h", "n", "times")],
                pa.array(o.astype(np.int32)), pa.array(span_hash(prefix, start, start + PASSAGE).view(np.int64)),
            ], ["t1", "t2", "h", "n", "times", "o", "w"])


def shared_passages(texts: DataFrame) -> DataFrame:
    """(t1, t2, n_shared_windows) over (t1, t2, text): how many windows of PASSAGE words stand in another text, too; texts without any are left out."""
    texts = texts.select("t1", "t2", "text")
    found = staged(map_arrow(texts, _word_anchors, "t1 long, t2 long, h long, s long, a int, lo int, hi int, times int"), "word_anchors")
    # n counts texts, since a text has each of its spans once
    spans = found.groupBy("h", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t1", "t2", "a", "lo", "hi", "times")).alias("one"))
    spans = staged(spans, "word_spans")
    groups = spans.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("all")).where("all > 1").select("h", "k")
    shared = staged(spans.join(groups, "h"), "word_shared")
    whole = shared.where("n > 1").select("h", "s")
    wanted = staged(
        shared.where("k > 1").select("one.t1", "one.t2", F.struct("h", "one.a", "one.lo", "one.hi", "one.times", F.least("n", F.lit(2)).alias("n")).alias("w"))
        .groupBy("t1", "t2").agg(F.collect_list("w").alias("want")), "word_wanted",
    )
    near = texts.join(small(wanted.select("t1", "t2"), MAX_BROADCAST_TEXTS), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])
    windows = map_arrow(near.join(wanted, ["t1", "t2"]).select("t1", "t2", "text", "want"), _word_windows, "t1 long, t2 long, h long, n long, times int, o int, w long")
    windows = staged(windows, "word_windows")
    # of texts whose span is theirs alone: two of them, or one beside a span of several
    text = F.struct("t1", "t2")
    met = windows.groupBy("h", "o", "w").agg(F.max("n").alias("most"), F.min(text).alias("least"), F.max(text).alias("last"))
    met = staged(met.where((F.col("most") > 1) | (F.col("least") != F.col("last"))).select("h", "o", "w"), "word_met")
    single = windows.where("n = 1").join(small(met, MAX_BROADCAST_TEXTS), ["h", "o", "w"]).select("t1", "t2", F.col("times").cast("long").alias("m"))
    inside = found.join(small(whole, MAX_BROADCAST_TEXTS), ["h", "s"]).dropDuplicates(["t1", "t2", "h", "s"]).select("t1", "t2", ((F.col("hi") - F.col("lo") + 1) * F.col("times")).cast("long").alias("m"))
    counts = staged(single.unionByName(inside).groupBy("t1", "t2").agg(F.sum("m").alias("n_shared_windows")), "word_counts")
    release(found, spans, shared, wanted, windows, met)
    return counts


def keyed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the text's two hashes as t1 and t2."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({text_col: text, "t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(7), text)})


def _kept(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[bytes, int, int]:
    """(what stays, bytes removed, maximal removed runs)."""
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, stops, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return raw[~gone].tobytes(), int(gone.sum()), int((np.diff(np.append(0, gone.astype(np.int8))) == 1).sum())


def without_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` (any columns but t1, t2 and spans) with kept (binary), n_bytes, n_removed, n_spans and n_shared_windows."""
    texts = keyed(docs.drop("t1", "t2", "spans", "kept", "n_bytes", "n_removed", "n_spans", "n_shared_windows"), text_col)
    plain = texts.select("t1", "t2", F.col(text_col).alias("text"))
    passages = shared_passages(plain)
    spans = repeated_spans(plain)
    none, zero = F.array().cast(spans.schema["spans"].dataType), F.lit(0).cast("long").alias("n_shared_windows")
    spans = staged(spans.join(passages, ["t1", "t2"], "full").select("t1", "t2", F.coalesce("spans", none).alias("spans"), F.coalesce("n_shared_windows", zero).alias("n_shared_windows")), "ranges")
    ids = spans.select("t1", "t2")
    if ids.count() <= MAX_BROADCAST_TEXTS:  # texts without repeats need not be dealt out
        ids = F.broadcast(ids)
        met = texts.join(ids, ["t1", "t2"], "left_semi").join(spans, ["t1", "t2"]).unionByName(texts.join(ids, ["t1", "t2"], "left_anti").withColumns({"spans": none, "n_shared_windows": zero}))
    else:
        met = texts.join(spans, ["t1", "t2"], "left").withColumns({"spans": F.coalesce("spans", none), "n_shared_windows": F.coalesce("n_shared_windows", zero)})
    met = met.drop("t1", "t2")
    at, ranges = met.columns.index(text_col), met.columns.index("spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(at))
            col = batch.column(ranges)
            begin = np.concatenate([[0], np.cumsum(np.asarray(col.value_lengths().fill_null(0)))])
            flat = col.flatten()
            starts, stops = np.asarray(flat.field("start")), np.asarray(flat.field("stop"))
            rows = [_kept(data[off[i] : off[i + 1]], starts[begin[i] : begin[i + 1]], stops[begin[i] : begin[i + 1]]) for i in range(batch.num_rows)]
            kept, removed, n = zip(*rows, strict=True) if rows else ((), (), ())
            others = [c for i, c in enumerate(batch.columns) if i != ranges]
            names = [c for c in batch.schema.names if c != "spans"]
            yield pa.RecordBatch.from_arrays([*others, pa.array(kept, pa.binary()), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(n, pa.int64())], [*names, "kept", "n_bytes", "n_removed", "n_spans"])

    extra = [T.StructField("kept", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]]
    return map_arrow(met, run, T.StructType([*[f for f in met.schema.fields if f.name != "spans"], *extra]))
