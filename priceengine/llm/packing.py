"""Operator 11: packing into sequences of fixed length by minimum bin slack.

Texts are turned into ids once, in Arrow batches, and written as pieces of at most `max_len` ids. What packing needs of
them is how many pieces have which length: at most `max_len` counts, whatever the input. Over these counts the bins are
filled one by one: the largest piece left opens a bin, and a subset sum over the lengths left, held as the bits of one
integer, finds the fullest combination for the rest of it, which is then taken away. A combination is taken as often as
its lengths last, since the next bins would find it again; so the plan has as many rows as combinations, not bins.

Pieces of one length are exchangeable: each is numbered in its task and length, counts of earlier tasks are added, and
the number tells its sequence and offset by a search in the plan, without a further shuffle of pieces. The ids stay in
the written table of pieces, where `sequences` finds them by (part, length, nth).

The counts (`max_len` rows) and the plan go through the driver: lengths are at most 4,096, and each combination uses up
a length or, where it is taken several times in a bin, at least halves what is left of it.

Word by word: a tokenizer that drops white space and ends a token between letters and punctuation gives a text the ids of its
words, so each worker asks for a word's ids once. Whether the tokenizer is of this kind is read from its file (`WORDS`);
any other one gets whole texts.

Cases: null and empty texts are the end id alone. Very long texts are cut into pieces of `max_len`, the last may be
shorter; nothing else is cut. Null doc_ids and repeated rows are documents like others. Equal lengths are told apart by
(part, nth). An empty table gives no sequence. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priceengine.llm.kernels import FOLD, IS_SPACE, slices, text_rows, tokens
from priceengine.llm.staging import map_arrow, staged

MAX_LEN, END = 4096, 1
#: What a worker remembers of words before it starts anew.
MAX_WORDS, MAX_WORD_BYTES = 1_000_000, 64 << 20
#: The settings of a tokenizer that works word by word.
WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
}
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long, ids array<int>"

_LETTER, _MARK = 1, 2
_CLASS = np.zeros(256, np.int8)
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = _MARK


class Packed(NamedTuple):
    """pieces: every piece with its ids; places: (part, length, nth, sequence_id, offset)."""

    pieces: DataFrame
    places: DataFrame


class Ids:
    """The ids of words, one after the other; words are numbered as they are first met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        first = (told.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        self.by_word = told["normalizer"] == WORDS["normalizer"] and first.get("pattern") == {"Regex": WORDS["split"]} and told.get("post_processor") is None and all(t["content"].startswith("<|") for t in told["added_tokens"])
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.begin, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of different words."""
        if len(self.number) > MAX_WORDS or self.size > MAX_WORD_BYTES // 4:
            self.clear()
        known = self.number
        new = [w for w in words if w not in known]
        # lower-case ASCII letters are what normalisation and splitting leave of them
        plain = [w for w in new if w.isalpha() and w.isascii() and w.islower()]
        rest = [w for w in new if not (w.isalpha() and w.isascii() and w.islower())]
        model = self.tokenizer.model
        got = [[t.id for t in model.tokenize(w.decode())] for w in plain]
        got += [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)]
        at = len(known)
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        ends = self.size + np.cumsum(lengths)
        while len(self.begin) < at + len(got) + 1:
            self.begin = np.append(self.begin, np.zeros_like(self.begin))
        total = int(ends[-1]) if len(got) else self.size
        while len(self.flat) < total:
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.flat[self.size : total] = np.fromiter((i for g in got for i in g), np.int32, total - self.size)
        self.begin[at + 1 : at + 1 + len(got)] = ends
        self.size = total
        known.update(zip([*plain, *rest], range(at, at + len(new)), strict=True))
        return np.fromiter((known[w] for w in words), np.int64, len(words))

    def of_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        n = len(offsets) - 1
        if not self.by_word:
            raw = data.tobytes()
            got = self.tokenizer.encode_batch([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], add_special_tokens=False)
            counts = np.fromiter((len(e.ids) for e in got), np.int64, n)
            return np.fromiter((i for e in got for i in e.ids), np.int32, int(counts.sum())), counts
        if b"<|" in data.tobytes():  # names of special tokens are left alone
            starts, ends, rows = tokens(data, offsets)
        else:
            data = FOLD[data]  # A-Z end as a-z anyway
            starts, ends, rows = words(data, offsets)
        told = slices(data, starts, ends).dictionary_encode()
        numbers = self.numbers(told.dictionary.to_pylist())[told.indices.to_numpy(zero_copy_only=False)] if len(starts) else np.zeros(0, np.int64)
        lengths = self.begin[numbers + 1] - self.begin[numbers]
        stops = np.cumsum(lengths)
        total = int(stops[-1]) if len(stops) else 0
        ids = self.flat[np.repeat(self.begin[numbers] - (stops - lengths), lengths) + np.arange(total)]
        return ids, np.bincount(rows, lengths, minlength=n).astype(np.int64)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the stretches without white space, cut between an ASCII letter and another ASCII mark than an apostrophe."""
    inside = ~IS_SPACE[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = (inside[1:] != inside[:-1]) | (kind[1:] + kind[:-1] == _LETTER + _MARK) & (kind[1:] != 0) & (kind[:-1] != 0)
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    kept = inside[starts]
    starts, ends = starts[kept], ends[kept]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


_LOADED: dict[str, Ids] = {}


def _cut(path: str, max_len: int, end: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = Ids(path)
        part = TaskContext.get().partitionId()
        used = np.zeros(max_len + 1, np.int64)
        for batch in batches:
            docs = batch.column(0)
            for i, j, data, offsets in text_rows(batch, "text"):
                ids, counts = _LOADED[path].of_texts(data, offsets)
                n = j - i
                whole = np.empty(len(ids) + n, np.int32)
                whole[np.arange(len(ids)) + np.repeat(np.arange(n), counts)] = ids
                sizes = counts + 1
                whole[np.cumsum(sizes) - 1] = end
                pieces = -(-sizes // max_len)
                row = np.repeat(np.arange(n), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                lengths = np.minimum(max_len, sizes[row] - piece * max_len)
                stops = np.cumsum(lengths)
                raw = memoryview(whole.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (b - a) : 4 * b]) for a, b in zip(lengths.tolist(), stops.tolist(), strict=True)]
                order = np.argsort(lengths, kind="stable")
                first = np.searchsorted(lengths[order], lengths[order])
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(row)) - first
                nth += used[lengths]
                used += np.bincount(lengths, minlength=max_len + 1)
                yield pa.RecordBatch.from_arrays([
                    docs.slice(i, n).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * max_len, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64()),
                    pa.array(np.full(len(row), part), pa.int32()), pa.array(nth), pa.ListArray.from_arrays(pa.array(np.append(0, stops), pa.int32()), pa.array(whole)),
                ], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"])

    return task


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of which lengths fill `room` best: a bounded subset sum whose reachable sums are the bits of an integer."""
    reach, steps, most = 1, [], (1 << room + 1) - 1
    for length in sorted((c for c in counts if c <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & most
            left, take = left - take, take * 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + take
            total -= length * take
    return out


def minimum_slack(counts: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[dict[int, int], int]]:
    """[(pieces of each length in a bin, number of such bins)]; the lengths of a bin descend."""
    left, plan = {c: n for c, n in counts.items() if n}, []
    while left:
        largest = max(left)
        left[largest] -= 1
        bin_ = fullest({c: n for c, n in left.items() if n}, max_len - largest)
        left[largest] += 1
        bin_[largest] = bin_.get(largest, 0) + 1
        times = min(left[c] // n for c, n in bin_.items())
        for c, n in bin_.items():
            left[c] -= n * times
            if not left[c]:
                del left[c]
        plan.append((dict(sorted(bin_.items(), reverse=True)), times))
    return plan


def _place(plan: list[tuple[dict[int, int], int]]) -> Callable:
    """A task that finds (sequence_id, offset) of the k-th piece of a length."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for bin_, times in plan:
        offset = 0
        for length, n in bin_.items():
            rows.append((length, used.get(length, 0), n, base, offset))
            used[length] = used.get(length, 0) + n * times
            offset += length * n
        base += times
    length, first, per_bin, base, offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    key = length << 48 | first

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, k = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "k"))
            row = np.searchsorted(key, size << 48 | k, "right") - 1
            at = k - first[row]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(base[row] + at // per_bin[row]), pa.array(offset[row] + at % per_bin[row] * size)], [*batch.schema.names[:-1], "sequence_id", "offset"]
            )

    return task


def pack(docs: DataFrame, tokenizer: str, max_len: int = MAX_LEN, end: int = END) -> Packed:
    """Pieces of all of (doc_id, text), each at a place of a sequence."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = staged(map_arrow(texts, _cut(tokenizer, max_len, end), SCHEMA), "pieces")
    per_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    before = staged(per_part.select("part", "length", "n", earlier.alias("before")), "lengths")
    counts = {r.length: r.n for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # max_len rows at most
    plan = minimum_slack(counts, max_len)
    known = pieces.drop("ids").join(before.drop("n"), ["part", "length"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
    placed = map_arrow(known.select(*names, (F.col("nth") + F.col("before")).alias("k")), _place(plan), SCHEMA.replace(", ids array<int>", ", sequence_id long, offset long"))
    return Packed(pieces, placed)


def sequences(packed: Packed) -> DataFrame:
    """(sequence_id, n_tokens, doc_ids, ids): the ids of each sequence, no more than `max_len`."""
    met = packed.places.select("sequence_id", "offset", "doc_id", "part", "length", "nth").join(packed.pieces.select("part", "length", "nth", "ids"), ["part", "length", "nth"])
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    out = met.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), inside.alias("inside"))
    return out.select("sequence_id", "n_tokens", F.col("inside.doc_id").alias("doc_ids"), F.flatten("inside.ids").alias("ids"))
