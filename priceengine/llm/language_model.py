"""Operator 10: a hierarchical Pitman-Yor language model.

A word is drawn from the Pitman-Yor restaurant of the word before it (the first word of a text: of the end token). Every
preceding word has a restaurant of its own; all of them share one parent, the unigram restaurant, whose base is a
spelling model: a hierarchy of Pitman-Yor restaurants over bytes, one for each context of up to PAST byte classes,
where a context's parent is the context without its oldest class and the root's base is uniform. Tables of a
restaurant are customers of its parent, all the way down.

Seating is sampled by Gibbs sweeps that take all customers of one (restaurant, dish) out and seat them again, one
after the other, by the Chinese-restaurant probabilities given everyone else (in blocks, with a normal draw, from the
64th customer on). In one sweep the dishes are seated side by side: what they see of the others is the state before the
sweep. As a customer is seated without regard to those who still come, this is near the conditional of the number of tables
but not the same (3 customers, base 0.5, 3 other tables, strength 10, discount 0.5: more than one table with 0.7725 in place
of 0.7700). SAMPLES chains with random numbers of their own make SWEEPS sweeps each, and the predictive probabilities of
their last states are averaged. A word pair that occurs once has one table in every state, so only the others are seated.

Where it runs: documents are cut once into chunks, runs of texts as numbers of words. Pairs and words are dealt out by hash to
blocks of some BLOCK tokens each; what a block holds or tells another travels as packed columns, a row for each two blocks. In a sweep the blocks
of words add up the tables that blocks of pairs tell them, seat the words and tell back; then the pairs are seated. To score, a chunk asks for its
different pairs and words; a chunk that the model is made from asks for its pairs as they are counted. Nothing of these passes the driver but sums. Pairs are dealt out by the hash of both words, so those
of a frequent word are spread over all blocks. Byte contexts have CLASSES classes, so the spelling model has a bounded number of cells at any
corpus size; those that occur come to the driver, in sorted arrays. Words and pairs are told apart by hashes of 64 bits.

Cases: null and empty texts are the end token alone. Unseen words are spelt; after an unseen word the unigram restaurant
speaks. A text without any white space is one word, whose probability is kept as a logarithm. Repeated rows count and are
scored each for itself; null doc_ids too. Without training documents the counts are zero and every word is spelt
by the uniform base. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceengine.llm.kernels import FOLD, mix, pieces, prefix_hash, slices, span_hash, text_rows, token_hashes, utf8
from priceengine.llm.staging import map_arrow, release, shuffles_dropped, staged

SAMPLES, BURN_IN, SWEEPS, THETA = 3, 4, 4, 10.0
#: Tokens of a chunk of documents, at which the next begins; training tokens for each block of words and pairs; parts in which pairs are looked up.
TOP, BLOCK, PASSES = 2_000_000, 2_000_000, 2
END = 0x20
CLASSES, LEVELS = 72, 4
PAST = LEVELS - 1
#: Byte classes of contexts: letters each, then white space (a word's edge), digits, other ASCII, kinds of lead bytes, and pairs of continuation bytes.
CLASS = np.full(256, 28, np.int64)
CLASS[97:123] = np.arange(26)
CLASS[65:91] = np.arange(26)
CLASS[[0x20, *range(0x09, 0x0E)]] = 26
CLASS[48:58] = 27
CLASS[0xC0:0xE0] = 29
CLASS[0xC3] = 30
CLASS[0xE0:] = 31
CLASS[0x80:0xC0] = 32 + np.arange(64) // 2
END_HASH = np.uint64(0x5851F42D4C957F2D)


def uniforms(keys: np.ndarray, step: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on key and step only."""
    return ((mix(keys + np.uint64((step * 0x9E3779B97F4A7C15) & (2**64 - 1))) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def seat(customers: np.ndarray, base: np.ndarray, others: np.ndarray, d: float, theta: float, keys: np.ndarray) -> np.ndarray:
    """Tables of each dish: its customers sit down one after the other; `others`: tables of the restaurant's other dishes."""
    tables = np.ones(len(customers), np.int64)
    live = np.flatnonzero(customers > 1)
    sat, step = 1, 0
    while len(live):
        block = max(1, sat // 16) if sat >= 64 else 1
        new = (theta + d * (others[live] + tables[live])) * base[live]
        p = new / (new + sat - d * tables[live])
        n = np.minimum(block, customers[live] - sat)
        u = uniforms(keys[live], step)
        if block == 1:
            tables[live] += u < p
        else:
            z = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * uniforms(keys[live], step + 1))
            tables[live] += np.clip(np.rint(n * p + z * np.sqrt(n * p * (1 - p))), 0, n).astype(np.int64)
        sat, step = sat + block, step + 2
        live = live[customers[live] > sat]
    return tables


def discount(ones: float, twos: float) -> float:
    return float(np.clip(ones / (ones + 2 * twos), 0.05, 0.95)) if ones else 0.5


@dataclass
class Level:
    """The restaurants of one length of context: their keys in order, and by sample what goes on to the shorter context; the cells that occur (context * 256 + byte) in order, and their probabilities by sample."""

    contexts: np.ndarray
    back: np.ndarray
    cells: np.ndarray
    p: np.ndarray


@dataclass
class Spelling:
    """The levels of the byte restaurants, no context first. Only cells and contexts that occur are held."""

    levels: list[Level]
    samples: int

    def logs(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Samples by symbols: natural logs of the probabilities of bytes behind contexts of PAST classes."""
        out, mass = np.zeros((self.samples, len(context))), np.ones((self.samples, len(context)))
        open_ = np.arange(len(context))
        for n in range(len(self.levels) - 1, -1, -1):
            level, here = self.levels[n], context[open_] % CLASSES**n
            at, met = _found(level.cells, here * 256 + symbol[open_])
            out[:, open_[met]] = mass[:, open_[met]] * level.p[:, at[met]]
            open_, here = open_[~met], here[~met]
            at, met = _found(level.contexts, here)
            mass[:, open_[met]] *= level.back[:, at[met]]
        out[:, open_] = mass[:, open_] / 256
        return np.log(out)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among sorted keys, whether it is there)."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def fit_spelling(context: np.ndarray, symbol: np.ndarray, count: np.ndarray, samples: int, seed: int) -> Spelling:
    """Gibbs sweeps over the byte restaurants; level n has contexts of n classes. A cell's parent is a cell of the level below, as each table is a customer there."""
    cells, up = [None] * LEVELS, [None] * LEVELS
    order = np.argsort(context * 256 + symbol)
    cells[-1] = (context * 256 + symbol)[order]
    for n in range(LEVELS - 2, -1, -1):
        cells[n], up[n + 1] = np.unique(cells[n + 1] // 256 % CLASSES**n * 256 + cells[n + 1] % 256, return_inverse=True)
    found = [np.unique(c // 256, return_inverse=True) for c in cells]
    there, ctx = [f[0] for f in found], [f[1] for f in found]
    customers, tables = [None] * LEVELS, [np.ones(len(c), np.int64) for c in cells]
    customers[-1] = count[order].astype(np.int64)
    for n in range(LEVELS - 1, 0, -1):
        customers[n - 1] = np.bincount(up[n], tables[n], len(cells[n - 1])).astype(np.int64)
    d = [discount(float((c == 1).sum()), float((c == 2).sum())) for c in customers]

    def level(n: int, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(what each context passes on, the probability of each cell), from the probabilities of the cells' parents."""
        total, seats = np.bincount(ctx[n], customers[n], len(there[n])), np.bincount(ctx[n], tables[n], len(there[n]))
        back = (THETA + d[n] * seats) / (THETA + total)
        return back, (customers[n] - d[n] * tables[n]) / (THETA + total[ctx[n]]) + back[ctx[n]] * parent

    def parents(n: int) -> np.ndarray:
        below = np.full(len(cells[0]), 1 / 256)
        for m in range(n):
            below = level(m, below)[1][up[m + 1]]
        return below

    kept: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for sweep in range(BURN_IN + samples):
        for n in range(LEVELS - 1, -1, -1):
            others = np.bincount(ctx[n], tables[n], len(there[n]))[ctx[n]] - tables[n]
            keys = mix(cells[n].astype(np.uint64) + np.uint64((seed * 1000 + sweep * 10 + n) << 40))
            tables[n] = seat(customers[n], parents(n), others, d[n], THETA, keys)
            if n:
                customers[n - 1] = np.bincount(up[n], tables[n], len(cells[n - 1])).astype(np.int64)
        if sweep >= BURN_IN:
            kept.append([level(n, parents(n)) for n in range(LEVELS)])
    return Spelling([Level(there[n], np.stack([k[n][0] for k in kept]).astype(np.float32), cells[n], np.stack([k[n][1] for k in kept]).astype(np.float32)) for n in range(LEVELS)], samples)


def spelt(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, symbol, first symbol of each word): every byte of each word and its end, with the PAST classes before it."""
    lengths = ends - starts + PAST + 1
    first = np.cumsum(lengths) - lengths
    text = np.full(int(lengths.sum()), END, np.uint8)
    word = np.repeat(np.arange(len(starts)), ends - starts)
    offset = np.arange(len(word)) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts)
    text[first[word] + PAST + offset] = data[starts[word] + offset]
    kind = CLASS[text]
    context = np.zeros(len(text), np.int64)
    for k in range(PAST):
        context[PAST:] += CLASSES**k * kind[PAST - 1 - k : len(kind) - 1 - k]
    keep = np.ones(len(text), bool)
    for k in range(PAST):
        keep[first + k] = False
    return context[keep], text[keep].astype(np.int64), first - PAST * np.arange(len(starts))


def spell_logs(model: Spelling, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Samples by words: natural logs of the words' probabilities."""
    if not len(starts):
        return np.zeros((model.samples, 0))
    context, symbol, first = spelt(data, starts, ends)
    cells, which = numbered(context * 256 + symbol)
    logs = model.logs(cells // 256, cells % 256)
    return np.stack([np.add.reduceat(x[which], first) for x in logs])


def token_pairs(batch: pa.RecordBatch, limit: int) -> Iterator[tuple]:
    """(first row, end row, bytes, start, end, row, hash, hash of the token before) of the tokens, each text's end token behind its words."""
    for i, j, data, off in text_rows(batch, "text", limit):
        starts, ends, rows, hashed = token_hashes(data, off)
        place = np.searchsorted(rows, np.arange(j - i), "right")
        starts, ends = np.insert(starts, place, 0), np.insert(ends, place, 0)
        rows, hashed = np.insert(rows, place, np.arange(j - i)), np.insert(hashed, place, END_HASH)
        # the end token of the text before stands before a first word
        yield i, j, data, starts, ends, rows, hashed, np.append(END_HASH, hashed[:-1])


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(before) + word)


def pack(values: np.ndarray) -> bytes:
    """64-bit numbers by planes of bytes, without the upper planes that are zero; what is alike stands together for the compression of shuffles and files."""
    v = np.ascontiguousarray(values).view(np.uint64)
    k = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    planes, each = np.empty((k, len(v)), np.uint8), v.view(np.uint8).reshape(-1, 8)
    for p in range(k):
        planes[p] = each[:, p]
    return b"".join((bytes([k]), planes))


def unpack(packed: bytes) -> np.ndarray:
    k = packed[0]
    n = (len(packed) - 1) // k
    out = np.zeros((n, 8), np.uint8)
    for p, plane in enumerate(np.frombuffer(packed, np.uint8, offset=1).reshape(k, n)):
        out[:, p] = plane
    return out.reshape(-1).view(np.int64)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed).view(np.uint64), dtype=np.uint64)


def pack_each(values: np.ndarray) -> list[bytes]:
    """Samples by rows of whole numbers, one part a sample."""
    return [pack(v.astype(np.int64)) for v in values]


def unpack_each(packed: list[bytes]) -> np.ndarray:
    return np.stack([unpack(x) for x in packed])


def floats(packed: bytes, kind: type = np.float32) -> np.ndarray:
    return np.frombuffer(packed, kind).reshape(SAMPLES, -1)


#: A stretch of a table as columns of numbers: block or chunk that it goes to, what it is, where it is from, sums over it, its packed columns.
ROWS = "to long, kind string, at long, sums array<double>, parts array<binary>"


def as_rows(rows: Iterator[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["to", "kind", "at", "sums", "parts"])


def each_row(rows: DataFrame, task: Callable[[int, str, list[bytes]], Iterator[tuple]]) -> DataFrame:
    """What `task` makes of (to, kind, parts), row by row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                yield as_rows(task(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].as_py()))

    return map_arrow(rows.select("to", "kind", "parts"), run, ROWS)


def each_block(rows: DataFrame, task: Callable[[int, dict], Iterator[tuple]]) -> DataFrame:
    """What `task` makes of all rows that go to one block: by kind, the list of (at, parts)."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([as_rows(task(key[0].as_py(), by_kind(table)))])

    return rows.groupBy("to").applyInArrow(run, ROWS)


def by_kind(table: pa.Table) -> dict[str, list[tuple[int, list[bytes]]]]:
    found = defaultdict(list)
    for kind, at, parts in zip(*(table.column(c).to_pylist() for c in ("kind", "at", "parts")), strict=True):
        found[kind].append((at, parts))
    return found


def by_places(to: np.ndarray, blocks: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order by block, else as before, and (block, begin, end) of the blocks that occur."""
    to = to.astype(np.uint16 if blocks <= 1 << 16 else np.int64)  # short numbers are sorted by radix
    order = np.argsort(to, kind="stable")
    n = np.bincount(to, minlength=blocks)
    ends = np.cumsum(n)
    return order, [(k, int(ends[k] - n[k]), int(ends[k])) for k in np.flatnonzero(n).tolist()]


def in_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of numbers from zero on. Their upper bits are sorted with their places as the lower ones, which takes a fifth of an argsort; keys that differ in lower bits alone are set right after."""
    keys, bits = keys.view(np.uint64), np.uint64(len(keys).bit_length())
    over = np.uint64(max(0, int(keys.max()).bit_length() + int(bits) - 64)) if len(keys) else np.uint64(0)
    placed = keys >> over << bits | np.arange(len(keys), dtype=np.uint64)
    placed.sort()
    order = (placed & ((np.uint64(1) << bits) - np.uint64(1))).view(np.int64)
    found = keys[order] if over else placed
    wrong = np.flatnonzero(found[1:] < found[:-1])
    if len(wrong) > 64:
        return np.argsort(keys, kind="stable")
    for upper in np.unique(found[wrong] >> over):
        i, j = np.searchsorted(found >> over, upper), np.searchsorted(found >> over, upper, "right")
        order[i:j] = order[i:j][np.argsort(found[i:j], kind="stable")]
    return order


def dealt(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order by block and key, and (block, begin, end) of the blocks that occur."""
    order = in_order(keys)
    by, there = by_places(keys[order] % np.uint64(blocks), blocks)
    return order[by], there


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the keys, where in it each different key begins)."""
    order = in_order(keys)
    found = keys[order]
    return order, np.flatnonzero(np.append(True, found[1:] != found[:-1])[: len(found)])


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the different values in order, the place of each value among them)."""
    order, begin = runs(values)
    which = np.empty(len(values), np.int64)
    which[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(values))))
    return values[order[begin]], which


def used(size: int, *places: np.ndarray) -> tuple[np.ndarray, ...]:
    """Which of `size` things the places name, and the places among those."""
    there = np.zeros(size, bool)
    for p in places:
        there[p] = True
    at = np.cumsum(there) - 1
    return np.flatnonzero(there), *(at[p] for p in places)


def chunked(docs: DataFrame, id_col: str, train: Column) -> DataFrame:
    """Runs of documents as numbers of words: ids, which are null, tokens of each, words in order, the words: lengths and bytes (`word_hashes` has their hashes), and which are for training; sums: tokens of all."""
    limit = TOP

    def chunk(number: int, held: list[tuple]) -> pa.RecordBatch:
        ids, trains, tokens, kinds, spelt, which = zip(*held, strict=True)
        hashes, first, at = np.unique(np.concatenate(kinds), return_index=True, return_inverse=True)
        before = np.cumsum([0, *map(len, kinds)])
        words = np.concatenate([at[w + b] for w, b in zip(which, before, strict=False)])
        order = np.argsort(-np.bincount(words, minlength=len(hashes)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        data, off = utf8(pa.concat_arrays(spelt).take(pa.array(first[order])))
        ids = pa.concat_arrays(ids)
        nulls = np.asarray(ids.is_null()).astype(np.uint8).tobytes()
        tokens, trains = np.concatenate(tokens), np.concatenate(trains)
        parts = [np.asarray(ids.fill_null(0)).tobytes(), nulls, pack(tokens), pack(rank[words]), pack(np.diff(off)), data.tobytes(), trains.tobytes()]
        return as_rows([(number, "chunk", number, [float(tokens.sum())], parts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for i, j, data, starts, ends, rows, hashed, _ in token_pairs(batch, min(4 << 20, limit)):
                order, begin = runs(hashed)
                first, which = order[begin], np.empty(len(hashed), np.int64)
                which[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(hashed))))
                kinds, trains = hashed[first], np.asarray(batch.column(1).slice(i, j - i)).astype(bool)
                held.append((batch.column(0).slice(i, j - i), trains, np.bincount(rows, minlength=j - i), kinds, slices(FOLD[data], starts[first], ends[first]), which))
                n += len(hashed)
                if n >= limit:
                    yield chunk(number, held)
                    number, held, n = number + 1, [], 0
        if held:
            yield chunk(number, held)

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc"), train.cast("int").alias("train"), "text"), run, ROWS)


def chunk_pairs(hashes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, a number for each token of the word before it and the word: place of the one times all hashes and place of the other)."""
    order = in_order(hashes)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    hashes, words = hashes[order], place[words]
    # the end token of the text before stands before a first word
    return hashes, np.append(np.searchsorted(hashes, END_HASH), words[:-1])[: len(words)] * len(hashes) + words


def for_training(parts: list[bytes]) -> np.ndarray:
    return unpack(parts[3])[np.repeat(np.frombuffer(parts[6], bool), unpack(parts[2]))]


def word_hashes(parts: list[bytes]) -> np.ndarray:
    """Hashes of a chunk's words, made anew from their bytes: stored, they would be a quarter of the chunk, as nothing compresses them."""
    lengths = unpack(parts[4])
    found = [span_hash(prefix_hash(data), off[:-1], off[1:]) for _, _, data, off in pieces(np.frombuffer(parts[5], np.uint8), np.append(0, np.cumsum(lengths)))]
    return np.where(lengths, np.concatenate([np.zeros(0, np.uint64), *found]), END_HASH)


def count_words(chunks: DataFrame, blocks: int) -> DataFrame:
    """The vocabulary with counts and the end token, whose token is empty, by block: hashes, counts, lengths, bytes."""
    def ask(_: int, __: str, parts: list[bytes]) -> Iterator[tuple]:
        words, hashes, lengths, data = for_training(parts), word_hashes(parts), unpack(parts[4]), np.frombuffer(parts[5], np.uint8)
        n, ends = np.bincount(words, minlength=len(hashes)), np.cumsum(lengths)
        seen = np.flatnonzero(n)
        order, there = dealt(hashes[seen], blocks)
        for to, i, j in there:
            of = seen[order[i:j]]
            yield to, "words", 0, None, [pack_sorted(hashes[of]), pack(n[of]), pack(lengths[of]), slices(data, ends[of] - lengths[of], ends[of]).buffers()[2].to_pybytes()]

    def merge(to: int, found: dict) -> Iterator[tuple]:
        parts = [p for _, p in found["words"]]
        hashes = np.concatenate([unpack_sorted(p[0]) for p in parts])
        order, begin = runs(hashes)
        first, n = order[begin], np.add.reduceat(np.concatenate([unpack(p[1]) for p in parts])[order], begin)
        hashes = hashes[first]
        lengths, data = np.concatenate([unpack(p[2]) for p in parts]), np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
        ends = np.cumsum(lengths)
        token = slices(data, (ends - lengths)[first], ends[first])
        yield to, "words", to, None, [pack_sorted(hashes), pack(n), pack(lengths[first]), token.buffers()[2].to_pybytes()]

    return each_block(each_row(chunks, ask), merge)


def count_pairs(chunks: DataFrame, blocks: int, asked: bool) -> DataFrame:
    """How often word w stands behind word u in training, by block, in the order of u: the words, places of u and w among them, counts; sums: pairs seen once and twice.

    asked: with what `tell_pairs` tells the chunks later, as rows of their own: by key, counts of all pairs that stand in a chunk, the chunks, places of the pairs of each.
    """
    def ask(chunk: int, _: str, parts: list[bytes]) -> Iterator[tuple]:
        hashes, code = chunk_pairs(word_hashes(parts), unpack(parts[3]))
        code = code * 2 + np.repeat(np.frombuffer(parts[6], np.uint8), unpack(parts[2]))
        code.sort()
        begin = np.flatnonzero(np.diff(code >> 1, prepend=-1))
        n, code = np.add.reduceat(code & 1, begin), code[begin] >> 1
        if not asked:
            n, code = n[n > 0], code[n > 0]
        u, w = code // len(hashes), code % len(hashes)
        order, there = by_places(pair_keys(hashes[u], hashes[w]) % np.uint64(blocks), blocks)
        for to, i, j in there:
            of = order[i:j]
            nodes, ui, wi = used(len(hashes), u[of], w[of])
            yield to, "pairs", chunk, None, packed_pairs(hashes[nodes], ui, wi, n[of])

    def merge(to: int, found: dict) -> Iterator[tuple]:
        u, w, n = (list(x) for x in zip(*(pair_columns(p) for _, p in found["pairs"]), strict=True))
        ends = np.cumsum([len(x) for x in n])[:-1]
        u, w, n = (np.concatenate(x) for x in (u, w, n))
        order, begin = runs(pair_keys(u, w))
        total = np.add.reduceat(n[order], begin)
        if asked:
            which = np.empty(len(n), np.int64)
            which[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(n))))
            places = [pack_sorted(np.sort(x).view(np.uint64)) for x in np.split(which, ends)]
            yield to, "asked", to, None, [pack(total), pack(np.array([at for at, _ in found["pairs"]])), *places]
        first, n = order[begin[total > 0]], total[total > 0]
        u, w = u[first], w[first]
        order = in_order(u)
        n = n[order]
        nodes, which = numbered(np.concatenate([u[order], w[order]]))
        yield to, "pairs", to, [float((n == 1).sum()), float((n == 2).sum())], packed_pairs(nodes, which[: len(n)], which[len(n) :], n)

    return each_block(each_row(chunks, ask), merge)


def packed_pairs(nodes: np.ndarray, u: np.ndarray, w: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Pairs in the order of u."""
    return [pack_sorted(nodes), pack(np.diff(u, prepend=0)), pack(w), pack(n)]


def pair_places(parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(words, places of u and w among them, counts)."""
    return unpack_sorted(parts[0]), np.cumsum(unpack(parts[1])), unpack(parts[2]), unpack(parts[3])


def pair_columns(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, w, counts)."""
    nodes, u, w, c = pair_places(parts)
    return nodes[u], nodes[w], c


def with_kinds(words: DataFrame, pairs: DataFrame, blocks: int) -> DataFrame:
    """`words` with the pairs that end in each word, those of them seen once, and those seen once that begin with it; sums over all words."""
    def tell(at: int, _: str, parts: list[bytes]) -> Iterator[tuple]:
        nodes, before, behind, c = pair_places(parts)
        counts = [np.bincount(behind, minlength=len(nodes)), np.bincount(behind[c == 1], minlength=len(nodes)), np.bincount(before[c == 1], minlength=len(nodes))]
        order, there = dealt(nodes, blocks)
        for to, i, j in there:
            yield to, "kinds", at, None, [pack_sorted(nodes[order[i:j]]), *[pack(x[order[i:j]].astype(np.int64)) for x in counts]]

    def add(to: int, found: dict) -> Iterator[tuple]:
        parts = found["words"][0][1]
        hashes, c = unpack_sorted(parts[0]), unpack(parts[1])
        counts = np.zeros((3, len(hashes)), np.int64)
        for _, p in found["kinds"]:
            counts[:, np.searchsorted(hashes, unpack_sorted(p[0]))] += np.stack([unpack(x) for x in p[1:]])
        kinds = counts[0]
        yield to, "words", to, [float(x) for x in (c.sum(), len(c), kinds.sum(), (kinds == 1).sum(), (kinds == 2).sum())], [*parts, *map(pack, counts)]

    return each_block(words.unionByName(each_row(pairs, tell)), add)


def sums_of(rows: DataFrame, n: int) -> np.ndarray:
    """The n sums over all rows."""
    return np.array([float(x or 0) for x in rows.agg(*[F.sum(F.col("sums")[k]) for k in range(n)]).first()])


def word_bytes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end) of the words of a block."""
    lengths = unpack(parts[2])
    ends = np.cumsum(lengths)
    return np.frombuffer(parts[3], np.uint8), ends - lengths, ends


def spelling_counts(words: DataFrame, blocks: int, tables: Callable[[list[bytes]], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, symbol, customers) of the words, each with its `tables`: the cells that occur, of at most CLASSES ** PAST * 256."""
    def ask(_: int, __: str, parts: list[bytes]) -> Iterator[tuple]:
        data, starts, ends = word_bytes(parts)
        context, symbol, first = spelt(data, starts, ends)
        weight = np.repeat(tables(parts), np.diff(np.append(first, len(context))))
        cells, which = numbered(context * 256 + symbol)
        n, cells = np.bincount(which, weight, len(cells)).astype(np.int64), cells.view(np.uint64)
        order, there = dealt(cells, blocks)
        for to, i, j in there:
            yield to, "cells", 0, None, [pack_sorted(cells[order[i:j]]), pack(n[order[i:j]])]

    def merge(to: int, found: dict) -> Iterator[tuple]:
        cells, which = np.unique(np.concatenate([unpack_sorted(p[0]) for _, p in found["cells"]]), return_inverse=True)
        yield to, "cells", to, None, [pack_sorted(cells), pack(np.bincount(which, np.concatenate([unpack(p[1]) for _, p in found["cells"]])).astype(np.int64))]

    found = [r.parts for r in each_block(each_row(words, ask), merge).select("parts").collect()]
    cells = np.concatenate([np.zeros(0, np.int64), *[unpack_sorted(p[0]).view(np.int64) for p in found]])
    n = np.concatenate([np.zeros(0, np.int64), *[unpack(p[1]) for p in found]])
    order = np.argsort(cells)
    return cells[order] // 256, cells[order] % 256, n[order]


@dataclass
class Root:
    """The unigram restaurant: customers and tables by sample, and the discount."""

    customers: np.ndarray
    tables: np.ndarray
    d: float

    def back(self) -> np.ndarray:
        """The mass that goes to the spelling."""
        return (THETA + self.d * self.tables) / (THETA + self.customers)

    def p(self, m: np.ndarray, t: np.ndarray, spelt: np.ndarray) -> np.ndarray:
        """Probabilities of words from customers, tables and spelling, samples by words."""
        mass = (THETA + self.d * self.tables)[:, None]
        return (m - self.d * t + mass * spelt) / (THETA + self.customers)[:, None]


def seat_words(hashes: np.ndarray, m: np.ndarray, logs: np.ndarray, root: Root, seed: int) -> np.ndarray:
    """Tables in the unigram restaurant, samples by words; m: customers."""
    others = [np.full(len(hashes), max(x - 1.0, 0.0)) for x in root.tables]
    return np.stack([seat(m[s], np.exp(logs[s]), others[s], root.d, THETA, mix(hashes + np.uint64(seed + 1000 * s))) for s in range(SAMPLES)])


def first_seating(words: DataFrame, model: Spelling, root: Root, seed: int) -> DataFrame:
    """Words with one table for each pair: lengths and bytes, and tables in the first sample; sums: customers and tables by sample."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(to: int, _: str, parts: list[bytes]) -> Iterator[tuple]:
        hashes, kinds = unpack_sorted(parts[0]), unpack(parts[4])
        logs = np.broadcast_to(spell_logs(shared.value, *word_bytes(parts)), (SAMPLES, len(hashes)))
        m = np.broadcast_to(kinds, (SAMPLES, len(kinds)))
        t = seat_words(hashes, m, logs, root, seed)
        yield to, "words", to, [*m.sum(1).astype(float).tolist(), *t.sum(1).astype(float).tolist()], [b"", pack(t[0]), *parts[2:4]]

    return each_row(words, run)


def with_spelling(words: DataFrame, model: Spelling) -> DataFrame:
    """Words with counts, pairs seen once behind and before them, and the natural logs of their spelling by sample."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(to: int, _: str, parts: list[bytes]) -> Iterator[tuple]:
        yield to, "words", to, None, [*parts[:2], *parts[5:7], spell_logs(shared.value, *word_bytes(parts)).tobytes()]

    return each_row(words, run)


def told(to: int, nodes: np.ndarray, u: np.ndarray, w: np.ndarray, c: np.ndarray, t: np.ndarray, blocks: int) -> Iterator[tuple]:
    """Repeated pairs of a block, as places among its words, and their tables by sample, and what these words get told of them: tables behind and before each."""
    yield to, "many", to, None, [pack_sorted(nodes), pack(u), pack(w), pack(c), *pack_each(t)]
    tables = [np.bincount(of, x, len(nodes)).astype(np.int64) for of in (w, u) for x in t]
    order, there = by_places(nodes % np.uint64(blocks), blocks)
    for k, i, j in there:
        yield k, "tables", to, None, [pack_sorted(nodes[order[i:j]]), *[pack(x[order[i:j]]) for x in tables]]


def repeated(pairs: DataFrame, blocks: int) -> DataFrame:
    """The pairs seen more than once, in the order of their keys, with one table each."""
    def run(to: int, _: str, parts: list[bytes]) -> Iterator[tuple]:
        nodes, u, w, c = pair_places(parts)
        many = np.flatnonzero(c > 1)
        many = many[in_order(pair_keys(nodes[u[many]], nodes[w[many]]))]
        there, u, w = used(len(nodes), u[many], w[many])
        yield from told(to, nodes[there], u, w, c[many], np.ones((SAMPLES, len(many)), np.int64), blocks)

    return each_row(pairs, run)


def sweep_words(words: DataFrame, many: DataFrame, root: Root, seed: int, last: bool) -> DataFrame:
    """Words seated in the unigram restaurant under the tables of all pairs; what pairs see of them or, at the last, the words themselves. Sums: customers and tables."""
    def run(to: int, found: dict) -> Iterator[tuple]:
        hashes, c, once, once_before = (f(x) for f, x in zip((unpack_sorted, unpack, unpack, unpack), found["words"][0][1], strict=False))
        logs = floats(found["words"][0][1][4], np.float64)
        m, tables = np.repeat(once[None], SAMPLES, 0), np.repeat(once_before[None], SAMPLES, 0)
        asked = [(at, unpack_sorted(p[0])) for at, p in found["tables"]]
        for (_, h), (_, p) in zip(asked, found["tables"], strict=True):
            at, t = np.searchsorted(hashes, h), unpack_each(p[1:])
            m[:, at] += t[:SAMPLES]
            tables[:, at] += t[SAMPLES:]
        t = seat_words(hashes, m, logs, root, seed)
        yield to, "sums", to, [*m.sum(1).astype(float).tolist(), *t.sum(1).astype(float).tolist()], None
        if last:
            yield to, "words", to, None, [pack_sorted(hashes), pack(c), *pack_each(m), *pack_each(t), *pack_each(tables), np.exp(logs).astype(np.float32).tobytes()]
            return
        for block, h in asked:
            at = np.searchsorted(hashes, h)
            yield block, "words", to, None, [pack_sorted(h), *pack_each(m[:, at]), *pack_each(t[:, at]), *pack_each(tables[:, at]), logs[:, at].tobytes()]

    return each_block(words.unionByName(many.where("kind = 'tables'")), run)


def sweep_pairs(many: DataFrame, words: DataFrame, root: Root, d: float, seed: int, blocks: int) -> DataFrame:
    """Repeated pairs seated under what they see of their words."""
    def run(to: int, found: dict) -> Iterator[tuple]:
        parts = found["many"][0][1]
        nodes, u, w, c, t = unpack_sorted(parts[0]), unpack(parts[1]), unpack(parts[2]), unpack(parts[3]), unpack_each(parts[4:])
        seen = [p for _, p in found["words"]]
        if not len(nodes):
            return
        order = in_order(np.concatenate([unpack_sorted(p[0]) for p in seen]))  # all of the nodes have been told
        m, t0, tables = (np.concatenate([unpack_each(p[k : k + SAMPLES]) for p in seen], 1)[:, order] for k in range(1, 3 * SAMPLES + 1, SAMPLES))
        p1 = root.p(m, t0, np.exp(np.concatenate([floats(p[-1], np.float64) for p in seen], 1)[:, order]))
        keys = pair_keys(nodes[u], nodes[w])
        new = [seat(c, p1[s, w], (tables[s, u] - t[s]).astype(float), d, THETA, mix(keys + np.uint64(seed + 1000 * s))) for s in range(SAMPLES)]
        yield from told(to, nodes, u, w, c, np.stack(new), blocks)

    return each_block(many.where("kind = 'many'").unionByName(words.where("kind = 'words'")), run)


@dataclass
class Model:
    """seated: words by block, with counts, customers, tables and spelling in the unigram restaurant, and the tables of their own; scored: pairs by block, or what chunks have asked of them;
    restaurants: tables of the pairs seen more than once, in the order of their keys. d: discount of the pairs.
    """

    seated: DataFrame
    scored: DataFrame
    restaurants: DataFrame
    spelling: Spelling
    tokens: int
    kinds: int
    root: Root
    d: float
    blocks: int

    @property
    def words(self) -> DataFrame:
        """(h, n, ln_p by sample, log_p: their mean alone) of the unigram restaurant."""
        flat = self._words()
        return flat.select("h", "n", F.transform("p", F.ln).alias("ln_p"), F.array(F.log10(_mean(lambda s: F.col("p")[s]))).alias("log_p"))

    @property
    def contexts(self) -> DataFrame:
        """(u, ln_back by sample)."""
        return self._words().select(F.col("h").alias("u"), F.transform("back", F.ln).alias("ln_back"))

    @property
    def pairs(self) -> DataFrame:
        """(u, w, n, log_p), n of w."""
        def run(_: tuple, table: pa.Table) -> pa.Table:
            u, w, c, t, _ = _pair_columns(by_kind(table))
            return pa.table([pa.array(u.view(np.int64)), pa.array(w.view(np.int64)), pa.array(c), _lists(t)], ["u", "w", "c", "t"])

        flat = self.scored.unionByName(self.restaurants).groupBy("to").applyInArrow(run, "u long, w long, c long, t array<long>")
        words, d = self._words(), self.d
        met = flat.join(words.select(F.col("h").alias("w"), "n", "p"), "w").join(words.select(F.col("h").alias("u"), F.col("n").alias("customers"), "back"), "u")
        p = _mean(lambda s: (F.col("c") - d * F.col("t")[s]) / (THETA + F.col("customers")) + F.col("back")[s] * F.col("p")[s])
        return met.select("u", "w", "n", F.log10(p).cast("float").alias("log_p"))

    def _words(self) -> DataFrame:
        root, d = self.root, self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for parts in batch.column(0).to_pylist():
                    h, n, p, back = _word_columns(root, d, parts)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), _lists(p), _lists(back)], ["h", "n", "p", "back"])

        return map_arrow(self.seated.where("kind = 'words'").select("parts"), run, "h long, n long, p array<double>, back array<double>")


def _mean(of: Callable[[int], Column]) -> Column:
    return sum((of(s) for s in range(1, SAMPLES)), of(0)) / float(SAMPLES)


def _lists(values: np.ndarray) -> pa.Array:
    """Samples by rows as a list column."""
    each, n = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * each + 1, each), pa.int32()), pa.array(np.ascontiguousarray(values.T).ravel()))


def _word_columns(root: Root, d: float, parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(hashes, n, probabilities in the unigram restaurant by sample, the mass that a word's own restaurant passes on to it)."""
    n = unpack(parts[1])
    m, t, tables = (unpack_each(parts[k : k + SAMPLES]) for k in range(2, 2 + 3 * SAMPLES, SAMPLES))
    return unpack_sorted(parts[0]), n, root.p(m, t, floats(parts[-1])), (THETA + d * tables) / (THETA + n)


def _pair_columns(found: dict) -> tuple[np.ndarray, ...]:
    """(u, w, count, tables by sample, key) of a block's pairs, in the order of their keys."""
    u, w, c = pair_columns(found["pairs"][0][1])
    keys = pair_keys(u, w)
    order = in_order(keys)
    c, t = c[order], np.ones((SAMPLES, len(c)), np.int64)
    for _, p in found["many"]:
        t[:, c > 1] = unpack_each(p)
    return u[order], w[order], c, t, keys[order]


def fit(train: DataFrame, seed: int = 5) -> Model:
    """The model of all texts of `train`."""
    with shuffles_dropped(train.sparkSession):
        chunks = staged(chunked(train.withColumn("__id", F.lit(0)), "__id", F.lit(True)), "chunks")
        model = _fit(chunks, seed, False)
        release(chunks)
    return model


def _fit(chunks: DataFrame, seed: int, asked: bool) -> Model:
    """asked: for `tell_pairs` to these chunks; the pairs themselves go."""
    blocks = 1 + int(sums_of(chunks, 1)[0]) // BLOCK
    counted = staged(count_words(chunks, blocks), "counted")
    scored = staged(count_pairs(chunks, blocks, asked), "scores")
    pairs = scored.where("kind = 'pairs'")
    words = staged(with_kinds(counted, pairs, blocks), "words")
    release(counted)
    said, seen = sums_of(words, 5), sums_of(pairs, 2)
    tokens, vocabulary, all_pairs = map(int, said[:3])
    d = discount(*seen)
    root = Root(np.full(SAMPLES, float(all_pairs)), np.full(SAMPLES, float(vocabulary)), discount(*said[3:]))

    # one table for each pair at first; the spelling is fitted again to the tables of the unigram restaurant
    plain = fit_spelling(*spelling_counts(words, blocks, lambda parts: np.ones(len(unpack(parts[1])), np.int64)), 1, seed)
    first = staged(first_seating(words, plain, root, seed), "first")
    sums = sums_of(first, 2 * SAMPLES)
    root = Root(sums[:SAMPLES], sums[SAMPLES:], root.d)
    spelling = fit_spelling(*spelling_counts(first, blocks, lambda parts: unpack(parts[1])), SAMPLES, seed + 1)
    spelt_words = staged(with_spelling(words, spelling), "spelt")
    release(words, first)

    many = staged(repeated(pairs, blocks), "many")
    if asked:
        pairs = staged(scored.where("kind = 'asked'"), "asked")
        release(scored)
    for sweep in range(SWEEPS + 1):
        seated = staged(sweep_words(spelt_words, many, root, seed + 7 + 10 * sweep, sweep == SWEEPS), "seated")
        sums = sums_of(seated, 2 * SAMPLES)
        root = Root(sums[:SAMPLES], sums[SAMPLES:], root.d)
        if sweep < SWEEPS:
            before, many = many, staged(sweep_pairs(many, seated, root, d, seed + 8 + 10 * sweep, blocks), "many")
            release(before, seated)
    release(spelt_words)
    restaurants = staged(each_row(many.where("kind = 'many'"), lambda to, kind, parts: iter([(to, kind, to, None, parts[4:])])), "restaurants")
    release(many)
    return Model(seated, pairs, restaurants, spelling, tokens, vocabulary, root, d, blocks)


def ask_words(chunks: DataFrame, model: Model) -> DataFrame:
    """For each chunk, what the model has of its words, in the order of block and hash: n (0: none), probabilities and tables of their own restaurants by sample."""
    root, d, blocks = model.root, model.d, model.blocks

    def ask(chunk: int, _: str, parts: list[bytes]) -> Iterator[tuple]:
        hashes = word_hashes(parts)
        order, there = dealt(hashes, blocks)
        for to, i, j in there:
            yield to, "ask", chunk, None, [pack_sorted(hashes[order[i:j]])]

    def answer(to: int, found: dict) -> Iterator[tuple]:
        hashes, n, p, tables = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((SAMPLES, 0)), np.zeros((SAMPLES, 0), np.int64)
        for _, parts in found["words"]:
            (hashes, n, p, _), tables = _word_columns(root, d, parts), unpack_each(parts[2 + 2 * SAMPLES : 2 + 3 * SAMPLES])
        for chunk, (asked,) in found["ask"]:
            at, met = _found(hashes, unpack_sorted(asked))
            at = at[met]
            count = np.zeros(len(met), np.int64)
            count[met] = n[at]
            yield chunk, "words", to, None, [pack(count), p[:, at].astype(np.float32).tobytes(), *pack_each(tables[:, at])]

    return each_block(model.seated.where("kind = 'words'").unionByName(each_row(chunks, ask)), answer)


def ask_pairs(chunks: DataFrame, model: Model, part: int) -> DataFrame:
    """For each chunk, what the model has of its pairs in the blocks of one of PASSES parts, in the order of block and key: count (0: none), and tables of those seen more than once."""
    blocks = model.blocks

    def ask(chunk: int, _: str, parts: list[bytes]) -> Iterator[tuple]:
        hashes, code = chunk_pairs(word_hashes(parts), unpack(parts[3]))
        code = np.sort(code)
        code = code[np.diff(code, prepend=-1) > 0]
        keys = pair_keys(hashes[code // len(hashes)], hashes[code % len(hashes)])
        keys = keys[keys % np.uint64(blocks) % np.uint64(PASSES) == part]
        order, there = dealt(keys, blocks)
        for to, i, j in there:
            yield to, "ask", chunk, None, [pack_sorted(keys[order[i:j]])]

    def keyed(to: int, kind: str, parts: list[bytes]) -> Iterator[tuple]:
        u, w, c = pair_columns(parts)
        keys = pair_keys(u, w)
        order = in_order(keys)
        yield to, kind, to, None, [pack_sorted(keys[order]), pack(c[order])]

    def answer(to: int, found: dict) -> Iterator[tuple]:
        keys, c, t = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((SAMPLES, 0), np.int64)
        for _, p in found["pairs"]:
            keys, c = unpack_sorted(p[0]), unpack(p[1])
        for _, p in found["many"]:
            t = unpack_each(p)
        place = np.cumsum(c > 1) - 1
        for chunk, (asked,) in found["ask"]:
            at, met = _found(keys, unpack_sorted(asked))
            n = np.zeros(len(met), np.int64)
            n[met] = c[at[met]]
            yield chunk, "pairs", to, None, [pack(n), *pack_each(t[:, place[at[n > 1]]])]

    here = F.col("to") % PASSES == part
    return each_block(each_row(model.scored.where(here), keyed).unionByName(model.restaurants.where(here)).unionByName(each_row(chunks, ask)), answer)


def tell_pairs(model: Model) -> DataFrame:
    """What `ask_pairs` has, for the chunks that the model is made from: they asked when pairs were counted, so that no keys are dealt out again."""
    def tell(to: int, found: dict) -> Iterator[tuple]:
        t = np.zeros((SAMPLES, 0), np.int64)
        for _, p in found["many"]:
            t = unpack_each(p)
        for _, parts in found["asked"]:
            c = unpack(parts[0])
            place = np.cumsum(c > 1) - 1
            for chunk, places in zip(unpack(parts[1]).tolist(), parts[2:], strict=True):
                at = unpack_sorted(places).view(np.int64)
                n = c[at]
                yield chunk, "pairs", to, None, [pack(n), *pack_each(t[:, place[at[n > 1]]])]

    return each_block(model.scored.unionByName(model.restaurants), tell)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row. All that is asked of the model's tables is staged when this returns."""
    with shuffles_dropped(docs.sparkSession):
        chunks = staged(chunked(docs, id_col, F.lit(True)), "chunks")
        return _score(chunks, model, [staged(ask_pairs(chunks, model, part), "answers") for part in range(min(PASSES, model.blocks))], id_col)


def fit_and_score(docs: DataFrame, train: Column, id_col: str = "doc_id", seed: int = 5) -> DataFrame:
    """`score` of all rows under `fit` of those where `train` holds, with texts cut into words once; the model's tables go once used up."""
    with shuffles_dropped(docs.sparkSession):
        chunks = staged(chunked(docs, id_col, train), "chunks")
        model = _fit(chunks, seed, True)
        scored = _score(chunks, model, [staged(tell_pairs(model), "answers")], id_col)
        release(model.seated, model.scored, model.restaurants)
    return scored


def _score(chunks: DataFrame, model: Model, told_pairs: list[DataFrame], id_col: str) -> DataFrame:
    answers = staged(ask_words(chunks, model), "answers")
    for told in told_pairs:
        answers = answers.unionByName(told)
    shared = chunks.sparkSession.sparkContext.broadcast(model.spelling)
    unit, tokens, root, d, blocks = float(model.tokens + model.kinds + 1), model.tokens, model.root, model.d, model.blocks

    def run(_: tuple, table: pa.Table) -> pa.Table:
        found = by_kind(table)
        parts = found["chunk"][0][1]
        spelt_as = word_hashes(parts)
        hashes, code = chunk_pairs(spelt_as, unpack(parts[3]))
        code, which = numbered(code)
        before, word = code // len(hashes), code % len(hashes)
        order, _ = dealt(hashes, blocks)
        told = [p for _, p in sorted(found["words"])]
        n = np.zeros(len(hashes), np.int64)
        n[order] = np.concatenate([unpack(p[0]) for p in told])
        # natural logs: of an unseen word the spelling, and behind it nothing is kept
        known, logs, backs = order[n[order] > 0], np.zeros((SAMPLES, len(hashes))), np.ones((SAMPLES, len(hashes)))
        p_words = np.zeros((SAMPLES, len(hashes)))
        p_words[:, known] = np.concatenate([floats(p[1]) for p in told], 1)
        logs[:, known] = np.log(p_words[:, known])
        backs[:, known] = (THETA + d * np.concatenate([unpack_each(p[2:]) for p in told], 1)) / (THETA + n[known])
        new, (data, starts, ends) = np.flatnonzero(n == 0), word_bytes([b"", b"", *parts[4:6]])
        at = in_order(spelt_as)[new]
        logs[:, new] = spell_logs(shared.value, data, starts[at], ends[at]) + np.log(root.back())[:, None]

        keys = pair_keys(hashes[before], hashes[word])
        order, _ = dealt(keys, blocks)
        told = [p for _, p in sorted(found["pairs"])]
        c = np.zeros(len(keys), np.int64)
        c[order] = np.concatenate([unpack(p[0]) for p in told])
        # of a pair seen, whose words are known, the probability; of another, which may be as small as its spelling, the logarithm
        many, seen, unseen = order[c[order] > 1], np.flatnonzero(c), np.flatnonzero(c == 0)
        tables, full = np.ones(len(keys)), np.zeros(len(keys))
        for s, sat in enumerate(np.concatenate([unpack_each(p[1:]) for p in told], 1)):
            tables[many] = sat
            full[seen] += (c[seen] - d * tables[seen]) / (THETA + n[before[seen]]) + backs[s][before[seen]] * p_words[s][word[seen]]
        full[seen] = np.log10(full[seen] / SAMPLES)
        each = np.log(backs)[:, before[unseen]] + logs[:, word[unseen]]
        peak = each.max(0)
        full[unseen] = (peak + np.log(np.exp(each - peak).mean(0))) / np.log(10)

        docs_tokens = unpack(parts[2])
        rows = np.repeat(np.arange(len(docs_tokens)), docs_tokens)
        by_row = lambda x: np.bincount(rows, x, len(docs_tokens))
        return pa.table(
            [
                pa.array(np.frombuffer(parts[0], np.int64), mask=np.frombuffer(parts[1], np.uint8).astype(bool)), pa.array(docs_tokens), pa.array(by_row((n[word] > 0)[which]).astype(np.int64)),
                pa.array(np.full(len(docs_tokens), tokens, np.int64)), pa.array(by_row(np.log10((n + 1) / unit)[word][which])), pa.array(by_row(full[which])),
            ],
            ["doc", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    scored = chunks.unionByName(answers).groupBy("to").applyInArrow(run, "doc long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("doc", id_col)
