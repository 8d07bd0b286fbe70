"""Numpy kernels over the UTF-8 buffer of an Arrow string column: tokens, hashes, per-row sums.

They run inside mapInArrow and look at a few MB of text at a time (`pieces`), so a worker's memory does not follow
the batch. One text is never cut: a very long one is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20
#: ASCII white space: 0x20 and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_RNG = np.random.Generator(np.random.PCG64(20240611))
BYTE_VALUE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + _RNG.integers(0, 2, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2**64 for i up to n."""
    if "up" not in _POWERS or len(_POWERS["up"]) <= n:
        size = max(n + 1, PIECE_BYTES + 1)
        for name, base in (("up", BASE), ("down", BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers whose output bits all depend on all input bits (the finaliser of splitmix64)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with no more than `limit` bytes, or one row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def text_rows(batch: pa.RecordBatch, name: str, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    return pieces(*utf8(batch.column(batch.schema.get_field_index(name))), limit)


def tokens(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each run of bytes that are not `between` (white space, if not given); runs end with their row."""
    word = ~between[data]
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(len(word) + 1, bool)
    first[0] = first[-1] = True
    first[1:-1] = ~word[:-1]
    first[offsets] = True
    starts = np.flatnonzero(word & first[:-1])
    last = np.zeros(len(word) + 1, bool)
    last[:-1] = ~word
    last[offsets] = True
    last[-1] = True
    ends = np.flatnonzero(word & last[1:]) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 sums of value(byte i) * BASE ** i modulo 2**64."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span, the same wherever the bytes stand; lengths count."""
    _, down = powers(len(prefix) - 1)
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def token_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, hash) of the tokens; fold: A-Z as a-z."""
    starts, ends, rows = tokens(data, offsets)
    prefix = prefix_hash(FOLD[data] if fold else data)
    return starts, ends, rows, span_hash(prefix, starts, ends)


def row_counts(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights, minlength=n)


def row_bytes(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each row the mask holds."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as an Arrow binary column, gathered in one copy."""
    lengths = ends - starts
    off = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=off[1:])
    at = np.repeat(starts - off[:-1], lengths) + np.arange(off[-1])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data[at].tobytes())])
