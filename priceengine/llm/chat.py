r"""Operator 8: chat formatting by columnar byte assembly.

A turn becomes `<|turn|>role<|says|>text<|end|>` and a newline. In roles and texts every backslash and every `<` gets
a backslash before it, so no text can hold a control string and the original comes back by dropping those
backslashes. Per batch, numpy computes the length of every segment, the offsets by a running sum, and the place of
every byte; headers and contents are then scattered into one preallocated buffer. Turns come in order of conversations, so
this buffer, cut where a conversation begins, is the Arrow column. The loss mask is a list of byte spans of the formatted
conversation: the escaped texts of the assistant.

Conversations are dealt out and sorted by (conv_id, turn, role, text); a batch may end inside one, whose bytes then wait
for the next and are joined once, when it ends. One conversation is one output row, so its own size bounds the memory; a
common first turn or copies of a conversation gather nowhere. Very long texts are read whole.

Cases: null role or text: empty. Null conv_id: one conversation of its own. Null turns come first. Ties and repeated
rows keep all rows, ordered by role and text. Empty texts are formatted as such. An empty table gives an empty one.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceengine.llm.kernels import pieces, utf8
from priceengine.llm.staging import map_arrow

TURN, SAYS, END = b"<|turn|>", b"<|says|>", b"<|end|>\n"
ESCAPE, OPEN = 0x5C, 0x3C
SCHEMA = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start:long,stop:long>>"


def escaped(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with a backslash before each backslash and `<`, and the new offsets."""
    special = (data == ESCAPE) | (data == OPEN)
    moved = np.zeros(len(data) + 1, np.int64)
    np.cumsum(special, out=moved[1:])
    out = np.full(len(data) + int(moved[-1]), ESCAPE, np.uint8)
    out[np.arange(len(data)) + moved[1:]] = data
    return out, offsets + moved[offsets]


def scatter(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Row by row, the segments of all parts one after the other, in one buffer. Returns it and each segment's start, by row and part."""
    lengths = np.stack([np.diff(off) for _, off in parts], 1)
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if ends.size else 0, np.uint8)
    for k, (data, off) in enumerate(parts):
        out[np.repeat(starts[:, k] - off[:-1], lengths[:, k]) + np.arange(len(data))] = data
    return out, starts


def constant(text: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.tile(np.frombuffer(text, np.uint8), n), np.arange(n + 1, dtype=np.int64) * len(text)


def assemble(roles: tuple[np.ndarray, np.ndarray], texts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start of each turn with the total at the end, start and end of each text)."""
    n = len(roles[1]) - 1
    out, starts = scatter([constant(TURN, n), escaped(*roles), constant(SAYS, n), escaped(*texts), constant(END, n)])
    return out, np.append(starts[:, 0], len(out)), starts[:, 3], starts[:, 4]


def _column(parts: list[np.ndarray], ends: np.ndarray, turns: np.ndarray, ids: pa.Array, spans: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """Whole conversations: `parts` are their bytes, `ends` where each ends in them. The Arrow column is the buffer itself, copied only if there are several parts."""
    data = parts[0] if len(parts) == 1 else np.concatenate(parts)
    starts = np.append(0, ends[:-1])
    of = np.searchsorted(ends, spans[0], "right")
    at = np.searchsorted(of, np.arange(len(ends) + 1))
    spans = pa.StructArray.from_arrays([pa.array(x - starts[of]) for x in spans], ["start", "stop"])
    text = pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([ids, pa.array(turns), text, pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans)], ["conv_id", "n_turns", "formatted", "loss_spans"])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # the conversation that is still open: its id, bytes, turns and spans
    key, held, turns, spans = None, [], 0, [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def closed(parts: list[np.ndarray], ends: list[int], counts: list[int], ids: pa.Array, more: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return _column(parts, np.array(ends, np.int64), np.array(counts, np.int64), ids, tuple(np.concatenate(x) for x in zip(*more, strict=True)))

    for batch in batches:
        ids = batch.column(0)
        role_data, role_off = utf8(batch.column(1))
        text_data, text_off = utf8(batch.column(2))
        for i, j, texts, off in pieces(text_data, text_off):
            roles = role_data[role_off[i] : role_off[j]], role_off[i : j + 1] - role_off[i]
            out, begin, lo, hi = assemble(roles, (texts, off))
            said = np.array([roles[0][a:b].tobytes() == b"assistant" for a, b in zip(roles[1][:-1], roles[1][1:], strict=True)], bool)
            here = ids.slice(i, j - i)
            values, null = here.fill_null(0).to_numpy(), here.is_null().to_numpy(zero_copy_only=False)
            new = np.ones(j - i, bool)
            new[1:] = (values[1:] != values[:-1]) | (null[1:] != null[:-1])
            new[0] = not turns or here[0].as_py() != key
            firsts, size = np.flatnonzero(new), sum(map(len, held))
            own = (lo[said] + size, hi[said] + size)
            if not len(firsts):
                held, turns, spans = [*held, out], turns + j - i, [*spans, own]
                continue
            last = int(firsts[-1])
            cut = int(begin[last])
            ends, counts, told = (begin[firsts[1:]] + size).tolist(), np.diff(firsts).tolist(), here.take(pa.array(firsts[:-1]))
            if turns:
                ends, counts, told = [size + int(begin[firsts[0]]), *ends], [turns + int(firsts[0]), *counts], pa.concat_arrays([pa.array([key], pa.int64()), told])
            late = own[0] >= size + cut
            if ends:
                yield closed([*held, out[:cut]], ends, counts, told, [*spans, (own[0][~late], own[1][~late])])
            key, held, turns, spans = here[last].as_py(), [out[cut:].copy()], j - i - last, [(own[0][late] - size - cut, own[1][late] - size - cut)]
    if turns:
        yield closed(held, [sum(map(len, held))], [turns], pa.array([key], pa.int64()), spans)


def format_chats(turns: DataFrame) -> DataFrame:
    """One row for each conversation of (conv_id, turn, role, text): the formatted text and the byte spans under the loss mask."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_arrow(dealt.select("conv_id", "role", "text"), _format, SCHEMA)


def unescaped(text: bytes) -> bytes:
    raw = np.frombuffer(text, np.uint8)
    marks = np.flatnonzero(raw == ESCAPE)
    if not len(marks):
        return text
    # in a run of backslashes every second one is a mark
    new = np.ones(len(marks), bool)
    new[1:] = np.diff(marks) != 1
    first = np.maximum.accumulate(np.where(new, np.arange(len(marks)), 0))
    drop = marks[(np.arange(len(marks)) - first) % 2 == 0]
    keep = np.ones(len(raw), bool)
    keep[drop] = False
    return raw[keep].tobytes()


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn of a formatted conversation. A `<` without a backslash opens a control string, always."""
    raw = np.frombuffer(formatted, np.uint8)
    opens = np.flatnonzero(raw == OPEN)
    # escaped ones directly follow an odd run of backslashes; runs are measured from the last other byte
    other = np.where(raw != ESCAPE, np.arange(len(raw)), -1)
    np.maximum.accumulate(other, out=other)
    before = np.where(opens > 0, other[np.maximum(opens - 1, 0)], -1)
    opens = opens[(opens - 1 - before) % 2 == 0].tolist()
    out = []
    for a, b, c in zip(opens[::3], opens[1::3], opens[2::3], strict=True):
        if not (formatted.startswith(TURN, a) and formatted.startswith(SAYS, b) and formatted.startswith(END, c)):
            raise ValueError("malformed conversation")
        out.append((unescaped(formatted[a + len(TURN) : b]), unescaped(formatted[b + len(SAYS) : c])))
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        rows = []
        for conv, formatted, spans in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
            raw = formatted.encode()
            turns = parse(raw)
            loss = b"".join(unescaped(raw[s["start"] : s["stop"]]) for s in spans)
            told = hashlib.sha256(b"".join(r + b"\n" + t + b"\n" for r, t in turns)).hexdigest()
            rows.append((conv, len(turns), told, len(loss.decode()), hashlib.sha256(loss).hexdigest(), len(formatted)))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def digest(chats: DataFrame) -> DataFrame:
    """Turns and masked texts, read back from the formatted conversations."""
    return map_arrow(chats, _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
