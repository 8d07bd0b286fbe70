"""Operator 9: audio columns.

A text's bytes, padded to whole blocks, are the samples of an 8-bit mono WAV file, so the stored form is lossless and
any audio tool opens it. Features are computed from the stored bytes read back: a polyphase filter bank changes the
sample rate, overlapping Hann frames give log-mel energies, and frame energy with two thresholds (a segment starts
above the upper one and lasts until the lower one is passed) gives time spans. All log-mel frames are kept: each
STRETCH frames are one Arrow fixed-shape tensor with its time span (the last one repeats its last frame to the full
shape and says how many are real). A text's tensors are stored as an Arrow IPC stream in a binary column, as Spark has no
tensor type of its own; `read_tensors` opens it.

Cases: null and empty texts are one block of padding. Long texts are filtered and framed in stretches of BLOCK
frames, so memory follows the stretch, the payload and its features only. Equal payloads give equal results, as each row is
computed alone; repeated rows are rows each, a null doc_id is kept. Other columns, whatever their names, are not read; ties do
not arise. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from priceengine.llm.staging import map_arrow

PAD, UNIT = 255, 576
RATE_IN, UP, DOWN = 24_000, 2, 3
RATE = RATE_IN * UP // DOWN
FRAME, HOP, FFT, MELS, STRETCH, BLOCK = 400, 200, 512, 32, 16, 1024
SCHEMA = "doc_id long, n_bytes long, media binary, tensors binary, spans array<struct<start_s:double,end_s:double>>, n_frames long"
TENSOR = pa.fixed_shape_tensor(pa.float32(), (STRETCH, MELS), dim_names=("frame", "mel"))
STORED = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()), ("logmel", TENSOR)])


def wav(payload: bytes) -> bytes:
    """RIFF/WAVE, PCM, mono, 8 bits a sample."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE_IN, RATE_IN, 1, 8, b"data", len(payload))
    return head + payload


def samples(media: bytes) -> bytes:
    """The data chunk of a WAV file."""
    at = 12
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def padded(text: bytes) -> bytes:
    return text + bytes([PAD]) * (-len(text) % UNIT if text else UNIT)


def _low_pass() -> np.ndarray:
    """UP rows of taps: a windowed sinc at the lower of both Nyquist rates, one row for each phase."""
    half = 8 * max(UP, DOWN)
    n = np.arange(-half, half + 1)
    taps = np.sinc(n / max(UP, DOWN)) * np.hamming(len(n)) / max(UP, DOWN) * UP
    taps = np.concatenate([taps, np.zeros(-len(taps) % UP)])
    return taps.reshape(-1, UP).T.astype(np.float32).copy()


PHASES = _low_pass()
TAPS = PHASES.shape[1]


def resample(x: np.ndarray, first: int, n: int) -> np.ndarray:
    """Outputs first .. first + n of the signal at RATE: each takes the taps of its phase, at stride DOWN."""
    out = np.zeros(n, np.float32)
    for lead in range(min(UP, n)):
        k = np.arange(first + lead, first + n, UP, dtype=np.int64) * DOWN
        phase, base = int(k[0] % UP), k // UP  # the phase is the same for the whole row as DOWN * UP is a multiple of UP
        lo, step = int(base[0]) - TAPS + 1, DOWN
        need = step * (len(base) - 1) + TAPS
        part = np.zeros(need, np.float32)
        a, b = max(lo, 0), min(lo + need, len(x))
        if b > a:
            part[a - lo : b - lo] = x[a:b]
        view = np.lib.stride_tricks.as_strided(part, (len(base), TAPS), (4 * step, 4))
        out[lead::UP] = view @ PHASES[phase][::-1]
    return out


def _mel_bank() -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(40.0), mel(RATE / 2), MELS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(FFT, 1 / RATE)
    left, mid, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.clip(np.minimum((bins - left) / (mid - left), (right - bins) / (right - mid)), 0, None).T.astype(np.float32).copy()


BANK, WINDOW = _mel_bank(), np.hanning(FRAME).astype(np.float32)


def log_mel(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames of log-mel energies, and the frames' RMS."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    total = len(x) * UP // DOWN
    frames = 1 + max(0, -(-(total - FRAME) // HOP))
    mels, rms = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    for i in range(0, frames, BLOCK):
        m = min(BLOCK, frames - i)
        y = resample(x, i * HOP, (m - 1) * HOP + FRAME)
        seen = np.lib.stride_tricks.as_strided(y, (m, FRAME), (4 * HOP, 4))
        rms[i : i + m] = np.sqrt((seen * seen).mean(1))
        power = np.abs(np.fft.rfft(seen * WINDOW, FFT)).astype(np.float32) ** 2
        mels[i : i + m] = np.log(power @ BANK + 1e-6)
    return mels, rms


def active_spans(rms: np.ndarray, up: float = 1.1, down: float = 0.9) -> list[tuple[float, float]]:
    """Hysteresis: a span starts where energy passes `up` times the mean and ends where it falls under `down` times it."""
    mean = float(rms.mean())
    state = np.where(rms > up * mean, 1, np.where(rms < down * mean, 0, -1)).astype(np.int8)
    known = np.where(state >= 0, np.arange(len(state)), -1)
    np.maximum.accumulate(known, out=known)
    on = np.where(known >= 0, state[known], 0).astype(np.int8)
    edge = np.diff(np.concatenate([[0], on, [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(float(a * HOP / RATE), float(((b - 1) * HOP + FRAME) / RATE)) for a, b in zip(starts, ends, strict=True)]


def store_tensors(mels: np.ndarray) -> bytes:
    """Frames as an Arrow stream of STRETCH by MELS tensors with time spans; values have three decimals."""
    n = len(mels)
    first = np.arange(0, n, STRETCH)
    last = np.minimum(first + STRETCH, n) - 1
    flat = np.round(mels[np.minimum(np.arange(len(first) * STRETCH), n - 1)], 3).ravel()
    tensors = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(flat), STRETCH * MELS))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, STORED) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array(first * HOP / RATE), pa.array((last * HOP + FRAME) / RATE), pa.array((last - first + 1).astype(np.int32)), tensors], schema=STORED))
    return sink.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> pa.Table:
    """(start_s, end_s, frames, logmel) of one row's `tensors`."""
    return pa.ipc.open_stream(stored).read_all()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("tensors", pa.binary()),
        ("spans", pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))), ("n_frames", pa.int64()),
    ])
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        rows: list[tuple] = []
        held = 0
        for i in range(batch.num_rows):
            text = (texts[i].as_py() or "").encode()
            media = wav(padded(text))
            mels, rms = log_mel(samples(media))
            spans = [{"start_s": a, "end_s": b} for a, b in active_spans(rms)]
            rows.append((ids[i].as_py(), len(text), media, store_tensors(mels), spans, len(mels)))
            held += 2 * len(media)
            if held > 4 << 20 or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, held = [], 0


def audio_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media, tensors, spans, n_frames) of each row."""
    return map_arrow(docs.selectExpr(f"cast({id_col} as long) as doc_id", f"{text_col} as text"), _encode, SCHEMA)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = batch.to_pydict()
        out = {k: [] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for doc, n, media, stored, spans, frames in zip(*(cols[k] for k in ("doc_id", "n_bytes", "media", "tensors", "spans", "n_frames")), strict=True):
            back = samples(media)
            mel = read_tensors(stored).column("logmel").combine_chunks().to_numpy_ndarray().reshape(-1, MELS)[:frames]
            said = f"frames={frames};spans={len(spans)};active_s={sum(s['end_s'] - s['start_s'] for s in spans):.3f};mean={mel.mean(dtype=np.float64):.2f};logmel={hashlib.sha256(mel.tobytes()).hexdigest()[:16]}"
            for k, v in zip(out, (doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), said), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict(out)


def digest(media: DataFrame) -> DataFrame:
    """What `audio_columns` stored, read back and hashed."""
    return map_arrow(media, _digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
