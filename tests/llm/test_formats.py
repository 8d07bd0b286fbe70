"""Operators 8, 9 and 10."""

from __future__ import annotations

import hashlib
import io
import math
import os
import random
import wave
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from priceengine.llm import audio, chat, language_model
from priceengine.llm.kernels import token_hashes
from priceengine.llm.staging import shared_folder
from tests.llm.common import SCHEMA, frame, prose

NASTY = st.lists(st.sampled_from([*"\\<|>tu é\n", "<|end|>\n", "<|turn|>", "<|says|>"]), max_size=12).map("".join)


def column(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(NASTY, NASTY), min_size=1, max_size=5))
def test_any_turns_come_back(turns):
    out, _, _, _ = chat.assemble(column([r.encode() for r, _ in turns]), column([t.encode() for _, t in turns]))
    assert chat.parse(out.tobytes()) == [(r.encode(), t.encode()) for r, t in turns]


def test_chats_come_back_from_the_format(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "<|turn|>"]), rng.choice(["<|end|>\n", "\\", "\\\\<", "été", "", prose(rng, 30)])) for c in range(40) for t in range(rng.randrange(1, 6))]
    rows += [(-1, 0, None, None), (None, 0, "user", "x"), (7, 99, "assistant", "z" * 300_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.digest(chat.format_chats(turns)).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1], r[2] or "", r[3] or ""))
        told = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in mine).encode()).hexdigest()
        loss = "".join(t or "" for _, _, r, t in mine if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == (len(mine), told, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(turns.where("false")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, 1, 2, 3]), st.sampled_from(["user", "assistant", "é<"]), NASTY), min_size=1, max_size=30), st.integers(1, 5), st.integers(1, 40))
def test_conversations_end_anywhere_in_batches_and_pieces(turns, per_batch, limit):
    """Conversations over several batches and pieces of text, null ids among them, are cut from the buffers where they begin."""
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0))
    kinds = [("conv_id", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*turns[i : i + per_batch], strict=True), kinds, strict=True)], [n for n, _ in kinds]) for i in range(0, len(turns), per_batch)]
    small, chat.pieces = chat.pieces, lambda data, off: small(data, off, limit)
    try:
        got = [r for b in chat._format(iter(batches)) for r in b.to_pylist()]
    finally:
        chat.pieces = small
    true = {}
    for conv, role, text in turns:
        true.setdefault(conv, []).append((role.encode(), text.encode()))
    assert [r["conv_id"] for r in got] == list(true)
    for r in got:
        raw = r["formatted"].encode()
        assert chat.parse(raw) == true[r["conv_id"]] and r["n_turns"] == len(true[r["conv_id"]])
        assert [chat.unescaped(raw[s["start"] : s["stop"]]) for s in r["loss_spans"]] == [t for role, t in true[r["conv_id"]] if role == b"assistant"]


def test_media_hold_the_bytes_and_are_audio(spark):
    rng = random.Random(1)
    texts = [None, "", "é" * 288, "a" * 577, prose(rng, 40_000), "\x00"]
    got = {r.doc_id: r for r in audio.audio_columns(frame(spark, texts)).collect()}
    said = {r.doc_id: r for r in audio.digest(audio.audio_columns(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        with wave.open(io.BytesIO(bytes(got[i].media))) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, payload)
        assert said[i].payload_sha256 == hashlib.sha256(payload).hexdigest() and said[i].tail_crc32 == zlib.crc32(payload[-32:])
        assert (said[i].n_bytes, said[i].payload_bytes) == (len(raw), len(payload))
        stored = audio.read_tensors(bytes(got[i].tensors))
        assert stored.schema.field("logmel").type == pa.fixed_shape_tensor(pa.float32(), (audio.STRETCH, audio.MELS), dim_names=("frame", "mel"))
        assert sum(stored["frames"].to_pylist()) == got[i].n_frames and stored.num_rows == -(-got[i].n_frames // audio.STRETCH)
        assert stored["start_s"].to_pylist() == [k * audio.STRETCH * audio.HOP / audio.RATE for k in range(stored.num_rows)]
    assert said[0].feature == said[1].feature
    assert audio.digest(audio.audio_columns(spark.createDataFrame([], SCHEMA))).collect() == []


def test_media_of_awkward_tables(spark):
    rows = [(None, "x y", 1, 2), (3, "x y", 1, 2), (3, "x y", 1, 2)]
    clash = spark.createDataFrame(rows, "doc_id long, text string, media int, spans int")
    got = audio.digest(audio.audio_columns(clash)).collect()
    assert [r.doc_id for r in got] == [None, 3, 3] and len({(r.media_sha256, r.feature) for r in got}) == 1


def test_features_are_those_of_a_direct_transform():
    """Sums over single samples and frequencies, in double precision."""
    rng = np.random.default_rng(6)
    payload = bytes(rng.integers(0, 256, 576 * 7, dtype=np.uint8))
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    half = 8 * max(audio.UP, audio.DOWN)
    k = np.arange(-half, half + 1)
    taps = np.sinc(k / max(audio.UP, audio.DOWN)) * np.hamming(len(k)) / max(audio.UP, audio.DOWN) * audio.UP
    stuffed = np.zeros(len(x) * audio.UP)
    stuffed[:: audio.UP] = x
    y = np.convolve(stuffed, taps)[:: audio.DOWN]
    mels, rms = audio.log_mel(payload)
    y = np.append(y, np.zeros(audio.FRAME))
    f = np.arange(audio.FFT // 2 + 1)[:, None] * np.arange(audio.FRAME) / audio.FFT
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(audio.FRAME) / (audio.FRAME - 1))
    mel = lambda hz: 2595 * math.log10(1 + hz / 700)
    edges = [700 * (10 ** ((mel(40) + (mel(audio.RATE / 2) - mel(40)) * i / (audio.MELS + 1)) / 2595) - 1) for i in range(audio.MELS + 2)]
    for i in range(len(mels)):
        frame_ = y[i * audio.HOP : i * audio.HOP + audio.FRAME]
        assert math.isclose(rms[i], math.sqrt((frame_**2).mean()), rel_tol=1e-4)
        power = abs((np.exp(-2j * np.pi * f) * (frame_ * hann)).sum(1)) ** 2
        hz = np.arange(audio.FFT // 2 + 1) * audio.RATE / audio.FFT
        for m in range(audio.MELS):
            a, b, c = edges[m : m + 3]
            weight = np.clip(np.minimum((hz - a) / (b - a), (c - hz) / (c - b)), 0, None)
            assert math.isclose(mels[i, m], math.log((power * weight).sum() + 1e-6), abs_tol=2e-3)


def test_resampling_keeps_a_tone_and_stretches_join():
    t = np.arange(24_000) / audio.RATE_IN
    tone = np.sin(2 * np.pi * 440 * t).astype(np.float32)
    whole = audio.resample(tone, 0, 16_000)
    assert np.allclose(np.concatenate([audio.resample(tone, a, 1000) for a in range(0, 16_000, 1000)]), whole, atol=1e-6)
    spectrum = np.abs(np.fft.rfft(whole[2000:14_000] * np.hanning(12_000)))
    assert abs(np.argmax(spectrum) * audio.RATE / 12_000 - 440) < 2
    gain = np.abs(whole[2000:14_000]).max()
    assert 0.95 < gain < 1.05


def test_energy_segments_have_hysteresis():
    rms = np.array([0, 2.0, 1.0, 2.0, 0.1, 1.0, 0.1], np.float32)
    spans = audio.active_spans(rms, up=1.5, down=0.5)
    hop, frame = audio.HOP / audio.RATE, audio.FRAME / audio.RATE
    assert spans == [(1 * hop, 3 * hop + frame)]


def lm_texts(n: int = 300) -> list[str | None]:
    rng = random.Random(12)
    return [None, "", *[prose(rng, rng.randrange(5, 60)) for _ in range(n)], "Unseenword zzzqqq"]


def test_base_scores_are_those_counted_by_hand(spark):
    texts = lm_texts()
    docs = frame(spark, texts)
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    model = language_model.fit(docs.where(~held))
    got = {r.doc_id: r for r in language_model.score(docs, model).collect()}
    words = lambda t: [*(t or "").lower().split(), None]
    count = Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2 for w in words(t))
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(texts):
        w = words(t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(x in count for x in w), n)
        assert math.isclose(got[i].base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert got[i].score < 0 and math.isfinite(got[i].score)


def test_predictive_probabilities_sum_to_one_over_known_words_and_the_rest(spark):
    """All training words and, by sampling of the spelling model, unseen ones: no more than 1, and most of it."""
    docs = frame(spark, lm_texts())
    model = language_model.fit(docs)
    total = model.words.select(F.posexplode("log_p").alias("x", "lp")).groupBy("x").agg(F.sum(F.pow(F.lit(10.0), F.col("lp").cast("double"))).alias("p")).collect()
    assert all(0.5 < r.p <= 1.0 + 1e-6 for r in total)


def test_model_beats_the_base_on_held_out_text(spark):
    """Two languages with other words each: the words before tell what may follow."""
    rng = random.Random(2)
    text = lambda lang: " ".join(f"{lang}{rng.choice('aeiou')}{rng.choice('klmn')}" for _ in range(40))
    docs = spark.createDataFrame([(i, text("bd"[i % 2]), "bd"[i % 2], "web", 0) for i in range(600)], SCHEMA)
    got = language_model.score(docs.where("doc_id >= 400"), language_model.fit(docs.where("doc_id < 400"))).collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_model_beats_the_base_where_new_words_stand_among_known_ones(spark):
    """Words of which each says much about the next, and every seventh or so a word made of syllables, mostly an unseen one, whose spelling has to tell it."""
    rng = random.Random(9)
    syllables = ["tha", "ner", "ing", "ous", "ver", "lich", "ter", "ion"]

    def text() -> str:
        return " ".join("".join(rng.choices(syllables, k=4)) if rng.random() < 0.15 else w for w in chain(rng, 60))

    docs = frame(spark, [text() for _ in range(300)])
    got = language_model.score(docs.where("doc_id >= 250"), language_model.fit(docs.where("doc_id < 250"))).collect()
    tokens, known = sum(r.n_tokens for r in got), sum(r.n_known for r in got)
    assert 0.01 < 1 - known / tokens < 0.2 and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_the_spelling_is_that_of_its_restaurants():
    """Probabilities of all bytes behind any context sum to one, and equal the recursion over the levels."""
    rng = np.random.default_rng(4)
    context = np.unique(rng.integers(0, language_model.CLASSES**language_model.PAST, 300))
    context, symbol = np.repeat(context, 3), rng.integers(97, 110, 3 * len(context))
    cells = np.unique(context * 256 + symbol)
    model = language_model.fit_spelling(cells // 256, cells % 256, rng.integers(1, 9, len(cells)), 2, 5)
    for c in [*context[:20], 1, 77]:
        p = np.exp(model.logs(np.full(256, c), np.arange(256)))
        assert np.allclose(p.sum(1), 1.0, atol=1e-4)
        slow = np.full((2, 256), 1 / 256)
        for n, level in enumerate(model.levels):
            own = c % language_model.CLASSES**n
            here = np.flatnonzero(level.contexts == own)
            if len(here):
                slow = slow * level.back[:, here]
                for cell in np.flatnonzero(level.cells // 256 == own):
                    slow[:, level.cells[cell] % 256] = level.p[:, cell]
        assert np.allclose(p, slow, rtol=1e-4)


def test_a_fit_leaves_only_the_tables_its_model_reads(spark):
    folder = Path(shared_folder(spark).removeprefix("file://").removeprefix("file:"))
    there = set(os.listdir(folder))
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    language_model.fit(frame(spark, lm_texts(40)))
    assert sorted(name.partition("-")[0] for name in set(os.listdir(folder)) - there) == ["restaurants", "scores", "seated"]
    assert spark.conf.get(setting) == before


def test_language_model_of_awkward_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    docs = frame(spark, ["a b", None, "x" * 20_000])
    model = language_model.fit(empty)
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in language_model.score(docs, model).collect()} == {(3, 0, 0), (1, 0, 0), (2, 0, 0)}
    assert language_model.score(empty, language_model.fit(docs)).collect() == []
    twice = docs.union(docs).withColumn("h", F.lit("clash"))
    assert language_model.score(twice, model).count() == 6


def chain(rng: random.Random, n: int) -> list[str]:
    """Words of which each says much about the next."""
    out = [rng.randrange(30)]
    while len(out) < n:
        out.append((out[-1] * 7 + rng.choice((1, 2))) % 30)
    return [f"w{k}x" for k in out]


def test_the_word_before_changes_a_score(spark):
    rng = random.Random(4)
    texts = [chain(rng, 40) for _ in range(300)]
    docs = frame(spark, [" ".join(t) for t in texts])
    model = language_model.fit(docs.where("doc_id < 250"))
    mixed = frame(spark, [" ".join(rng.sample(t, len(t))) for t in texts])
    right, wrong = ({r.doc_id: r.score for r in language_model.score(d.where("doc_id >= 250"), model).collect()} for d in (docs, mixed))
    assert all(right[i] > wrong[i] + 10 for i in right) and len(right) == 50


def test_probabilities_behind_a_word_sum_to_one(spark):
    model = language_model.fit(frame(spark, lm_texts()))
    pairs = model.pairs.groupBy("u").agg(F.sum(F.pow(F.lit(10.0), F.col("log_p").cast("double"))).alias("p"), F.collect_set("w").alias("ws"))
    unigram = {r.h: 10 ** r.log_p[0] for r in model.words.collect()}
    back = {r.u: sum(math.exp(x) for x in r.ln_back) / language_model.SAMPLES for r in model.contexts.collect()}
    for r in pairs.collect():
        # the mean of products over samples is near the product of means
        assert 0.5 < r.p + back[r.u] * sum(p for w, p in unigram.items() if w not in set(r.ws)) < 1.01


class Restaurant:
    """Customers one by one at tables of their own."""

    def __init__(self, d: float, theta: float, parent):
        self.d, self.theta, self.parent = d, theta, parent
        self.tables: dict[str, list[int]] = {}

    def p(self, dish: str) -> float:
        at = self.tables.get(dish, [])
        n, t = sum(map(sum, self.tables.values())), sum(map(len, self.tables.values()))
        return (sum(at) - self.d * len(at) + (self.theta + self.d * t) * self.parent.p(dish)) / (self.theta + n)

    def add(self, rng: random.Random, dish: str) -> None:
        at = self.tables.setdefault(dish, [])
        t = sum(map(len, self.tables.values()))
        k = rng.choices(range(len(at) + 1), [*(x - self.d for x in at), (self.theta + self.d * t) * self.parent.p(dish)])[0]
        if k < len(at):
            at[k] += 1
        else:
            at.append(1)
            self.parent.add(rng, dish)

    def remove(self, rng: random.Random, dish: str) -> None:
        at = self.tables[dish]
        k = rng.choices(range(len(at)), at)[0]
        at[k] -= 1
        if not at[k]:
            at.pop(k)
            self.parent.remove(rng, dish)


class Base:
    def __init__(self, p: dict[str, float]):
        self.known = p

    def p(self, dish: str) -> float:
        return self.known[dish]

    def add(self, rng: random.Random, dish: str) -> None: ...

    def remove(self, rng: random.Random, dish: str) -> None: ...


def test_scores_are_near_those_of_a_sampler_of_single_customers(spark):
    """One customer at a time is taken out and seated again, averaged over many states; spelling and discounts are the model's."""
    rng = random.Random(7)
    texts = [" ".join(chain(rng, 25)) for _ in range(40)]
    docs = frame(spark, texts)
    model = language_model.fit(docs)
    words = sorted({w for t in texts for w in t.split()} | {""})
    raw = [w.encode() for w in words]
    off = np.cumsum([0, *map(len, raw)])
    logs = language_model.spell_logs(model.spelling, np.frombuffer(b"".join(raw), np.uint8), off[:-1], off[1:])
    spelt = dict(zip(words, np.exp(logs).mean(0).tolist(), strict=True))
    pairs = [(u, w) for t in texts for u, w in zip(["", *t.split()], [*t.split(), ""], strict=True)]
    kinds = Counter(Counter(pairs).values())
    d1 = language_model.discount(kinds[1], kinds[2])
    after = Counter(w for _, w in set(pairs))
    d0 = language_model.discount(sum(n == 1 for n in after.values()), sum(n == 2 for n in after.values()))
    root = Restaurant(d0, language_model.THETA, Base(spelt))
    rooms = {u: Restaurant(d1, language_model.THETA, root) for u in words}
    for u, w in pairs:
        rooms[u].add(rng, w)
    mean: Counter = Counter()
    for sweep in range(30):
        for u, w in pairs:
            rooms[u].remove(rng, w)
            rooms[u].add(rng, w)
        if sweep >= 10:
            for u, w in set(pairs):
                mean[u, w] += rooms[u].p(w) / 20
    got = {r.doc_id: r.score for r in language_model.score(docs, model).collect()}
    for i, t in enumerate(texts):
        true = sum(math.log10(mean[u, w]) for u, w in zip(["", *t.split()], [*t.split(), ""], strict=True))
        assert abs(got[i] / true - 1) < 0.05


def test_scores_do_not_depend_on_what_is_broadcast(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda lang: " ".join(f"{lang}{rng.choice('aeiou')}{rng.choice('klmn')}" for _ in range(20))
    docs = spark.createDataFrame([(i, text("bd"[i % 3 == 0]), "bd"[i % 3 == 0], "web", 0) for i in range(200)], SCHEMA)
    got = []
    for top in (100_000, 3):
        monkeypatch.setattr(language_model, "TOP", top)
        got.append({r.doc_id: r for r in language_model.score(docs, language_model.fit(docs.where("doc_id < 150"))).collect()})
    for i, r in got[0].items():
        assert r.n_known == got[1][i].n_known and math.isclose(r.score, got[1][i].score, rel_tol=1e-5)
        assert math.isclose(r.base_score, got[1][i].base_score, rel_tol=1e-9)


def test_the_language_model_takes_few_bytes_for_each_pair(spark):
    """Its tables and the shuffles behind them are what fills the disk: nearly all pairs of these texts differ."""
    rng = random.Random(8)
    words = [f"w{k:x}" for k in rng.sample(range(1 << 24), 8000)]
    folder = Path(shared_folder(spark).removeprefix("file://").removeprefix("file:"))
    there = set(os.listdir(folder))
    model = language_model.fit(frame(spark, [" ".join(rng.choices(words, k=400)) for _ in range(200)]))
    taken = sum(p.stat().st_size for name in set(os.listdir(folder)) - there for p in (folder / name).rglob("*.parquet"))
    assert taken < 12 * model.pairs.count()


def test_chunks_ask_for_pairs_as_they_are_counted(spark, monkeypatch):
    """No keys of pairs are dealt out again to score what the model is made from: many chunks and blocks, most rows held out, and none for training."""
    docs = frame(spark, lm_texts(60))
    want = {r.doc_id: r for r in language_model.score(docs, language_model.fit(docs.where("doc_id < 12"))).collect()}
    for name, value in (("TOP", 100), ("BLOCK", 300), ("ask_pairs", None)):
        monkeypatch.setattr(language_model, name, value)
    for r in language_model.fit_and_score(docs, F.col("doc_id") < 12).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (want[r.doc_id].n_tokens, want[r.doc_id].n_known, want[r.doc_id].train_tokens)
        assert math.isclose(r.score, want[r.doc_id].score, rel_tol=1e-5)
    assert {(r.n_known, r.train_tokens) for r in language_model.fit_and_score(docs, F.lit(False)).collect()} == {(0, 0)}
    assert language_model.fit_and_score(docs.limit(0), F.lit(True)).collect() == []


def test_chunks_hold_no_hashes_of_their_words(spark):
    """Eight bytes a word that nothing compresses: here they would be more than the words themselves."""
    rng = random.Random(9)
    words = [f"{k:06d}" for k in rng.sample(range(10**6), 20_000)]
    docs = frame(spark, [" ".join(words[i : i + 400]) for i in range(0, len(words), 400)]).coalesce(1)
    row = language_model.chunked(docs, "doc_id", F.lit(True)).first()
    assert sum(map(len, row.parts)) < 12 * len(words)
    found = {bytes(w): h for w, h in zip(words_of(row.parts), language_model.word_hashes(row.parts).tolist(), strict=True)}
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _, hashed = token_hashes(data, np.array([0, len(data)]))
    assert found == {b"": int(language_model.END_HASH), **{data[i:j].tobytes(): h for i, j, h in zip(starts, ends, hashed.tolist(), strict=True)}}


def words_of(parts: list[bytes]) -> list[bytes]:
    data, starts, ends = language_model.word_bytes([b"", b"", *parts[4:6]])
    return [data[i:j].tobytes() for i, j in zip(starts, ends, strict=True)]


def test_order_of_long_and_alike_keys():
    """The sort of keys with their places is a stable argsort, where keys differ in their lowest bits alone, too."""
    rng = np.random.default_rng(4)
    hashes = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    near = np.uint64(2**63) + rng.integers(0, 40, 5000, dtype=np.uint64)
    for keys in (hashes, near, np.append(hashes, near[:30]), rng.integers(0, 50, 5000), np.zeros(0, np.uint64), np.zeros(1, np.int64), np.append(hashes, hashes)):
        assert (language_model.in_order(keys) == np.argsort(keys, kind="stable")).all()


def test_scores_do_not_depend_on_blocks_and_parts(spark, monkeypatch):
    docs, got = frame(spark, lm_texts(80)), []
    for block in (2_000_000, 500):
        monkeypatch.setattr(language_model, "BLOCK", block)
        got.append({r.doc_id: r for r in language_model.fit_and_score(docs, F.col("doc_id") < 60).collect()})
    apart = {r.doc_id: r for r in language_model.score(docs, language_model.fit(docs.where("doc_id < 60"))).collect()}
    for i, r in apart.items():
        for other in (x[i] for x in got):
            assert (r.n_tokens, r.n_known, r.train_tokens) == (other.n_tokens, other.n_known, other.train_tokens)
            assert math.isclose(r.score, other.score, rel_tol=1e-5) and math.isclose(r.base_score, other.base_score, rel_tol=1e-9)
