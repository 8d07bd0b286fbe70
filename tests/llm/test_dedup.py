"""Operators 3, 5 and 6 against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from priceengine.llm import near_dedup
from priceengine.llm.line_dedup import dedup_lines
from priceengine.llm.near_dedup import bag_min_hash, drop_near_copies, multisets, near_classes
from priceengine.llm.substring_dedup import without_repeats
from tests.llm.common import SCHEMA, frame, prose, rows


def shingles(text: str | None) -> Counter:
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_classes(texts: list[str | None]) -> list[int]:
    bags = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            either = sum((bags[i] | bags[j]).values())
            if either and both * 10 >= either * 8:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def edited(rng: random.Random, text: str, n: int) -> str:
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = prose(rng, 1)
    return " ".join(w)


def near_texts() -> list[str | None]:
    rng = random.Random(4)
    texts: list[str | None] = [None, "", "  \n", "one two", "one two", "one two three"]
    hot = prose(rng, 120)
    texts += [edited(rng, hot, rng.randrange(3)) for _ in range(60)] + [hot] * 20
    for _ in range(30):
        base = prose(rng, rng.randrange(5, 300))
        texts += [base, edited(rng, base, max(1, len(base.split()) // 60)), edited(rng, base, len(base.split()) // 10)]
    texts.append((prose(rng, 40) + " ") * 100)  # very long, repeated runs
    texts.append((prose(rng, 40) + " ") * 100)
    rng.shuffle(texts)
    return texts


def test_near_classes_are_those_of_all_pairs(spark):
    texts = near_texts()
    found = {r.doc_id: r.class_id for r in near_classes(frame(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == brute_classes(texts)


def test_copies_of_one_original_that_are_unlike_each_other(spark):
    """Each copy is near the original and hardly any two copies are near each other: the original links them all."""
    rng = random.Random(11)
    original = prose(rng, 200)
    texts = [edited(rng, original, 4) for _ in range(40)]
    texts.insert(25, original)
    found = {r.doc_id: r.class_id for r in near_classes(frame(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == brute_classes(texts)


def test_near_classes_of_awkward_tables(spark):
    assert near_classes(spark.createDataFrame([], SCHEMA)).collect() == []
    clash = spark.createDataFrame([(5, "a b c d e f", 1, 2), (None, "a b c d e f", 1, 2), (3, "a b c d e f", 1, 2), (5, "a b c d e f", 1, 2)], "doc_id long, text string, class_id int, key int")
    assert sorted(((r.doc_id or 0, r.class_id) for r in near_classes(clash).collect()), key=lambda x: x[0]) == [(0, None), (3, 3), (5, 3), (5, 3)]
    kept = drop_near_copies(clash)
    assert kept.columns == clash.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3]


def test_bag_min_hash_is_unbiased():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = rng.integers(1, 9, 400), rng.integers(1, 9, 400)
    a[300:], b[:50] = 0, 0
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    shares = []
    for salt in range(40):
        row = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        hashed = near_dedup.mix(np.concatenate([keys[a > 0], keys[b > 0]]) + np.uint64(salt * 1000))
        count = np.concatenate([a[a > 0], b[b > 0]])
        sig = bag_min_hash(row, hashed, count, 2)
        shares.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(shares) - true) < 0.02


def test_multisets_count():
    row, hashed, count = multisets(np.array([0, 0, 1, 0]), np.array([7, 7, 7, 9], np.uint64))
    assert list(zip(row.tolist(), hashed.tolist(), count.tolist(), strict=True)) == [(0, 7, 2), (0, 9, 1), (1, 7, 1)]


def brute_substrings(texts: list[str | None], width: int = 400) -> list[tuple[int, int, int, str]]:
    raw = [(t or "").encode() for t in texts]
    count: Counter = Counter(r[i : i + width] for r in raw for i in range(len(r) - width + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - width + 1):
            if count[r[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out.append((len(r), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def substring_texts() -> list[str | None]:
    rng = random.Random(8)
    shared, other = prose(rng, 150), prose(rng, 90)
    texts: list[str | None] = [None, "", "x" * 399, "x" * 900, "é" * 500, prose(rng, 30)]
    texts += [f"{prose(rng, 40)} {shared} {prose(rng, 40)}" for _ in range(5)]
    texts += [prose(rng, 20) + shared[rng.randrange(200) :] for _ in range(6)] + [shared[: rng.randrange(380, 420)] for _ in range(6)]
    copy = prose(rng, 200)
    texts += [copy, copy, copy + "!", f"{other} {prose(rng, 10)} {other} {prose(rng, 10)}", prose(rng, 5000)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("group", [1500, 2])
def test_repeated_substrings_are_those_of_all_windows(spark, monkeypatch, group):
    """group 2: all larger groups of edges take the counted way."""
    from priceengine.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "GROUP", group)
    texts = substring_texts()
    left = without_repeats(frame(spark, texts)).withColumn("sha", F.sha2("kept", 256))
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in left.collect()}
    assert [found[i] for i in range(len(texts))] == brute_substrings(texts)


def brute_passages(texts: list[str | None], width: int = 51) -> list[int]:
    words = [re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    own = [[tuple(w[i : i + width]) for i in range(len(w) - width + 1)] for w in words]
    texts_with = Counter(x for windows in own for x in set(windows))
    return [sum(texts_with[x] > 1 for x in windows) for windows in own]


def test_passages_of_over_fifty_words_are_those_of_all_windows(spark):
    """Short words, other case and white space count as well; what repeats only inside one text does not."""
    rng = random.Random(21)
    short, passage = " ".join(rng.choice("abcdefgh") for _ in range(51)), prose(rng, 60)
    texts = [*substring_texts(), prose(rng, 50), f"{prose(rng, 70)} {short}", f"{short.upper()} {prose(rng, 5)}", short[:-2]]
    texts += [f"{prose(rng, rng.randrange(60))} {passage.title()}\t{prose(rng, 30)}" for _ in range(8)] + [passage.replace(" ", "\n ") for _ in range(2)]
    texts += [f"{passage} {passage} {prose(rng, 3)}", f"{prose(rng, 55)} " * 3]
    found = {r.doc_id: r.n_shared_windows for r in without_repeats(frame(spark, texts)).collect()}
    true = brute_passages(texts)
    assert [found[i] for i in range(len(texts))] == true
    assert true[-1] == 0 < true[-2]


def test_substrings_of_awkward_tables(spark):
    assert without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    twice = spark.createDataFrame([(1, "ab" * 300, 9), (None, "ab" * 300, 9)], "doc_id long, text string, h int")
    got = without_repeats(twice).collect()
    assert [r.n_removed for r in got] == [600, 600] and [r.h for r in got] == [9, 9]


def test_a_lying_hash_is_found_out(monkeypatch):
    """With a prefix hash that says the same of everything, the bytes decide."""
    from priceengine.llm import substring_dedup as sd

    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 99, 500, dtype=np.uint8))[:420] for _ in range(6)]
    texts.append(texts[0][:410] + b"z" * 10)
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    n = len(texts)
    args = (np.zeros(n, np.int64), data, off, np.full(n, 20), np.zeros(n, np.int64), np.full(n, 20), np.ones(n, np.int64))
    true = sd.repeated_offsets(*args)
    monkeypatch.setattr(sd, "row_prefix_hashes", lambda m: np.zeros((m.shape[0], m.shape[1] + 1), np.uint64))
    assert (sd.repeated_offsets(*args) == true).all() and true.any()


def brute_lines(texts: list[str | None]) -> list[tuple[int, int, str]]:
    space = " \t\n\x0b\x0c\r"
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(space))
    holders = defaultdict(set)
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and i != max(holders[key(x)]))]
        out.append((len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_lines_are_dropped_as_by_hand(spark):
    rng = random.Random(2)
    common = [prose(rng, 6) for _ in range(5)] + ["short one", "ÉTÉ " + prose(rng, 5)]
    texts: list[str | None] = [None, "", "\n\n", "a\n"]
    for _ in range(80):
        lines = [rng.choice(common) for _ in range(3)] + [prose(rng, 5) for _ in range(3)]
        texts.append("\n".join(rng.choice(["", " ", "\t"]) + (x.upper() if x.isascii() and rng.random() < 0.3 else x) + rng.choice(["", " \r"]) for x in lines))
    got = dedup_lines(frame(spark, texts)).withColumn("sha", F.sha2(F.encode("text", "UTF-8"), 256))
    found = {r.doc_id: (r.n_lines, r.n_dropped, r.sha) for r in got.collect()}
    assert [found[i] for i in range(len(texts))] == brute_lines(texts)


def test_lines_of_a_very_long_text(spark):
    rng = random.Random(3)
    common = [f"common line {i} of many documents" for i in range(3000)]
    long = [x for i in range(40_000) for x in ([rng.choice(common)] if i % 2 else [f"own line {i} {prose(rng, 3)}"])]
    texts: list[str | None] = ["\n".join(long), *["\n".join(common)] * 3]
    got = dedup_lines(frame(spark, texts)).withColumn("sha", F.sha2(F.encode("text", "UTF-8"), 256))
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.sha) for r in got.collect()} == dict(enumerate(brute_lines(texts)))


def test_lines_of_awkward_tables(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []
    line = "this line is long enough to be dropped"
    table = spark.createDataFrame([*[(i, line, i) for i in (1, 2, 3, 3)], (None, line, 0)], "doc_id long, text string, common int")
    got = sorted((r.doc_id or 0, r.n_dropped, r.text) for r in dedup_lines(table).collect())
    assert got == [(0, 0, line), (1, 1, ""), (2, 1, ""), (3, 0, line), (3, 0, line)]
