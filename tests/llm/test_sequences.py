"""Operators 11, 12 and 13."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from priceengine.llm import divergence, manifest, packing
from tests.llm.common import SCHEMA, frame, prose

PATH = public_tokenizers.path("word_bpe_49k.json")
AWKWARD = st.lists(st.sampled_from([*"aZs'!.9<|> \n é̸́=…Σ_", "'s", "'LL", "word", "WORD", "<|endoftext|>", "<|ENDOFTEXT|>", "東京", "don't", "x=1;"]), max_size=14).map("".join)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def ids():
    return packing.Ids(PATH)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(AWKWARD, min_size=1, max_size=4))
def test_word_by_word_gives_the_ids_of_whole_texts(tokenizer, ids, texts):
    assert ids.by_word
    raw = [t.encode() for t in texts]
    got, counts = ids.of_texts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    true = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(t) for t in true] and got.tolist() == sum(true, [])


def test_other_tokenizers_get_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    assert not packing.Ids(path).by_word
    texts = ["Some words  here", "", "one more"]
    got = {tuple(r.doc_ids): r.ids for r in packing.sequences(packing.pack(frame(spark, texts), path, max_len=5)).collect()}
    assert Counter(i for v in got.values() for i in v) == Counter(i for t in texts for i in [*whole.encode(t, add_special_tokens=False).ids, 1])


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(0, 5), max_size=8))
def test_bins_are_the_fullest_for_their_largest_piece(counts):
    left = Counter({c: n for c, n in counts.items() if n})
    for bin_, times in packing.minimum_slack(counts, 20):
        for _ in range(times):
            largest = max(c for c, n in left.items() if n)
            rest = Counter(left)
            rest[largest] -= 1
            sums = {0}
            for c in rest.elements():
                sums |= {s + c for s in sums if s + c <= 20 - largest}
            assert largest in bin_ and sum(c * n for c, n in bin_.items()) == largest + max(sums)
            left.subtract(bin_)
            assert min(left.values()) >= 0
    assert not any(left.values())


def test_every_piece_has_a_place_of_its_own(spark, tokenizer):
    rng = random.Random(5)
    texts = [None, "", "x", *[prose(rng, rng.choice([1, 3, 9, 30, 80])) for _ in range(150)], prose(rng, 3000), "<|endoftext|> A'S", "same", "same"]
    rows = [(i, t, "en", "web", 1, "clash") for i, t in enumerate(texts)] + [(None, "no id", "en", "web", 1, "clash"), (9, texts[9], "en", "web", 1, "clash")]
    docs = spark.createDataFrame(rows, SCHEMA + ", length string").repartition(5)
    packed = packing.pack(docs, PATH, max_len=64)
    places = packed.places.collect()
    true = Counter()
    for r in rows:
        own = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(own), 64):
            true[(r[0], k // 64, k, len(own[k : k + 64]), zlib.crc32(np.array(own[k : k + 64], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in places) == true
    inside = defaultdict(list)
    for r in places:
        inside[r.sequence_id].append((r.offset, r.length))
    for parts in inside.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in places)
    assert len(inside) <= -(-total // 64) + 1
    got = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert got.keys() == inside.keys() and all(len(r.ids) == r.n_tokens for r in got.values())
    for r in places:
        own = got[r.sequence_id].ids[r.offset : r.offset + r.length]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
    assert packing.pack(docs.where("false"), PATH).places.collect() == []


def audited(rows: list[tuple], min_docs: int, top: int) -> set[tuple]:
    """The audit by its definition."""
    held, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        held[lang].update(set(terms))
        count[lang, source].update(terms)
    out = set()
    for lang, source in groups:
        kept = sorted(t for t, n in held[lang].items() if n >= min_docs)
        others = sorted(s for x, s in groups if x == lang)
        all_ = Counter()
        for s in others:
            all_.update(count[lang, s])

        def p(c: Counter, t: str, kept=kept) -> int:
            return 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept))

        share = {s: [p(count[lang, s], t) for t in kept] for s in others}
        far = [(-sum(abs(a - b) for a, b in zip(share[source], share[s], strict=True)), s.encode(), s) for s in others if s != source]
        out |= {(lang, source, "pair", s, -v, k) for k, (v, _, s) in enumerate(sorted(far), 1)}
        over = [(p(all_, t) - x, t.encode(), t) for t, x in zip(kept, share[source], strict=True) if count[lang, source][t] and x > p(all_, t)]
        out |= {(lang, source, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(over)[:top], 1)}
    return out


@pytest.mark.parametrize(("dense_share", "tile_sources"), [(8, 256), (3, 256), (1, 256), (3, 4), (1, 5), (1000, 7)])
def test_distances_are_those_of_all_terms(spark, dense_share, tile_sources):
    """All tiles, all postings and both, in one block of sources and in several."""
    rng = random.Random(dense_share)
    rows = []
    for i in range(400):
        s = rng.randrange(19)
        words = ["the", "Of", "été"] * rng.randrange(3) + [f"w{chr(97 + (s * rng.randrange(4)) % 26)}x" for _ in range(6)] + [f"rare{chr(97 + rng.randrange(26))}" for _ in range(2)]
        rows.append((i, " 7".join(words), rng.choice(["en", "en", "fr", None]), f"s{s}" if s else None, 1))
    rows += [(1, None, "en", "empty", 1), (2, "", "only", "one", 1), (2, "", "only", "one", 1), (None, "the the", "en", "é", 1), (3, "the " * 5000, "en", "s1", 1)]
    got = {tuple(r) for r in divergence.audit(spark.createDataFrame(rows, SCHEMA), 5, 7, dense_share, tile_sources).collect()}
    assert got == audited(rows, 5, 7)


def test_an_audit_of_nothing_is_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    (a, b) = divergence.audit(spark.createDataFrame([(1, "x", "en", "a", 1), (2, "y", "en", "b", 1)], SCHEMA)).collect()
    assert (a.value, b.value, {a.item, b.item}) == (0, 0, {"a", "b"})


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def hashed(row: tuple) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root and, for each node, what stands left and right of it at each level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
            ways[k].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        nodes, at = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)], [i // 16 for i in at]
    return nodes[0], ways


def proved(rows: list[tuple], changed) -> Counter:  # noqa: ANN001
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, hashed(r), hashed((r[0], changed(r), *r[2:]))))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([x[2] for x in sorted(by[s])]) for s in order]
    root, ways = climb([t[0] for t in trees])
    out = Counter()
    for s, (subroot, own), up in zip(order, trees, ways, strict=True):
        for (known, doc, leaf, other), way in zip(sorted(by[s]), own, strict=True):
            acc = other
            for left, right in [*way, *up]:
                acc = sha(left + acc + right)
            out[doc if known else None, leaf, subroot, root, sha("".join(a + b for a, b in [*way, *up])), acc, acc == root] += 1
    return out


@pytest.mark.parametrize("sources", [1, 2, 40])
def test_proofs_are_those_of_the_definition(spark, sources):
    rng = random.Random(sources)
    rows = [(i, rng.choice(["Aé", "b C", "", None]), rng.choice(["en", None]), f"s{i % 97 % sources}", rng.choice([3, None])) for i in range(900)]
    rows += [(None, "x", "en", "s0", 1), (5, "Twice", "en", "s0", 1), (5, "Twice", "en", "s0", 1), (5, "Other", "en", "s0", 1), (7, "L" * 300_000, "en", "s0", 1)]
    if sources > 1:
        rows += [(1, "Lone", "en", None, 1), (10_000, "lone", "en", "é", 1)]
    lower = lambda r: r[1] if r[1] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 else re.sub("[A-Z]", lambda m: m[0].lower(), r[1])
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", idx string").repartition(6)
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = manifest.digest(manifest.manifest(docs, F.when(hit, manifest.ascii_lower(F.col("text"))).otherwise(F.col("text")))).collect()
    assert Counter(map(tuple, got)) == proved(rows, lower)
    assert {r.verified for r in got} == {True, False}


def test_a_manifest_of_one_row_and_of_none(spark):
    (r,) = manifest.digest(manifest.manifest(frame(spark, ["one"]))).collect()
    assert (r.leaf, r.subroot, r.root, r.verified, r.proof_sha256) == (r.folded_root, r.leaf, r.leaf, True, sha(""))
    assert manifest.digest(manifest.manifest(frame(spark, ["one"]).where("false"))).collect() == []


def test_trees_of_many_levels(spark):
    """A hundred thousand leaves of one source, over several rounds."""
    docs = spark.range(70_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    got = manifest.digest(manifest.manifest(docs))
    (r,) = got.agg(F.count(F.lit(1)).alias("n"), F.count_if("verified").alias("good"), F.first("root").alias("root")).collect()
    root, _ = climb_root([hashed((i, "t", "en", "hot", 1)) for i in range(70_000)])
    assert (r.n, r.good, r.root) == (70_000, 70_000, root)


def climb_root(nodes: list[str]) -> tuple[str, int]:
    levels = 0
    while len(nodes) > 1:
        nodes, levels = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)], levels + 1
    return nodes[0], levels
