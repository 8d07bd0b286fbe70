"""Operators 1, 2, 4 and 7."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from priceengine.llm import decontaminate as decontaminate_module
from priceengine.llm import quality, staging
from priceengine.llm.decontaminate import SEEDS, decontaminate, fewest_seeds, find_leaks
from priceengine.llm.mixing import mix_sources, source_rates
from priceengine.llm.quality import keep_good, score_quality, site_posteriors
from priceengine.llm import toxicity
from priceengine.llm.toxicity import TrieAutomaton, learn, score_toxicity
from tests.llm.common import SCHEMA, frame, prose


def osa(a: str, b: str) -> int:
    """Edits with swaps of neighbours."""
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[len(a)][len(b)]


def test_automaton_finds_what_the_edit_distance_says():
    rng = random.Random(1)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randrange(4, 7))): float(i + 1) for i in range(25)}
    automaton = TrieAutomaton(terms)
    for _ in range(3000):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(2, 8)))
        assert automaton.match(word) == max((w for t, w in terms.items() if osa(word, t) <= 1), default=0.0)


def test_automaton_forgets_and_goes_on(monkeypatch):
    terms = {"abcabc": 1.0, "bcbcaa": 2.0}
    once = TrieAutomaton(terms)
    monkeypatch.setattr(toxicity, "STATES", 3)
    again = TrieAutomaton(terms)
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(4, 8))) for _ in range(500)] + list(terms) + ["abcabc" * 50]
    assert [again.match(w) for w in words] == [max((x for t, x in terms.items() if osa(w, t) <= 1), default=0.0) for w in words]
    assert once.match("bcbcaaa") == 2.0


def brute_evidence(model: toxicity.Model, text: str) -> tuple[float, float, int]:
    """(log of the hits' weights, log of the densest window, hits) word by word."""
    hits, at, place = [], 0, 0
    lines = text.split("\n")
    for line in lines:
        for m in re.finditer(r"[0-9A-Za-z'\u0080-\U0010ffff]+", line):
            word = m.group().lower()
            weight = model.terms.get(word, 0.0)
            if not weight and len(word.encode()) >= toxicity.MIN_FUZZY - 1 and word not in model.harmless:
                weight = toxicity.MISSPELLED * max((x for t, x in model.terms.items() if len(t) >= toxicity.MIN_FUZZY and osa(word, t) <= 1), default=0.0)
            if weight:
                quoted = line[: m.start()].count('"') % 2 == 1 and '"' in line[m.end() :]
                hits.append((place, weight * (toxicity.QUOTED if quoted else 1.0)))
            place += 1
        at += len(line) + 1
    dense = max((sum(w for q, w in hits if abs(p - q) <= toxicity.WINDOW) for p, _ in hits), default=0.0)
    return math.log1p(sum(w for _, w in hits)), math.log1p(dense), len(hits)


def test_evidence_is_that_of_word_by_word_scores():
    rng = random.Random(13)
    model = toxicity.Model({"grobelix": 3.0, "vunterok": 2.0, "smargulon": 4.5, "bad": 1.5}, harmless=frozenset(["grobelit"]))
    near = ["grobelix", "grobelx", "gorbelix", "grobelit", "vunteroks", "smargulom", "bad", "bed", "SMARGULON", "vunterok" * 20]
    texts = ["", "\n"]
    for _ in range(200):
        words = [rng.choice(near) if rng.random() < 0.2 else prose(rng, 1) for _ in range(rng.randrange(60))]
        words = [w + rng.choice(["", "", "", ",", '"', "\n"]) if rng.random() < 0.7 else '"' + w for w in words]
        texts.append(" ".join(words))
    raw = [t.encode() for t in texts]
    total, dense, count = toxicity.evidence(model, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for i, t in enumerate(texts):
        assert (total[i], dense[i], count[i]) == pytest.approx(brute_evidence(model, t)), t


def toxic_corpus(spark, n: int = 600):
    rng = random.Random(5)
    bad = ["grobelix", "vunterok", "smargulon"]
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randrange(20, 80)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                w = rng.choice(bad)
                if rng.random() < 0.4:
                    k = rng.randrange(1, len(w) - 1)
                    w = w[:k] + "x" + w[k + 1 :]
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_documents(spark):
    docs, labels = toxic_corpus(spark)
    model = learn(docs, labels.where("doc_id < 400"))
    got = score_toxicity(docs, model).join(labels, "doc_id").where("doc_id >= 400").collect()
    right = sum((r.toxicity >= 0.3) == bool(r.toxic) for r in got)
    assert right / len(got) > 0.97


def test_quoted_terms_count_less(spark):
    docs, labels = toxic_corpus(spark)
    model = learn(docs, labels)
    texts = ["he said grobelix to them and grobelix again", 'he said "grobelix" to them and "grobelix" again', "", None, "grobelix " * 20_000]
    got = {r.doc_id: r.toxicity for r in score_toxicity(frame(spark, texts), model).collect()}
    assert got[0] > got[1] > got[2] == got[3] and 0.9 < got[4] <= 1


def test_toxicity_without_labels(spark):
    docs = frame(spark, ["a b", None])
    none = spark.createDataFrame([(0, None), (1, 3)], "doc_id long, toxic int")
    got = score_toxicity(docs.withColumn("toxicity", F.lit("clash")), learn(docs, none)).collect()
    assert all(0 <= r.toxicity <= 1 for r in got) and len(got) == 2
    assert score_toxicity(spark.createDataFrame([], SCHEMA), learn(docs, none)).collect() == []


def brute_leaks(texts: list[str | None], items: list[str], min_overlap: int = 8, share: float = 0.8) -> set[tuple[int, int]]:
    """Every shift of every pair."""
    out = set()
    for j, item in enumerate(items):
        b = item.lower().split()
        for i, t in enumerate(texts):
            a = (t or "").lower().split()
            for shift in range(-len(b) + min_overlap, len(a) - min_overlap + 1):
                lo, skip = max(shift, 0), max(-shift, 0)
                n = min(len(a) - lo, len(b) - skip)
                hit = [a[lo + k] == b[skip + k] for k in range(max(n, 0))]
                run = max((sum(hit[k : k + 13]) for k in range(max(n - 13, 0) + 1)), default=0)
                if n >= min_overlap and len(b) >= min_overlap and (sum(hit) >= share * n or run >= share * 13):
                    out.add((i, j))
    return out


def test_leaks_are_those_of_all_shifts(spark):
    rng = random.Random(6)
    items = [prose(rng, n) for n in (8, 9, 12, 13, 20, 40, 7, 120)]
    texts: list[str | None] = [None, "", prose(rng, 3000)]
    for item in items:
        texts += [f"{prose(rng, 10)} {item.upper()} {prose(rng, 10)}", item]
        words = item.split()
        if len(words) >= 20:
            words[5] = "replaced"
            texts.append(prose(rng, 5) + " " + " ".join(words))
            texts.append(" ".join(words[len(words) // 2 :]) + " " + prose(rng, 30))
    bench = spark.createDataFrame([*enumerate(items), (None, "x"), (99, None)], "item_id long, text string")
    docs = frame(spark, texts)
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()}
    true = brute_leaks(texts, items)
    part = lambda i, j: len(items[j].split()) >= 40 and " ".join(items[j].split()[len(items[j].split()) // 2 :]) in texts[i]
    planted = {(i, j) for i, j in true if texts[i] and (items[j].lower() in texts[i].lower() or "replaced" in texts[i] or part(i, j))}
    assert any(part(i, j) and items[j] not in texts[i] and "replaced" not in texts[i] for i, j in planted)
    assert got <= true and planted <= got
    assert {r.doc_id for r in decontaminate(docs, bench).collect()} == set(range(len(texts))) - {i for i, _ in got}


def test_leaks_are_those_of_the_sql(spark, small_sf):
    """The SQL looks at every shift."""
    import duckdb

    from priceengine.llm.oracle import oracle_sql
    from priceengine.llm.queries import op2_decontaminate

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_sf}/{t}.parquet'")
    columns = ["doc_id", "item_id", "shift", "n_overlap", "n_agree", "n_run"]
    true = con.execute(f"SELECT {', '.join(columns)} FROM ({oracle_sql()['op2_decontaminate']})").fetchall()
    assert sorted(map(tuple, op2_decontaminate(spark, small_sf).select(columns).collect())) == sorted(true) and true


def test_leaks_of_one_repeated_word(spark):
    """A word that fills document and item agrees at every shift; ties go to the least shift."""
    bench = spark.createDataFrame([(1, "no " * 12)], "item_id long, text string")
    docs = frame(spark, ["no " * 3000, "no " * 9, "no " * 7])
    got = {r.doc_id: (r.shift, r.n_overlap, r.n_agree, r.n_run) for r in find_leaks(docs, bench).collect()}
    assert got == {0: (0, 12, 12, 12), 1: (-3, 9, 9, 9)}


def test_leaks_of_awkward_tables(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
    empty = spark.createDataFrame([], SCHEMA)
    assert find_leaks(empty, bench).collect() == []
    docs = spark.createDataFrame([(1, bench.first().text, 1), (1, "x", 2), (None, bench.first().text, 3)], "doc_id long, text string, item_id int")
    assert [(r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()] == [(1, 1)]
    assert find_leaks(docs, spark.createDataFrame([], "item_id long, text string")).collect() == []


def quality_corpus(spark, n: int = 400):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        text = prose(rng, rng.randrange(30, 120))
        if not good:
            text = " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in text.split())
        rows.append((i, text, "en", f"s{i % 7}" if good or i % 8 else "junk", len(text)))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_keeps_clean_documents_and_rejects_junk(spark):
    docs, labels = quality_corpus(spark)
    scored = score_quality(docs, labels.where("doc_id < 250")).join(labels, "doc_id").where("doc_id >= 250").collect()
    assert all((r.quality_score >= 0.3) == bool(r.quality) for r in scored)
    assert keep_good(docs, labels).columns == docs.columns


def test_a_sparse_site_falls_back_to_the_global_prior(spark):
    docs, labels = quality_corpus(spark)
    text = docs.where("doc_id = 1").first().text
    more = docs.unionByName(spark.createDataFrame([(1000, text, "xx", "unseen", 1), (1001, text, None, None, 1), (1002, "", "en", "s1", 0), (1003, None, "en", "s1", 0)], SCHEMA))
    got = {r.doc_id: r for r in score_quality(more, labels).collect()}
    share = labels.agg(F.avg("quality")).first()[0]
    assert abs(got[1000].prior - share) < 0.02 and got[1000].prior == got[1001].prior
    assert got[1002].quality_score == got[1003].quality_score


def brute_posteriors(rows: list[tuple[int, str, str]]) -> tuple[float, dict, dict]:
    """(global rate, rate by host, rate by path) from (quality, source, lang), by the definitions."""
    n, k = len(rows), sum(q for q, _, _ in rows)
    mean = (k + 1) / (n + 2)
    hosts, paths = {}, {}
    for q, s, lang in rows:
        hosts.setdefault(s, []).append(q)
        paths.setdefault((s, lang), []).append(q)

    def strength(spread: float, noise: float, weight: float, variance: float) -> float:
        between = max((spread - noise) / weight, 1e-9) if weight > 0 else variance / 101
        return min(max(variance / between - 1, 2.0), 10_000.0)

    v = mean * (1 - mean)
    a = strength(sum(len(x) * (sum(x) / len(x) - mean) ** 2 for x in hosts.values()), v * (len(hosts) - 1), n - sum(len(x) ** 2 for x in hosts.values()) / n, v)
    host = {s: (sum(x) + mean * a) / (len(x) + a) for s, x in hosts.items()}
    rest = {p: 1 - len(x) / len(hosts[p[0]]) for p, x in paths.items()}
    own = {s: r * (1 - r) for s, r in host.items()}
    weight = sum(len(x) * rest[p] for p, x in paths.items())
    spread = sum(len(x) * (sum(x) / len(x) - sum(hosts[p[0]]) / len(hosts[p[0]])) ** 2 for p, x in paths.items())
    b = strength(spread, sum(own[p[0]] * rest[p] for p in paths), weight, sum(len(x) * rest[p] * own[p[0]] for p, x in paths.items()) / weight if weight else v)
    return mean, host, {p: (sum(x) + host[p[0]] * b) / (len(x) + b) for p, x in paths.items()}


@pytest.mark.parametrize("hosts", [1, 2, 9])
def test_site_posteriors_are_those_of_the_definitions(spark, hosts):
    rng = random.Random(hosts)
    rate = {(f"s{h}" if h else None, lang): rng.random() for h in range(hosts) for lang in ("en", "de", None)}
    rows = [(int(rng.random() < rate[p]), *p) for p in rate for _ in range(rng.randrange(1, 60))]
    mean, host, path = site_posteriors(spark.createDataFrame(rows, "quality int, source string, lang string"))
    true = brute_posteriors(rows)
    assert mean == pytest.approx(true[0])
    assert {r[0]: r[1] for r in host.collect()} == pytest.approx(true[1])
    assert {(r[0], r[1]): r[2] for r in path.collect()} == pytest.approx(true[2])


def test_quality_of_contradictory_and_long_rows(spark):
    docs, labels = quality_corpus(spark)
    more = docs.unionByName(spark.createDataFrame([(None, "kan lor", "en", "s1", 7), (2000, "kanlo " * 60_000, "en", "s1", 1), (2001, "kanlo " * 60_000, "en", "s1", 1)], SCHEMA))
    twice = labels.unionByName(spark.createDataFrame([(1, 0, 0), (None, 0, 0)], labels.schema))
    got = {r.doc_id: r.quality_score for r in score_quality(more, twice).collect()}
    assert len(got) == more.count() and got[2000] == got[2001]
    assert got[1] == {r.doc_id: r.quality_score for r in score_quality(more, labels).collect()}[1]


def test_quality_of_awkward_tables(spark):
    docs, labels = quality_corpus(spark, 8)
    assert score_quality(spark.createDataFrame([], SCHEMA), labels).collect() == []
    none = labels.where("false")
    assert {r.quality_score for r in score_quality(docs.withColumn("prior", F.lit(1)), none).collect()} == {0.5}
    assert keep_good(docs, none).count() == 8


def poisson_count(u: float, rate: float) -> int:
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u and k < 192:
        k += 1
        p *= rate / k
        total += p
    return k


def test_mixing_draws_poisson_counts(spark):
    import hashlib

    n = 4000
    rows = [(i, f"t{i}", "en", "big" if i % 4 else "little", 2) for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix_sources(docs, {"big": 1.0, "little": 1.0}, seed=3).collect()
    copies = Counter(r.doc_id for r in got)
    rate = {"big": 0.5 * n / (n * 3 // 4), "little": 0.5 * n / (n // 4)}
    for i, _, _, source, _ in rows:
        u = (int(hashlib.sha256(f"3:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        assert copies[i] == poisson_count(u, rate[source])
    by = Counter(r.source for r in got)
    assert abs(by["big"] / by["little"] - 1) < 0.1
    keys = [r.order_key for r in got]
    assert keys == sorted(keys)


def test_mixing_of_awkward_tables(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(None, None, "en", None, 0)] * 3 + [(1, "", "en", "a", 0)], SCHEMA).withColumn("copy", F.lit("x"))
    got = mix_sources(docs, epochs=20.0).collect()
    assert {r.source for r in got} == {None, "a"} and all(isinstance(r.copy, int) for r in got)
    assert mix_sources(docs, {"a": 2.0}).where("source is null").count() == 0
    assert source_rates(docs, {"b": 1.0}, 0.5, 1.0).agg(F.max("rate")).first()[0] == pytest.approx(0.0)


def test_mixing_is_that_of_its_sql(spark, tmp_path):
    """With a source whose rate is beyond one draw, nulls and repeated rows."""
    import duckdb

    from priceengine.llm.oracle import OP7

    rows = [(i, f"t{i}", "en", "big" if i >= 1 else "rare", 1) for i in range(40_000)] + [(None, None, "en", None, 0), (3, "t3", "en", "big", 1), (3, "t3", "en", "big", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    true = Counter((d, s, c, k) for d, s, c, k, _ in con.execute(OP7).fetchall())
    got = Counter((r.doc_id, r.source, r.copy, r.order_key) for r in mix_sources(docs).collect())
    assert got == true and sum(n for (d, *_), n in got.items() if d == 0) > 64


def test_mixing_of_a_rare_source_reaches_its_weight(spark):
    docs = spark.createDataFrame([(i, "t", "en", "big" if i >= 10 else "rare", 1) for i in range(4000)], SCHEMA)
    assert source_rates(docs, {"big": 1.0, "rare": 1.0}, 0.5, 1.0).where("__source = 'rare'").first().rate == pytest.approx(200.0)
    copies = Counter(r.doc_id for r in mix_sources(docs, {"big": 1.0, "rare": 1.0}, seed=3).collect() if r.source == "rare")
    assert len(set(copies.values())) > 3 and abs(sum(copies.values()) / 2000 - 1) < 0.1
    assert all(120 < n < 280 for n in copies.values())


def test_a_seed_stays_whole_in_every_accepted_placement():
    """More than 15 words split into stretches of 8 to 15, of which one has no more than its share of the replaced words."""
    for n in range(8, 26):
        seeds = [sum(1 << (i + k) for k, c in enumerate(m) if c == "1") for m in SEEDS for i in range(n - len(m) + 1)]
        for out in combinations(range(n), n // 5):
            gone = sum(1 << k for k in out)
            assert any(not s & gone for s in seeds)


def test_the_fewest_seeds_are_counted_by_trying_all(spark):
    least = fewest_seeds(0.8)
    for n in range(8, 24):
        per = [sum(all(c == "0" or i + k not in out for k, c in enumerate(m)) for m in SEEDS for i in range(n - len(m) + 1)) for out in combinations(range(n), n // 5)]
        assert 1 <= least[n] <= min(per)
    assert least[-1] <= min(least[16:]) and least[10] == 1 and min(least[11:]) == 2


def test_a_phrase_of_every_document_and_item_makes_no_candidates(spark, monkeypatch):
    rng = random.Random(6)
    phrase = "once upon a time"
    items = [f"{prose(rng, 9)} {phrase} {prose(rng, 9)}" for _ in range(40)]
    texts: list[str | None] = [f"{prose(rng, 30)} {phrase} {prose(rng, 30)}" for _ in range(200)]
    texts[7] = f"{prose(rng, 5)} {items[3]} {prose(rng, 5)}"
    kept = {}

    def watched(df, name):
        kept[name] = staging.staged(df, name)
        return kept[name]

    monkeypatch.setattr(decontaminate_module, "staged", watched)
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(frame(spark, texts), bench).collect()}
    assert got == brute_leaks(texts, items) == {(7, 3)}
    # of 8,000 pairs only those that agree beside the phrase, too, in a vocabulary of 160 words
    assert kept["hits"].selectExpr("sum(size(__hits))").first()[0] < 400 and kept["hits"].schema["__hits"].dataType.elementType.names == ["item_id", "shift", "__len"]


def test_evidence_of_quality_is_that_of_its_definition(spark):
    rng = random.Random(12)
    texts = [prose(rng, rng.randrange(5, 60)) if i % 3 else "$$$ BUY!! " * rng.randrange(1, 30) + prose(rng, rng.randrange(9)) for i in range(120)]
    rows = [(i, t, rng.choice(["en", "fr"]), f"s{rng.randrange(4)}", len(t)) for i, t in enumerate(texts)]
    labels = [(i, int(i % 3 > 0) if rng.random() < 0.9 else int(i % 3 == 0)) for i in range(90)]
    got = {r.doc_id: r for r in score_quality(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    raw = [t.encode() for t in texts]
    bins = quality.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    good, bad = Counter(), Counter()
    for i, q in labels:
        for f, b in enumerate(bins[i]):
            (good if q else bad)[f, int(b)] += 1
    n1, n0 = sum(q for _, q in labels), sum(1 - q for _, q in labels)
    rate, ratio = n1 / (n1 + n0), np.zeros((len(quality.FEATURES), quality.BINS))
    for f, b in {*good, *bad}:
        ratio[f, b] = math.log((good[f, b] + rate) / (n1 + rate)) - math.log((bad[f, b] + 1 - rate) / (n0 + 1 - rate))
    x = ratio[np.arange(len(quality.FEATURES)), bins]
    # the weights by plain gradient descent on the same penalised likelihood
    fit, y = np.column_stack([x[:90], np.ones(90)]), np.array([q for _, q in labels], float)
    centre, pull = np.append(np.full(len(quality.FEATURES), 0.5), 0.0), np.append(np.full(len(quality.FEATURES), 3.0), 1e-3)
    w = centre.copy()
    for _ in range(40_000):
        w -= 2e-3 * (fit.T @ (1 / (1 + np.exp(-fit @ w)) - y) + pull * (w - centre))
    evidence = x @ w[:-1] + w[-1] - math.log(rate / (1 - rate))
    for i in range(len(rows)):
        assert abs(got[i].evidence - evidence[i]) < 1e-3
        site = math.log(got[i].prior / (1 - got[i].prior))
        assert math.isclose(got[i].quality_score, 1 / (1 + math.exp(-(site + got[i].evidence))), rel_tol=1e-9)


def test_leaks_with_any_words_replaced(spark):
    rng = random.Random(8)
    items = [prose(rng, n) for n in (8, 9, 10, 12, 13, 15, 20, 25)]
    texts: list[str | None] = []
    for item in items:
        n = len(item.split())
        for r in range(1, n // 5 + 1):
            spread = [sorted(rng.sample(range(n), r)) for _ in range(6)]
            for out in [[0, *range(n - r + 1, n)], list(range(n - r, n)), list(range(r, n, n // r))[:r], *spread]:
                words = [f"x{k}" if k in out else w for k, w in enumerate(item.split())]
                texts.append(" ".join([*prose(rng, rng.randrange(4)).split(), *words, *prose(rng, 3).split()]))
        texts.append(" ".join(item.split()[-8:]) + " " + prose(rng, 5))
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(frame(spark, texts), bench).collect()}
    assert got == brute_leaks(texts, items) and len({i for i, _ in got}) == len(texts)
