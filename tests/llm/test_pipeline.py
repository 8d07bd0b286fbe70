"""The pipeline against its brute-force version, and what every query of the subpackage returns."""

from __future__ import annotations

import hashlib
import random

import pytest

import corpus_pipeline
from priceengine.llm import oracle, queries
from priceengine.llm.staging import shared_folder
from tests.llm.common import SCHEMA, prose
from tests.llm.test_dedup import brute_classes, brute_lines, edited
from tests.llm.test_select import brute_leaks, poisson_count


def corpus(spark, folder: str) -> tuple[list[tuple], list[str], set[int]]:
    """Documents, benchmark items and the ids of junk, written as tables."""
    rng = random.Random(21)
    items = [prose(rng, n) for n in (20, 30, 40)]
    boiler = [prose(rng, 8) for _ in range(3)]
    texts: list[str] = []
    for i in range(160):
        body = prose(rng, rng.randrange(40, 90))
        texts.append(f"{rng.choice(boiler)}\n{body}\n{rng.choice(boiler)}" if i % 3 else body)
    texts += [edited(rng, t.split("\n")[0] if "\n" not in t else t.split("\n")[1], 1) for t in texts[:12]] + texts[20:26]
    texts += [f"{prose(rng, 30)} {item} {prose(rng, 30)}" for item in items]
    junk = set(range(len(texts), len(texts) + 60))
    texts += [" ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in prose(rng, 60).split()) for _ in junk]
    docs = [(i, t, "en", f"s{i % 3}" if i % 5 else "rare", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i not in junk), 0) for i in range(len(texts)) if i % 3 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items, junk


def brute(docs: list[tuple], items: list[str], junk: set[int]) -> dict[int, tuple[int, str]]:
    """(copies, text) by document; that the classifier's decisions are the planted ones is part of the test."""
    import numpy as np  # noqa: F401

    docs = [d for d in docs if d[0] not in junk]
    # brute_lines and brute_classes number by place, which rises with doc_id
    sha = [s for _, _, s in brute_lines([d[1] for d in docs])]
    texts = []
    for d, want in zip(docs, sha, strict=True):
        parts = d[1].split("\n")
        kept = next(t for t in ("\n".join(p for k, p in enumerate(parts) if mask >> k & 1) for mask in range(1 << len(parts))) if hashlib.sha256(t.encode()).hexdigest() == want)
        texts.append(kept)
    first = brute_classes(texts)
    left = [(d, t) for k, (d, t) in enumerate(zip(docs, texts, strict=True)) if first[k] == k]
    leaked = {i for i, _ in brute_leaks([t for _, t in left], items)}
    left = [x for k, x in enumerate(left) if k not in leaked]
    n = {s: sum(d[3] == s for d, _ in left) for s in {d[3] for d, _ in left}}
    weight = {s: c**0.5 for s, c in n.items()}
    rate = {s: weight[s] / sum(weight.values()) * len(left) / n[s] for s in n}
    u = lambda i: (int(hashlib.sha256(f"17:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    out = {d[0]: (poisson_count(u(d[0]), rate[d[3]]), t) for d, t in left}
    return {i: x for i, x in out.items() if x[0]}


def test_pipeline_does_what_its_stages_say(spark, tmp_path):
    docs, items, junk = corpus(spark, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    found: dict[int, tuple[int, str]] = {}
    for r in got:
        found[r.doc_id] = (found.get(r.doc_id, (0, ""))[0] + 1, r.text)
        assert r.n_chars == len(r.text)
    assert found == brute(docs, items, junk)


def test_stages_return_the_columns_of_documents(spark, small_sf):
    docs = queries.table(spark, small_sf, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "mix"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small_sf).columns == docs.columns


def test_pipeline_of_awkward_rows(spark, tmp_path):
    """Nulls in every column, an empty and a very long text, repeated rows and clashing names."""
    rng = random.Random(5)
    docs, _, _ = corpus(spark, str(tmp_path))
    own = [prose(rng, 60) for _ in range(3)]
    odd = [(None, own[0], None, None, None), (9001, None, "en", "s1", None), (9002, "", None, None, 0), (9003, prose(rng, 60_000), "en", "s1", 1), (9004, own[1], "en", "s1", 1), (9004, own[1], "en", "s1", 1)]
    frame = spark.createDataFrame(docs + odd, SCHEMA).selectExpr("*", "'clash' as copy", "1 as label", "2 as __id")
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        if name != "mix":
            assert frame.columns == columns
            got = [r.doc_id for r in frame.where("doc_id > 9000 or doc_id is null").collect()]
            assert sorted(x or 0 for x in got) == [0, 9001, 9002, 9003, 9004, 9004], name
    assert {r.copy for r in frame.collect()} <= set(range(1, 60))


def test_stages_of_an_empty_table(spark, small_sf):
    docs = queries.table(spark, small_sf, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small_sf).collect() == []


def test_queries_are_whole(spark, small_sf):
    """One row for each document, or the rows that the contract names."""
    n = queries.table(spark, small_sf, "documents").count()
    for name, f in queries.queries().items():
        got = f(spark, small_sf)
        if name.split("_")[0] in ("op1", "op3", "op4", "op5", "op6", "op9", "op10"):
            assert got.count() == n, name
    talks = queries.table(spark, small_sf, "conversations").select("conv_id").distinct().count()
    assert queries.op8_chat(spark, small_sf).count() == talks + 1
    assert set(oracle.oracle_sql()) <= set(queries.queries())


def test_a_cluster_without_a_shared_folder_is_told_so():
    class Context:
        applicationId = "none"  # noqa: N815

        def __init__(self, master: str):
            self.master = master

    class Session:
        def __init__(self, master: str, named: str | None):
            self.sparkContext, self.conf = Context(master), {"spark.checkpoint.dir": named} if named else {}

    assert shared_folder(Session("spark://a:1", "hdfs://b/c/")) == "hdfs://b/c" and shared_folder(Session("local[2]", None)).startswith("file:///")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session("spark://a:1", None))
