"""Operator 13: a Merkle manifest of a dataset, with a proof for each row.

A row's leaf is the hash of its fields. Leaves of a source, in order of doc_id, are the bottom of a tree whose nodes are
hashes of 16 children; the roots of the sources, in order of the source, are the bottom of one more tree.

Rows get their number within the source by a range partitioning on (source, doc_id) and the counts of earlier
partitions, so a hot source is numbered by many tasks. Trees are built event by event: a task takes nodes as they come and
gathers the children of each parent, by their index, until there are as many as the size of the tree says; then the parent
is hashed, written with its children, and is itself a child of the parent above. Parents still waiting when a task ends
give their children back: they are dealt out again, two levels higher, until none is left. A round deals nodes by their ancestor
`STEP` levels up, so that at most 16 ** STEP nodes are bound to one task however large a source is, and comes in order, so that a
task holds a few open parents only.

Proofs go the way back: from the top, each node passes down, level by level, what stands left and right of it in its run.
Leaves meet the parent of their run, which has the whole way to the root; no proof is stored for each row of a run on its own.

Cases: null fields are hashed as `-`; a null source is a source and comes first; null doc_ids come first in their source. Repeated
doc_ids are ordered by their leaf; equal rows have equal leaves and each its own place. Very long texts are hashed by
Spark, whole. Empty texts are hashed as such. An empty table gives an empty manifest. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priceengine.llm.line_dedup import LOWER, UPPER
from priceengine.llm.staging import counted, map_arrow, staged

ARITY, BITS = 16, 4
#: Levels that a round climbs.
STEP = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree long, n long, level int, idx long, digest string, children array<string>"


def field(value: Column) -> Column:
    """`-` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def ascii_lower(text: Column) -> Column:
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def depth(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """`df` with idx (from 0, by `order`, nulls first) within each `group`, and n, the rows of the group."""
    keys = [group, *order]
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = staged(spread.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}), name)
    blocks = rows.groupBy(group, "__part").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    of_group = Window.partitionBy(group)  # a row for each partition
    shift = F.sum("__n").over(of_group.orderBy("__part")) - F.col("__n") - F.col("__first")
    known = blocks.select(F.col(group).alias("__group"), F.col("__part").alias("__at"), shift.alias("__shift"), F.sum("__n").over(of_group).alias("n"))
    met = rows.join(known, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__at")))
    return met.withColumn("idx", F.col("__row") + F.col("__shift")).drop("__part", "__row", "__group", "__at", "__shift")


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes come; parents go out, with their children, and the nodes (without children) whose parents lack some."""
    waiting: dict[tuple[int, int, int], tuple[int, dict[int, str]]] = {}
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["tree", "n", "level", "idx", "digest", "children"])

    for batch in batches:
        for tree, n, level, idx, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            wide = -(-n // ARITY**level)  # nodes of this level
            while wide > 1:
                key = (tree, level + 1, idx >> BITS)
                children = waiting.setdefault(key, (n, {}))[1]
                children[idx] = digest
                if len(children) < min(ARITY, wide - (idx >> BITS << BITS)):
                    break
                del waiting[key]
                inside = [children[i] for i in sorted(children)]
                level, idx, digest, wide = level + 1, idx >> BITS, hashlib.sha256("".join(inside).encode()).hexdigest(), -(-wide // ARITY)
                out.append((tree, n, level, idx, digest, inside))
        if len(out) > 4096:
            yield flush()
            out = []
    for (tree, level, _), (n, children) in waiting.items():
        out += [(tree, n, level - 1, i, digest, None) for i, digest in children.items()]
    yield flush()


def parents(nodes: DataFrame, name: str) -> DataFrame:
    """All inner nodes, with their children, above the leaves (tree, n, level 0, idx, digest)."""
    found, height = None, STEP
    while True:
        up = F.expr(f"shiftright(idx, {BITS} * ({height} - level))")
        dealt = nodes.select("tree", "n", "level", "idx", "digest", up.alias("__up")).repartition("tree", "__up").sortWithinPartitions("tree", "__up", "level", "idx")
        out, waiting = counted(map_arrow(dealt.drop("__up"), _climb, NODE), f"{name}-{height}", F.col("children").isNull())
        done = out.where(F.col("children").isNotNull())
        found = done if found is None else found.unionByName(done)
        if not waiting:
            return found
        nodes, height = out.where(F.col("children").isNull()), height + STEP


def _step(position: Column) -> Column:
    """What stands left and right of a child in its run."""
    left = F.array_join(F.slice("children", F.lit(1), position), "")
    right = F.array_join(F.slice("children", position + 2, F.lit(ARITY)), "")
    return F.struct(left.alias("left"), right.alias("right"))


def with_proofs(leaves: DataFrame, inner: DataFrame, roots: DataFrame, levels: int) -> DataFrame:
    """`leaves` (tree, n, idx, ...) with `steps`, from the leaf's run up to the last root, and the columns of `roots`.

    roots: (tree, steps, ...): what stands above the root of each tree.
    """
    told = [c for c in roots.columns if c not in ("tree", "steps")]

    def under(nodes: DataFrame, above: DataFrame) -> DataFrame:
        met = nodes.withColumn("__up", F.shiftright("idx", BITS)).join(above.select(F.col("tree").alias("__tree"), F.col("idx").alias("__idx"), "children", F.col("steps").alias("__steps"), *told), (F.col("tree") == F.col("__tree")) & (F.col("__up") == F.col("__idx")))
        position = F.pmod(F.col("idx"), F.lit(ARITY)).cast("int")
        return met.withColumn("steps", F.concat(F.array(_step(position)), F.col("__steps"))).drop("__up", "__tree", "__idx", "__steps", "children")

    above = None
    wide = F.ceil(F.col("n") / F.pow(F.lit(float(ARITY)), F.col("level")))
    for level in range(levels, 0, -1):
        here = inner.where(F.col("level") == level)
        out = here.where(wide == 1).join(roots, "tree")
        if above is not None:
            own = here.where(wide > 1).withColumnRenamed("children", "own")
            out = out.unionByName(under(own, above).withColumnRenamed("own", "children"))
        above = out
    single = leaves.where(F.col("n") == 1).join(roots, "tree")
    return single if above is None else single.unionByName(under(leaves.where(F.col("n") > 1), above))


def folded(start: Column) -> Column:
    """The root that a leaf and its steps lead to."""
    return F.aggregate("steps", start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, source, idx, n, leaf, changed_leaf, subroot, root, steps) of every row; changed_leaf: with `tampered` as its text."""
    hashed = docs.select(F.col("doc_id"), F.col("source"), leaf().alias("leaf"), (leaf() if tampered is None else leaf(text=tampered)).alias("changed_leaf"))
    rows = numbered(hashed, "source", ["doc_id", "leaf", "changed_leaf"], "leaves")
    sources = staged(numbered(rows.where(F.col("idx") == 0).select("source").withColumn("__all", F.lit(0)), "__all", ["source"], "sources").select("source", F.col("idx").alias("tree")), "trees")
    placed = rows.join(sources.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    placed = staged(placed, "placed")
    inner = parents(placed.select("tree", "n", F.lit(0).alias("level"), "idx", F.col("leaf").alias("digest")), "nodes")
    sizes = placed.where(F.col("idx") == 0).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("trees")).first()
    if not sizes.trees:
        none = F.lit(None).cast("string")
        return placed.select("doc_id", "source", "idx", "n", "leaf", "changed_leaf", none.alias("subroot"), none.alias("root"), F.lit(None).cast("array<struct<left:string,right:string>>").alias("steps"))
    top = F.ceil(F.col("n") / F.pow(F.lit(float(ARITY)), F.col("level"))) == 1
    subroots = inner.where(top).select("tree", F.col("digest").alias("subroot")).unionByName(placed.where(F.col("n") == 1).select("tree", F.col("leaf").alias("subroot")))
    bottom = staged(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(sizes.trees).alias("n"), F.lit(0).alias("level"), F.col("tree").alias("idx"), "subroot"), "subroots")
    upper = parents(bottom.withColumnRenamed("subroot", "digest"), "upper")
    last = (upper.where(top) if sizes.trees > 1 else bottom.withColumnRenamed("subroot", "digest")).select("tree", F.col("digest").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("steps"))
    above = staged(with_proofs(bottom, upper, last, depth(sizes.trees)).select(F.col("idx").alias("tree"), "subroot", "root", "steps"), "above")
    proved = with_proofs(placed, inner, above, depth(sizes.n))
    return proved.select("doc_id", "source", "idx", "n", "leaf", "changed_leaf", "subroot", "root", "steps")


def digest(proved: DataFrame) -> DataFrame:
    """Proofs as hashes, and whether each row, as it stands now, still leads to the root."""
    siblings = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    return proved.select(
        "doc_id", "leaf", "subroot", "root", siblings.alias("proof_sha256"), folded(F.col("changed_leaf")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
