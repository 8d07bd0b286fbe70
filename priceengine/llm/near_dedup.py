"""Operator 3: near-duplicate documents by BagMinHash.

A text is the multiset of its runs of five words (white space parts words, A-Z count as a-z). Two texts are linked if
their weighted Jaccard similarity, the sum of the smaller counts over the sum of the larger ones, is 0.8 or more; a
class is what links connect. A text of one to four words is one run; a text without words is like no other.

Signatures. The weight axis is cut at 0, 1, 2, 4, 8, ...; every run of words has a Poisson process of points on each
of these intervals that its count reaches, and a point counts if its weight lies under the count (so at most half are
thrown away). Points come in order of time and fall into one of SLOTS slots; a slot keeps its earliest point, and a
process stops once it is later than all slots' points. The share of equal slots is the weighted Jaccard similarity,
without bias.

Candidates. BANDS bands of ROWS slots make buckets: texts of similarity 0.8 share one of them with probability
1 - (1 - 0.8 ** ROWS) ** BANDS = 0.99994. A bucket is open while it holds several classes. In TURNS turns every text
of another class is compared with one leader of its open buckets, first with the text that meets most others (the
original of a group of copies does), then with random ones; linked classes become one. So each turn compares no
more pairs than there are texts, and most of a group is one class soon.

The rest, exactly. All texts of buckets that are still open are compared, but for pairs of one class and pairs that
cannot be linked: linked texts have so many runs in common that one of the rarest runs of either is a common one
(`rare_run_pairs`). This finds every pair of those texts with THRESHOLD, not only those that share a bucket. Compared is the members' own similarity, computed
exactly from their runs. So no pair is skipped but those that cannot change a class.

Exact copies are one text from the start. Classes merge by smallest-neighbour steps with pointer jumping on written
tables. Nothing but counts comes to the driver.

Cases: very long texts are read whole. Null and empty texts, and texts of white space, are classes of their own. A null doc_id has a null class and
is kept by `drop_near_copies`. Repeated rows are copies; a doc_id that stands on rows with several texts takes the
smallest of their classes. Ties do not arise, ids order everything. An empty table gives an empty one. Other columns
are kept by `drop_near_copies`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceengine.llm.kernels import mix, row_counts, text_rows, token_hashes
from priceengine.llm.staging import counted, map_arrow, release, small, staged

RUN, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 6
SLOTS = BANDS * ROWS
TURNS = 4
MAX_BROADCAST_IDS = 300_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TICKS = float(1 << 26)


def runs_of_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, words a row) of all runs of RUN words, or of the one shorter run."""
    n = len(offsets) - 1
    _, _, rows, hashed = token_hashes(data, offsets)
    words = row_counts(rows, n)
    first = np.cumsum(words) - words
    runs = np.where(words >= RUN, words - RUN + 1, np.minimum(words, 1))
    row = np.repeat(np.arange(n), runs)
    at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
    out = np.zeros(len(row), np.uint64)
    for k in range(RUN):
        there = np.minimum(words[row], RUN) > k
        out = out * _STEP + np.where(there, hashed[np.minimum(at + k, max(len(hashed) - 1, 0))] if len(hashed) else np.uint64(0), np.uint64(0))
    return row, mix(out), words


def multisets(row: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count), ordered."""
    order = np.lexsort((hashed, row))
    row, hashed = row[order], hashed[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashed[1:] != hashed[:-1])
    at = np.flatnonzero(new)
    return row[at], hashed[at], np.diff(np.append(at, len(row)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def bag_min_hash(row: np.ndarray, hashed: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """n by SLOTS identities of the earliest points (24 bits), from the multiset of each row."""
    # one process for each run and interval of the weight axis: [0, 1), [1, 2), [2, 4), ...
    reach = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 2))).astype(np.int64) + 1, 1)
    item = np.repeat(np.arange(len(row)), reach)
    octave = np.arange(len(item)) - np.repeat(np.cumsum(reach) - reach, reach)
    low = np.where(octave > 0, 2.0 ** (octave - 1), 0.0)
    width = np.where(octave > 0, low, 1.0)
    seed, row, count = mix(hashed[item] + octave.astype(np.uint64)), row[item], count[item].astype(float)
    best = np.full(n * SLOTS, np.uint64(2**64 - 1))
    latest = np.full(n, np.inf)
    time = np.zeros(len(item))
    live, step = np.arange(len(item)), 0
    while len(live):
        block = 1 if step < 3 else 16
        s, r = seed[live, None], row[live, None]
        k = (step + np.arange(block)).astype(np.uint64)
        draw = mix(s + k * _STEP)
        t = time[live, None] + np.cumsum(-np.log(_uniform(draw)), 1) / width[live, None]
        other = mix(draw + np.uint64(1))
        slot = ((other >> np.uint64(32)) * np.uint64(SLOTS) >> np.uint64(32)).astype(np.int64)
        ok = t < latest[r]
        if (partial := low[live] + width[live] > count[live]).any():
            ok &= ~partial[:, None] | (low[live, None] + _uniform(mix(other)) * width[live, None] < count[live, None])
        point = (np.minimum(t * _TICKS, float((1 << 40) - 1)).astype(np.uint64) << np.uint64(24)) | (draw & np.uint64(0xFFFFFF))
        np.minimum.at(best, (r * SLOTS + slot)[ok], point[ok])
        touched = np.unique(row[live])
        worst = best.reshape(n, SLOTS)[touched].max(1)
        latest[touched] = np.where(worst == np.uint64(2**64 - 1), np.inf, ((worst >> np.uint64(24)).astype(float) + 1) / _TICKS)
        time[live] = t[:, -1]
        live = live[time[live] < latest[row[live]]]
        step += block
    return best.reshape(n, SLOTS) & np.uint64(0xFFFFFF)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """n by BANDS bucket keys."""
    part = signature.reshape(len(signature), BANDS, ROWS)
    out = np.zeros(part.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = out * _STEP + part[:, :, k] + np.uint64(1)
    return mix(out)


def _lists(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat.view(np.int64)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, off in text_rows(batch, "text"):
            row, hashed, words = runs_of_words(data, off)
            # the whole text, run by run in order: 128 bits
            n = j - i
            place = (np.arange(len(row)) - np.searchsorted(row, row)).astype(np.uint64)
            both = []
            for salt in (3, 5):
                total = np.zeros(n, np.uint64)
                np.add.at(total, row, mix(hashed + place * _STEP + np.uint64(salt)))
                both.append(mix(total + words.astype(np.uint64)).view(np.int64))
            keys = band_keys(bag_min_hash(*multisets(row, hashed), n))
            some = words > 0
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(i, n).filter(pa.array(some)), pa.array(both[0][some]), pa.array(both[1][some]), _lists(keys[some].ravel(), np.full(int(some.sum()), BANDS)),
            ], ["id", "k1", "k2", "bands"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, off in text_rows(batch, "text"):
            row, hashed, _ = runs_of_words(data, off)
            order = np.lexsort((hashed, row))
            row, hashed = row[order], hashed[order]
            same = np.arange(len(row)) - np.maximum.accumulate(np.where(np.append(True, (row[1:] != row[:-1]) | (hashed[1:] != hashed[:-1]))[: len(row)], np.arange(len(row)), 0))
            # the k-th of equal runs is an element of its own: multisets are then sets
            hashed = np.where(same > 0, mix(hashed + same.astype(np.uint64) * _STEP), hashed)
            order = np.lexsort((hashed, row))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _lists(hashed[order], row_counts(row, j - i))], ["id", "runs"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = []
        for name in ("runs_a", "runs_b"):
            col = batch.column(batch.schema.get_field_index(name))
            sides.append((np.asarray(col.flatten()).view(np.uint64), np.concatenate([[0], np.cumsum(np.asarray(col.value_lengths().fill_null(0)))])))
        (xs, x_off), (ys, y_off) = sides
        linked = np.zeros(batch.num_rows, bool)
        for k in range(batch.num_rows):
            x, y = xs[x_off[k] : x_off[k + 1]], ys[y_off[k] : y_off[k + 1]]
            if min(len(x), len(y)) < THRESHOLD * max(len(x), len(y)):
                continue
            at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
            common = int((y[at] == x).sum())
            linked[k] = common * 10 >= (len(x) + len(y) - common) * 8
        mask = pa.array(linked)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def links_of(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose weighted Jaccard similarity is THRESHOLD or more."""
    sides = runs.select(F.col("id").alias("a"), F.col("runs").alias("runs_a")), runs.select(F.col("id").alias("b"), F.col("runs").alias("runs_b"))
    met = pairs.join(sides[1], "b").join(sides[0], "a").select("a", "b", "runs_a", "runs_b")
    return map_arrow(met, _verify, "a long, b long")


def connect(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id that edges (a, b) connect each id with. Written at every step."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), "edges")
    labels = old = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("theirs")), "b").groupBy("a").agg(F.min("theirs").alias("theirs"))
        stepped = labels.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", "label", F.least("label", F.coalesce("theirs", "label")).alias("new"))
        up = labels.select(F.col("id").alias("new"), F.col("label").alias("above"))
        jumped, changed = counted(stepped.join(up, "new", "left").select("id", "label", F.least("new", F.coalesce("above", "new")).alias("new")), "labels", F.col("new") != F.col("label"))
        labels = jumped.select("id", F.col("new").alias("label"))
        release(old)
        old = jumped
        if not changed:
            release(both)
            return labels


def known(labels: DataFrame, rows: int, *columns: str) -> DataFrame:
    """Columns of `labels` for a join; broadcast if its counted `rows` are few."""
    out = labels.select("id", *columns)
    return F.broadcast(out) if rows <= MAX_BROADCAST_IDS else out


def joined_classes(labels: DataFrame, pairs: DataFrame, links: DataFrame) -> DataFrame:
    """`labels` (id, label, weight) after the classes of linked pairs (a, b, la, lb: their labels) become one."""
    edges = links.join(pairs, ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b"))
    moved = connect(edges)
    out = staged(labels.join(moved.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label"), "weight"), "labels")
    release(moved)
    return out


def open_buckets(members: DataFrame, labels: DataFrame, texts: int, turn: int) -> tuple[DataFrame, DataFrame, int]:
    """(id, key, label) of the members, and (key, of, of_label) of the buckets that hold several classes: a leader of each.

    The first turn leads with the text that meets most others in all its buckets, the later ones with a random one.
    """
    rank = -F.col("weight") if turn == 0 else F.xxhash64("id", F.lit(turn))
    there = members.join(known(labels, texts, "label", "weight"), "id")
    leader = F.min(F.struct(rank.alias("rank"), F.col("id").alias("of"), F.col("label").alias("of_label"))).alias("l")
    buckets = there.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), leader).where("x < y")
    buckets, n = counted(buckets.select("key", "l.of", "l.of_label"), "open")
    return there.select("id", "key", "label"), buckets, n


def leader_pairs(there: DataFrame, buckets: DataFrame) -> DataFrame:
    """(a, b, la, lb): one pair for each text a that is not in the class of a leader of its buckets, with the leader b that it meets most."""
    met = there.join(buckets, "key").where("label != of_label").groupBy("id", "label", "of", "of_label").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct("n", (-F.col("of")).alias("back"), "of_label")).alias("m")
    return met.groupBy("id", "label").agg(best).select(F.col("id").alias("a"), (-F.col("m.back")).alias("b"), F.col("label").alias("la"), F.col("m.of_label").alias("lb"))


def least_common(x: Column, y: Column) -> Column:
    """How many runs texts of x and y runs must have in common to be linked: 4 / 9 of the sum, rounded up."""
    return F.floor((4 * (x + y) + 8) / 9)


def rare_run_pairs(runs: DataFrame, live: DataFrame) -> DataFrame:
    """(a, b, la, lb): all pairs of `live` texts (id, label) of several classes that can still be linked.

    The runs of a text are put in order: first those that stand in one class only, then rare before frequent ones. Of two
    texts that have `c` runs in common, at least, the first n - c + 1 of either (n: its runs) hold a common one. So the
    copies of one original that differ from it too much, each in its own way, never meet: their first runs are their own.
    Texts meet under a run and a step of size, of the smaller text; 12 steps are a doubling.
    """
    rows = runs.join(live, "id").select("id", "label", F.size("runs").alias("n"), F.explode("runs").alias("run"))
    across = rows.groupBy("run").agg(F.count(F.lit(1)).alias("df"), F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("run", "df")
    common = rows.join(across, "run").groupBy("id", "label", "n").agg(F.array_sort(F.collect_list(F.struct("df", "run"))).alias("own"))  # a text's own runs
    n, step = F.col("n"), lambda size: F.floor(F.log2(size) * 12).cast("int")
    alone = n - F.size("own")
    first = F.slice("own", F.lit(1), F.greatest(n - F.ceil(n * 4 / 5) + 1 - alone, F.lit(0)).cast("int"))
    placed = common.select("id", "label", "n", alone.alias("alone"), F.posexplode(first).alias("at", "r")).select("id", "label", "n", F.col("r.run").alias("run"), (F.col("alone") + F.col("at") + 1).alias("p"))
    placed = staged(placed, "rare")
    smaller = placed.where(F.col("p") <= n - least_common(n, n) + 1).select("run", step(n).alias("step"), F.col("id").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("p").alias("pa"))
    larger = placed.select("run", F.explode(F.sequence(step(n) - 4, step(n))).alias("step"), F.col("id").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("p").alias("pb"))
    need = least_common(F.col("na"), F.col("nb"))
    fits = (F.col("la") != F.col("lb")) & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))) & (F.col("na") * 5 >= F.col("nb") * 4)
    near = (F.col("pa") <= F.col("na") - need + 1) & (F.col("pb") <= F.col("nb") - need + 1)
    left, right = smaller.alias("s"), larger.alias("t")
    met = left.join(right, (F.col("s.run") == F.col("t.run")) & (F.col("s.step") == F.col("t.step")) & fits & near)
    return met.select("a", "b", "la", "lb").distinct()


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id): one row for each row of `docs`; the class is the smallest doc_id in it."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    plain_known = plain.where(F.col("id").isNotNull())
    signed = staged(map_arrow(plain_known, _sign, "id long, k1 long, k2 long, bands array<long>"), "signed")
    texts = staged(signed.groupBy("k1", "k2").agg(F.min("id").alias("rep")), "texts")
    copies = staged(signed.select("id", "k1", "k2").join(texts, ["k1", "k2"]).select("id", "rep").distinct(), "copies")
    reps = signed.join(copies.where("id = rep").select("id"), "id", "left_semi")
    buckets = staged(reps.select("id", F.explode(F.array_distinct("bands")).alias("key")).distinct(), "buckets")
    release(signed, texts)
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    weighed = staged(buckets.join(shared, "key"), "shared")
    release(buckets)
    members = weighed.select("id", "key")
    # how many texts a text meets in its buckets: the one that others were made from meets most
    wanted, few = counted(weighed.groupBy("id").agg(F.sum("n").alias("weight")), "wanted")
    runs = staged(map_arrow(plain_known.join(small(wanted.select("id"), MAX_BROADCAST_IDS), "id", "left_semi"), _runs, "id long, runs array<long>"), "runs")
    labels = staged(wanted.select("id", F.col("id").alias("label"), "weight"), "labels")
    release(wanted)
    for turn in range(TURNS + 1):
        there, leading, n = open_buckets(members, labels, few, turn)
        if not n:
            break
        if turn < TURNS:
            pairs, tried = counted(leader_pairs(there, leading), "pairs")
        else:
            live = staged(there.join(leading.select("key"), "key", "left_semi").select("id", "label").distinct(), "live")
            pairs, tried = counted(rare_run_pairs(runs, live), "pairs")
        links, linked = counted(links_of(pairs.select("a", "b"), runs).distinct(), "links")
        if linked:
            before, labels = labels, joined_classes(labels, pairs, links)
            release(before)
        release(leading, pairs, links)
    by_doc = copies.join(labels, F.col("rep") == labels["id"], "left").groupBy(copies["id"].alias("id")).agg(F.min(F.coalesce("label", "rep")).alias("class_id"))
    by_doc = staged(by_doc, "classes")
    release(copies, labels, weighed, runs)
    return docs.select(F.col(id_col).cast("long").alias("doc_id")).join(by_doc, F.col("doc_id") == F.col("id"), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each class, the one with the smallest id (all rows of that id stay)."""
    gone = near_classes(docs, id_col, text_col).where("class_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    gone = small(staged(gone, "gone"), MAX_BROADCAST_IDS)
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
