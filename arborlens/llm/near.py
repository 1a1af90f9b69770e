"""Exact Jaccard join of documents in metric space, and the components of its links.

Jaccard distance is a metric. Two documents link at similarity 0.8, a distance of 0.2, and copies of a
set are one point. The join has four parts, each exact:

1. Filter. In any one order of all shingles, two linked documents share many of the first shingles of
   both. Hashes are that order; each document sends its first ones to slots, learns how many of them
   another document has, and leaves if these are too few. Most documents of a corpus leave here.
2. Pivots. Among the rest, shingles are ordered from the rarest. Linked documents share one of their
   rarest shingles, so each shingle names a pivot (its most typical document), and two linked documents
   have a pivot in common. Distances to pivots are computed; a document in the ball of radius 0.2 is
   linked to the pivot.
3. Regions. The documents of a pivot are cut into rings by their distance to it. Two in the ball are
   connected by the pivot; all other pairs have one outside it. By the triangle inequality such a
   document links only within a window of rings, whose documents are replicated to it.
4. Recursion. Each document outside a ball is a pivot for the documents of its window, in units of
   bounded size; of the links found only spanning ones leave a unit.

Copies are never expanded. No step holds a whole region, and no pairs inside a ball are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlens.llm import common
from arborlens.session import hand_over

WIDTH = 5
RING = 0.05
WINDOW = 5  # rings: the distance 0.2 and one more for rounding
LANE = 64
CHUNK = 1024


def most_apart(n: np.ndarray) -> np.ndarray:
    """Shingles of a set of ``n`` that a linked one may lack: n minus the smallest whole number from 0.8 n."""
    return n - (8 * n + 9) // 10


def _depth(n: np.ndarray) -> np.ndarray:
    """How many shared shingles the longer prefix of the filter asks for."""
    return np.maximum(1, n // 5)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and the number of each text."""
    n_docs = len(offsets) - 1
    start, end, doc = common.find_words(data, offsets)
    found, owner = common.shingles(common.hash_spans(data, start, end, fold=True), doc, n_docs, width)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.r_[True, (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])][: len(found)]
    return found[new], np.bincount(owner[new], minlength=n_docs)


def set_sizes(docs: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """``(key, n, d1, d2, shared)``: size and digests of each set, and the first shingles it shares.

    One pass over the texts. A slice of texts sends a shingle that several of its texts have only once,
    so a shingle that a third of all documents have reaches its slot once per slice.
    """
    rows = docs.select(key, text)
    slots = common.n_slots(docs)
    info = np.dtype([("doc", "<i8"), ("n", "<i8"), ("d1", "<u8"), ("d2", "<u8"), ("shared", "<i8")])
    names = ["slot", "part", "keys", "index"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in common.text_slices(batch.column(1)):
                part += 1
                found, n = shingle_sets(data, offsets, width)
                owner = np.repeat(np.arange(len(n)), n)
                row = np.zeros(len(n), info)
                row["doc"], row["n"] = ids[first:last], n
                filled = n > 0
                heads = (np.cumsum(n) - n)[filled]
                if len(heads):
                    row["d1"][filled] = np.add.reduceat(common.mix(found ^ np.uint64(0xA5A5)), heads)
                    row["d2"][filled] = np.add.reduceat(common.mix(found ^ np.uint64(0x5A5A5A)), heads)
                place = np.arange(len(found)) - np.repeat(np.cumsum(n) - n, n)
                # The hash is the one order of all shingles.
                first_ones = place < (most_apart(n) + _depth(n))[owner]
                keys, who = found[first_ones], owner[first_ones]
                times, head = common.in_slice_counts(keys)
                row["shared"] = np.bincount(who[times > 1], minlength=len(n))
                lone = times == 1
                go = lone | head
                keys, index = keys[go], np.where(lone[go], who[go], 0xFFFFFFFF).astype("<u4")
                order, used, edges = common.by_slot(keys, slots)
                low, index = keys[order].astype("<u4"), index[order]
                cut = lambda x: [x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
                columns = [used.tolist() + [-1 - part % slots], [part] * (len(used) + 1), cut(low) + [row.tobytes()], cut(index) + [None]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], names=names
                )

    def meet(key_, group: pd.DataFrame) -> pd.DataFrame:
        if key_[0] < 0:
            parts = [np.frombuffer(x, info) for x in group["keys"]]
            rows = np.concatenate(parts)
            return pd.DataFrame(
                {
                    "part": np.repeat(group["part"].to_numpy(), [len(p) for p in parts]),
                    "index": np.concatenate([np.arange(len(p)) for p in parts]),
                    "doc": rows["doc"], "n": rows["n"], "d1": rows["d1"].astype(np.int64), "d2": rows["d2"].astype(np.int64), "shared": rows["shared"],
                }
            )
        keys = np.frombuffer(b"".join(group["keys"]), "<u4")
        index = np.frombuffer(b"".join(group["index"]), "<u4").astype(np.int64)
        part = np.repeat(group["part"].to_numpy(), [len(x) // 4 for x in group["keys"]])
        times, _ = common.in_slice_counts(keys)
        # A shingle of several texts of one slice comes without a text; it counts for the others.
        good = (times > 1) & (index != 0xFFFFFFFF)
        who = np.stack([part[good], index[good]], 1)
        pairs, shared = np.unique(who, axis=0, return_counts=True) if len(who) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
        none = pd.array([None] * len(pairs), "Int64")
        return pd.DataFrame({"part": pairs[:, 0], "index": pairs[:, 1], "doc": none, "n": none, "d1": none, "d2": none, "shared": shared})

    sent = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), text).mapInArrow(send, "slot long, part long, keys binary, index binary")
    met = sent.groupBy("slot").applyInPandas(meet, "part long, index long, doc long, n long, d1 long, d2 long, shared long")
    totals = met.groupBy("part", "index").agg(*[F.max(c).alias(c) for c in ("doc", "n", "d1", "d2")], F.sum("shared").alias("shared"))
    return totals.select(F.col("doc").alias(key), "n", "d1", "d2", "shared")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """``(id, n, set array<long>)`` of ``docs(id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in common.text_slices(batch.column(1)):
                found, n = shingle_sets(data, offsets, width)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(found.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(n.astype(np.int64)), lists], names=["id", "n", "set"])

    return docs.mapInArrow(run, "id long, n long, set array<long>")


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size of the intersection of the two sets of each row ``(id, pivot, a, b)``."""
    for batch in batches:
        for first in range(0, len(batch), 256):
            part = batch.slice(first, 256)
            (a, n), (b, m) = _flat(part.column(2)), _flat(part.column(3))
            row = np.r_[np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)]
            both = np.r_[a, b]
            order = np.lexsort((both, row))
            both, row = both[order], row[order]
            twice = (both[1:] == both[:-1]) & (row[1:] == row[:-1])
            shared = np.bincount(row[1:][twice], minlength=len(n))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n), pa.array(m), pa.array(shared.astype(np.int64))], names=["id", "pivot", "n", "m", "shared"]
            )


def linked_in_unit(lane: list[np.ndarray], members: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (lane, member) of sets at similarity 0.8 or more."""
    words = np.unique(np.concatenate(lane))
    grid = np.zeros((len(words) + 1, len(lane)), np.uint16)
    for k, s in enumerate(lane):
        grid[np.searchsorted(words, s), k] = 1
    sizes = np.array([len(s) for s in lane])
    n = np.array([len(s) for s in members])
    out_i, out_j, first = [], [], 0
    while first < len(members):
        last = first + max(1, int(np.searchsorted(np.cumsum(n[first:]), 100_000)))
        flat = np.concatenate(members[first:last])
        at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
        at = np.where(words[at] == flat, at, len(words))
        heads = np.cumsum(n[first:last]) - n[first:last]
        shared = np.add.reduceat(grid[at], heads, axis=0, dtype=np.int64)
        good = 100 * shared >= 80 * (sizes[None, :] + n[first:last, None] - shared)
        j, i = np.nonzero(good)
        out_i.append(i)
        out_j.append(j + first)
        first = last
    return np.concatenate(out_i), np.concatenate(out_j)


def _unit(key_, rows: pd.DataFrame) -> pd.DataFrame:
    """Spanning links of one lane of pivots and one chunk of the documents in its window."""
    lane, members = rows[rows["lane_row"]], rows[~rows["lane_row"]]
    if lane.empty or members.empty:
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    i, j = linked_in_unit(list(lane["set"]), list(members["set"]))
    ids = np.r_[lane["id"].to_numpy(), members["id"].to_numpy()]
    child, parent = common.spanning(ids, i, j + len(lane))
    return pd.DataFrame({"a": child, "b": parent})


def near_links(sets: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect what linked sets connect; ``sets(id, n, set)`` are distinct."""
    postings = sets.select("id", "n", F.explode("set").alias("h"))
    shared = postings.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    # A shingle of one document only comes before all others; it can be no common one.
    known = postings.join(shared, "h").withColumn("_m", F.count("*").over(Window.partitionBy("id")))
    alive = known.where("_m * 10 >= n * 8")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "h"))
    rare = alive.withColumn("_rank", rank + F.col("n") - F.col("_m")).where("_rank <= n - (8 * n + 9) div 10 + 1")
    rare = hand_over(rare.select("h", "id", F.expr("CAST((n - _m) * 1000 div n AS INT)").alias("odd")), "rare")
    # The most typical document, with the smallest share of shingles of its own, is the pivot.
    pivots = rare.groupBy("h").agg(F.min(F.struct("odd", "id")).alias("p"), F.count("*").alias("_n")).where("_n > 1")
    pairs = rare.join(pivots, "h").select("id", F.col("p.id").alias("pivot")).where("id <> pivot").distinct()
    compared = (
        pairs.join(sets.select("id", F.col("set").alias("a")), "id")
        .join(sets.select(F.col("id").alias("pivot"), F.col("set").alias("b")), "pivot")
        .select("id", "pivot", "a", "b")
        .mapInArrow(_overlaps, "id long, pivot long, n long, m long, shared long")
    )
    compared = hand_over(compared, "distances")
    union = "(n + m - shared)"
    ball = compared.where(f"100 * shared >= 80 * {union}").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
    rings = compared.select("id", "pivot", F.expr(f"CAST(floor((1 - shared / {union}) / {RING}) AS INT)").alias("ring"), F.expr(f"100 * shared < 80 * {union}").alias("outside"))
    # Lanes of documents outside the balls, by ring; their number follows from counts, not from lists.
    outside = rings.where("outside")
    counts = outside.groupBy("pivot", "ring").agg(F.expr(f"CAST(ceil(count(*) / {LANE}D) AS INT)").alias("lanes"))
    sizes = rings.groupBy("pivot").agg(F.expr(f"CAST(ceil(count(*) / {CHUNK}D) AS INT)").alias("chunks"))
    lanes = outside.join(counts, ["pivot", "ring"]).join(sizes, "pivot").select(
        "pivot", "ring", F.pmod(F.xxhash64("id"), F.col("lanes")).alias("lane"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "id", F.lit(True).alias("lane_row")
    )
    around = rings.join(sizes, "pivot").select("pivot", F.col("ring").alias("_ring"), "id", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"))
    windows = counts.withColumn("_ring", F.explode(F.sequence(F.greatest(F.col("ring") - WINDOW, F.lit(0)), F.col("ring") + WINDOW)))
    members = around.join(windows, ["pivot", "_ring"]).select(
        "pivot", "ring", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lanes").cast("long") - 1)).alias("lane"), "chunk", "id", F.lit(False).alias("lane_row")
    )
    units = lanes.union(members).join(sets.select("id", "set"), "id")
    found = units.groupBy("pivot", "ring", "lane", "chunk").applyInPandas(_unit, "a long, b long")
    return ball.union(found)


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``(key, n_shingles, component_id)`` of every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z as a-z; a text with fewer than ``width`` words is one
    shingle. A null, empty or blank text has none and is alone. The key is a whole number; a row with
    a null key is alone and has null for its component. Rows that repeat a key and text give repeated rows.
    Shingles are compared as 64-bit hashes.
    """
    sizes = hand_over(set_sizes(docs, key, text, width), "sizes")
    # The same set: one class, with or without a partner elsewhere.
    found = sizes.where("n > 0").withColumn("need", F.expr("greatest(1, ((8 * n + 9) div 10) div 5)"))
    classes = found.groupBy("n", "d1", "d2").agg(F.min(key).alias("rep"), F.max("shared").alias("shared"), F.max("need").alias("need"))
    reps = hand_over(classes, "classes")
    candidates = reps.where("shared >= need").select(F.col("rep").alias(key))
    chosen = docs.select(F.col(key).cast("long").alias(key), text).join(candidates, key, "left_semi").select(F.col(key).alias("id"), text)
    sets = hand_over(_sets(chosen, width).where("n > 0").dropDuplicates(["id"]), "sets")
    parts = common.components(near_links(sets)).withColumnsRenamed({"id": "rep", "component_id": "_part"})
    named = reps.drop("shared", "need").join(parts, "rep", "left").withColumn("_part", F.coalesce("_part", "rep"))
    member = found.drop("shared", "need").join(named, ["n", "d1", "d2"]).groupBy(F.col(key).alias("_id")).agg(F.min("_part").alias("_part"))
    listed = sizes.groupBy(F.col(key).alias("_id")).agg(F.max("n").alias("n"))
    result = listed.join(member, "_id", "left")
    rows = docs.select(F.col(key).cast("long").alias(key))
    return rows.join(result, rows[key] == result["_id"], "left").select(
        key, F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("_part", key).alias("component_id")
    )
