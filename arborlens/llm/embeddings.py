"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe, verification.

Equal vectors are one class, so copies are never compared with each other. Each table rotates the
vectors (random signs and a fast Hadamard transform, three times) and takes the axes they are nearest
to, once per hash of the table; the second nearest axis of each hash is probed too. Hashes follow from the size
of the largest label, so buckets stay small as the data grows; tables follow from how often
vectors at the threshold meet in one table, which is tried out on drawn pairs.

Vectors that share a bucket of a table are compared exactly; a pair is counted only in the first table
and bucket where it meets, so counts are sums of what the tasks find. Big buckets are cut into blocks of
bounded size, and pairs of blocks are compared. Buckets are dealt to slots of bounded size. A task works off all
buckets of a slot as arrays; only counts and spanning links leave it, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens.llm import common
from arborlens.session import hand_over

BLOCK = 512
COSINE = 0.98
#: Share of pairs at the threshold that the tables together bring into one bucket.
RECALL = 0.9995
#: Vectors of a slot, about, and products worked off at once.
SLOT_ROWS = 32_768
PAIRS = 65_536


def rotations(dims: int, count: int, seed: int = 5) -> np.ndarray:
    """Random signs of ``count`` rotations of three rounds each, for vectors padded to a power of two."""
    size = 1 << max(1, (dims - 1).bit_length())
    return np.random.default_rng(seed).choice([-1.0, 1.0], (count, 3, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row, scaled to keep lengths."""
    n, size = x.shape
    h = 1
    while h < size:
        x = x.reshape(n, size // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, size)
        h *= 2
    return x / np.sqrt(size)


def nearest_axes(unit: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest and second nearest signed axis of every row after one rotation."""
    x = np.zeros((len(unit), signs.shape[1]))
    x[:, : unit.shape[1]] = unit
    for s in signs:
        x = hadamard(x * s)
    size = np.abs(x)
    rows = np.arange(len(x))
    first = np.argmax(size, 1)
    a = 2 * first + (x[rows, first] < 0)
    size[rows, first] = -1
    second = np.argmax(size, 1)
    return a, 2 * second + (x[rows, second] < 0)


def probed_buckets(unit: np.ndarray, tables: int, hashes: int) -> np.ndarray:
    """Bucket numbers ``(rows, tables, probes)``: the bucket of a row, and one per hash with its second axis."""
    signs = rotations(unit.shape[1], tables * hashes)
    base = 2 * signs.shape[2]
    out = np.zeros((len(unit), tables, hashes + 1), np.int64)
    for t in range(tables):
        axes = [nearest_axes(unit, signs[t * hashes + k]) for k in range(hashes)]
        for probe in range(hashes + 1):
            code = np.zeros(len(unit), np.int64)
            for k, (a, b) in enumerate(axes):
                code = code * base + (b if probe == k + 1 else a)
            out[:, t, probe] = code
    return out


def hashes_for(rows: int, dims: int) -> int:
    """Hashes of a table that give as many buckets as a label has rows; two at least."""
    base = 2 << max(1, (dims - 1).bit_length())
    return min(max(2, math.ceil(math.log(max(rows, 2), base))), int(62 // math.log2(base)))


def tables_for(dims: int, hashes: int, cosine: float, recall: float = RECALL, tried: int = 8) -> int:
    """Tables after which a pair at ``cosine`` has met with probability ``recall``, from drawn pairs."""
    rng = np.random.default_rng(17)
    drawn = max(200, 100_000 // dims)
    a = rng.normal(size=(drawn, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=(drawn, dims))
    side -= (side * a).sum(1, keepdims=True) * a
    size = np.linalg.norm(side, axis=1, keepdims=True)
    side = np.divide(side, size, out=np.zeros_like(side), where=size > 1e-9)
    b = cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * side
    x, y = (probed_buckets(v, tried, hashes) for v in (a, b))
    met = (x[:, :, :, None] == y[:, :, None, :]).any((2, 3)).mean()
    return 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log(1 - max(met, 1e-3)))


def can_link(vector: str, label: str) -> Column:
    """A label, and a vector that is not null or zero and has finite components only."""
    good = F.col(label).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)
    good = good & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Rows that can link, with plain names. Zeros of either sign are equal."""
    plain = F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0))
    return vectors.where(can_link(vector, label)).select(
        F.col(key).alias("_id"), F.col(label).cast("string").alias("_label"), plain.alias("_vector")
    )


def pairs_of(low: np.ndarray, high: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of every row with the rows ``low`` to ``high``, about ``most`` at a time."""
    counts = high - low
    total = np.cumsum(counts)
    first = 0
    while first < len(counts):
        done = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, done + most, "right")))
        n = counts[first:last]
        i = np.repeat(np.arange(first, last), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[first:last], n)
        if len(i):
            yield i, j
        first = last


def first_meeting(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First table, and smallest bucket in it, that the probes ``(pairs, tables, probes)`` of two rows share."""
    same = x[:, :, :, None] == y[:, :, None, :]
    table = np.argmax(same.any((2, 3)), 1)
    rows = np.arange(len(table))
    shared = np.where(same[rows, table].any(2), x[rows, table], np.iinfo(np.int64).max)
    return table, shared.min(1)


def compare_slot(rows: pa.Table, cosine: float) -> pa.Table:
    """Links of all buckets of a slot: ``(uid, n, to)`` with counts (``to`` null) and spanning links."""
    labels = np.unique(np.array(rows["label"].to_pylist(), str), return_inverse=True)[1]
    dims, table, bucket, a, b, block, uid, copies = (
        rows[c].to_numpy() for c in ("dims", "table", "bucket", "_a", "_b", "_block", "uid", "copies")
    )
    bodies, probes = rows["unit"].to_pylist(), rows["probes"].to_pylist()
    counted, links = [], []
    for size in np.unique(dims):
        mine = np.flatnonzero(dims == size)
        order = mine[np.lexsort((uid[mine], block[mine], b[mine], a[mine], bucket[mine], table[mine], labels[mine]))]
        names = np.stack([c[order] for c in (labels, table, bucket, a, b)])
        edge = np.flatnonzero(np.r_[True, (names[:, 1:] != names[:, :-1]).any(0)])
        end = np.repeat(np.r_[edge[1:], len(order)], np.diff(np.r_[edge, len(order)]))
        left = block[order] == a[order]
        within = a[order] == b[order]
        # Rows of one block meet those after them; rows of the first block meet all of the second.
        middle = np.repeat(np.add.reduceat(left, edge) + edge, np.diff(np.r_[edge, len(order)]))
        low = np.where(within, np.arange(len(order)) + 1, np.where(left, middle, end))
        unit = np.frombuffer(b"".join(bodies[k] for k in order), np.float64).reshape(len(order), size)
        n = np.zeros(len(order), np.int64)
        for i, j in pairs_of(low, end):
            near = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
            i, j = i[near], j[near]
            if not len(i):
                continue
            per_table = len(probes[order[0]]) // 8 // int(rows["tables"][0].as_py())
            x, y = (np.stack([np.frombuffer(probes[order[k]], np.int64) for k in part]).reshape(len(part), -1, per_table) for part in (i, j))
            at, where = first_meeting(x, y)
            keep = (at == table[order[i]]) & (where == bucket[order[i]])
            i, j = i[keep], j[keep]
            np.add.at(n, i, copies[order[j]])
            np.add.at(n, j, copies[order[i]])
            links.append(common.spanning(uid[order], i, j))
        some = np.flatnonzero(n)
        counted.append((uid[order[some]], n[some]))
    whose, n = (np.concatenate(c) if counted else np.zeros(0, np.int64) for c in (list(zip(*counted, strict=True)) or [[], []]))
    child, parent = (np.concatenate(c) if links else np.zeros(0, np.int64) for c in (list(zip(*links, strict=True)) or [[], []]))
    return pa.table(
        {
            "uid": pa.array(np.concatenate([whose, child]).astype(np.int64)),
            "n": pa.array(np.concatenate([n, np.zeros(len(child), np.int64)])),
            "to": pa.concat_arrays([pa.nulls(len(whose), pa.int64()), pa.array(parent.astype(np.int64))]),
        }
    )


def near_duplicates(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    cosine: float = COSINE,
    recall: float = RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """``(key, n_links, component_id, kept)`` of every row; only rows of one label are compared.

    ``n_links`` counts the other rows at ``cosine`` or more that were found, copies included;
    ``component_id`` is the smallest key reachable, ``kept`` marks it. Rows that cannot link (see
    ``usable``) are alone. Keys should be unique; rows that repeat a key and a vector are copies, rows that
    repeat a key with another vector are rows of their own. Vectors of different length are never compared. Classes of
    equal vectors go by a 64-bit hash as links, but a row belongs to one by its label and vector.
    """
    good = usable(vectors, key, vector, label).withColumn("uid", F.xxhash64("_label", "_vector"))
    good = hand_over(good, "vectors")
    # Copies: one row per label and vector.
    classes = good.groupBy("uid", "_label", "_vector").agg(F.min("_id").alias("rep"), F.count("*").alias("copies"))
    classes = hand_over(classes, "classes")
    sizes = classes.groupBy("_label", F.size("_vector").alias("dims")).agg(F.count("*").alias("n"))
    plan = {}
    # One row for each length of vectors that occurs.
    for dims, rows in sizes.groupBy("dims").agg(F.max("n")).collect():
        hashes = hashes_for(rows, dims)
        plan[dims] = (tables_for(dims, hashes, cosine, recall), hashes)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(lengths):
                tables, hashes = plan[int(size)]
                rows = pa.array(np.flatnonzero(lengths == size))
                part = batch.take(rows)
                x = part.column(3).flatten().to_numpy().reshape(len(rows), -1)
                x = x / np.max(np.abs(x), 1, keepdims=True)  # no overflow in the squares
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                buckets = probed_buckets(unit, tables, hashes)
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        part.column(2),
                        pa.array(np.full(n, size, np.int32)),
                        pa.array(np.full(n, tables, np.int32)),
                        pa.array([u.tobytes() for u in unit]),
                        pa.array([p.tobytes() for p in buckets]),
                        pa.array(list(buckets.reshape(n, -1)), pa.list_(pa.int64())),
                    ],
                    names=["uid", "copies", "label", "dims", "tables", "unit", "probes", "buckets"],
                )

    units = hand_over(
        classes.select("uid", "copies", "_label", "_vector").mapInArrow(
            probe, "uid long, copies long, label string, dims int, tables int, unit binary, probes binary, buckets array<long>"
        ),
        "units",
    )
    table = F.expr("CAST(_at div (_probes div tables) AS INT)").alias("table")
    entries = units.select("uid", "label", "dims", "tables", F.size("buckets").alias("_probes"), F.posexplode("buckets").alias("_at", "bucket"))
    entries = entries.select("uid", "label", "dims", table, "bucket")
    group = ["label", "dims", "table", "bucket"]
    full = entries.groupBy(*group).agg(F.count("*").alias("_n")).where("_n > 1")
    # A bucket of n rows has n / block blocks; each pair of blocks is compared.
    placed = entries.join(full, group).withColumn("_blocks", F.expr(f"CAST(ceil(_n / {block}D) AS INT)"))
    placed = placed.withColumn("_block", F.pmod(F.xxhash64("uid"), F.col("_blocks")).cast("int"))
    work = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        *group, "uid", "_block", F.least("_block", "_other").alias("_a"), F.greatest("_block", "_other").alias("_b")
    )
    work = hand_over(work, "work")
    slots = max(common.n_slots(vectors), math.ceil(work.count() / SLOT_ROWS))
    dealt = work.withColumn("slot", F.pmod(F.xxhash64(*group, "_a", "_b"), F.lit(slots)).cast("int"))
    dealt = dealt.join(units.select("uid", "copies", "unit", "probes", "tables", "label", "dims"), ["uid", "label", "dims"])
    met = hand_over(dealt.groupBy("slot").applyInArrow(lambda rows: compare_slot(rows, cosine), "uid long, n long, to long"), "met")

    counts = met.where("to IS NULL").groupBy("uid").agg(F.sum("n").alias("_other"))
    parts = common.components(met.where("to IS NOT NULL").select(F.col("uid").alias("a"), F.col("to").alias("b")))
    reps = classes.select("uid", "_label", "_vector", "rep", "copies").join(parts.withColumnRenamed("id", "uid"), "uid", "left")
    reps = reps.withColumn("_part", F.coalesce("component_id", "uid")).drop("component_id")
    least = reps.groupBy("_part").agg(F.min("rep").alias("component_id"))
    reps = reps.join(least, "_part").join(counts, "uid", "left")
    reps = reps.withColumn("n_links", F.col("copies") - 1 + F.coalesce("_other", F.lit(0)))
    member = good.join(reps, ["uid", "_label", "_vector"]).select(F.col("_id").alias(key), "n_links", "component_id")
    alone = vectors.where(~can_link(vector, label)).select(
        key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id")
    )
    return member.unionByName(alone).withColumn("kept", F.col("component_id") == F.col(key))
