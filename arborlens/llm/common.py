"""What the operators share: slices of Arrow batches, words as arrays, links to components.

A text is handled whole. Inside a task, texts are worked off in slices of a few megabytes, so memory
follows the slice (or the longest single text) and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.session import hand_over, scratch_path

SLICE_BYTES = 4 << 20
#: For work that takes a hundred times the room of the text.
SMALL_SLICE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240607)
_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_FOLDED = _CODES.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _CODES[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``[first, last)`` with the UTF-8 bytes of their texts and the offset of each text; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, places, data = column.buffers()
    places = np.frombuffer(places, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(places, places[first] + most, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last, data[places[first] : places[last]], places[first : last + 1] - places[first]
        first = last


def by_slot(values: np.ndarray, n_slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deal hashes to slots by their leading bits: an order, and the first and last place of each used slot."""
    slot = ((values >> np.uint64(32)) % np.uint64(n_slots)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(slot[order]) > 0]) if len(order) else np.zeros(0, np.int64)
    return order, slot[order][edges], np.r_[edges, len(order)]


def in_slice_counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each value occurs, and whether it is the first of its value."""
    _, first, place, counts = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
    head = np.zeros(len(values), bool)
    head[first] = True
    return counts[place], head


def fresh(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def n_slots(df: DataFrame) -> int:
    """Slots for values that meet by hash: a few per shuffle partition, so they follow the cluster's setting."""
    return 4 * max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to as many partitions as shuffles have, by the hash that joins on ``key`` use."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def bucketed(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``hand_over`` as a table in buckets of ``key``: joins on it leave the rows in place. ``rows`` come dealt by ``key``."""
    spark = rows.sparkSession
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(buckets, key).sortBy(key).saveAsTable(table, path=path)
    return spark.table(table)


def spanning(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from an id to a smaller one that connect what the links ``ids[i] - ids[j]`` connect."""
    names, place = np.unique(ids, return_inverse=True)
    a, b = place[i], place[j]
    label = np.arange(len(names))
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word ``[^\\x20\\x09-\\x0D]+``, in byte positions."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (edge[:-1] | ~before))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (edge[1:] | ~after)) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hash of every byte span, the same wherever the span lies; ``fold`` takes A-Z as a-z."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _CODES)[data] * up[: len(data)], out=total[1:])
    return mix(((total[end] - total[start]) * down[start]) ^ (end - start).astype(np.uint64))


def shingles(words: np.ndarray, doc: np.ndarray, n_docs: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of ``width`` words; a shorter text is one run of all its words."""
    counts = np.bincount(doc, minlength=n_docs)
    n = len(words)
    found, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= width:
        full = doc[: n - width + 1] == doc[width - 1 :]
        rolled = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            rolled = rolled * np.uint64(_BASE) + words[k : n - width + 1 + k]
        found, owner = mix(rolled[full]), doc[: n - width + 1][full]
    short = (counts > 0) & (counts < width)
    if short.any():
        first = np.cumsum(counts) - counts
        more, whose = np.flatnonzero(short), first[short]
        rolled = counts[more].astype(np.uint64) << np.uint64(56)
        for k in range(width - 1):
            has = counts[more] > k
            rolled[has] = rolled[has] * np.uint64(_BASE) + words[whose[has] + k]
        found, owner = np.concatenate([found, mix(rolled)]), np.concatenate([owner, more])
    return found, owner


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component_id)`` of every id that occurs in ``links``; the component is its smallest id.

    Alternating star contraction: every vertex points its larger neighbours, then its smaller ones,
    to the smallest it sees. Rounds grow with the logarithm of a component's size. Minima are
    partial aggregates and the joins can be split, so a vertex with very many links is no hot task;
    each round is written to the shared folder.
    """
    pairs = links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs = hand_over(pairs, "links")
    mark = None
    while True:
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = hand_over(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        pairs = hand_over(small.select("x.u", "x.v").where("u <> v").distinct(), "links")
        seen = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    stars = pairs.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return stars.union(stars.select(F.col("component_id").alias("id"), "component_id")).distinct()
