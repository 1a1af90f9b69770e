"""Hard negatives by threshold joins over an inverted index with suffix-norm bounds.

For every anchor the nearest rows of its label are its positives, and the nearest rows of other labels
within a window under each positive are its hard negatives. Both are threshold joins: find every row
whose inner product with the anchor reaches a threshold, and lower the threshold until the windows fill.

The join follows L2AP. Dimensions stand in the order of their energy, in groups. A row is listed under
its leading groups only: where the norm of what follows, times the largest such norm of an anchor, is
below the threshold, the rest is left out of the index, since no pair could reach the threshold by it.
Partial scores grow list by list, and a pair is dropped as soon as its score so far and the product of
the remaining norms stay below the threshold. What survives is checked by the whole vectors.

Rows are dealt to slots and anchors to groups, both of bounded size; a unit of work joins one slot with
one group. A first round over a share of the slots gives thresholds that are known to fill the windows;
the second round meets the other slots with these, so a unit reports a few rows for each window only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlens.llm import common
from arborlens.session import hand_over

#: Dimensions of one group of the index.
GROUP = 16
ROW_TILE = 4096
ANCHOR_TILE = 256
#: Rows of a slot and anchors of a group, at most (on average, they are dealt by a hash).
SLOT_ROWS = 131_072
GROUP_ANCHORS = 16_384
#: One slot of so many gives the first thresholds.
SEED_SHARE = 16
#: Thresholds on the way down, as shares of the way from the lowest to the highest score of a window.
STEPS = (0.75, 0.625, 0.5, 0.0)
_MOST = 2**62


def pack(rows: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """``(id, label, dims, body)`` of the rows that take part, equal ones once; ``body`` holds floor(scale * x)."""
    good = F.col(label).isNotNull() & F.col(vector).isNotNull()
    good = good & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * scale) < float(_MOST)))
    chosen = rows.where(F.coalesce(good, F.lit(False))).select(
        F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector")
    )

    def whole(batches):
        for batch in batches:
            column = batch.column(2)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
            values = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
            ends = np.cumsum(sizes)
            bodies = []
            for end, size in zip(ends, sizes, strict=True):
                row = values[end - size : end]
                small = size == 0 or np.abs(row).max() < 2**31
                bodies.append(row.astype("<i4" if small else "<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes), pa.array(bodies, pa.binary())], names=["id", "label", "dims", "body"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema.fields}
    return chosen.mapInArrow(whole, f"id {kinds['id']}, label {kinds['label']}, dims int, body binary").distinct()


def matrix(bodies: list[bytes], dims: int) -> np.ndarray:
    """Whole numbers of ``pack`` as rows; int64 where products could leave the exact range of doubles."""
    if all(len(b) == 4 * dims for b in bodies):
        out = np.frombuffer(b"".join(bodies), "<i4").reshape(len(bodies), dims).astype(np.float64)
    else:
        out = np.stack([np.frombuffer(b, "<i4" if len(b) == 4 * dims else "<i8").astype(np.int64) for b in bodies])
    return out


def _exact(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether every partial sum of a product of two rows is exact in doubles."""
    if x.dtype == np.int64 or y.dtype == np.int64:
        return False
    norms = [np.sqrt((m * m).sum(1).max(initial=0.0)) for m in (x, y)]
    return norms[0] * norms[1] < 2.0**52


class Tile:
    """Rows of one tile with dimensions in the order of their energy, and norms of what follows each group."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows
        self.values = rows.astype(np.float64)
        dims = rows.shape[1]
        self.order = np.argsort(-(self.values**2).sum(0), kind="stable")
        self.groups = [self.order[i : i + GROUP] for i in range(0, dims, GROUP)]
        self.rest = self.suffix(self.values)

    def suffix(self, x: np.ndarray) -> np.ndarray:
        """Norm of a row from each group on; the last column is 0."""
        out = np.zeros((len(x), len(self.groups) + 1))
        for g in reversed(range(len(self.groups))):
            out[:, g] = out[:, g + 1] + (x[:, self.groups[g]] ** 2).sum(1)
        return np.sqrt(out)

    def join(self, anchors: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, row and score of every pair whose score reaches the anchor's ``least``."""
        x = anchors.astype(np.float64)
        above = self.suffix(x)
        low = least - 0.5 - 1e-9 * np.abs(least)  # room for rounded norms
        # Groups under which each row is listed: up to the first where what follows stays below every threshold.
        open_ = self.rest * above.max(0, initial=0.0) >= low.min(initial=np.inf)
        listed = np.logical_and.accumulate(open_[:, :-1], 1).sum(1)
        order = np.argsort(-listed, kind="stable")
        order = order[listed[order] > 0]
        listed = listed[order]
        score = np.zeros((len(x), len(order)))
        alive = np.ones(len(order), bool)
        for g, dims in enumerate(self.groups):
            at = np.flatnonzero(alive & (listed > g))
            if not len(at):
                break
            score[:, at] += x[:, dims] @ self.values[np.ix_(order[at], dims)].T
            reach = score[:, at] + above[:, g + 1, None] * self.rest[order[at], g + 1]
            alive[at] = (reach >= low[:, None]).any(0)
        at = np.flatnonzero(alive)
        left = listed[at]  # the first group under which the row is not listed
        i, j = np.nonzero(score[:, at] + above[:, left] * self.rest[order[at], left] >= low[:, None])
        j = order[at[j]]
        if not self.groups:
            i, j = np.nonzero(np.broadcast_to(least[:, None] <= 0, (len(x), len(self.rows))))
        if _exact(anchors, self.rows):
            found = np.einsum("ij,ij->i", x[i], self.values[j])
        else:
            found = (anchors[i].astype(np.int64) * self.rows[j].astype(np.int64)).sum(1)
        right = found >= least[i]
        return i[right], j[right], found[right].astype(np.int64)


def first_of(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, wanted: int) -> np.ndarray:
    """Places of the ``wanted`` first of each owner: high scores first, ties by id."""
    order = np.lexsort((ids, -score, owner))
    o = owner[order]
    start = np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) if len(o) else np.zeros(0, np.int64)
    rank = np.arange(len(o)) - np.repeat(start, np.diff(np.r_[start, len(o)]))
    return order[rank < wanted]


def fill(
    anchors: np.ndarray,
    own: np.ndarray,
    marks: np.ndarray,
    high: np.ndarray,
    low: np.ndarray,
    rows: np.ndarray,
    ids: np.ndarray,
    row_marks: np.ndarray,
    same: bool,
    wanted: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, window, row and score of the first rows in the windows ``[low, high]`` of each anchor.

    ``marks`` and ``row_marks`` are labels as numbers; ``same`` asks for equal ones, else for different ones.
    ``own`` and ``ids`` are the keys; an anchor never meets its own. Windows with low > high are empty.
    """
    tiles = [(first, Tile(rows[first : first + ROW_TILE])) for first in range(0, len(rows), ROW_TILE)]
    out = []
    longest = max((float(t.rest[:, 0].max(initial=0.0)) for _, t in tiles), default=0.0)
    for start in range(0, len(anchors), ANCHOR_TILE):
        part = slice(start, start + ANCHOR_TILE)
        x, hi, lo = anchors[part], high[part], low[part]
        reach = np.sqrt((x.astype(np.float64) ** 2).sum(1)) * longest + 1
        top = np.minimum(hi, np.minimum(reach, _MOST).astype(np.int64)[:, None])
        floor = np.maximum(lo, -np.minimum(reach, _MOST).astype(np.int64)[:, None])
        open_ = floor <= top
        for step in STEPS:
            if not open_.any():
                break
            least = floor + np.floor((top - floor) * step).astype(np.int64) if step else floor
            use = np.flatnonzero(open_.any(1))
            bound = np.where(open_, least, _MOST)[use].min(1)
            best = [np.zeros(0, np.int64) for _ in range(4)]
            for first, tile in tiles:
                i, j, score = tile.join(x[use], bound)
                fits = ((marks[part][use[i]] == row_marks[first + j]) == same) & (own[part][use[i]] != ids[first + j])
                i, j, score = use[i[fits]], first + j[fits], score[fits]
                for w in range(hi.shape[1]):
                    inside = open_[i, w] & (score <= hi[i, w]) & (score >= least[i, w])
                    found = (i[inside], np.full(int(inside.sum()), w, np.int64), j[inside], score[inside])
                    best = [np.concatenate(b) for b in zip(best, found, strict=True)]
                keep = first_of(best[0] * hi.shape[1] + best[1], best[3], ids[best[2]], wanted)
                best = [b[keep] for b in best]
            # A window that is full, or at its lowest threshold, is done; the others start again lower down.
            full = np.zeros(hi.shape, np.int64)
            np.add.at(full, (best[0], best[1]), 1)
            done = open_ & ((full >= wanted) | (least <= floor))
            ready = done[best[0], best[1]]
            out.append((best[0][ready] + start, *(b[ready] for b in best[1:])))
            open_ = open_ & ~done
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _join(rows: DataFrame, requests: DataFrame, first: int, end: int, n_groups: int, same: bool, wanted: int, name: str) -> DataFrame:
    """``(id, uid, window, found, score)``: the first rows of slots ``first`` to ``end`` in each window of every anchor."""
    key = rows.schema["id"].dataType.simpleString()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            _, numbers = np.unique(np.array(left["label"].to_pylist() + right["label"].to_pylist(), object).astype(str), return_inverse=True)
            marks, row_marks = numbers[: left.num_rows], numbers[left.num_rows :]
            dims, row_dims = left["dims"].to_numpy(), right["dims"].to_numpy()
            own, ids = left["id"].to_numpy(), right["found"].to_numpy()
            for size in np.intersect1d(dims, row_dims):
                # Rows of one label meet the anchors of that label; rows of other labels are met all at once.
                pairs = np.intersect1d(marks[dims == size], row_marks[row_dims == size]) if same else [None]
                for mark in pairs:
                    a = np.flatnonzero((dims == size) & (True if mark is None else marks == mark))
                    b = np.flatnonzero((row_dims == size) & (True if mark is None else row_marks == mark))
                    x, y = (matrix(t["body"].take(pa.array(p)).to_pylist(), int(size)) for t, p in ((left, a), (right, b)))
                    high, low = (_padded(left[c].take(pa.array(a)).to_pylist(), fill_) for c, fill_ in (("high", -_MOST), ("low", _MOST)))
                    i, w, j, score = fill(x, own[a], marks[a], high, low, y, ids[b], row_marks[b], same, wanted)
                    out.append((a[i], w, b[j], score))
        i, w, j, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 4
        return pa.table(
            {
                "id": left["id"].combine_chunks().take(pa.array(i, pa.int64())),
                "uid": left["uid"].combine_chunks().take(pa.array(i, pa.int64())),
                "window": pa.array(w.astype(np.int32)),
                "found": right["found"].combine_chunks().take(pa.array(j, pa.int64())),
                "score": pa.array(score),
            }
        )

    grouped = rows.where(F.col("slot").between(first, end - 1)).withColumnRenamed("id", "found")
    grouped = grouped.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    spread = requests.withColumn("slot", F.explode(F.sequence(F.lit(first), F.lit(end - 1))))
    found = spread.groupBy("slot", "group").cogroup(grouped.groupBy("slot", "group")).applyInArrow(
        meet, f"id {key}, uid long, window int, found {key}, score long"
    )
    return hand_over(found, name)


def _padded(lists: list[list[int]], value: int) -> np.ndarray:
    width = max(map(len, lists))
    return np.array([[*x, *[value] * (width - len(x))] for x in lists], np.int64)


def search(rows: DataFrame, requests: DataFrame, n_slots: int, n_groups: int, same: bool, wanted: int, name: str) -> DataFrame:
    """``(id, uid, window, rank, found, score)``: the first ``wanted`` rows in every window of ``requests``.

    ``requests``: ``id, uid, label, dims, body, group, high, low``, the last two as arrays with one entry for each window.
    """
    seeds = -(-n_slots // SEED_SHARE)
    first = _join(rows, requests, 0, seeds, n_groups, same, wanted, f"{name}-first")
    found = first
    if seeds < n_slots:
        # The least score of a full window is a threshold that fills it whatever the other slots hold.
        known = _ranked(first, wanted).groupBy("id", "uid", "window").agg(F.count("*").alias("_n"), F.min("score").alias("_least"))
        known = known.where(F.col("_n") >= wanted).groupBy("id", "uid").agg(F.map_from_entries(F.collect_list(F.struct("window", "_least"))).alias("_known"))
        raised = requests.join(known, ["id", "uid"], "left").withColumn(
            "low", F.transform("low", lambda x, w: F.coalesce(F.greatest(x, F.col("_known")[w.cast("int")]), x))
        )
        raised = hand_over(raised.drop("_known"), f"{name}-thresholds")
        found = first.union(_join(rows, raised, seeds, n_slots, n_groups, same, wanted, f"{name}-second"))
    return _ranked(found, wanted)


def _ranked(found: DataFrame, wanted: int) -> DataFrame:
    """A unit reports ``wanted`` rows at most for a window, so what is ranked here is small whatever an anchor is like."""
    order = Window.partitionBy("id", "uid", "window").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)


def _percent(share: int, rounding: str) -> Column:
    """``share`` percent of ``score``, rounded to a whole number without leaving the range of longs."""
    value = F.expr(f"{rounding}({share} * CAST(score AS DECIMAL(20, 0)) / 100)")
    return F.least(F.greatest(value, F.lit(-_MOST)), F.lit(_MOST)).cast("long")


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Scores are inner products of floor(``scale`` * x); ``anchors`` is a condition on ``id``, the key.
    Every anchor has its first ``positives`` other rows of its label; for each, the first ``negatives`` rows
    of other labels with ``low`` % to ``high`` % of the positive's score are returned. High scores come
    first, ties by smaller key. Rows with a null label or vector, or any null or non-finite component,
    take no part (nor do components that no long holds); neither do rows with a null key. Rows that are
    equal count once; rows that repeat a key with another label or vector are rows of their own, but never
    meet each other. Keys are whole numbers. Vectors of different length never meet. An anchor without positives, or with
    empty windows, gives no row. Scores must fit a long.
    """
    rows = pack(vectors.where(F.col(key).isNotNull()), key, vector, label, scale)
    rows = hand_over(rows.withColumn("uid", F.xxhash64("id", "label", "body")), "vectors")
    chosen = hand_over(rows.where(anchors), "anchors")
    n_rows, n_anchors = rows.count(), chosen.count()
    n_slots = max(common.n_slots(vectors), math.ceil(n_rows / SLOT_ROWS))
    n_groups = max(1, math.ceil(n_anchors / GROUP_ANCHORS))
    placed = rows.withColumn("slot", F.pmod(F.xxhash64("uid"), F.lit(n_slots)).cast("int")).drop("uid")
    asked = chosen.withColumn("group", F.pmod(F.xxhash64("uid"), F.lit(n_groups)).cast("int"))

    bounds = [F.array(F.lit(x).cast("long")) for x in (_MOST, -_MOST)]
    first = asked.withColumn("high", bounds[0]).withColumn("low", bounds[1])
    near = hand_over(search(placed, first, n_slots, n_groups, True, positives, "positives"), "positives")

    windows = near.withColumn("high", _percent(high, "floor")).withColumn("low", _percent(low, "ceil"))
    windows = windows.groupBy("id", "uid").agg(F.array_sort(F.collect_list(F.struct("rank", "high", "low"))).alias("_w"))
    second = asked.join(windows, ["id", "uid"]).withColumn("high", F.col("_w.high")).withColumn("low", F.col("_w.low")).drop("_w")
    hard = search(placed, hand_over(second, "windows"), n_slots, n_groups, False, negatives, "negatives")
    return (
        hard.select("id", "uid", (F.col("window") + 1).alias("_window"), "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(near.select("id", "uid", F.col("rank").alias("_window"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")), ["id", "uid", "_window"])
        .select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
