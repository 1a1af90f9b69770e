"""Best-fit packing of documents into sequences, after a Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so the instance is a table of counts by length, as
small for a huge corpus as for a few documents. The reduction and the best fit work on that table
and give bin patterns with multiplicities; documents are then dealt to the places of the patterns
by their number within their length. That numbering and the join are distributed.

Reduction: taking lengths from the largest, let ``x`` be open and let its bin have ``c - x`` left.
* Nothing open fits beside ``x``: ``x`` alone dominates every set with ``x``.
* ``x`` and ``y`` fill the bin exactly: ``{x, y}`` dominates, whatever else could stand beside ``x``.
* Only one item fits beside ``x`` (the two smallest open ones do not fit together): the largest open
  ``y`` that fits dominates.
* At most two items fit beside ``x`` (the three smallest do not), and the largest open ``y`` that fits
  is at least as long as the two largest that fit together: ``{x, y}`` dominates as well.
Sets that dominate are fixed for good; what remains open goes through best fit decreasing.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborlens.llm import common
from arborlens.session import hand_over

CAPACITY = 2048
END_ID = 0
#: Room for what an encoder remembers.
CACHE_BYTES = 24 << 20

# Fixed value: the published split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_encoding(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a ``tokenizers`` file as merge ranks; special tokens are ordinary text."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {x["content"] for x in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut_chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of chunks whose ids do not depend on their neighbours.

    A cut lies where every match of ``PATTERN`` ends: before a blank or line end that follows no
    white space, after a single line end that something else follows, and between an ASCII letter and a
    punctuation mark.
    """
    n = len(data)
    space = common._SPACE[data]
    space |= (data >= 0x1C) & (data <= 0x1F)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        before, here = data[:-1], data[1:]
        safe = ~space[:-1]
        # White space outside ASCII ends in one of these: no cut after it.
        safe[1:] &= ~((data[:-2] == 0xC2) & (before[1:] >= 0x80))
        safe[2:] &= ~((data[:-3] >= 0xE1) & (data[:-3] <= 0xE3) & (before[2:] >= 0x80))
        cut[1:-1] |= safe & ((here == 0x20) | (here == 0x0A))
        # A single line end is a match of its own.
        cut[2:-1] |= safe[:-1] & (before[1:] == 0x0A) & ~space[2:] & (here[1:] < 0x80)
        lower = before | 0x20
        mark = (here == 0x2E) | (here == 0x2C) | (here == 0x3B) | (here == 0x3A) | (here == 0x21) | (here == 0x3F)
        cut[1:-1] |= (lower >= 0x61) & (lower <= 0x7A) & mark
    cut[offsets] = True
    at = np.flatnonzero(cut)
    return at[:-1], at[1:]


_ODD = common._SPACE.copy()
_ODD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


class Encoder:
    """Ids of many texts: each distinct chunk of a slice is encoded once, frequent ones are remembered."""

    def __init__(self, path: str, room: int = CACHE_BYTES):
        self.encoding = load_encoding(path)
        self.room = room
        self.line_end = self.encoding.encode_ordinary("\n")[0]
        self.known = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, raw: bytes, start: np.ndarray, end: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, the ``odd`` ones last, and how many each has."""
        plain = np.flatnonzero(~odd)
        counts = np.zeros(len(start), np.int64)
        ids = np.zeros(0, np.uint32)
        if len(plain):
            # One call: a line end stays apart from what stands before and after it.
            text = b"\n".join([raw[a:b] for a, b in zip(start[plain].tolist(), end[plain].tolist())])
            ids = np.array(self.encoding.encode_ordinary(text.decode("utf-8", "replace")), np.uint32)
            owner = np.cumsum(ids == self.line_end)
            inside = ids != self.line_end
            counts[plain] = np.bincount(owner[inside], minlength=len(plain))
            ids = ids[inside]
        rest = [self.encoding.encode_ordinary(raw[start[i] : end[i]].decode("utf-8", "replace")) for i in np.flatnonzero(odd)]
        counts[odd] = [len(x) for x in rest]
        return np.concatenate([ids, *[np.array(x, np.uint32) for x in rest]]), counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        n_docs = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n_docs, np.int64)
        start, end = cut_chunks(data, offsets)
        keys = common.hash_spans(data, start, end)
        distinct, example, place = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        hit = np.zeros(len(distinct), bool)
        inside = at < len(self.known)
        hit[inside] = self.known[at[inside]] == distinct[inside]
        first, count = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        first[hit], count[hit] = self.first[at[hit]], self.count[at[hit]]
        miss = np.flatnonzero(~hit)
        a, b = start[example[miss]], end[example[miss]]
        # White space inside a chunk, or bytes that may begin white space outside ASCII: encoded one by one.
        odd_before = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_ODD[data], out=odd_before[1:])
        odd = odd_before[b] - odd_before[a] > (data[a] == 0x20)
        miss, a, b = (np.concatenate([x[~odd], x[odd]]) for x in (miss, a, b))
        new_ids, new_count = self._encode(data.tobytes(), a, b, np.sort(odd))
        pool = np.concatenate([self.ids, new_ids])
        first[miss] = len(self.ids) + np.cumsum(new_count) - new_count
        count[miss] = new_count
        if len(miss) and pool.nbytes + 24 * (len(self.known) + len(miss)) <= self.room:
            merged = np.concatenate([self.known, distinct[miss]])
            order = np.argsort(merged, kind="stable")
            self.known = merged[order]
            self.first = np.concatenate([self.first, first[miss]])[order]
            self.count = np.concatenate([self.count, count[miss]])[order]
            self.ids = pool
        size, begin = count[place], first[place]
        total = np.cumsum(size)
        ids = pool[np.arange(total[-1]) + np.repeat(begin - total + size, size)]
        doc = np.searchsorted(offsets, start, "right") - 1
        return ids, np.bincount(doc, size, minlength=n_docs).astype(np.int64)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces ``(key, piece, start, length, ids_crc32)`` of every document; a null text is empty.

    A document is its ids and then ``END_ID``. Only longer ones than ``capacity`` are cut, into
    pieces of that length; the first one takes what is over. ``tokenizer`` is a path that every
    executor can read.
    """
    rows = docs.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(tokenizer)
            for first, last, data, offsets in common.text_slices(batch.column(1), common.SMALL_SLICE):
                ids, counts = encoder.encode(data, offsets)
                ends = np.cumsum(counts)
                size = counts + 1
                pieces = -(-size // capacity)
                owner = np.repeat(np.arange(last - first), pieces)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = size - (pieces - 1) * capacity
                start = np.where(number == 0, 0, head[owner] + (number - 1) * capacity)
                length = np.where(number == 0, head[owner], capacity)
                begin = (ends - counts)[owner] + start
                stop = np.minimum(begin + length, ends[owner])
                closing = number == pieces[owner] - 1
                view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                tail = np.array([END_ID], "<u4").tobytes()
                sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), stop.tolist())]
                sums = [zlib.crc32(tail, s) if z else s for s, z in zip(sums, closing.tolist())]
                keys = batch.column(0).slice(first, last - first).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())],
                    names=[key, "piece", "start", "length", "ids_crc32"],
                )

    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bin patterns ``(lengths, times)`` that hold every item of ``counts`` (number of items by length)."""
    open_: dict[int, int] = {x: n for x, n in counts.items() if n > 0}
    lengths = sorted(open_)
    bins: list[tuple[tuple[int, ...], int]] = []

    def take(x: int, n: int) -> None:
        open_[x] -= n
        if not open_[x]:
            del open_[x]
            lengths.pop(bisect_right(lengths, x) - 1)

    def smallest(k: int) -> list[int]:
        found: list[int] = []
        for x in lengths:
            found += [x] * min(open_[x], k - len(found))
            if len(found) == k:
                break
        return found

    # Dominance: fix sets while the largest open length allows it.
    rest: dict[int, int] = {}
    for x in sorted(open_, reverse=True):
        while open_.get(x, 0):
            room = capacity - x
            others = smallest(4)
            if x in others:
                others.remove(x)  # the item itself is not beside itself
            if not others or others[0] > room:
                n = open_[x]
                bins.append(((x,), n))
                take(x, n)
                continue
            at = bisect_right(lengths, room) - 1
            y = lengths[at]
            if y == x and open_[x] == 1:
                at -= 1
                y = lengths[at] if at >= 0 else 0
            single = y and (y == room or len(others) < 2 or others[0] + others[1] > room)
            if y and not single and (len(others) < 3 or sum(others[:3]) > room):
                # Two more fit at most: y dominates if no two fitting items are longer together.
                pair = _longest_pair(lengths, open_, room, x)
                single = y >= pair
            if not single:
                break
            n = open_[x] // 2 if y == x else min(open_[x], open_[y])
            if y != room:
                # As long as the smallest items are there, the argument holds for each of them in turn.
                n = min(n, max(1, n - 2))
            bins.append(((x, y), n))
            take(x, n)
            take(y, n)
        if open_.get(x, 0):
            rest[x] = open_[x]
            take(x, open_[x])
            # The reduced instance keeps x for best fit; smaller lengths are judged without it only if
            # they cannot stand beside it, else the reduction ends here.
            if lengths and lengths[0] + x <= capacity:
                for z, n in open_.items():
                    rest[z] = rest.get(z, 0) + n
                break
    return bins + best_fit(rest, capacity)


def _longest_pair(lengths: list[int], open_: dict[int, int], room: int, x: int) -> int:
    """Largest sum, within ``room``, of two open items other than one ``x``."""
    best, i, j = 0, 0, len(lengths) - 1
    while i <= j:
        a, b = lengths[i], lengths[j]
        left = {a: open_[a] - (a == x), b: open_[b] - (b == x)}
        fits = a + b <= room
        if fits and left[a] > 0 and left[b] > (1 if a == b else 0):
            best = max(best, a + b)
        if fits:
            i += 1
        else:
            j -= 1
    return best


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on counts: equal open bins are one entry with a multiplicity."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}  # room -> pattern -> times
    rooms: list[int] = []

    def add(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in open_:
            open_[room] = {}
            insort(rooms, room)
        open_[room][pattern] = open_[room].get(pattern, 0) + n

    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            at = bisect_right(rooms, x - 1)
            if at == len(rooms):
                # A new bin takes as many of this length as it holds.
                k = capacity // x
                if n >= k:
                    add(capacity - k * x, (x,) * k, n // k)
                    n %= k
                else:
                    add(capacity - n * x, (x,) * n, 1)
                    n = 0
                continue
            room = rooms[at]
            pattern, times = next(iter(open_[room].items()))
            k = min(room // x, n)
            bins = min(times, n // k)
            del open_[room][pattern]
            if times > bins:
                open_[room][pattern] = times - bins
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            add(room - k * x, pattern + (x,) * k, bins)
            n -= k * bins
    return [(p, n) for by in open_.values() for p, n in by.items()]


def number_within(pieces: DataFrame, column: str, out: str) -> DataFrame:
    """Add ``out``, a 0-based number of each row among the rows of equal ``column``.

    Rows are numbered inside their own task and shifted by what earlier tasks hold; there is no task
    per length. ``pieces`` must be a written table, so that a second reading has the same tasks.
    """
    placed = hand_over(pieces.withColumn("_task", F.spark_partition_id()).withColumn("_slot", F.monotonically_increasing_id()), "slots")
    # One row per task and length at most.
    totals = placed.groupBy(column, "_task").count()
    earlier = Window.partitionBy(column).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(column, "_task", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_task", column).orderBy("_slot")
    return (
        placed.withColumn("_within", F.row_number().over(inside) - 1)
        .join(shifts, [column, "_task"])
        .withColumn(out, F.col("_within") + F.col("_shift"))
        .drop("_task", "_slot", "_within", "_shift")
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows of ``token_pieces``. No rows in, no rows out."""
    spark: SparkSession = pieces.sparkSession
    # Numbering first: the counts by length then come from a written table.
    numbered = number_within(pieces, "length", "_number")
    counts = {r["length"]: r["count"] for r in numbered.groupBy("length").count().collect()}  # one row per length, capacity at most
    places, sequence, used = [], 0, {}
    for pattern, times in pack_counts(counts, capacity):
        offset = 0
        per_bin = {x: pattern.count(x) for x in set(pattern)}
        seen = dict.fromkeys(per_bin, 0)
        for x in pattern:
            # Items numbered first + k * per_bin + seen, for k = 0 .. times - 1, stand here.
            places.append((x, used.get(x, 0), used.get(x, 0) + per_bin[x] * times, per_bin[x], seen[x], sequence, offset))
            seen[x] += 1
            offset += x
        for x, k in per_bin.items():
            used[x] = used.get(x, 0) + k * times
        sequence += times
    schema = "length long, _from long, _to long, _each long, _seat long, _sequence long, offset long"
    # A few rows per length and pattern, whatever the number of documents.
    table = spark.createDataFrame(places, schema)
    joined = numbered.join(F.broadcast(table), "length").where(
        "_number >= _from AND _number < _to AND (_number - _from) % _each = _seat"
    )
    return joined.select(
        *pieces.columns, (F.col("_sequence") + F.expr("(_number - _from) div _each")).alias("sequence_id"), "offset"
    )
