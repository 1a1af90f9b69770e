"""Repeated passages: compact windows of min-hashes, interval joins, verification on the words.

Shingles of five words are the tokens of a text. For each of a few hash functions, the smallest hash of
a run of tokens stays the same while the run moves within a compact window ``(l, c, r)``: all runs that
hold the token ``c`` and lie in ``[l, r]``. Windows are the nodes of the Cartesian tree over the hashes
whose subtree is as wide as a passage; they are few, about two per passage length and function.

1. Windows meet by hash value; those of one document only leave.
2. Within a document the windows of the functions are joined as intervals. Where enough functions have a
   window that lives, the pairs of their values are the keys of the passage.
3. Each key names its first document, first in every slice of texts, then among the first ones of all slices. A
   document and the first one of a key are compared as a whole: runs of equal shingles are chained, and the
   parts of a chain that agree in enough shingles are reported.

4. A first document may share a key by chance and hide what the others have in common. So all documents that
   were compared meet once more, by exact runs that two copies of a passage must have: long ones, which are a passage
   by themselves, and short ones, which any near copy keeps somewhere. What lies in a passage found before goes back to
   that passage's first document; a run pairs one document of each such origin with its own first document.

A document is compared with first documents only, not with all that share a key: what repeats is linked through
them. Windows, keys and runs move as packed bytes, and what a third of all documents have moves once for each slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.llm import common
from arborlens.session import hand_over

PASSAGE = 50
SHINGLE = 5
FUNCTIONS = 4
NEED = 2
SIMILARITY = 0.8

#: A window as the runs that it holds: the start of the first one, and how many more there are.
_ENTRY = np.dtype([("value", "<u4"), ("index", "<u4"), ("first", "<u4"), ("more", "<u2")])
_KEY = np.dtype([("key", "<i8"), ("doc", "<i8")])
#: A document of a row of runs, the document that they go back to, and how many of the row's runs it has so.
_OWNER = np.dtype([("doc", "<i8"), ("origin", "<i8"), ("runs", "<u4")])
#: Of so many neighbouring runs one is met.
SPREAD = 6
#: Words of a slice whose runs are hashed at once.
_SLICE_WORDS = 1 << 18


def window_minima(h: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the first smallest value of some run of ``width`` places of one text."""
    n = len(h)
    if n < width:
        return np.zeros(0, np.int64)
    best = np.arange(n)
    size = 1
    while size < width:
        step = min(size, width - size)
        a, b = best[: n - size - step + 1], best[step : n - size + 1]
        best = np.where(h[b] < h[a], b, a)
        size += step
    whole = doc[: n - width + 1] == doc[width - 1 :]
    return np.unique(best[whole])


def compact_windows(h: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(low, at, high)`` of every compact window that holds a run of ``width`` places.

    ``at`` is the first smallest place of its window. What bounds a wide node of the Cartesian tree is
    a wide node itself, so the tree is built over the minima of runs only.
    """
    at = window_minima(h, doc, width)
    ends = np.cumsum(np.bincount(doc)) if len(doc) else np.zeros(0, np.int64)
    low, high = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    values, places, owner = h[at].tolist(), at.tolist(), doc[at].tolist()
    stack: list[int] = []
    current = -1
    for k, v in enumerate(values):
        if owner[k] != current:
            for x in stack:
                high[x] = ends[current] - 1
            stack = []
            current = owner[k]
        while stack and values[stack[-1]] > v:
            high[stack.pop()] = places[k] - 1
        low[k] = places[stack[-1]] + 1 if stack else (ends[current - 1] if current else 0)
        stack.append(k)
    for x in stack:
        high[x] = ends[current] - 1
    return low, at, high


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of the texts, their text numbers, and how many words each text has."""
    start, end, doc = common.find_words(data, offsets)
    return common.hash_spans(data, start, end, fold=True), doc, np.bincount(doc, minlength=len(offsets) - 1)


def shared_windows(docs: DataFrame, key: str, text: str, passage: int, functions: int) -> DataFrame:
    """Windows ``(part, index, function, value, first, more)`` whose value another text has, and the texts of every slice.

    ``first`` is the start, in shingles, of the first run of a passage's length that a window holds, ``more`` the
    number of further ones. Rows of function -1 name the document of an index of a part. A value that several texts of a slice have needs no meeting: its windows live, and it reaches its
    slot once per slice.
    """
    rows = docs.select(key, text)
    slots = common.n_slots(docs)
    width = passage - SHINGLE + 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in common.text_slices(batch.column(1)):
                part += 1
                words, doc, counts = tokens_of(data, offsets)
                shingle, owner = common.shingles(words, doc, last - first, SHINGLE)
                full = counts[owner] >= SHINGLE
                shingle, owner = shingle[full], owner[full]
                per_text = np.bincount(owner, minlength=last - first)
                heads = np.cumsum(per_text) - per_text
                # Texts without shingles have no number in the tree.
                _, dense = np.unique(owner, return_inverse=True)
                out: list[list] = [[], [], [], []]
                lived = []
                for f in range(functions):
                    h = common.mix(shingle ^ np.uint64(0x632BE59BD9B4E019 * (f + 1) % 2**64))
                    low, at, high = compact_windows(h, dense, width)
                    who = owner[at]
                    entry = np.zeros(len(at), _ENTRY)
                    entry["index"] = who
                    begin = np.maximum(low, at - width + 1)
                    entry["first"] = begin - heads[who]
                    entry["more"] = np.minimum(high - width + 1, at) - begin
                    value = h[at]
                    # One text may have a value more than once; texts are what must differ.
                    seen = common.mix(value) ^ common.mix(who.astype(np.uint64))
                    _, once = np.unique(seen, return_index=True)
                    texts = np.zeros(len(at), bool)
                    texts[once] = True
                    _, place = np.unique(value, return_inverse=True)
                    several = np.bincount(place, texts)[place] > 1 if len(place) else np.zeros(0, bool)
                    _, head = common.in_slice_counts(value)
                    lived.append((np.full(several.sum(), f, np.int64), value[several], entry[several]))
                    go = ~several | head
                    value, entry = value[go], entry[go]
                    entry["index"][several[go]] = 0xFFFFFFFF
                    entry["value"] = value.astype("<u4")
                    order, used, edges = common.by_slot(value, slots)
                    entry = entry[order]
                    out[0] += (used * functions + f).tolist()
                    out[1] += [part] * len(used)
                    out[2] += [entry[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
                    out[3] += [None] * len(used)
                f, value, entry = (np.concatenate([x[k] for x in lived]) for k in range(3))
                out[0].append(-1 - part % slots)
                out[1].append(part)
                out[2].append(entry.tobytes())
                out[3].append(np.stack([f.astype(np.uint64), value]).tobytes() + ids[first:last].astype("<i8").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())],
                    names=["slot", "part", "entries", "extra"],
                )

    def meet(key_, group: pd.DataFrame) -> pd.DataFrame:
        found = []
        if key_[0] < 0:
            for part, entries, extra in zip(group["part"], group["entries"], group["extra"]):
                e = np.frombuffer(entries, _ENTRY)
                head = np.frombuffer(extra[: 16 * len(e)], np.uint64).reshape(2, -1)
                ids = np.frombuffer(extra[16 * len(e) :], "<i8")
                # The texts of the slice themselves, to name those that live elsewhere.
                names = pd.DataFrame({"part": part, "index": np.arange(len(ids)), "function": -1, "value": ids, "first": 0, "more": 0})
                lives = pd.DataFrame({"part": part, "index": e["index"].astype(np.int64), "function": head[0].astype(np.int64), "value": _value(head[1], slots),
                                      "first": e["first"].astype(np.int64), "more": e["more"].astype(np.int64)})
                found += [names, lives]
            return pd.concat(found, ignore_index=True)
        slot, f = divmod(key_[0], functions)
        e = np.frombuffer(b"".join(group["entries"]), _ENTRY)
        part = np.repeat(group["part"].to_numpy(), [len(x) // _ENTRY.itemsize for x in group["entries"]])
        single = e["index"] != 0xFFFFFFFF
        # Texts per value; a value of several texts of a slice counts as two.
        who = common.mix(part.astype(np.uint64)) ^ e["index"].astype(np.uint64)
        _, once = np.unique(np.stack([e["value"].astype(np.uint64), who], 1), axis=0, return_index=True) if len(e) else (None, np.zeros(0, np.int64))
        weight = np.zeros(len(e))
        weight[once] = np.where(single[once], 1, 2)
        _, place = np.unique(e["value"], return_inverse=True)
        good = (np.bincount(place, weight)[place] > 1) & single if len(e) else single
        e, part = e[good], part[good]
        value = (np.int64(slot) << 32) | e["value"].astype(np.int64)
        return pd.DataFrame({"part": part, "index": e["index"].astype(np.int64), "function": f, "value": value,
                             "first": e["first"].astype(np.int64), "more": e["more"].astype(np.int64)})

    sent = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), text).mapInArrow(send, "slot long, part long, entries binary, extra binary")
    return sent.groupBy("slot").applyInPandas(meet, "part long, index int, function short, value long, first int, more int")


def _value(h: np.ndarray, slots: int) -> np.ndarray:
    """A hash as its slot and its low half, as the slots see it."""
    slot = (h >> np.uint64(32)) % np.uint64(slots)
    return ((slot << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))).astype(np.int64)


def interval_keys(rows: pd.DataFrame, functions: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and documents of the windows of whole documents: values of ``need`` functions that hold one run. Each pair once."""
    from itertools import combinations

    docs, owner = np.unique(rows["doc"].to_numpy(np.int64), return_inverse=True)
    first, more = (rows[c].to_numpy(np.int64) for c in ("first", "more"))
    value, function = rows["value"].to_numpy(np.int64), rows["function"].to_numpy()
    # Starts of the runs, on one line for all documents.
    span = int((first + more).max()) + 2 if len(first) else 1
    a = owner * span + first
    b = a + more
    cuts = np.unique(np.r_[a, b + 1])
    held = []
    for f in range(functions):
        mine = np.flatnonzero(function == f)
        mine = mine[np.argsort(a[mine], kind="stable")]
        j = np.searchsorted(a[mine], cuts, "right") - 1
        ok = j >= 0
        ok[ok] &= cuts[ok] <= b[mine[j[ok]]]
        held.append(np.where(ok, mine[np.maximum(j, 0)] if len(mine) else -1, -1))
    out = [np.zeros((0, 2), np.int64)]
    for chosen in combinations(range(functions), need):
        ok = np.logical_and.reduce([held[f] >= 0 for f in chosen])
        windows = [held[f][ok] for f in chosen]
        key = np.full(ok.sum(), sum(1 << f for f in chosen), np.uint64)
        for w in windows:
            key = common.mix(key * np.uint64(31) + value[w].astype(np.uint64))
        found = np.stack([key.astype(np.int64), docs[owner[windows[0]]]], 1)
        # Neighbouring cuts mostly have the same windows.
        out.append(found[np.r_[True, (found[1:] != found[:-1]).any(1)][: len(found)]])
    found = np.concatenate(out)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    found = found[np.r_[True, (found[1:] != found[:-1]).any(1)][: len(found)]]
    return found[:, 0], found[:, 1]


def first_documents(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each key begins in sorted pairs, and distinct ``(document, first document)`` of all others."""
    head = np.r_[True, key[1:] != key[:-1]][: len(key)]
    at = np.flatnonzero(head)
    first = np.repeat(doc[at], np.diff(np.r_[at, len(key)]))
    other = np.flatnonzero(doc != first)
    pairs = np.unique(np.stack([doc[other], first[other]], 1), axis=0)
    return at, pairs[:, 0], pairs[:, 1]


def run_hashes(words: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of ``width`` words that lies in one text."""
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = common.powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(common.mix(words.astype(np.uint64) + np.uint64(1)) * up[: len(words)], out=total[1:])
    whole = doc[:n] == doc[width - 1 :]
    return common.mix((total[width:] - total[:n]) * down[:n])[whole], doc[:n][whole]


def least_shared(passage: int, similarity: float) -> int:
    """Shingles that two near copies of a passage have in common at least."""
    return int(np.ceil(2 * (passage - SHINGLE + 1) * similarity / (1 + similarity) - 1e-9))


def near_run(passage: int, similarity: float) -> int:
    """Words of the longest exact run that two near copies of a passage have at least.

    A place where they differ costs nine shingles of both sides together (a word put in), and not more than
    ``1 / similarity - 1`` of the shared ones may be lost. Texts that repeat four words at once can differ for less.
    """
    least = least_shared(passage, similarity)
    return SHINGLE - 1 + min(-(-k // (int((1 / similarity - 1) * k / (2 * SHINGLE - 1) + 1e-9) + 1)) for k in range(least, 20 * least))


def first_origins(run: np.ndarray, doc: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each run begins in rows sorted by run and document, and distinct ``(document, first document)``.

    Of the documents of a run that go back to one origin the smallest is paired; none whose origin is that of the first.
    """
    at = np.flatnonzero(np.r_[True, run[1:] != run[:-1]][: len(run)])
    first, home = (np.repeat(x[at], np.diff(np.r_[at, len(run)])) for x in (doc, origin))
    other = np.flatnonzero((origin != home) & (doc != first))
    other = other[np.lexsort((doc[other], origin[other], run[other]))]
    r, o = run[other], origin[other]
    other = other[np.r_[True, (r[1:] != r[:-1]) | (o[1:] != o[:-1])][: len(other)]]
    pairs = np.unique(np.stack([doc[other], first[other]], 1), axis=0)
    return at, pairs[:, 0], pairs[:, 1]


def run_pairs(words: DataFrame, passage: int | tuple[int, ...], slots: int, spread: int = 1) -> DataFrame:
    """``(doc, first)`` of the documents of ``words(id, words)`` that have a run of ``passage`` words in common.

    ``first`` is the smallest document of a slice that has the run; the first ones of all slices are paired
    with the smallest of all. A run that several texts of a slice have moves once. ``passage`` may name several lengths.
    Of ``spread`` neighbouring runs the one with the smallest hash is met, so what has a run of ``passage + spread - 1``
    words in common is sure to meet. A column ``spans`` holds ``(start, n_words, other)`` of the passages of a document
    that are known from an earlier one: a run inside goes back to it, and only runs of different origin are paired.
    """
    widths = np.atleast_1d(passage).tolist()
    kind = "array<struct<start:long,n_words:long,other:long>>"
    spans = F.col("spans") if "spans" in words.columns else F.lit(None).cast(kind).alias("spans")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            column = batch.column(1).cast(pa.large_binary())
            _, places, data = column.buffers()
            places = np.frombuffer(places, np.int64)[column.offset : column.offset + len(ids) + 1]
            data = np.frombuffer(data, np.uint8)
            known = batch.column(2).offsets.to_numpy()
            start, n_words, other = (batch.column(2).values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            a = 0
            while a < len(ids):
                b = int(np.searchsorted(places, places[a] + 4 * _SLICE_WORDS, "right")) - 1
                b = min(max(b, a + 1), len(ids))
                names = ids[a:b]
                text = data[places[a] : places[b]].view("<u4")
                doc = np.repeat(np.arange(b - a), np.diff(places[a : b + 1]) // 4)
                found = []
                for width in widths:
                    run, who = run_hashes(text, doc, width)
                    met = window_minima(run, who, spread)
                    heads = np.searchsorted(who, np.arange(b - a))
                    run, who = run[met], who[met]
                    place, origin = met - heads[who], names[who]
                    edges = np.searchsorted(who, np.arange(b - a + 1))
                    for k in np.flatnonzero(np.diff(known[a : b + 1])).tolist():
                        here, goes = place[edges[k] : edges[k + 1]], origin[edges[k] : edges[k + 1]]
                        for s in range(known[a + k], known[a + k + 1]):
                            x, y = np.searchsorted(here, start[s]), np.searchsorted(here, start[s] + n_words[s] - width, "right")
                            goes[x:y] = np.minimum(goes[x:y], other[s])
                    found.append((run, names[who], origin))
                a = b
                run, who, origin = (np.concatenate([x[k] for x in found]) for k in range(3))
                order = np.lexsort((origin, who, run))
                run, who, origin = run[order], who[order], origin[order]
                at, later, first = first_origins(run, who, origin)
                run, who, origin = run[at], who[at], origin[at]
                # By document within a slot, so that a document is named once for all its runs there.
                back = np.lexsort((origin, who))
                run, who, origin = run[back], who[back], origin[back]
                order, used, edges = common.by_slot(run, slots)
                run, who, origin = run[order], who[order], origin[order]
                packed, owners = [], []
                for x, y in zip(edges[: len(used)], edges[1:]):
                    heads = np.flatnonzero(np.r_[True, (who[x + 1 : y] != who[x : y - 1]) | (origin[x + 1 : y] != origin[x : y - 1])])
                    owner = np.zeros(len(heads), _OWNER)
                    owner["doc"], owner["origin"], owner["runs"] = who[x:y][heads], origin[x:y][heads], np.diff(np.r_[heads, y - x])
                    # 40 bits beside the slot: its number came from the leading half, the quotient is left of that.
                    high = (run[x:y] >> np.uint64(32)) // np.uint64(slots)
                    packed.append((run[x:y] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (high & np.uint64(0xFF)).astype("u1").tobytes())
                    owners.append(owner.tobytes())
                if len(later):
                    # The pairs of the slice itself go along in a row of their own.
                    used = np.r_[used, -1 - int(later[0]) % slots]
                    packed.append(later.astype("<i8").tobytes())
                    owners.append(first.astype("<i8").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int64()), pa.array(packed, pa.binary()), pa.array(owners, pa.binary())], names=["slot", "runs", "owners"]
                )

    def across(key_, rows: pd.DataFrame) -> pd.DataFrame:
        if key_[0] < 0:
            later, first = (np.frombuffer(b"".join(rows[c]), "<i8") for c in ("runs", "owners"))
            return pd.DataFrame({"doc": later, "first": first}).drop_duplicates()
        owner = np.frombuffer(b"".join(rows["owners"]), _OWNER)
        doc, origin = (np.repeat(owner[c], owner["runs"]) for c in ("doc", "origin"))
        low = np.frombuffer(b"".join(r[: len(r) // 5 * 4] for r in rows["runs"]), "<u4")
        high = np.frombuffer(b"".join(r[len(r) // 5 * 4 :] for r in rows["runs"]), "u1")
        run = high.astype(np.int64) << 32 | low
        order = np.lexsort((doc, run))
        _, later, first = first_origins(run[order], doc[order], origin[order])
        return pd.DataFrame({"doc": later, "first": first})

    sent = words.select("id", "words", spans).mapInArrow(send, "slot long, runs binary, owners binary")
    return sent.groupBy("slot").applyInPandas(across, "doc long, first long").distinct()


def shingled(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of one text, their order by hash (and place), and the hashes in that order."""
    found = common.shingles(words.astype(np.uint64), np.zeros(len(words), np.int64), 1, SHINGLE)[0]
    order = np.argsort(found, kind="stable")
    return found, order, found[order]


def common_blocks(x: np.ndarray, y: tuple[np.ndarray, np.ndarray, np.ndarray], width: int, least: int) -> list[tuple[int, int, int]]:
    """Runs ``(i, j, n)`` of equal shingles, along x; of several places in y the one that agrees longest."""
    other, order, ordered = y
    low, high = np.searchsorted(ordered, x, "left"), np.searchsorted(ordered, x, "right")
    has = np.flatnonzero(high > low)
    if len(has) < least:
        return []
    blocks: list[tuple[int, int, int]] = []
    p, before = 0, 0
    while p < len(has):
        i = int(has[p])
        places = order[low[i] : high[i]]
        t = 1
        while len(places) > 1 and t < width and i + t < len(x):
            longer = places[places + t < len(other)]
            longer = longer[other[longer + t] == x[i + t]]
            if not len(longer):
                break
            places, t = longer, t + 1
        k = int(np.searchsorted(places, before))
        j = int(places[k] if k < len(places) else places[0])
        n, step, most = 1, 64, min(len(x) - i, len(other) - j)
        while n < most:
            end = min(most, n + step)
            differ = np.flatnonzero(x[i + n : i + end] != other[j + n : j + end])
            if len(differ):
                n += int(differ[0])
                break
            n, step = end, step * 4
        blocks.append((i, j, n))
        before = j + n
        p = int(np.searchsorted(has, i + n))
    return blocks


def near_passages(
    x: tuple[np.ndarray, np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray, np.ndarray], passage: int, similarity: float
) -> list[tuple[int, int, int, int]]:
    """Word spans ``(a, b)`` of x and ``(c, d)`` of y that are near copies, words put in or left out included.

    Equal runs of shingles are chained in the order of both texts. A part of a chain is reported where its
    shingles are the asked share of all shingles between its ends and as many as two passages must have in common.
    """
    width = passage - SHINGLE + 1
    least = least_shared(passage, similarity)
    chains: list[list[tuple[int, int, int]]] = []
    live: list[int] = []
    # What stands between two runs must not outweigh all that could be shared.
    most = max(passage, int((1 / similarity - 1) * min(len(x[0]), len(y[0]))) + 1)
    for i, j, n in common_blocks(x[0], y, width, least):
        live = [c for c in live if i - sum(chains[c][-1][::2]) <= most]
        best = None
        for c in live:
            u, v, m = chains[c][-1]
            trim = max(0, v + m - j)
            if trim < min(n, SHINGLE) and j - v - m <= most:
                rank = (abs((i - u) - (j - v)), -c)
                best = min(best, (rank, c, trim)) if best else (rank, c, trim)
        if best:
            _, c, trim = best
            chains[c].append((i + trim, j + trim, n - trim))
        else:
            live.append(len(chains))
            chains.append([(i, j, n)])
    spans = []
    for chain in chains:
        at, to = (np.concatenate([np.arange(b[k], b[k] + b[2]) for b in chain]) for k in (0, 1))
        k = np.arange(len(at))
        # Shared shingles of a part, times this, less the shingles of both sides: at least 0 in a near copy.
        worth = (1 + 1 / similarity) * k - at - to
        ahead = np.maximum.accumulate(worth[::-1])
        reach = len(at) - 1 - np.searchsorted(ahead, worth + 1 - 1 / similarity - 1e-6)
        good = np.flatnonzero(reach >= k + least - 1)
        end = -1
        parts: list[list[int]] = []
        for g in good.tolist():
            # Parts that touch are one.
            if parts and (g <= end or (at[g] <= at[end] + SHINGLE and to[g] <= to[end] + SHINGLE)):
                parts[-1][1] = end = max(end, int(reach[g]))
            else:
                end = int(reach[g])
                parts.append([g, end])
        spans += [(int(at[g]), int(at[e]) + SHINGLE, int(to[g]), int(to[e]) + SHINGLE) for g, e in parts]
    return sorted(spans)


def repeated_passages(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    passage: int = PASSAGE,
    functions: int = FUNCTIONS,
    need: int = NEED,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """Passages of about ``passage`` words or more that two documents share.

    One row ``(key, start, n_words, other, other_start, first)`` per passage and side: ``start`` and
    ``n_words`` in words of the document (near copies may differ in length), ``other`` the document it was compared with, ``first`` true on
    the side of the earlier document (the copy to keep). Words are compared with A-Z as a-z. A document
    with fewer words than a passage, a null or empty text, or a null key has no rows. The key is a
    whole number; rows that repeat a key must repeat its text. An exact repeat of ``passage`` words has
    the same keys on both sides, whatever stands around it.
    """
    unique = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias(key), text)
    windows = shared_windows(unique, key, text, passage, functions)
    slots = common.n_slots(docs)

    def within(key_, rows: pd.DataFrame) -> pd.DataFrame:
        # All windows of a slice of texts.
        names = rows[rows["function"] < 0]
        docs_ = np.zeros(int(rows["index"].max()) + 1, np.int64)
        docs_[names["index"].to_numpy(np.int64)] = names["value"].to_numpy(np.int64)
        rows = rows[rows["function"] >= 0]
        found, doc = interval_keys(rows.assign(doc=docs_[rows["index"].to_numpy(np.int64)]), functions, need)
        at, later, first = first_documents(found, doc)
        packed = np.zeros(len(at), _KEY)
        packed["key"], packed["doc"] = found[at], doc[at]
        order, used, edges = common.by_slot(packed["key"].astype(np.uint64), slots)
        packed = packed[order]
        sent = pd.DataFrame({"slot": used, "keys": [packed[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:], strict=True)]})
        return pd.concat([sent, pd.DataFrame({"doc": later, "first": first})], ignore_index=True).astype(
            {"slot": "Int64", "doc": "Int64", "first": "Int64"}
        )[["slot", "keys", "doc", "first"]]

    def across(key_, rows: pd.DataFrame) -> pd.DataFrame:
        pairs = np.unique(np.frombuffer(b"".join(rows["keys"]), _KEY))
        _, later, first = first_documents(pairs["key"], pairs["doc"])
        return pd.DataFrame({"doc": later, "first": first})

    keys = hand_over(windows.groupBy("part").applyInPandas(within, "slot long, keys binary, doc long, first long"), "keys")
    met = keys.where("slot IS NOT NULL").select("slot", "keys").groupBy("slot").applyInPandas(across, "doc long, first long")
    compared = hand_over(keys.where("slot IS NULL").select("doc", "first").union(met).distinct(), "compared")
    named = compared.select("doc").union(compared.select("first")).distinct().withColumnRenamed("doc", "id")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in common.text_slices(batch.column(1)):
                words, _, counts = tokens_of(data, offsets)
                parts = np.split(words, np.cumsum(counts)[:-1])
                columns = [batch.column(0).slice(first, last - first), pa.array(counts, pa.int64()), pa.array([p.astype("<u4").tobytes() for p in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "words"])

    # Words move to the buckets of their documents once, and no text moves for them.
    spelled = common.dealt(unique.mapInArrow(spell, "id long, n long, words binary"), "id")
    words = common.bucketed(spelled.join(named, "id", "left_semi").dropDuplicates(["id"]), "id", "words")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last document that stayed: its pairs mostly stand together.
        kept: tuple = (None, None)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for mover, at, moved, here in zip(*(batch.column(k) for k in range(4))):
                mover, at = mover.as_py(), at.as_py()
                if kept[0] != at:
                    kept = (at, shingled(np.frombuffer(here.as_py(), "<u4")))
                sides = {mover: shingled(np.frombuffer(moved.as_py(), "<u4")), at: kept[1]}
                doc, other = max(sides), min(sides)
                for a, b, c, d in near_passages(sides[doc], sides[other], passage, similarity):
                    for row in ((doc, a, b - a, other, c, False), (other, c, d - c, doc, a, True)):
                        for column, v in zip(out, row):
                            column.append(v)
            kinds = [pa.int64()] * 5 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[key, "start", "n_words", "other", "other_start", "first"])

    def checked(pairs: DataFrame) -> DataFrame:
        # The shorter text of a pair moves to the longer one.
        size = words.select("id", "n")
        sized = pairs.join(size.toDF("doc", "n_doc"), "doc").join(size.toDF("first", "n_first"), "first")
        shorter = F.col("n_doc") <= F.col("n_first")
        sized = sized.select(F.when(shorter, F.col("doc")).otherwise(F.col("first")).alias("mover"), F.when(shorter, F.col("first")).otherwise(F.col("doc")).alias("at"))
        moved = sized.join(words.select(F.col("id").alias("mover"), F.col("words").alias("moved")), "mover")
        met = moved.join(words.select(F.col("id").alias("at"), F.col("words").alias("here")), "at")
        spans = met.select("mover", "at", "moved", "here").mapInArrow(
            verify, f"{key} long, start long, n_words long, other long, other_start long, first boolean"
        )
        return hand_over(spans, "passages")

    found = checked(compared)
    # Every compared document meets the others by runs; passages found so far only tell where a run comes from.
    spans = found.where("NOT first").groupBy(F.col(key).alias("id")).agg(F.collect_list(F.struct("start", "n_words", "other")).alias("spans"))
    # A long run of this length is found as a passage by itself, whichever document it is met in.
    long_run = least_shared(passage, similarity) + SHINGLE - 1
    spread = min(SPREAD, passage - long_run + 1)
    short_run = max(SHINGLE, near_run(passage, similarity) - spread + 1)
    hidden = run_pairs(words.join(spans, "id", "left"), (long_run, short_run), slots, spread)
    found = found.union(checked(hidden.join(compared, ["doc", "first"], "left_anti")))
    # The earlier side once per passage, with its first repeat.
    earlier = found.where("first").groupBy(key, "start", "n_words").agg(F.min(F.struct("other", "other_start")).alias("o"))
    earlier = earlier.select(key, "start", "n_words", "o.other", "o.other_start", F.lit(True).alias("first"))
    return found.where("NOT first").union(earlier)
