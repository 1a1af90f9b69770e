"""Concerns that say the same in other words, and what models make of the same file.

Two concerns of a run are alike when their sets of words overlap enough (Jaccard). Concerns that alike ones
connect are one topic. Candidates come from prefix filters: with the words of a set in order of
how rare they are, two sets that overlap by the threshold must share one of their first few
words, so only concerns with a rare word in common are compared. Concerns with equal sets are one
before that, however many there are.

Texts stay where they are meanwhile: sets go by a number, their first words move packed to the slots of their hashes, and
with each goes its place in the set and a bit map of the words from there on. The first word that two sets share has all others
they share behind it, so its places rule out most pairs that meet in a slot, and two maps that differ in more bits than
the rests of two sets may differ in words rule out most others. Only pairs that are alike, and few others, meet their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from arborlens.operators.components import connected_components
from arborlens.operators.reports import mentions
from arborlens.session import hand_over

#: Least share of common words, in percent of all words of both.
ALIKE = 60
#: Words are counted by so many leading values of their hashes; any order of words gives the same pairs.
COUNTERS = 1 << 18
#: 64-bit pieces of a bit map.
MAP = 4
#: Pairs that a task looks at in one go.
PAIRS = 1 << 20

_ENTRY = np.dtype([("word", "<u4"), ("n", "<u4"), ("place", "<u4"), ("id", "<i8"), ("map", "<u8", MAP)])


_BETWEEN = r"[^\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """Distinct words of a text: letters, digits and ``_``, in lower case."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), _BETWEEN), ""))


def spaced(text: Column) -> Column:
    """The words of a text with a blank between them, as ``word_sets`` reads them."""
    return F.trim(F.regexp_replace(F.lower(text), _BETWEEN, " "))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of texts: sums over their bytes of a number that stands for a byte at its place."""
    ends = np.frombuffer(distinct.buffers()[1], np.int32)[distinct.offset : distinct.offset + len(distinct) + 1].astype(np.int64)
    data = np.frombuffer(distinct.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    n = np.diff(ends)
    place = np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], n)
    found = np.zeros(len(n), np.uint64)
    found[n > 0] = np.add.reduceat(_mix(data + np.uint64(1) + (place.astype(np.uint64) << np.uint64(8))), (ends[:-1] - ends[0])[n > 0]) if len(data) else 0
    return _mix(found)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """All words of ``texts`` from ``spaced``: the numbers of their texts, their places in hashes, these, and how many texts there are."""
    lists = pc.split_pattern(texts.cast(pa.string()), " ")
    n = np.diff(lists.offsets.to_numpy())
    found = lists.flatten().dictionary_encode()
    at = found.indices.to_numpy()
    # A text without words is one empty piece.
    is_word = (pc.binary_length(found.dictionary).to_numpy() > 0)[at]
    return np.repeat(np.arange(len(n)), n)[is_word], at[is_word], _hashes(found.dictionary), len(n)


def word_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words of each text from ``spaced``, in ascending order, and where the texts begin and end there."""
    owner, at, hashes, n = _words(texts)
    order = np.argsort(hashes)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    # Numbers sort many times faster than pairs of numbers.
    pairs = np.sort(owner * len(hashes) + rank[at])
    pairs = pairs[np.diff(pairs, prepend=-1) > 0]
    owner, at = np.divmod(pairs, max(1, len(hashes)))
    return hashes[order][at], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def first_words(
    hashes: np.ndarray, ends: np.ndarray, times: np.ndarray, percent: int, onward: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``hashes`` of the first words of every set, the sets they belong to, and the bit maps of all sets.

    Set ``k`` has the hashes ``ends[k]`` to ``ends[k + 1]``, one at least. With ``onward`` there is a map for each
    first word instead, of this word and those behind it in its set.
    """
    n = np.diff(ends)
    owner = np.repeat(np.arange(len(n)), n)
    distinct, which = np.unique(hashes, return_inverse=True)
    order = np.lexsort((distinct, times[distinct % np.uint64(COUNTERS)]))
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    order = np.argsort(owner * len(distinct) + rank[which])
    # Of n words at least ceil(n * percent / 100) are shared, so one of the first n - that + 1 is.
    first = n - (n * percent + 99) // 100 + 1
    chosen = np.arange(len(hashes)) - ends[:-1][owner] < first[owner]
    bit = _mix(hashes[order]) >> np.uint64(40)
    piece, bit = (bit // np.uint64(64) % np.uint64(MAP)).astype(np.int64), np.uint64(1) << bit % np.uint64(64)

    def united(starts: np.ndarray) -> np.ndarray:
        """Maps of the words of every set from ``starts`` on."""
        maps = np.zeros((len(n), MAP), np.uint64)
        ranges = np.stack([starts, ends[1:]], 1).reshape(-1)
        for k in range(MAP if len(n) else 0):
            maps[:, k] = np.bitwise_or.reduceat(np.append(np.where(piece == k, bit, np.uint64(0)), np.uint64(0)), ranges)[::2]
        # What begins at its end has no word.
        maps[starts == ends[1:]] = 0
        return maps

    if not onward:
        return order[chosen], owner[chosen], united(ends[:-1])
    # From the last one of the first words to the first: the sets with most of them stand in front.
    longest = np.argsort(-first, kind="stable")
    so_far = united(ends[:-1] + first)[longest]
    begin = np.concatenate([[0], np.cumsum(first)[:-1]]).astype(np.int64)
    maps = np.zeros((int(first.sum()), MAP), np.uint64)
    have = np.searchsorted(-first[longest], -np.arange(int(first.max(initial=0))), "left")
    for place in range(len(have) - 1, -1, -1):
        some = longest[: have[place]]
        at = ends[some] + place
        so_far[np.arange(len(some)), piece[at]] |= bit[at]
        maps[begin[some] + place] = so_far[: len(some)]
    return order[chosen], owner[chosen], maps


def slot_pairs(entries: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of the sets of ``entries`` that share a word and whose sizes, places and maps let them be alike."""
    e = entries[np.lexsort((entries["n"], entries["word"]))]
    word, n, ids, maps = e["word"].astype(np.uint64) << np.uint64(32), e["n"].astype(np.int64), e["id"], e["map"]
    rest = n - e["place"]
    # Alike sets have percent * both / (100 + percent) words in common or more, all of them from their first common word on.
    # Partners stand behind, up to the largest size that this word's place allows.
    most = np.clip(np.minimum(100 * n // percent, rest * (100 + percent) // percent - n), 0, 2**32 - 1)
    last = np.searchsorted(word | n.astype(np.uint64), word | most.astype(np.uint64), "right")
    count = np.maximum(last - np.arange(len(e)) - 1, 0)
    total = np.cumsum(count)
    found = [np.zeros((0, 2), np.int64)]
    done = 0
    while done < (total[-1] if len(e) else 0):
        end = min(done + PAIRS, int(total[-1]))
        # The pairs ``done`` to ``end`` of all, so that a frequent word takes no more room than others.
        rows = np.arange(np.searchsorted(total, done, "right"), np.searchsorted(total, end, "left") + 1)
        i = np.repeat(rows, np.minimum(total[rows], end) - np.maximum(total[rows] - count[rows], done))
        j = i + 1 + np.arange(done, end) - (total[i] - count[i])
        done = end
        good = percent * (n[i] + n[j]) <= (100 + percent) * rest[j]
        i, j = i[good], j[good]
        # Each bit that differs is a word that is not common.
        least = -(-percent * (n[i] + n[j]) // (100 + percent))
        differ = np.bitwise_count(maps[i] ^ maps[j]).sum(1, dtype=np.int64)
        good = (differ <= rest[i] + rest[j] - 2 * least) & (ids[i] != ids[j])
        a, b = ids[i[good]], ids[j[good]]
        found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], pairs[:, 1]


def word_times(texts: DataFrame) -> np.ndarray:
    """How often words occur in ``texts(text)``, by the counters of their hashes: a fixed number, whatever the number of words."""
    share = COUNTERS // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            _, at, hashes, _ = _words(batch.column(0))
            here = np.bincount(at, minlength=len(hashes))
            times += np.bincount((hashes % np.uint64(COUNTERS)).astype(np.int64), here, COUNTERS).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"part": np.arange(64), "times": [x.tobytes() for x in times.reshape(64, share)]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        times = sum(np.frombuffer(x, np.int64) for x in rows["times"])
        return pd.DataFrame({"part": rows["part"][:1], "times": [times.tobytes()]})

    counted = texts.select(spaced(F.col("text"))).mapInArrow(count, "part long, times binary")
    times = np.zeros((64, share), np.int64)
    for row in counted.groupBy("part").applyInPandas(add, "part long, times binary").collect():
        times[row.part] = np.frombuffer(row.times, np.int64)
    return times.reshape(-1)


def _squeezed(entries: np.ndarray) -> bytes:
    """Entries in the order of their ids, byte by byte, in about half their size: maps are sparse and ids close."""
    entries = entries.copy()
    entries["id"] = np.diff(entries["id"], prepend=0)
    planes = entries.view(np.uint8).reshape(-1, _ENTRY.itemsize).T.tobytes()
    return len(entries).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unsqueezed(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = pa.decompress(packed[8:], n * _ENTRY.itemsize, codec="zstd", asbytes=True)
    entries = np.frombuffer(planes, np.uint8).reshape(_ENTRY.itemsize, n).T.copy().view(_ENTRY).reshape(-1)
    entries["id"] = np.cumsum(entries["id"])
    return entries


def sent_words(sets: DataFrame, percent: int, slots: int, squeezed: bool = False) -> DataFrame:
    """The first words of ``sets(run_id, id, text)``, packed: rows ``(slot, entries)``."""
    times = word_times(sets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, runs = (batch.column(k).to_numpy() for k in (0, 1))
            hashes, ends = word_sets(batch.column(2))
            at, owner, maps = first_words(hashes, ends, times, percent, onward=True)
            word = _mix(hashes[at] ^ _mix(runs.view(np.uint64)[owner]))
            entry = np.zeros(len(at), _ENTRY)
            entry["word"], entry["n"], entry["id"], entry["map"] = word & np.uint64(0xFFFFFFFF), np.diff(ends)[owner], ids[owner], maps
            entry["place"] = np.arange(len(at)) - np.searchsorted(owner, owner)
            slot = ((word >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            used, first = np.unique(slot[order], return_index=True)
            pieces = [_squeezed(x) if squeezed else x.tobytes() for x in np.split(entry[order], first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(pieces, pa.binary())], names=["slot", "entries"])

    hashed = sets.select("id", F.xxhash64("run_id").alias("run"), spaced(F.col("text")))
    return hashed.mapInArrow(send, "slot long, entries binary")


def candidate_pairs(sets: DataFrame, percent: int = ALIKE) -> DataFrame:
    """``(src, dst)`` of all pairs of ``sets(run_id, id, text)`` that may be alike: all that are, and few others."""
    slots = 4 * max(1, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        src, dst = slot_pairs(np.concatenate([_unsqueezed(x) for x in rows["entries"]]), percent)
        return pd.DataFrame({"src": src, "dst": dst})

    return hand_over(sent_words(sets, percent, slots, squeezed=True).groupBy("slot").applyInPandas(meet, "src long, dst long").distinct(), "pairs")


def _met(pairs: DataFrame, ends: DataFrame) -> DataFrame:
    """The rows of ``ends`` that ``pairs`` name, which are few, with their words, as a written table."""
    named = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return hand_over(ends.join(named, "id", "left_semi").withColumn("words", words(F.col("text"))), "ends")


def _checked(pairs: DataFrame, ends: DataFrame, percent: int) -> DataFrame:
    ends = ends.select("run_id", "id", "words")
    met = pairs.join(ends.withColumnsRenamed({"run_id": "_run", "id": "src", "words": "_a"}), "src").join(
        ends.withColumnsRenamed({"id": "dst", "words": "_b"}), "dst"
    )
    common = F.size(F.array_intersect("_a", "_b"))
    alike = 100 * common >= percent * (F.size("_a") + F.size("_b") - common)
    return met.where("_run = run_id").where(alike).select("run_id", "src", "dst")


def alike_pairs(sets: DataFrame, percent: int = ALIKE) -> DataFrame:
    """``(run_id, src, dst)`` of every pair of ``sets(run_id, id, text)`` whose texts have ``percent`` of common words.

    ``id`` is a number of one set; ``sets`` is a written table, and every text has a word.
    """
    pairs = candidate_pairs(sets, percent)
    return _checked(pairs, _met(pairs, sets), percent)


def _by_set(raised: DataFrame) -> DataFrame:
    """The rows of ``raised`` with a run and a concern, each once, as a written table with ``key``, ``id`` and ``name``.

    Concerns of equal words are one set and have one ``key``, a 128-bit hash of the words; that of a concern without any word
    is one of the concern itself. The first row of a set has its smallest concern and no ``name``; others have that concern there.
    """
    columns = raised.columns
    at = columns.index("concern")

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, ends = word_sets(batch.column(len(columns)))
            of, found = hashes.tobytes(), (8 * ends).tolist()
            keys = [hashlib.blake2b(of[a:b], digest_size=16).digest() for a, b in zip(found, found[1:])]
            for k in np.flatnonzero(np.diff(ends) == 0).tolist():
                keys[k] = hashlib.blake2b(b" " + batch.column(at)[k].as_buffer().to_pybytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(keys, pa.binary())], names=[*columns, "key"])

    schema = StructType([StructField(f.name, f.dataType) for f in raised.schema.fields] + [StructField("key", BinaryType())])
    rows = raised.where("concern IS NOT NULL AND run_id IS NOT NULL").select("*", spaced(F.col("concern"))).mapInArrow(key, schema)
    others = ["concern", *(c for c in columns if c not in ("run_id", "concern"))]
    in_set = Window.partitionBy("run_id", "key").orderBy(*others)
    place, before = F.row_number().over(in_set), F.lag(F.struct(*others)).over(in_set)
    rows = rows.select("*", F.when(place > 1, F.first("concern").over(in_set)).alias("name"), before.eqNullSafe(F.struct(*others)).alias("_again"))
    return hand_over(rows.where("NOT _again").drop("_again").withColumn("id", F.monotonically_increasing_id()), "sets")


def _set_topics(sets: DataFrame, percent: int) -> DataFrame:
    """``(run_id, key, component, topic)`` of the sets of ``_by_set`` that are alike to others; a topic is the smallest concern."""
    some = sets.where("name IS NULL").where(F.lower("concern").rlike(r"[\p{L}\p{N}_]")).select("run_id", "key", "id", F.col("concern").alias("text"))
    pairs = candidate_pairs(some.drop("key"), percent)
    met = _met(pairs, some)
    parts = connected_components(_checked(pairs, met, percent), ["run_id"]).select(F.col("node").alias("id"), "component")
    parts = hand_over(met.join(parts, "id"), "parts")
    tops = parts.groupBy("component").agg(F.min("text").alias("topic"))
    return parts.join(tops, "component").select("run_id", "key", "component", "topic")


def concern_topics(raised: DataFrame, percent: int = ALIKE) -> DataFrame:
    """``(run_id, concern, topic)`` of every concern of ``raised(run_id, concern, ...)``.

    A topic goes by its smallest concern. A concern without any word is like its equals only.
    """
    sets = _by_set(raised.select("run_id", "concern"))
    topics = _set_topics(sets, percent).select("run_id", "key", "topic")
    return sets.join(topics, ["run_id", "key"], "left").select("run_id", "concern", F.coalesce("topic", "name", "concern").alias("topic"))


def topic_findings(raised: DataFrame, percent: int = ALIKE) -> DataFrame:
    """Topics of ``raised(run_id, concern, model)`` by the number of models that raise them, in whatever words."""
    sets = _by_set(raised.select("run_id", "concern", "model"))
    topics = hand_over(_set_topics(sets, percent), "topics")
    # Concerns are counted by hashes inside their set, so their texts stay where they are.
    counted = sets.select("run_id", "key", "model", F.xxhash64("concern").alias("concern"))
    counted = counted.join(topics.select("run_id", "key", "component"), ["run_id", "key"], "left")
    counted = counted.groupBy("run_id", "component", F.when(F.col("component").isNull(), F.col("key")).alias("key")).agg(
        F.count_distinct("key", "concern").alias("n_concerns"), F.count_distinct("model").alias("n_models")
    )
    linked = counted.where("component IS NOT NULL").drop("key").join(topics.select("component", "topic").distinct(), "component")
    names = sets.where("name IS NULL").select("run_id", "key", F.col("concern").alias("topic"))
    alone = counted.where("component IS NULL").join(names, ["run_id", "key"])
    found = ["run_id", "topic", "n_concerns", "n_models"]
    found = linked.select(found).unionByName(alone.select(found))
    converges = F.col("n_models") >= 2
    return found.withColumns(
        {
            "verdict": F.when(converges, "convergent").otherwise("unique"),
            "confidence": F.when(converges, "high").otherwise("medium"),
        }
    )


def disputed_areas(reports: DataFrame, percent: int = ALIKE) -> DataFrame:
    """``(run_id, file, n_models, n_topics)`` of files on which models differ.

    Two models or more refer to the file and raise concerns, but no topic is shared by two of them.
    """
    raised = mentions(reports, "key_concerns", "concern")
    by_model = raised.join(concern_topics(raised, percent), ["run_id", "concern"]).select("run_id", "model", "topic").distinct()
    files = mentions(reports, "files_referenced", "file")
    per_topic = files.join(by_model, ["run_id", "model"]).groupBy("run_id", "file", "topic").agg(F.count(F.lit(1)).alias("shared"))
    per_file = per_topic.groupBy("run_id", "file").agg(F.count(F.lit(1)).alias("n_topics"), F.max("shared").alias("most"))
    speakers = files.join(by_model.select("run_id", "model").distinct(), ["run_id", "model"]).groupBy("run_id", "file").agg(F.count(F.lit(1)).alias("n_models"))
    return per_file.where("most = 1").join(speakers.where("n_models >= 2"), ["run_id", "file"]).select("run_id", "file", "n_models", "n_topics")
