"""Quality rules on repetition: a suffix array over the words of every text.

The suffixes of many texts are sorted together by rank doubling in numpy; only suffixes that are not
yet unique take part in the next round. The longest common prefix of neighbours in the array gives,
for each word, the longest repeat that starts there. Repeats that cannot be extended to the left are
the maximal repeated substrings; their spans are united and measured against two limits: the share
of words covered, and the longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from arborlens.llm import common

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, longest_repeat long"
)


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often ``mask`` holds in each text."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def suffix_order(symbol: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Suffix array of all texts: suffixes of one text that begin alike are neighbours."""
    n = len(symbol)
    # Texts stay apart: a word of another text is another symbol.
    _, known, sizes = np.unique(symbol ^ common.mix(doc.astype(np.uint64)), return_inverse=True, return_counts=True)
    rank = (np.cumsum(sizes) - sizes)[known]
    ends = np.cumsum(np.bincount(doc))[doc]
    active = np.flatnonzero(sizes[known] > 1)
    step = 1
    while len(active):
        after = active + step
        inside = after < ends[active]
        second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        # A suffix that ends here comes first; equal ones cannot both end in the same text.
        order = np.lexsort((second, rank[active]))
        moved, major, minor = active[order], rank[active][order], second[order]
        new_major = np.r_[True, major[1:] != major[:-1]]
        new = new_major | np.r_[True, minor[1:] != minor[:-1]]
        at = np.arange(len(moved))
        within = at - np.maximum.accumulate(np.where(new_major, at, 0))
        group = np.maximum.accumulate(np.where(new, at, 0))
        rank[moved] = major + within[group]
        size = np.diff(np.r_[np.flatnonzero(new), len(moved)])
        active = moved[np.repeat(size > 1, size)]
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


def shared_prefix(symbol: np.ndarray, left: np.ndarray, right: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common words of the suffixes at ``left`` and ``right``, up to ``most``: a search over prefix hashes."""
    up, down = common.powers(len(symbol) + 1)
    total = np.zeros(len(symbol) + 1, np.uint64)
    np.cumsum(symbol * up[: len(symbol)], out=total[1:])

    def same(i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (total[i + length] - total[i]) * down[i] == (total[j + length] - total[j]) * down[j]

    low = np.zeros(len(left), np.int64)
    open_ = np.flatnonzero((most > 0) & (symbol[left] == symbol[right]))
    low[open_] = 1
    # Double the length while it fits and matches, then halve.
    step = np.ones(len(left), np.int64)
    while len(open_):
        fits = low[open_] + step[open_] <= most[open_]
        open_ = open_[fits]
        good = same(left[open_], right[open_], low[open_] + step[open_])
        open_ = open_[good]
        low[open_] += step[open_]
        step[open_] *= 2
    open_ = np.flatnonzero(low > 0)
    while len(open_):
        step[open_] //= 2
        open_ = open_[step[open_] > 0]
        at = open_[low[open_] + step[open_] <= most[open_]]
        at = at[same(left[at], right[at], low[at] + step[at])]
        low[at] += step[at]
    return low


def longest_repeats(symbol: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Length in words of the longest repeat (within the text) that starts at each word."""
    n = len(symbol)
    repeat = np.zeros(n, np.int64)
    if n < 2:
        return repeat
    order = suffix_order(symbol, doc)
    a, b = order[:-1], order[1:]
    ends = np.cumsum(np.bincount(doc))[doc]
    most = np.where(doc[a] == doc[b], np.minimum(ends[a] - a, ends[b] - b), 0)
    prefix = shared_prefix(symbol, a, b, most)
    repeat[a] = prefix
    repeat[b] = np.maximum(repeat[b], prefix)
    return repeat


def repeated_spans(repeat: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the repeats of ``least`` words or more that cannot be extended to the left."""
    inner = np.zeros(len(repeat), bool)
    inner[1:] = (doc[1:] == doc[:-1]) & (repeat[:-1] == repeat[1:] + 1)
    at = np.flatnonzero((repeat >= least) & ~inner)
    return at, repeat[at]


def covered(repeat: np.ndarray, doc: np.ndarray, n_docs: int, least: int) -> np.ndarray:
    """Words of each text inside the union of its repeats of ``least`` words or more."""
    start, length = repeated_spans(repeat, doc, least)
    change = np.zeros(len(repeat) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + length, -1)
    return np.bincount(doc, np.cumsum(change[:-1]) > 0, minlength=n_docs).astype(np.int64)


def measure(data: np.ndarray, offsets: np.ndarray, least: int) -> list[np.ndarray]:
    """The columns of ``SCHEMA`` for the texts of one slice."""
    n_docs = len(offsets) - 1
    start, end, doc = common.find_words(data, offsets)
    symbol = common.hash_spans(data, start, end)
    n_words = np.bincount(doc, minlength=n_docs)
    char_starts = ((data & 0xC0) != 0x80) & ~common._SPACE[data]
    ends_line = data == ord("\n")
    edges = np.unique(np.r_[offsets, np.flatnonzero(ends_line), np.flatnonzero(ends_line) + 1])
    head, tail = edges[:-1], edges[1:]
    has_word = np.searchsorted(start, head, "left") < np.searchsorted(start, tail, "left")
    head, tail = head[has_word], tail[has_word]
    owner = np.searchsorted(offsets, head, "right") - 1
    lines = common.hash_spans(data, head, tail)
    order = np.lexsort((lines, owner))
    again = np.zeros(len(order), bool)
    again[1:] = (lines[order][1:] == lines[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    repeat = longest_repeats(symbol, doc)
    longest = np.zeros(n_docs, np.int64)
    np.maximum.at(longest, doc, repeat)
    return [
        n_words,
        _per_text(char_starts, offsets),
        _per_text(_IS_SYMBOL[data], offsets),
        np.bincount(owner[order][again], minlength=n_docs),
        covered(repeat, doc, n_docs, 3),
        covered(repeat, doc, n_docs, least),
        longest,
    ]


def repetition_stats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """``key`` and the columns of ``SCHEMA`` for every row; one narrow stage, nothing is shuffled.

    A null or empty text has no words and zeros everywhere. Repeated rows give repeated rows; other
    columns are ignored. ``covered_words`` counts the words inside repeats of ``least`` words or more.
    """
    rows = docs.select(key, text)
    schema = f"{rows.schema[key].simpleString()}, {SCHEMA}".replace(":", " ", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in common.text_slices(batch.column(1)):
                found = [pa.array(x.astype(np.int64)) for x in measure(data, offsets, least)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), *found], schema=None, names=[key, *(x.split()[0] for x in SCHEMA.split(", "))]
                )

    return rows.mapInArrow(run, schema)


def judge(
    stats: DataFrame, most_covered: float = 0.3, longest: int = 60, least_words: int = 50, most_repeated: int = 50
) -> DataFrame:
    """``base_failed`` and ``kept`` for rows of ``repetition_stats``.

    The base fails below ``least_words`` or with more than ``most_repeated`` percent of the words in
    repeated three-word windows. A text is kept if the base holds, its repeats cover at most the share
    ``most_covered`` of its words and none is longer than ``longest`` words.
    """
    failed = f"n_words < {least_words} OR 100 * n_repeat_words > {most_repeated} * n_words"
    verdict = f"covered_words <= {most_covered}D * n_words AND longest_repeat <= {longest}"
    return stats.selectExpr("*", f"{failed} AS base_failed", f"NOT ({failed}) AND {verdict} AS kept")
