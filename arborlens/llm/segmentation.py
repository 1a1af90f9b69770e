"""SentencePiece encoding and decoding: a Viterbi search in numpy over many words at once.

A text is escaped as the model does (a blank is U+2581, one stands before the text) and cut into
words. Distinct words of a slice that have equal length advance together: for every end position and
piece length, hashes of the substrings probe the sorted hashes of the pieces, and a maximum over the
lengths stores the back pointers. Characters that no piece covers become byte pieces.

The model was trained by merging pairs. Under its merges every beginning of a word has one last piece: the one that
would not have been merged with the piece before it. So a candidate scores 1 where the pair of the piece before
and itself is stable and 0 elsewhere, and the maximum finds the segmentation of the model's own encoder. A pair is
stable if no merge across its border comes before those that built its two pieces; the symbols at
the border, from single characters to the pieces, are looked up in tables made once from the model.

Words of many characters are cut where no piece of the model has the two characters side by side.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from arborlens.llm import common

MARK = "▁"
#: Words that a task remembers, about 200 bytes each.
CACHE_ENTRIES = 600_000
#: Places of the memory of pairs, as a power of two.
PAIR_BITS = 20
#: Words from this length on are cut where no merge can cross.
LONG_WORD = 48
_HEAD = np.uint64(64 - 20)
_WORD = re.compile(r" *[^ ]+| +")


class Pieces:
    """The pieces of a model as sorted hash keys."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.text: list[bytes] = [b""] * self.size
        self.byte_id = np.full(256, -1, np.int64)
        self.unknown = model.unk_id()
        words: dict[int, list[int]] = {}
        rank: dict[str, tuple[float, int]] = {}
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                rank[piece] = (-model.get_score(i), i)
                self.text[i] = piece.replace(MARK, " ").encode()
                words.setdefault(len(piece), []).append(i)
        self.pool = np.frombuffer(b"".join(self.text), np.uint8)
        self.length = np.array([len(t) for t in self.text], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.longest = max(words)
        self.value, self.chars = np.zeros(self.size, np.uint64), np.zeros(self.size, np.int64)
        for length, found in words.items():
            points = np.array([[ord(c) for c in model.id_to_piece(i)] for i in found], np.uint32)
            self.value[found], self.chars[found] = _prefix(points)[:, -1], length
        self.ids = np.flatnonzero(self.chars)
        self.ids = self.ids[np.argsort(self.value[self.ids])]
        self.keys = self.value[self.ids]
        self.heads = np.zeros(1 << 20, bool)
        self.heads[(self.keys >> _HEAD).astype(np.int64)] = True
        self._merges(rank)
        self.seen = np.full(1 << PAIR_BITS, -1, np.int64)
        self.seen_answer = np.zeros(1 << PAIR_BITS, bool)

    def _merges(self, rank: dict[str, tuple[float, int]]) -> None:
        """Order of the merges, and the symbols at both ends of every piece while it is built."""
        ordered = sorted(rank.values())
        self.rank = np.full(self.size + 1, np.iinfo(np.int32).max, np.int32)
        self.rank[[i for _, i in ordered]] = np.arange(len(ordered))
        place = {piece: int(self.rank[i]) for piece, (_, i) in rank.items()}
        number = {piece: i for piece, (_, i) in rank.items()}
        depth = self.longest + 1
        # Row ``size`` stands for no symbol.
        self.head, self.tail = (np.full((self.size, depth), self.size, np.int32) for _ in range(2))
        self.built = np.zeros(self.size, bool)
        for piece in sorted(number, key=len):
            i = number[piece]
            if len(piece) == 1:
                self.head[i, 0] = self.tail[i, 0] = i
                self.built[i] = True
                continue
            halves = last_merge(piece, place)
            if halves:
                left, right = (number[h] for h in halves)
                for table, part in ((self.head, left), (self.tail, right)):
                    n = int((table[part] < self.size).sum())
                    table[i, :n], table[i, n] = table[part, :n], i
                self.built[i] = True
        several = self.chars[self.ids] > 1
        self.merged, self.merged_id = self.keys[several], self.ids[several]
        codes = {(ord(x) << 21) | ord(y) for piece in number for x, y in zip(piece, piece[1:])}
        self.side_by_side = np.array(sorted(codes), np.int64)

    def stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two pieces that stand side by side stay apart under the merges of the model.

        Pairs recur, so a table keeps the answers; a later pair may take the place of an earlier one.
        """
        pairs = left * self.size + right
        at = (common.mix(pairs.astype(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        answer = self.seen_answer[at]
        new = np.flatnonzero(self.seen[at] != pairs)
        if len(new):
            answer[new] = self._stable(left[new], right[new])
            # Of pairs for one place any may stay, if its answer stays with it.
            self.seen[at[new]] = pairs[new]
            kept = self.seen[at[new]] == pairs[new]
            self.seen_answer[at[new][kept]] = answer[new][kept]
        return answer

    def _stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.ones(len(left), bool)
        a, b = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        open_ = np.arange(len(left))
        _, depth = self.tail.shape
        up, _ = common.powers(self.longest + 1)
        none = np.iinfo(np.int32).max
        while len(open_):
            l, r, i, j = left[open_], right[open_], a[open_], b[open_]
            x, y = self.tail[l, i], self.head[r, j]
            key = self.value[x] + self.value[y] * up[self.chars[x]]
            at = np.minimum(np.searchsorted(self.merged, key), len(self.merged) - 1)
            across = np.where(self.merged[at] == key, self.rank[self.merged_id[at]], none)
            # The next merges that take the symbols away from the border; of equal ones the left goes first.
            next_x = self.rank[self.tail[l, np.minimum(i + 1, depth - 1)]]
            next_y = self.rank[self.head[r, np.minimum(j + 1, depth - 1)]]
            joined = (across < none) & (across < next_x) & (across <= next_y)
            done = joined | ((next_x == none) & (next_y == none))
            out[open_[joined]] = False
            grow_x = next_x <= next_y
            a[open_[~done & grow_x]] += 1
            b[open_[~done & ~grow_x]] += 1
            open_ = open_[~done]
        return out

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys that are pieces, with the ids of these."""
        # Most substrings are no piece: a table of leading bits turns them away before the search.
        rows = np.flatnonzero(self.heads[(keys >> _HEAD).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, keys[rows]), len(self.keys) - 1)
        hit = self.keys[at] == keys[rows]
        return rows[hit], self.ids[at[hit]]

    def spell(self, point: int) -> list[int]:
        """Byte pieces of a character."""
        raw = chr(point).encode("utf-8", "surrogatepass")
        return [int(self.byte_id[b]) if self.byte_id[b] >= 0 else self.unknown for b in raw]


def last_merge(piece: str, place: dict[str, int]) -> tuple[str, str] | None:
    """The two symbols that are merged to ``piece`` at last; none if the merges never build it."""
    symbols = list(piece)
    while len(symbols) > 2:
        found = min(((place[x + y], k) for k, (x, y) in enumerate(zip(symbols, symbols[1:])) if x + y in place), default=None)
        if found is None:
            return None
        k = found[1]
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
    return (symbols[0], symbols[1]) if all(x in place for x in symbols) else None


def _prefix(points: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes of each row of code points; the empty one first."""
    n, length = points.shape
    up, _ = common.powers(length + 1)
    total = np.zeros((n, length + 1), np.uint64)
    spread = common.mix(points.astype(np.uint64) + np.uint64(0x51ED27))
    np.cumsum(spread * up[:length], axis=1, out=total[:, 1:])
    return total


def viterbi(points: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each row of ``points`` (words of one length, as code points), in a row, and their counts."""
    n, length = points.shape
    total = np.ascontiguousarray(_prefix(points).T)
    _, down = common.powers(length + 1)
    back = np.ones((length + 1, n), np.int64)
    piece = np.full((length + 1, n), -1, np.int64)
    for end in range(1, length + 1):
        # A character that is no piece stands in bytes, and nothing is merged with it.
        begin = max(0, end - pieces.longest)
        keys = (total[end] - total[begin:end]) * down[begin:end, None]
        place, ids = pieces.probe(keys.ravel())
        start, rows = place // n + begin, place % n
        sizes, before = end - start, piece[start, rows]
        score = pieces.built[ids].copy()
        pair = np.flatnonzero(score & (before >= 0))
        score[pair] = pieces.stable(before[pair], ids[pair])
        # The maximum over the lengths; ties go to the longer piece.
        fits = np.flatnonzero(score)
        rows, sizes, ids = rows[fits], sizes[fits], ids[fits]
        np.maximum.at(back[end], rows, sizes)
        best = back[end, rows] == sizes
        piece[end, rows[best]] = ids[best]
    # Back pointers of all rows together, from the last piece to the first.
    at = np.full(n, length)
    rows = np.arange(n)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(rows):
        ids = piece[at[rows], rows]
        for k in np.flatnonzero(ids < 0):
            ids[k] = -1 - int(points[rows[k], at[rows[k]] - 1])
        found.append((rows, ids))
        at[rows] -= back[at[rows], rows]
        rows = rows[at[rows] > 0]
    owner = np.concatenate([r for r, _ in reversed(found)])
    ids = np.concatenate([i for _, i in reversed(found)])
    order = np.argsort(owner, kind="stable")
    owner, ids = owner[order], ids[order]
    if (ids < 0).any():
        wide = [pieces.spell(-1 - i) if i < 0 else [i] for i in ids.tolist()]
        owner = np.repeat(owner, [len(x) for x in wide])
        ids = np.array([i for x in wide for i in x])
    return ids, np.bincount(owner, minlength=n)


class Segmenter:
    """Encoder and decoder with a bounded memory of frequent words."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.pieces = Pieces(path)
        self.entries = entries
        self.known: dict[str, bytes] = {}

    def _words(self, words: list[str]) -> dict[str, bytes]:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        found: dict[str, bytes] = {}
        for length, same in by_length.items():
            step = max(1, 60_000 // length)  # the tables of a round stay in the cache of a core
            for first in range(0, len(same), step):
                part = same[first : first + step]
                points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), length)
                ids, counts = viterbi(np.where(points == 0x20, ord(MARK), points), self.pieces)
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts * 4).tolist()
                for w, a, b in zip(part, [0, *ends], ends):
                    found[w] = raw[a:b]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers. An empty text has none."""
        split = [self._parts(cut_words(t.replace(MARK, " "))) for t in texts]
        missing = {w for words in split for w in words} - self.known.keys()
        known = self.known
        if missing:
            new = self._words(sorted(missing))
            if len(known) + len(new) <= self.entries:
                known.update(new)
            else:
                known = known | new
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def _parts(self, words: list[str]) -> list[str]:
        """Words, long ones cut where no merge can cross."""
        if max(map(len, words), default=0) < LONG_WORD:
            return words
        out = []
        for w in words:
            if len(w) < LONG_WORD:
                out.append(w)
                continue
            points = np.frombuffer(w.replace(" ", MARK).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            codes, known = (points[:-1] << 21) | points[1:], self.pieces.side_by_side
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            cuts = (np.flatnonzero(known[at] != codes) + 1).tolist()
            out += [w[a:b] for a, b in zip([0, *cuts], [*cuts, len(w)], strict=True)]
        return out

    def decode(self, coded: list[bytes]) -> list[bytes]:
        """The UTF-8 text of each list of ids: blanks for U+2581, without the first one."""
        ids = np.frombuffer(b"".join(coded), "<u4")
        size = self.pieces.length[ids]
        total = np.cumsum(size)
        n = int(total[-1]) if len(total) else 0
        raw = self.pieces.pool[np.arange(n) + np.repeat(self.pieces.first[ids] - total + size, size)].tobytes()
        ends = np.r_[0, total][np.cumsum([0, *(len(c) // 4 for c in coded)])].tolist()
        parts = [raw[a:b] for a, b in zip(ends[:-1], ends[1:])]
        return [x[1:] if x[:1] == b" " else x for x in parts]


def cut_words(text: str) -> list[str]:
    """Words of a text: blanks with what follows them. No piece has a blank after another character."""
    return _WORD.findall(" " + text) if text else []


def segment_documents(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids array<int>, n_bytes, same)`` of every row; one narrow stage.

    ``n_bytes`` counts byte pieces, ``same`` says whether decoding gives the text back (U+2581 in a
    text comes back as a blank). A null text is taken as empty: no ids.
    """
    return _encoded(docs, model, key, text, True)


def segment_digests(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``segment_documents``, with ``n_pieces`` and ``ids_crc32`` instead of the ids."""
    return _encoded(docs, model, key, text, False)


def _encoded(docs: DataFrame, model: str, key: str, text: str, whole: bool) -> DataFrame:
    rows = docs.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = None
        for batch in batches:
            segmenter = segmenter or Segmenter(model)
            is_byte = np.zeros(segmenter.pieces.size, bool)
            is_byte[segmenter.pieces.byte_id[segmenter.pieces.byte_id >= 0]] = True
            for first, last, data, offsets in common.text_slices(batch.column(1)):
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                coded = segmenter.encode([t.decode("utf-8", "replace") for t in texts])
                n_bytes = [int(is_byte[np.frombuffer(c, "<u4")].sum()) for c in coded]
                same = [d == t for d, t in zip(segmenter.decode(coded), texts)]
                keys = batch.column(0).slice(first, last - first)
                tail = [pa.array(n_bytes, pa.int64()), pa.array(same, pa.bool_())]
                if whole:
                    ids = pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in coded], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([keys, ids, *tail], names=[key, "ids", "n_bytes", "same"])
                else:
                    sums = pa.array([zlib.crc32(c) for c in coded], pa.int64())
                    counts = pa.array([len(c) // 4 for c in coded], pa.int64())
                    yield pa.RecordBatch.from_arrays([keys, counts, sums, *tail], names=[key, "n_pieces", "ids_crc32", "n_bytes", "same"])

    head = f"{key} {rows.schema[key].dataType.simpleString()}"
    columns = "ids array<int>" if whole else "n_pieces long, ids_crc32 long"
    return rows.mapInArrow(run, f"{head}, {columns}, n_bytes long, same boolean")
