"""Line dedup by a log-template tree of fixed depth.

A line goes down the tree by its number of tokens and then by its leading tokens, where a token with
a digit is a variable field. In the leaf the rest of the line is generalised: besides the line with
its digit fields masked, a long line has one form for each of ``SEGMENTS`` parts of the rest with this part
masked, a shorter one a form for each single token of the rest. Two lines that differ within one part have a form
in common: their template. A template that says enough by itself (no masked field at all, or a long line
with as many words as masked ones) recurs from ``SURE_DOCS`` documents on, any other from ``MIN_DOCS`` on.
Lines whose own form is not a sure one have one more with nothing masked, and so have lines of one long token
(a link, or text without blanks). Lines of recurring templates are dropped, but for the first one (by
document and line), so one copy of everything stays.

Forms are hashed in numpy, in one narrow pass over the texts; the counts are partial aggregates, and no
key has a task or a row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.llm import common
from arborlens.session import hand_over

LEAD = 2
SEGMENTS = 4
#: Shorter lines have no parts to mask but single tokens, and from ``MIN_SINGLE`` tokens on only.
MIN_SEGMENTED = 10
MIN_SINGLE = 5
MIN_TOKENS = 2
#: A line of one token has a form from so many bytes on: four Chinese characters, about two words.
MIN_BYTES = 12
MIN_DOCS = 4
SURE_DOCS = 2

_HAS_DIGIT = np.zeros(256, bool)
_HAS_DIGIT[ord("0") : ord("9") + 1] = True


def template_forms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Form hash, text number and line number of every form of every line of a slice.

    The last bit of a hash is set if the form is a sure one.
    """
    start, end, doc = common.find_words(data, offsets)
    tokens = common.hash_spans(data, start, end)
    digits = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_HAS_DIGIT[data], out=digits[1:])
    # A field with a digit is a variable one and reads as an asterisk.
    one = np.frombuffer(b"*", np.uint8)
    field = common.hash_spans(one, np.array([0]), np.array([1]))[0]
    plain = tokens.copy()
    tokens[digits[end] > digits[start]] = field
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == ord("\n"), out=breaks[1:])
    line = breaks[start] - breaks[offsets[doc]]
    head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])][: len(doc)])
    size = np.diff(np.r_[head, len(doc)])
    enough = (size >= MIN_TOKENS) | ((end - start)[head] >= MIN_BYTES)
    head, size = head[enough], size[enough]
    up, down = common.powers(len(tokens) + 1)

    def sums(tokens: np.ndarray) -> np.ndarray:
        total = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * up[: len(tokens)], out=total[1:])
        return total

    total = sums(tokens)
    said = np.zeros(len(tokens) + 1, np.int64)
    np.cumsum(tokens != field, out=said[1:])

    def run(a: np.ndarray, b: np.ndarray, total: np.ndarray = total) -> np.ndarray:
        return common.mix(((total[b] - total[a]) * down[a]) ^ (b - a).astype(np.uint64))

    several = np.flatnonzero(size >= MIN_TOKENS)
    first, n = head[several], size[several]
    words = said[first + n] - said[first]
    forms, at = [run(first, first + n)], [several]
    firm = [(words == n) | ((n >= MIN_SEGMENTED) & (2 * words >= n))]
    left = np.r_[several[~firm[0]], np.flatnonzero(size < MIN_TOKENS)]
    forms.append(common.mix(run(head[left], head[left] + size[left], sums(plain)) ^ np.uint64(0x632BE59BD9B4E019)))
    at.append(left)
    firm.append(np.ones(len(left), bool))

    def without(lines: np.ndarray, a: np.ndarray, b: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """Add the forms of ``lines`` with tokens ``a`` to ``b`` masked; how many words are left in each."""
        first, n = head[lines], size[lines]
        parts = run(first, a) * np.uint64(0x9E3779B97F4A7C15) + run(b, first + n) * np.uint64(0xC2B2AE3D27D4EB4F)
        forms.append(common.mix(parts + tag.astype(np.uint64)))
        at.append(lines)
        return said[a] - said[first] + said[first + n] - said[b]

    long_ = np.flatnonzero(size >= MIN_SEGMENTED)
    first, n = head[long_], size[long_]
    for k in range(SEGMENTS):
        a = first + LEAD + (n - LEAD) * k // SEGMENTS
        b = first + LEAD + (n - LEAD) * (k + 1) // SEGMENTS
        firm.append(2 * without(long_, a, b, n * (SEGMENTS + 1) + k + 1) >= n)
    for k in range(LEAD, MIN_SEGMENTED - 1):
        short = np.flatnonzero((size >= MIN_SINGLE) & (size < MIN_SEGMENTED) & (size > k))
        a = head[short] + k
        without(short, a, a + 1, size[short] * 1024 + k)
        firm.append(np.zeros(len(short), bool))
    at, forms = np.concatenate(at), np.concatenate(forms)
    forms = (forms & ~np.uint64(1)) | np.concatenate(firm).astype(np.uint64)
    return forms, doc[head[at]], line[head[at]]


def line_forms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(form, _doc, line)`` of every line that has a form; ``line`` counts from 0."""
    rows = docs.where(F.col(key).isNotNull()).select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in common.text_slices(batch.column(1)):
                if len(data):
                    forms, doc, line = template_forms(data, offsets)
                    keys = batch.column(0).slice(first, last - first).take(pa.array(doc))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(forms.astype(np.int64)), keys, pa.array(line.astype(np.int32))], names=["form", "_doc", "line"]
                    )

    return rows.mapInArrow(run, f"form long, _doc {rows.schema[key].dataType.simpleString()}, line int")


def drop_recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text`` less its recurring lines, and ``n_lines``, ``n_dropped`` added.

    Documents are counted by key, and the first line of a form is the first one of the smallest key. Rows
    that repeat a key are one document to that count; a line number that goes from one of them goes from all.
    A null key or text is left as it is; an empty text has one line, which is kept. If all lines go, the
    text is empty. Columns named ``n_lines`` or ``n_dropped`` are replaced. ``SURE_DOCS`` documents
    are enough for sure forms, ``min_docs`` for others.
    """
    docs = docs.drop("n_lines", "n_dropped")
    forms = line_forms(docs, key, text)
    needed = F.when(F.col("form").bitwiseAND(1) == 1, min(SURE_DOCS, min_docs)).otherwise(min_docs)
    # The line where a form first stands in a document; a partial aggregate, as the count of documents.
    seen = forms.groupBy("form", "_doc").agg(F.min("line").alias("_line"))
    recurring = (
        seen.groupBy("form").agg(F.count("*").alias("_docs"), F.min("_doc").alias("_first_doc")).where(F.col("_docs") >= needed).drop("_docs")
    )
    recurring = hand_over(recurring, "recurring")
    hits = hand_over(forms.join(recurring, "form"), "hits")
    firsts = hits.where("_doc = _first_doc").groupBy("form", "_doc").agg(F.min("line").alias("_keep"))
    other = hits.where("_doc <> _first_doc").select("_doc", "line")
    later = hits.where("_doc = _first_doc").join(firsts, ["form", "_doc"]).where("line > _keep").select("_doc", "line")
    # A list holds lines of one document, as its text does.
    gone, parts = (common.fresh(docs, name) for name in ("_gone", "_parts"))
    dropped = other.union(later).groupBy("_doc").agg(F.collect_set("line").alias(gone))
    dropped = dropped.withColumnRenamed("_doc", owner := common.fresh(docs, "_doc"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    joined = docs.join(dropped, docs[key] == dropped[owner], "left")
    found = F.col(gone).isNotNull()
    return (
        joined.withColumn(parts, F.split(F.col(text), "\n"))
        .withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).cast("long"))
        # A row that repeats a key may have fewer lines.
        .withColumn("n_dropped", F.when(found, F.size(parts) - F.size(kept)).otherwise(0).cast("long"))
        .withColumn(text, F.when(found, F.concat_ws("\n", F.transform(kept, lambda i: F.col(parts)[i]))).otherwise(F.col(text)))
        .select(*docs.columns, "n_lines", "n_dropped")
    )
