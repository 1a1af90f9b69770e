"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of a text are computed once, in a narrow stage. Fitting needs the labelled rows only:
each partition sums its part of the normal equations, the parts are added up, and the model is a
vector of a few hundred numbers. Scores of other labelled rows, counted in bins, calibrate it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.llm import common
from arborlens.session import hand_over

#: Statistics of a text, in the order of the feature vector.
STATISTICS = (
    "log_bytes log_words word_bytes upper digits symbols stops other_punct spaces lines_per_word "
    "line_words distinct_words top_word repeated_lines ends_alike byte_entropy"
).split()

FIT_ROWS = 200_000
FIT_PARTITIONS = 32
N_FEATURES = 192
BINS = 512


def _classes() -> np.ndarray:
    kind = np.zeros((256, 6))
    for column, members in enumerate(
        (
            range(ord("A"), ord("Z") + 1),
            range(ord("0"), ord("9") + 1),
            b"#*$%&|<>~^_=+{}[]\\@",
            b".,;:",
            b"!?\"'()-/`",
            (0x20, *range(0x09, 0x0E)),
        )
    ):
        kind[list(members), column] = 1
    return kind


_CLASSES = _classes()


def measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` per text of a slice; an empty text has zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    kinds, entropy = np.zeros((n, _CLASSES.shape[1])), np.zeros(n)
    for first in range(0, n, 512):  # the table of shares stays small beside the texts
        last = min(n, first + 512)
        owner = np.repeat(np.arange(0, (last - first) * 256, 256, dtype=np.int32), size[first:last])
        cells = owner + data[offsets[first] : offsets[last]]
        share = np.bincount(cells, minlength=(last - first) * 256).reshape(-1, 256) / np.maximum(size[first:last], 1)[:, None]
        kinds[first:last] = share @ _CLASSES
        entropy[first:last] = -np.sum(share * np.log(np.where(share > 0, share, 1)), 1)

    start, end, doc = common.find_words(data, offsets)
    words = np.bincount(doc, minlength=n)
    per_word = 1.0 / np.maximum(words, 1)
    symbol = common.hash_spans(data, start, end, fold=True)
    order = np.lexsort((symbol, doc))
    new = np.r_[True, (symbol[order][1:] != symbol[order][:-1]) | (doc[order][1:] != doc[order][:-1])][: len(order)]
    at = np.flatnonzero(new)
    times = np.diff(np.r_[at, len(order)])
    most = np.zeros(n)
    np.maximum.at(most, doc[order][at], times)
    distinct = np.bincount(doc[order][at], minlength=n)

    last_byte = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    odd_end = np.bincount(doc, _CLASSES[last_byte][:, 2] + _CLASSES[last_byte][:, 4] > 0, minlength=n)

    breaks = np.flatnonzero(data == ord("\n"))
    edges = np.unique(np.r_[offsets, breaks, breaks + 1])
    head, tail = edges[:-1], edges[1:]
    full = np.searchsorted(start, head, "left") < np.searchsorted(start, tail, "left")
    head, tail = head[full], tail[full]
    whose = np.searchsorted(offsets, head, "right") - 1
    line = common.hash_spans(data, head, tail)
    order = np.lexsort((line, whose))
    again = np.r_[False, (line[order][1:] == line[order][:-1]) & (whose[order][1:] == whose[order][:-1])][: len(order)]
    lines = np.bincount(whose, minlength=n)
    repeated = np.bincount(whose[order][again], minlength=n)
    return np.column_stack(
        [
            np.log1p(size),
            np.log1p(words),
            np.bincount(doc, end - start, minlength=n) * per_word,
            kinds,
            lines * per_word,
            words / np.maximum(lines, 1),
            distinct * per_word,
            most * per_word,
            repeated / np.maximum(lines, 1),
            odd_end * per_word,
            entropy,
        ]
    )


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, stats array<double>)`` for every row; nothing is shuffled.

    A null text counts as empty (all zeros). Repeated rows give repeated rows, other columns are
    ignored. Only the text is looked at.
    """
    rows = docs.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in common.text_slices(batch.column(1), common.SMALL_SLICE):
                found = measure(data, offsets)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel())
                )
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists], names=[key, "stats"])

    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, stats array<double>")


@dataclass(frozen=True)
class Model:
    """Standardisation, random features, ridge weights and the calibration steps."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # calibrated score of each bin of the raw score

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Cosines of random projections, whose products approximate a Gaussian kernel; then a constant."""
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.column_stack([waves, np.ones(len(z))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        at = np.clip(self.raw(stats), 0, 1) * (len(self.steps) - 1)
        low = np.minimum(at.astype(int), len(self.steps) - 2)
        return np.clip(self.steps[low] + (at - low) * (self.steps[low + 1] - self.steps[low]), 0, 1)


def _rows(batch: pa.RecordBatch, column: int = 0) -> np.ndarray:
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def isotonic(total: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing rates closest to those of the bins."""
    blocks: list[list[float]] = []
    for i, (n, p) in enumerate(zip(total, positive)):
        if n:
            blocks.append([p, n, i])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                p1, n1, _ = blocks.pop()
                blocks[-1][0] += p1
                blocks[-1][1] += n1
                blocks[-1][2] = i
    if not blocks:
        return np.linspace(0, 1, len(total))
    rates, last, first = np.zeros(len(total)), -1, 0
    for p, n, end in blocks:
        rates[first : end + 1] = p / n
        first, last = end + 1, p / n
    rates[first:] = last
    return rates


def fit(
    labelled: DataFrame,
    fit_rows: int = FIT_ROWS,
    n_features: int = N_FEATURES,
    width: float = 4.0,
    ridge: float = 1e-3,
    seed: int = 11,
) -> Model:
    """Fit on ``labelled(stats, label 0/1, fold int)``; rows of fold 0 calibrate, the others fit.

    Beyond ``fit_rows`` labelled rows an even share of them is taken, so about ``fit_rows`` are used.
    Without any row the score is 0.5 for every text; with one class only it is that class's rate.
    """
    n_stats = len(STATISTICS)
    count = labelled.count()
    if count > fit_rows:
        labelled = labelled.where(F.rand(seed) < fit_rows / count)
    labelled = hand_over(labelled.select("stats", F.col("label").cast("double").alias("label"), "fold").repartition(FIT_PARTITIONS), "labelled")
    rng = np.random.default_rng(seed)
    directions = rng.normal(0, 1 / width, (n_stats, n_features))
    phases = rng.uniform(0, 2 * np.pi, n_features)

    moments = labelled.select(
        *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(n_stats)],
        *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(n_stats)],
    ).first()
    mean = np.array([moments[i] or 0.0 for i in range(n_stats)])
    scale = np.array([moments[n_stats + i] or 0.0 for i in range(n_stats)])
    blank = Model(mean, np.where(scale > 1e-9, scale, 1.0), directions, phases, np.zeros(n_features + 1), np.zeros(2))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, moment = np.zeros((n_features + 1, n_features + 1)), np.zeros(n_features + 1)
        for batch in batches:
            z = blank.features(_rows(batch))
            gram += z.T @ z
            moment += z.T @ batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([np.vstack([gram, moment]).tobytes()])], names=["part"])

    total = np.zeros((n_features + 2, n_features + 1))
    # At most FIT_PARTITIONS matrices of a fixed size, taken one after the other.
    for row in labelled.where("fold <> 0").select("stats", "label").mapInArrow(sums, "part binary").toLocalIterator():
        total += np.frombuffer(row.part, np.float64).reshape(total.shape)
    gram, moment = total[:-1], total[-1]
    n_fit = gram[-1, -1]
    penalty = np.full(n_features + 1, ridge * max(n_fit, 1) / n_features)
    penalty[-1] = 1e-9
    weights = np.linalg.solve(gram + np.diag(penalty), moment) if n_fit else np.r_[np.zeros(n_features), 0.5]
    fitted = Model(mean, blank.scale, directions, phases, weights, np.zeros(2))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.rint(np.clip(fitted.raw(_rows(batch)), 0, 1) * (BINS - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], names=["bin", "label"])

    total, positive = np.zeros(BINS), np.zeros(BINS)
    held = labelled.where("fold = 0").select("stats", "label").mapInArrow(bins, "bin long, label double")
    for row in held.groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect():  # BINS rows
        total[row.bin], positive[row.bin] = row.n, row.p
    return Model(mean, blank.scale, directions, phases, weights, isotonic(total, positive))


def apply_model(stats: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """``(key, score)`` for rows of ``document_statistics``."""
    rows = stats.select(key, "stats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(_rows(batch, 1)) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=[key, "score"])

    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, score double")


def _known(labels: DataFrame, learn: str) -> DataFrame:
    """One label per document. Null labels are ignored, several are averaged (0.5 or more: 1)."""
    good = labels.where(f"quality IS NOT NULL AND doc_id IS NOT NULL AND {learn}")
    return good.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))


def _with_labels(stats: DataFrame, labels: DataFrame, learn: str) -> DataFrame:
    return stats.join(_known(labels, learn), "doc_id").withColumn("fold", F.expr("pmod(xxhash64(doc_id), 5)"))


def labelled_statistics(docs: DataFrame, labels: DataFrame, learn: str = "true") -> DataFrame:
    """``(doc_id, stats, label, fold)`` of the documents with a label: what ``fit`` takes."""
    return _with_labels(document_statistics(docs), labels, learn)


def keep_good(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` with a score of ``least`` or more; all columns, one narrow stage.

    The text is measured again, which is cheaper than a join of all texts with their scores.
    """
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in common.text_slices(batch.column(at), common.SMALL_SLICE):
                good = model.score(measure(data, offsets)) >= least
                yield batch.slice(first, last - first).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, learn: str = "true") -> DataFrame:
    """``(doc_id, held_out, score)`` of every row of ``docs``, learnt from ``labels(doc_id, quality)``.

    Labels count only where ``learn``, a condition on ``doc_id``, holds; ``held_out`` is its opposite.
    Labels of unknown documents are ignored. A null or empty text is scored by its zero statistics.
    """
    stats = hand_over(document_statistics(docs), "stats")
    scores = apply_model(stats, fit(_with_labels(stats, labels, learn)))
    return scores.withColumn("held_out", ~F.coalesce(F.expr(learn), F.lit(True)))
