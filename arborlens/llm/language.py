"""Language identification: nearest of several centroids per language, on TF-IDF n-gram vectors.

A text becomes a normalised vector of hashed letter n-grams (one to three letters, case folded, runs
of other characters as one blank). Training vectors of each language are clustered by spherical
k-means; a text gets the language of the centroid with the largest cosine. A text farther from it
than the training vectors of that language are is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlens.llm import common

DIMENSIONS = 4096
#: Rows per language that the classifier is fitted on, about; languages are few, texts are not.
FIT_PER_LANGUAGE = 400
CLUSTERS = 3
#: A training cosine below this quantile of its language counts as too far.
REJECT_QUANTILE = 0.005

_letters: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """For every code point: the first code point of its lower case if it is a letter, else 0."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                table[c] = ord(s.lower()[0])
        _letters.append(table)
    return _letters[0]


def _code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the offset of each text in them."""
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, heads[offsets]


def gram_counts(data: np.ndarray, offsets: np.ndarray, dims: int = DIMENSIONS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, counts, letters)`` for groups of texts: n-gram counts and the number of letters."""
    points, places = _code_points(data, offsets)
    letter = _fold_table()[points]
    n_docs = len(offsets) - 1
    # A blank stands for a run of other characters, and before the first letter of a text.
    keep = letter > 0
    keep[1:] |= letter[:-1] > 0
    kept_before = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=kept_before[1:])
    letters_before = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(letter > 0, out=letters_before[1:])
    n_letters = np.diff(letters_before[places])
    code, place = letter[keep].astype(np.uint64), kept_before[places]
    last1 = np.zeros(len(code), np.uint64)
    last1[1:] = code[:-1]
    last2 = np.zeros(len(code), np.uint64)
    last2[2:] = code[:-2]
    heads = place[:-1][np.diff(place) > 0]
    last1[heads] = 0
    last2[heads] = 0
    seconds = heads + 1
    last2[seconds[seconds < len(code)]] = 0
    one = code * np.uint64(0x9E3779B1)
    two = one + last1 * np.uint64(0x85EBCA77C2B2AE63)
    three = two + last2 * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(7)
    two += np.uint64(3)
    shift = np.uint64(64 - int(dims).bit_length() + 1)
    spread = np.uint64(0x9E3779B97F4A7C15)
    cells = [((h * spread) >> shift).astype(np.int64) for h in (one, two, three)]
    step = 256
    for first in range(0, n_docs, step):
        last = min(n_docs, first + step)
        a, b = place[first], place[last]
        owner = np.repeat(np.arange(last - first) * dims, np.diff(place[first : last + 1]))
        counts = np.zeros((last - first) * dims)
        for h in cells:
            counts += np.bincount(owner + h[a:b], minlength=len(counts))
        yield first, last, counts.reshape(-1, dims), n_letters[first:last]


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors; the term frequency is dampened by a logarithm."""
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray  # language number of each centroid
    nearest: np.ndarray  # smallest cosine that a language accepts


def _clusters(vectors: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Spherical k-means; the first centre is the mean direction, each next one the farthest vector."""
    centres = [vectors.mean(0)]
    for _ in range(min(k, len(vectors)) - 1):
        centres.append(vectors[np.argmin(np.max(vectors @ np.array(centres).T, 1))])
    c = np.array(centres)
    for _ in range(12):
        near = np.argmax(vectors @ c.T, 1)
        c = np.array([vectors[near == i].sum(0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def training_sample(labelled: DataFrame, per_language: int = FIT_PER_LANGUAGE) -> DataFrame:
    """About ``per_language`` rows of each language of ``labelled(doc_id, text, lang)``, chosen by hash.

    The share of each language follows from its count, so rows are thinned out before they meet;
    the largest number of rows of a language is twice ``per_language``.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL AND length(text) > 0")
    counts = rows.groupBy("lang").count()
    thin = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_003)) < F.ceil(1_000_003.0 * per_language / F.col("count"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id")
    # One row per language: the table of counts is small whatever the corpus is.
    return (
        rows.join(F.broadcast(counts), "lang")
        .where(thin)
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= 2 * per_language)
        .select("lang", "text")
    )


def fit(labelled: DataFrame, per_language: int = FIT_PER_LANGUAGE, clusters: int = CLUSTERS, dims: int = DIMENSIONS) -> Model:
    """Fit on a bounded sample of ``labelled(doc_id, text, lang)``."""
    sample = training_sample(labelled, per_language)

    def counted(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups:
            for first, last, data, offsets in common.text_slices(pa.array(group["text"], pa.string())):
                langs = group["lang"].iloc[first:last].to_numpy()
                for a, b, counts, letters in gram_counts(data, offsets, dims):
                    good = letters > 0
                    yield pd.DataFrame({"lang": langs[a:b][good], "counts": [np.minimum(x, 65535).astype(np.uint16).tobytes() for x in counts[good]]})

    vectors = sample.mapInPandas(counted, "lang string, counts binary").persist()
    # df over the sample: one number per dimension and task, added up
    def frequencies(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(dims, np.int64), 0
        for group in groups:
            for row in group["counts"]:
                df += np.frombuffer(row, np.uint16) > 0
                n += 1
        yield pd.DataFrame({"df": [df.tobytes()], "n": [n]})

    df, n = np.zeros(dims, np.int64), 0
    for row in vectors.coalesce(8).mapInPandas(frequencies, "df binary, n long").collect():
        df += np.frombuffer(row.df, np.int64)
        n += row.n
    idf = np.log((1 + n) / (1 + df)) + 0.1

    def cluster(key, group: pd.DataFrame) -> pd.DataFrame:
        v = weigh(np.stack([np.frombuffer(x, np.uint16) for x in group["counts"]]).astype(float), idf)
        c = _clusters(v, clusters)
        near = np.max(v @ c.T, 1)
        return pd.DataFrame({"lang": key[0], "centre": [x.astype(np.float32).tobytes() for x in c], "near": float(np.quantile(near, REJECT_QUANTILE))})

    # A group holds at most 2 * per_language vectors of a fixed size.
    found = vectors.groupBy("lang").applyInPandas(cluster, "lang string, centre binary, near double").orderBy("lang").collect()
    vectors.unpersist()
    languages = sorted({r.lang for r in found})
    return Model(
        languages,
        idf,
        np.array([np.frombuffer(r.centre, np.float32) for r in found], np.float64).reshape(-1, dims),
        np.array([languages.index(r.lang) for r in found], np.int64),
        np.array([next(r.near for r in found if r.lang == x) for x in languages]),
    )


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, lang_pred, score, rejected)`` for every row; nothing is shuffled.

    ``und`` with score 0 for a null text, a text without letters, or a model without languages.
    ``rejected`` marks texts farther from every centroid of their language than its training texts.
    """
    rows = docs.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, "und"], object)
        centres = model.centroids.T
        for batch in batches:
            for first, last, data, offsets in common.text_slices(batch.column(1)):
                lang = np.full(last - first, len(names) - 1)
                score = np.zeros(last - first)
                if len(model.languages):
                    for a, b, counts, letters in gram_counts(data, offsets, len(model.idf)):
                        cosine = weigh(counts, model.idf) @ centres
                        near = np.argmax(cosine, 1)
                        lang[a:b] = np.where(letters > 0, model.owner[near], len(names) - 1)
                        score[a:b] = np.where(letters > 0, np.clip(cosine[np.arange(b - a), near], 0, 1), 0)
                limit = np.append(model.nearest, np.inf)[lang]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(names[lang], pa.string()), pa.array(score), pa.array(score < limit)],
                    names=[key, "lang_pred", "score", "rejected"],
                )

    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
