"""Shards by rendezvous hashing of stable record keys, over weighted shards.

Every shard draws a number from the key and its own name; the shard with the best draw for its weight
takes the record. A shard that is added draws for itself alone, so it takes records only into itself,
and one that goes gives up only its own. Nothing but the key, the names and the weights decides, so
a shard may be as large as its keys make it: a key that many rows hold lies in one shard whole.

A task draws for its own rows (one number at a time for each shard, in numpy). Texts never move for
that: places are worked out from the key, the size and the checksum. Positions in a shard come from a
range partitioning of these narrow rows, so a shard is no task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlens.llm import common
from arborlens.operators.ordering import number_rows
from arborlens.session import hand_over

SHARDS = 40
#: Bytes of a record beside its text.
RECORD_BYTES = 16
#: Records that ``write_shards`` puts into one file at most.
FILE_ROWS = 100_000


def draws(keys: np.ndarray, shard: int) -> np.ndarray:
    """Number in (0, 1) that ``shard`` draws for every 64-bit key."""
    salt = common.mix(np.array([shard + 1], np.uint64))
    return ((common.mix(keys ^ salt) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def rendezvous(keys: np.ndarray, weights: Sequence[float], names: Sequence[int] | None = None) -> np.ndarray:
    """Name of the shard that takes each key; shards without weight take none. The earlier one wins a tie."""
    names = range(len(weights)) if names is None else names
    best = np.full(len(keys), np.inf)
    shard = np.full(len(keys), -1, np.int32)
    for name, weight in zip(names, weights, strict=True):
        if weight <= 0:
            continue
        cost = -np.log(draws(keys, name)) / weight
        better = cost < best
        best[better], shard[better] = cost[better], name
    return shard


def assign(rows: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * SHARDS, added: float | None = 1.0) -> DataFrame:
    """``rows`` with ``shard`` and ``grown_shard``, the shard with one more of weight ``added`` (null without).

    Keys of any type that casts to a string; equal strings get equal shards, null is a key like any
    other. Columns named ``shard`` or ``grown_shard`` are replaced.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("at least one shard needs a weight above zero")
    weights = [float(w) for w in weights]
    rows = rows.drop("shard", "grown_shard")
    digest = common.fresh(rows, "_key")
    # A digest that other engines have too; the first eight bytes are the key's number.
    keyed = rows.withColumn(digest, F.expr(f"unhex(substring(md5(coalesce(CAST(`{key}` AS STRING), '')), 1, 16))"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *given, digests = batch.columns
            keys = np.frombuffer(b"".join(digests.to_pylist()), ">u8").astype(np.uint64)
            shard = rendezvous(keys, weights)
            grown = pa.nulls(len(keys), pa.int32())
            if added is not None:
                grown = pa.array(rendezvous(keys, [*weights, added]))
            yield pa.RecordBatch.from_arrays([*given, pa.array(shard), grown], names=[*batch.schema.names[:-1], "shard", "grown_shard"])

    schema = T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("grown_shard", T.IntegerType())])
    return keyed.mapInArrow(deal, schema)


def shard_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * SHARDS, added: float | None = 1.0
) -> DataFrame:
    """``(key, size, text_crc32, law, shard, slot, grown_shard)`` of every row.

    ``size`` is the UTF-8 bytes of the text plus 16, ``slot`` the place in the shard, by key, size and
    checksum. A null text counts as empty. Rows that repeat a key lie in one shard, one after the other.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key), (F.octet_length(body) + RECORD_BYTES).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")
    )
    placed = hand_over(assign(narrow, key, weights, added), "shards")
    # What else is equal is the same row, so its order does not matter.
    numbered = number_rows(placed, ["shard"], [key, "size", "text_crc32"], out="slot")
    return numbered.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", weights: Sequence[float] = (1.0,) * SHARDS, file_rows: int = FILE_ROWS) -> None:
    """Write ``docs`` to ``path/shard=N`` as Parquet. A shard of any size is dealt over files of about ``file_rows`` rows."""
    rows = assign(docs, key, weights, None).drop("grown_shard")
    sizes = rows.groupBy("shard").agg(F.count("*").alias("_n"))
    parts = max(1, sum(-(-r["_n"] // file_rows) for r in sizes.collect()))  # one row for each shard
    rows.repartition(parts).write.partitionBy("shard").parquet(path)


def moves(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(shard, to, rows)``: keys of two placements by the shard they leave and the one they come to."""
    old = before.select(key, F.col("shard")).distinct()
    new = after.select(key, F.col("shard").alias("to")).distinct()
    same = old[key].eqNullSafe(new[key])
    return old.join(new, same).groupBy("shard", "to").agg(F.count("*").alias("rows"))
