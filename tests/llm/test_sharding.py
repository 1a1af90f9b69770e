"""Shards against a plain draw; balance, weights, moves, slots and files."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from arborlens.llm import sharding

SCHEMA = "doc_id long, text string, lang string, shard string, slot int, _key string, size int"
M = 2**64 - 1


def mix(h):
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = ((h ^ (h >> shift)) * by) & M
    return h ^ (h >> 31)


def drawn(key, weights):
    k = int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:16], 16)
    costs = [(-math.log(((mix(k ^ mix(s + 1)) >> 11) + 0.5) / 2**53) / w, s) for s, w in enumerate(weights) if w > 0]
    return min(costs)[1]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 1, "k", 3) for i, t in rows], SCHEMA)


def test_shards_of_documents(spark):
    rows = [(i, f"text {i}") for i in range(300)] + [(7, "text 7"), (7, "other"), (None, "no key"), (None, None), (400, None), (401, ""), (402, "é" * 50_000)]
    found = sharding.shard_documents(frame(spark, rows)).collect()
    wanted = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key", drawn(i, [1] * 40), drawn(i, [1] * 41)) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in found) == wanted
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(frame(spark, [])).collect() == []


def test_weights_and_moves(spark):
    keys = np.random.default_rng(2).integers(0, 2**63, 200_000).astype(np.uint64)
    weights = [1.0, 2.0, 0.0, 5.0]
    shard = sharding.rendezvous(keys, weights)
    shares = np.bincount(shard, minlength=4) / len(keys)
    assert np.abs(shares - np.array(weights) / 8).max() < 0.01
    # A shard that goes gives up only its own; the others keep theirs.
    less = sharding.rendezvous(keys, [1.0, 0.0, 0.0, 5.0])
    assert (less[shard != 1] == shard[shard != 1]).all()
    grown = sharding.rendezvous(keys, [*weights, 2.0])
    assert set(grown[grown != shard]) == {4} and abs((grown == 4).mean() - 0.2) < 0.01
    old = sharding.assign(frame(spark, [(i, "") for i in range(500)]), weights=weights, added=None)
    new = sharding.assign(frame(spark, [(i, "") for i in range(500)]), weights=[*weights, 2.0], added=None)
    moved = sharding.moves(old, new).collect()
    assert sum(r["rows"] for r in moved) == 500 and all(r.to in (r.shard, 4) for r in moved)


def test_files(spark, tmp_path):
    rows = [(i, f"t{i}") for i in range(100)]
    sharding.write_shards(frame(spark, rows), str(tmp_path / "out"), weights=[1, 1, 1], file_rows=10)
    back = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "text", "shard").collect()
    assert sorted((r.doc_id, r.text, r.shard) for r in back) == [(i, t, drawn(i, [1] * 3)) for i, t in rows]
