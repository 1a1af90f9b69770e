"""Near-duplicate vectors: recall of planted pairs, exact counts in a hot bucket, keys that repeat."""

import numpy as np

from arborlens.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, rep int, n int"


def found(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "u", 1, 2) for r in rows], SCHEMA)
    out = embeddings.near_duplicates(frame, **options)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return out.collect()


def at_cosine(rng, a, cosine):
    side = rng.normal(size=a.shape)
    side -= (side @ a) / (a @ a) * a
    return cosine * a / np.linalg.norm(a) + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)


def test_recall_of_planted_pairs(spark):
    """10,000 vectors, a third of them in pairs just above the threshold."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(8350, 64))
    extra = [at_cosine(rng, base[i], 0.9805) * rng.uniform(0.5, 3) for i in range(1650)]
    rows = [(i, [float(x) for x in v], i % 2 if i < 1650 else int(rng.integers(2))) for i, v in enumerate(base)]
    rows += [(8350 + i, [float(x) for x in v], i % 2) for i, v in enumerate(extra)]
    got = {r.vec_id: r for r in found(spark, rows)}
    linked = sum(got[8350 + i].component_id == i and got[i].n_links == 1 for i in range(1650))
    assert len(got) == 10_000 and linked >= 0.99 * 1650
    assert all(got[i].n_links == 0 and got[i].kept for i in range(1650, 8350))


def test_a_hot_bucket_is_counted_exactly(spark):
    """Very near vectors that all link with each other, more than several blocks hold, and copies."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    rows = [(i, [float(x) for x in centre + rng.normal(size=16) * 0.001], 1) for i in range(300)]
    rows += [(300 + i, rows[i % 3][1], 1) for i in range(30)] + [(400, rows[0][1], 2)]
    got = {r.vec_id: r for r in found(spark, rows, block=32)}
    assert all(got[i].n_links == 329 and got[i].component_id == 0 and got[i].kept == (i == 0) for i in range(330))
    assert got[400].n_links == 0 and got[400].kept


def test_keys_that_repeat(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (1, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [0.0, 1.0, 0.0], 0), (3, [-0.0, 1.0, 0.0], 0), (None, [0.0, 0.0, 1.0], 0), (4, None, 0), (4, None, 0)]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in found(spark, rows))
    assert got == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4), (4, 0, 4)]
