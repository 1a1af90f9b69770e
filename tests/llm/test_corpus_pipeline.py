"""Every stage of the pipeline against a plain version of its rule; odd rows; queries with SQL against DuckDB."""

import os
import random
import re
from collections import Counter, defaultdict

import compare
import duckdb
import pytest

import corpus_pipeline
from arborlens.llm import packing, pseudonyms, quality, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
KEY = "a secret for tests"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.fixture(scope="module")
def docs(spark):
    """The given documents, near copies that differ in several places, odd rows, and a column more."""
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    rng = random.Random(4)
    good = [r for r in rows if r[1] and 120 < len(r[1].split()) < 400][:12]
    for k, (_, text, lang, source, _) in enumerate(good):
        for n in range(2):
            words = text.split()
            for at in (len(words) // 5, len(words) // 2, len(words) * 4 // 5):
                words[at] = f"{words[at - 7]}{'xyz'[n]}"
            rows.append((10_000 + 10 * k + n, " ".join(words), lang, source, None))
    rows += [(20_000, None, None, None, None), (20_001, "", "en", "", 0), (20_002, " \n ", "en", "s", 3), (None, rows[3][1], "en", "s", 9), rows[5], rows[5]]
    rows.append((rows[7][0], "another text under a key that is in use " + " ".join(rng.sample("abcdefghijk", 8)), "en", "s", 5))
    rows.append((20_003, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(999)) for _ in range(30_000)), "en", "s", 5))
    return spark.createDataFrame(rows, spark.read.parquet(f"{FOLDER}/documents.parquet").schema)


@pytest.fixture(scope="module")
def stages(spark, docs):
    """Rows before and after every stage."""
    spark.conf.set(pseudonyms.KEY_SETTING, KEY)
    found, seen = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, seen, FOLDER).cache()
        found[name] = (seen.collect(), made.collect(), seen)
        if name != "best-fit packing":
            assert made.columns == docs.columns
        seen = made
    spark.conf.unset(pseudonyms.KEY_SETTING)
    return found


def test_quality_stage(spark, stages):
    before, after, frame = stages["quality classifier"]
    model = quality.fit(quality.labelled_statistics(frame, spark.read.parquet(f"{FOLDER}/labels.parquet")))
    import numpy as np

    def score(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        return float(model.score(quality.measure(data, np.array([0, len(data)])))[0])

    assert Counter(after) == Counter(r for r in before if score(r.text) >= 0.5) and 0 < len(after) < len(before)


def test_line_stage(stages):
    before, after, _ = stages["line dedup"]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE docs (doc_id BIGINT, text VARCHAR)")
    keys = Counter(r.doc_id for r in before)
    connection.executemany("INSERT INTO docs VALUES (?, ?)", [(r.doc_id, r.text) for r in before])
    lean = dict(connection.sql("WITH " + queries.LINES_SQL.replace("{docs}", "docs") + "SELECT doc_id, text FROM rest").fetchall())
    for r in after:
        if r.doc_id is not None and r.text is not None and keys[r.doc_id] == 1:
            assert r.text == lean[r.doc_id]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert all(not re.search(r"[^\x20\x09-\x0D]", lean[i]) for i in gone)
    assert sum(a.text != b.text for a, b in zip(sorted(before, key=str), sorted(after, key=str), strict=False)) > 0


def test_near_stage(stages):
    before, after, _ = stages["n-gram Jaccard join"]
    sets = defaultdict(set)
    for r in before:
        if r.doc_id is not None and shingles(r.text):
            sets[r.doc_id].add(frozenset(shingles(r.text)))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(10 * len(x & y) >= 8 * len(x | y) for x in sets[a] for y in sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    stay = {r.doc_id for r in before if r.doc_id is None or r.doc_id not in sets or root(r.doc_id) == r.doc_id}
    assert {r.doc_id for r in after} == stay and len(stay) < len({r.doc_id for r in before})
    assert {(r.doc_id, r.text) for r in after} == {(r.doc_id, r.text) for r in before if r.doc_id in stay}
    assert len(after) == len({(r.doc_id, r.text) for r in after})


def test_pii_stage(spark, stages):
    before, after, _ = stages["PII"]
    spark.conf.set(pseudonyms.KEY_SETTING, KEY)
    key = pseudonyms.job_key(spark)
    spark.conf.unset(pseudonyms.KEY_SETTING)
    assert Counter((r.doc_id, r.text) for r in after) == Counter((r.doc_id, pseudonyms.pseudonymize(r.text, key)[0]) for r in before)
    assert any(a.text != b.text for a, b in zip(sorted(before, key=str), sorted(after, key=str), strict=True))
    assert pseudonyms.job_key(spark) != pseudonyms.job_key(spark)


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    before, placed, _ = stages["best-fit packing"]
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.encode_special_tokens = True
    tokens = Counter()
    for r in before:
        tokens[r.doc_id] += len(encoder.encode(r.text or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in placed:
        got[r.doc_id] += r.length
    bins = Counter()
    for r in placed:
        bins[r.sequence_id] += r.length
    assert got == tokens and max(bins.values()) <= packing.CAPACITY


@pytest.mark.parametrize("name", ["op1_line_templates", "op3_repetition", "op11_hard_negatives", "op12_shards", "op13_manifest"])
def test_sql(spark, name):
    assert compare.differences(spark, compare.open_duckdb(FOLDER), name, FOLDER) == ""


def test_queries_without_sql():
    """These are held against plain versions in this folder."""
    without = {"op2_language", "op4_sentencepiece", "op5_passages", "op6_near_documents", "op7_pseudonyms", "op8_embeddings", "op9_quality", "op10_packing"}
    assert set(queries.REGISTERED) - set(queries.ORACLE) == without and corpus_pipeline.ORACLE_SQL is None
