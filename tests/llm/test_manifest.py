"""Manifest against a plain tree: nulls, repeats, one row, several stored levels, proofs that fold to the root."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from arborlens.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos int, node string, path string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, text, lang, source, n):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, k):
    out = []
    for level in levels[:-1]:
        first = k - k % 8
        out.append((level[first:k], level[k + 1 : first + 8]))
        k //= 8
    return out


def plain(rows):
    trees = defaultdict(list)
    for row in rows:
        i, text, lang, source, n = row
        changed = text is not None and i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text) if changed else text
        trees[lang].append(((i is not None, i or 0), leaf(*row), leaf(i, low, lang, source, n), i))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: levels_of([t[1] for t in sorted(trees[x], key=lambda t: t[:2])]) for x in names}
    top = levels_of([built[x][-1][0] for x in names])
    out = []
    for place, name in enumerate(names):
        for k, (_, own, start, i) in enumerate(sorted(trees[name], key=lambda t: t[:2])):
            steps = siblings(built[name], k) + siblings(top, place)
            folded = start
            for before, after in steps:
                folded = H(*before, folded, *after)
            root = top[-1][0]
            out.append((i, own, built[name][-1][0], root, H(*(x for s in steps for y in s for x in y)), folded, folded == root))
    return sorted(out, key=str)


def proved(spark, rows):
    docs = spark.createDataFrame([(*r, "t", 1, "n", "p") for r in rows], SCHEMA)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    altered = F.expr("pmod(crc32(CAST(doc_id AS STRING)), 3) = 0")
    found = manifest.dataset_manifest(docs, altered, F.translate("text", upper, upper.lower()))
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 9, 64, 65, 600])
def test_sizes(spark, n):
    rows = [(i, f"Text {i}", "en", "web", i) for i in range(n)]
    assert proved(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(i, f"Text {i}", ("en", "de", None, "", "zz", "é")[i % 6], None if i % 5 else "web", None) for i in range(100)]
    rows += [(3, "Text 3", "en", None, None)] * 3 + [(3, "Other", "en", None, None), (None, None, None, None, None), (None, "A", "en", "s", 1)]
    rows += [(200, "", "en", "", 0), (201, "ÄÖ AB\n" * 30_000, "de", "x", 5), (202, None, "de", "x", 5)]
    assert proved(spark, rows) == plain(rows)


def test_several_stored_levels(spark, monkeypatch):
    monkeypatch.setattr(manifest, "STRIDE", 1)
    rows = [(i, f"T{i}", "en" if i % 7 else f"l{i % 90:02}", "web", i) for i in range(700)]
    assert proved(spark, rows) == plain(rows)


def test_full_proofs_lead_to_the_root(spark):
    rows = [(i, f"T{i}", "en" if i % 3 else "de", "web", i) for i in range(150)]
    docs = spark.createDataFrame([(*r, "t", 1, "n", "p") for r in rows], SCHEMA)
    found = manifest.dataset_manifest(docs, full=True).collect()
    assert len(found) == 150 and all(r.verified for r in found)
    for r in found:
        assert r.proof_sha256 == H(*r.siblings)
