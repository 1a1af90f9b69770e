"""Merkle manifest of a dataset: a tree for each language under one root, checkpointed every few levels.

A leaf is the hash of a document. Every ``FAN`` consecutive nodes of a level are hashed to one of the
next. Only every ``STRIDE``-th level is stored, as one row for each aligned subtree with the digests it
stands on (``FAN ** STRIDE`` at most). The levels between are never written: building a subtree or
drawing proofs from it hashes them again from the stored digests, in the task that holds the row, and
drops them.

Proofs are drawn from the top. A subtree gets the siblings above it, once for all its leaves, and adds
those inside. So what moves for a proof is one row for each subtree, and a text is read once, for its leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens.operators.ordering import number_rows
from arborlens.session import hand_over

FAN = 8
STRIDE = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Subtrees whose leaves leave a task in one batch.
EMIT = 16
#: Files of a table with one row for each language or fewer.
FEW = 4


def digest(nodes: bytes) -> bytes:
    """Hash of digests that stand one after the other, as hex text."""
    return sha256(nodes.hex().encode()).digest()


def interior(nodes: list[bytes], whole: bool) -> list[list[bytes]]:
    """Levels of an aligned subtree from the stored one up; ``whole`` ends at the first single node."""
    levels = [nodes]
    while len(levels) <= STRIDE and not (whole and len(levels[-1]) == 1):
        low = levels[-1]
        levels.append([digest(b"".join(low[i : i + FAN])) for i in range(0, len(low), FAN)])
    return levels


def siblings(levels: list[list[bytes]], place: int) -> list[tuple[bytes, bytes]]:
    """Digests before and after the node above ``place`` in its run, for each level below the top one."""
    found = []
    for level in levels[:-1]:
        first = place - place % FAN
        found.append((b"".join(level[first:place]), b"".join(level[place + 1 : first + FAN])))
        place //= FAN
    return found


def to_path(steps: list[tuple[bytes, bytes]]) -> bytes:
    """Steps as bytes: how many digests stand before and after, then the digests."""
    return b"".join(bytes((len(a) // 32, len(b) // 32)) + a + b for a, b in steps)


def to_steps(path: bytes) -> list[tuple[bytes, bytes]]:
    steps, at = [], 0
    while at < len(path):
        middle = at + 2 + 32 * path[at]
        end = middle + 32 * path[at + 1]
        steps.append((path[at + 2 : middle], path[middle:end]))
        at = end
    return steps


def fold(node: bytes, steps: list[tuple[bytes, bytes]]) -> bytes:
    """Root that a node and its siblings lead to."""
    for before, after in steps:
        node = digest(before + node + after)
    return node


def leaf_hash(fields: dict[str, Column]) -> Column:
    """Digest of the fields in the order of ``FIELDS``: ``-`` if null, else byte count, ``:`` and value."""
    parts = []
    for name in FIELDS:
        value = fields[name].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


@dataclass
class Level:
    """Stored digests of one level: ``(tree, block, n, nodes)``, ``nodes`` in order with their payload."""

    height: int
    rows: DataFrame


@dataclass
class Manifest:
    """``levels`` of the language trees from the leaves up, those of the tree over them, and ``roots``.

    ``roots`` has one row for each language: ``tree, n, subroot, path, root``.
    """

    levels: list[Level]
    roots: DataFrame


def _spread(height: int) -> int:
    return FAN ** (STRIDE * height)


def _build(leaves: DataFrame, payload: list[str], few: bool = False) -> tuple[list[Level], DataFrame]:
    """Stored levels over ``leaves`` (``tree, pos, node`` and payload), and ``(tree, n, node)`` of their tops.

    ``few``: the leaves are languages, so every table is written by few tasks.
    """
    sizes = hand_over(leaves.groupBy("tree").agg(F.count("*").alias("n")).coalesce(FEW), "sizes")
    most = sizes.agg(F.max("n")).first()[0] or 0
    nodes = leaves.join(sizes, "tree")
    levels, tops = [], None
    while True:
        height = len(levels)
        rows = (
            nodes.groupBy("tree", F.expr(f"pos div {FAN**STRIDE}").alias("block"), "n")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "node", *payload))).alias("nodes"))
            .withColumn("whole", F.col("n") <= _spread(height + 1))
        )
        rows = hand_over(rows.coalesce(FEW) if few else rows, f"level-{height}")
        levels.append(Level(height, rows))
        above = hand_over(
            rows.select("tree", "block", "n", F.col("nodes.node").alias("nodes"), "whole").mapInArrow(
                _tops, "tree string, pos long, n long, node binary, whole boolean"
            ),
            f"tops-{height}",
        )
        found = above.where("whole").select("tree", "n", "node")
        tops = found if tops is None else tops.union(found)
        if most <= _spread(height + 1):
            return levels, tops
        nodes, payload = above.where("NOT whole").select("tree", "pos", "n", "node"), []


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Top node of every aligned subtree."""
    for batch in batches:
        tree, block, n, nodes, whole = batch.columns
        found = [interior(nodes[i].as_py(), whole[i].as_py())[-1][0] for i in range(len(batch))]
        yield pa.RecordBatch.from_arrays([tree, block, n, pa.array(found, pa.binary()), whole], names=["tree", "pos", "n", "node", "whole"])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path to the root of every stored node of the subtrees."""
    names = ["tree", "pos", "path"]
    for batch in batches:
        for i in range(len(batch)):
            tree, block, nodes, whole, path = (c[i].as_py() for c in batch.columns)
            levels = interior(nodes, whole)
            found = [to_path(siblings(levels, k)) + path for k in range(len(nodes))]
            first = block * FAN**STRIDE
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree] * len(nodes)), pa.array(range(first, first + len(nodes)), pa.int64()), pa.array(found, pa.binary())], names=names
            )


def _descend(levels: list[Level], tops: DataFrame) -> DataFrame:
    """Stored leaf level with ``path``, what stands above each subtree; ``tops`` has the path of each tree's top."""
    above = None
    for level in reversed(levels):
        ends = tops.where((F.col("n") <= _spread(level.height + 1)) & (F.col("n") > (_spread(level.height) if level.height else 0)))
        start = ends.select("tree", F.lit(0).cast("long").alias("block"), "path")
        above = start if above is None else start.union(above.select("tree", F.col("pos").alias("block"), "path"))
        rows = level.rows.join(above, ["tree", "block"])
        if level.height == 0:
            return rows
        inner = rows.select("tree", "block", F.col("nodes.node").alias("nodes"), "whole", "path")
        above = inner.mapInArrow(_paths, "tree string, pos long, path binary")


def leaves_of(docs: DataFrame, altered: Column | None = None, text: Column | None = None) -> DataFrame:
    """``tree, doc_id, node`` of every row, and ``changed``: the leaf with ``text`` for its text where ``altered``."""
    fields = {name: F.col(name) for name in FIELDS}
    changed = F.lit(None).cast("binary")
    if altered is not None:
        changed = F.when(altered & F.col("text").isNotNull(), leaf_hash(fields | {"text": text}))
    # Null comes before every language, and languages in the order of their bytes.
    tree = F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0"))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(fields).alias("node"), changed.alias("changed"))


def build_manifest(leaves: DataFrame) -> Manifest:
    """Manifest over ``leaves_of`` rows; leaves of a language stand by ``doc_id`` (null first), then by digest."""
    leaves = hand_over(leaves, "leaves")
    placed = number_rows(leaves, ["tree"], ["doc_id", "node", "changed"], out="pos")
    levels, tops = _build(placed, ["doc_id", "changed"])
    tops = hand_over(tops, "subroots")
    over = number_rows(tops.select(F.lit("").alias("over"), "tree", "node"), ["over"], ["tree"], out="pos")
    upper, root = _build(over.select(F.col("over").alias("tree"), "pos", "node"), [])
    root = hand_over(root.coalesce(1), "root")
    start = root.select("tree", "n", F.unhex(F.lit("")).alias("path"))
    inner = _descend(upper, start).select("tree", "block", F.col("nodes.node").alias("nodes"), "whole", "path")
    paths = inner.mapInArrow(_paths, "tree string, pos long, path binary")
    named = over.select("over", "tree", "pos", F.col("node").alias("subroot")).join(paths.select("pos", "path"), "pos")
    named = named.join(root.select(F.col("tree").alias("over"), F.col("node").alias("root")), "over")
    roots = named.join(tops.select("tree", "n"), "tree")
    return Manifest(levels, hand_over(roots.select("tree", "n", "subroot", "path", "root").coalesce(FEW), "roots"))


def prove(manifest: Manifest, full: bool = False) -> DataFrame:
    """Proof of every leaf, drawn from the stored levels and checked.

    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, digests as hex;
    ``folded_root`` starts from the changed leaf where there is one. ``full`` adds ``siblings``, the
    digests of the proof from the leaf's run up, in order, and ``before``, how many of each level stand left of the path.
    """
    rows = _descend(manifest.levels, manifest.roots.select("tree", "n", "path"))
    rows = rows.join(manifest.roots.select("tree", "subroot", "root"), "tree")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), EMIT):
                out: list[list] = [[] for _ in range(9 if full else 7)]
                for nodes, whole, path, subroot, root in zip(*(c.to_pylist() for c in batch.slice(first, EMIT).columns), strict=True):
                    above = to_steps(path)
                    rest = b"".join(a + b for a, b in above).hex().encode()
                    levels = interior([x["node"] for x in nodes], whole)
                    for place, leaf in enumerate(nodes):
                        steps = siblings(levels, place)
                        own = b"".join(a + b for a, b in steps).hex().encode()
                        folded = fold(leaf["changed"] or leaf["node"], steps + above)
                        row = [leaf["doc_id"], leaf["node"].hex(), subroot.hex(), root.hex(), sha256(own + rest).hexdigest(), folded.hex(), folded == root]
                        if full:
                            every = (own + rest).decode()
                            row += [[every[i : i + 64] for i in range(0, len(every), 64)], [len(a) // 32 for a, _ in steps + above]]
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names
                )

    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if full:
        names, kinds = [*names, "siblings", "before"], [*kinds, pa.list_(pa.string()), pa.list_(pa.int32())]
        schema += ", siblings array<string>, before array<int>"
    return rows.select("nodes", "whole", "path", "subroot", "root").mapInArrow(check, schema)


def dataset_manifest(docs: DataFrame, altered: Column | None = None, text: Column | None = None, full: bool = False) -> DataFrame:
    """Proof of every row of ``docs`` (columns ``doc_id, source, lang, n_chars, text``; others are ignored).

    Nulls are values of their own. Rows that repeat a ``doc_id`` are leaves of their own, in the order
    of their digests. No rows make no tree and no root.
    """
    return prove(build_manifest(leaves_of(docs, altered, text)), full)
