"""Curated sequences: an ordered tree of groups and leaves, resolved to a list of files.

``nodes(project, node_id, parent_id, pos, path, name, ord)``: a node with a path is a leaf (a file
or a glob), a node with a name and children is a group, anything else is ignored. ``ord`` is
``alphabetical`` for groups whose files are sorted by path, however deep they lie.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from arborlens.functions import globs, paths
from arborlens.operators.ordering import number_rows
from arborlens.session import hand_over

LEAF = ["project", "major", "minor", "by_path", "path"]

# A tree deeper than this is taken for one whose nodes repeat an id and name each other; the job then fails.
MOST_LEVELS = 10_000

_TREE = """
WITH RECURSIVE tree AS (
  SELECT project, node_id, path, name, ord, array(pos) AS major, false AS by_path FROM {nodes} WHERE parent_id IS NULL
  UNION ALL
  SELECT n.project, n.node_id, n.path, n.name, n.ord,
         CASE WHEN g.by_path OR g.ord = 'alphabetical' THEN g.major ELSE concat(g.major, array(n.pos)) END,
         g.by_path OR g.ord = 'alphabetical'
  FROM tree g JOIN {nodes} n ON n.project = g.project AND n.parent_id = g.node_id
  WHERE g.path IS NULL AND g.name IS NOT NULL
)
SELECT project, major, '' AS minor, by_path, path FROM tree WHERE path IS NOT NULL
"""


def tree_leaves(nodes: DataFrame) -> DataFrame:
    """Leaves in depth-first order, by one recursive query for trees of any depth.

    ``major`` is the list of sibling positions down to the leaf, or down to the outermost
    alphabetical group above it; ``by_path`` tells which. The nodes are written once, so a level does
    not work them out again; Spark's own limit of rows is lifted while the leaves are found.
    """
    spark = nodes.sparkSession
    narrow = nodes.select(
        "project", "node_id", "parent_id", F.col("pos").cast("bigint").alias("pos"),
        paths.normalise(F.col("path")).alias("path"), "name", F.coalesce("ord", F.lit("")).alias("ord"),
    )
    limits = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": str(MOST_LEVELS)}
    before = {name: spark.conf.get(name) for name in limits}
    try:
        for name, value in limits.items():
            spark.conf.set(name, value)
        return hand_over(spark.sql(_TREE, nodes=hand_over(narrow, "nodes")), "leaves")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def is_glob(path: Column) -> Column:
    return path.rlike(r"[*?\[]")


_SHAPE = (
    StructType()
    .add("_depth", IntegerType())
    .add("_length", IntegerType())
    .add("_head", StringType())
    .add("_tail", StringType())
    .add("_regex", StringType())
)


@F.pandas_udf(_SHAPE)
def _shape(patterns: pd.Series) -> pd.DataFrame:
    rows = [(*globs.tree_shape(p), globs.tree_regex(p)) for p in patterns]
    return pd.DataFrame(rows, columns=_SHAPE.names)


def glob_files(leaves: DataFrame, files: DataFrame) -> DataFrame:
    """Files of glob leaves, joined on depth, length and the literal head and tail of the glob.

    The matches of a glob agree in the text before its first and after its last wildcard, without
    ``**`` in depth, and without ``*`` in length. A project has few combinations of such sizes, so a
    file is offered once for each that fits it, its own head and tail cut to size. A bracket in a
    file name, where one character is wild, thus meets only the names that differ in that one. The
    test of the glob follows the equi-join.
    """
    path = F.col("path")
    size = ["project", "_depth", "_length", "_head_chars", "_tail_chars"]
    patterns = (
        leaves.where(is_glob(path))
        .select("project", "major", "minor", "by_path", path.alias("_glob"), _shape(path).alias("_s"))
        .select("*", "_s.*")
        .drop("_s")
        .withColumns({"_head_chars": F.length("_head"), "_tail_chars": F.length("_tail")})
    )
    known = [(paths.depth(path), F.length(path)), (paths.depth(path), F.lit(-1)), (F.lit(-1), F.lit(-1))]
    fits = F.array(*[F.struct(d.alias("_depth"), n.alias("_length")) for d, n in known])
    offers = (
        files.select("project", "path")
        .join(patterns.select("project").distinct(), "project", "left_semi")
        .select("project", "path", F.inline(fits))
        .join(patterns.select(*size).distinct(), ["project", "_depth", "_length"])
        .withColumns({"_head": F.left("path", "_head_chars"), "_tail": F.right("path", "_tail_chars")})
    )
    matched = offers.join(patterns, [*size, "_head", "_tail"]).where(F.expr("path RLIKE _regex"))
    return matched.select(*LEAF, "_glob")


def placed(rows: DataFrame) -> DataFrame:
    """``(project, path, place)``: the place of a file in the order of its leaf."""
    path = F.col("path")
    tie = F.when(F.col("by_path"), path).otherwise(paths.parts_key(path)).alias("tie")
    return rows.withColumn("place", F.struct("major", "minor", tie)).drop("major", "minor", "by_path")


def leaf_files(leaves: DataFrame, files: DataFrame) -> DataFrame:
    """Replace each leaf by its files: ``(project, path, place)``.

    Missing files are left out, globs may give any number.
    """
    plain = leaves.where(~is_glob(F.col("path"))).join(
        files.select("project", "path"), ["project", "path"], "left_semi"
    )
    return placed(plain.select(*LEAF).unionByName(glob_files(leaves, files).select(*LEAF)))


# What a file of unknown size counts for: as much as a whole block of a snapshot.
UNKNOWN_CHARS = 8_000_000


def add_sizes(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Add ``chars`` from ``sizes(project, path, chars)``, usually the manifest.

    The sizes a scan has found spare another reading of the texts. They only serve to cut blocks,
    so a file that was not scanned counts for a whole block.
    """
    known = rows.join(sizes.select("project", "path", "chars"), ["project", "path"], "left")
    return known.withColumn("chars", F.coalesce("chars", F.lit(UNKNOWN_CHARS)))


def number_files(found: DataFrame) -> DataFrame:
    """Keep the first place of each file and number the files: ``(project, pos, path)``.

    If ``found`` has ``chars``, also ``before``, the characters of all earlier files.
    """
    sized = "chars" in found.columns
    sizes = [F.max("chars").alias("chars")] if sized else []
    first = found.groupBy("project", "path").agg(F.min("place").alias("place"), *sizes)
    running = {"before": "chars"} if sized else {}
    numbered = number_rows(first, ["project"], ["place"], running=running)
    return numbered.select("project", "pos", "path", *running)


def resolve_sequence(nodes: DataFrame, files: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Files of a curated sequence, each once, in order; with ``before`` if ``sizes`` are given."""
    found = leaf_files(tree_leaves(nodes), files)
    return number_files(add_sizes(found, sizes) if sizes is not None else found)


def default_positions(leaves: DataFrame, files: DataFrame) -> DataFrame:
    """Files of the default sequence: ``(project, pos, path, before)``.

    ``leaves`` are those of a manifest and have ``chars``, so its files need not be looked up. A
    leaf whose name holds ``*``, ``?`` or ``[`` counts as a glob here, as in any sequence.
    """
    plain = leaves.where(~is_glob(F.col("path")))
    globbed = placed(glob_files(leaves, files).select(*LEAF))
    return number_files(placed(plain).unionByName(add_sizes(globbed, leaves)))
