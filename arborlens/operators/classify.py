"""Scan: which files count, and what is known about each without its neighbours.

Everything here is a projection or a filter. A scan of any size is one narrow stage, and the path
tests come before the content is looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens.functions import fixed, globs, paths, tokens
from arborlens.operators.ordering import number_rows

WORK_DIR = ".arborlens"


@dataclass(frozen=True)
class ScanRules:
    """What a scan leaves out. ``extra_exclude`` is added to the default globs."""

    extra_exclude: tuple[str, ...] = ()
    work_dir: str = WORK_DIR

    @property
    def excludes(self) -> tuple[str, ...]:
        return (*fixed.DEFAULT_EXCLUDES, f"**/{self.work_dir}/**", *self.extra_exclude)

    @property
    def pruned(self) -> tuple[str, ...]:
        """Folder names never entered: the fixed ones and those of ``**/name/**`` excludes."""
        named = [globs.folder_name(p) for p in self.excludes]
        return tuple(dict.fromkeys([*fixed.PRUNED_FOLDERS, self.work_dir, *filter(None, named)]))


def is_excluded(path: Column, rules: ScanRules = ScanRules()) -> Column:
    """Any exclude glob covers the path (``\\`` counts as ``/``)."""
    expression = globs.anchored([globs.exclude_body(p) for p in rules.excludes])
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike(expression)


def in_pruned_folder(path: Column, rules: ScanRules = ScanRules()) -> Column:
    """A folder above the file is never entered.

    That is so when its name is pruned, or when an exclude glob covers the probe ``<folder>/x``
    after all leading ``.`` and ``/`` characters are dropped from the probe.
    """
    names = "|".join(globs.exclude_body(name) for name in rules.pruned)
    by_name = path.rlike(rf"(?:\A|/)(?:{names})/")
    # ``**/name/**`` covers a probe exactly when a folder is called ``name``, or the top folder
    # is after its dots are dropped: no walk over the folders is needed for those.
    stripped = path.rlike(rf"\A[./]+(?:{names_of(rules)})/")
    probes = [p for p in rules.excludes if globs.may_match_probe(p) and not globs.folder_name(p)]
    if not probes:
        return by_name | stripped
    expression = globs.anchored([globs.exclude_body(p) for p in probes])
    probed = F.exists(
        F.filter(paths.folders(path), lambda folder: folder != ""),
        lambda folder: F.replace(
            F.regexp_replace(F.concat(folder, F.lit("/x")), r"\A[./]+", ""), F.lit("\\"), F.lit("/")
        ).rlike(expression),
    )
    return by_name | stripped | probed


def names_of(rules: ScanRules) -> str:
    """The names of ``**/name/**`` excludes as alternatives."""
    return "|".join(globs.exclude_body(n) for n in map(globs.folder_name, rules.excludes) if n)


def keep_scanned(files: DataFrame, rules: ScanRules = ScanRules()) -> DataFrame:
    """Drop binary, excluded and pruned files of ``files(path, ...)``."""
    path = F.col("path")
    return files.where(
        ~paths.is_binary(path) & ~is_excluded(path, rules) & ~in_pruned_folder(path, rules)
    )


def scan_files(
    files: DataFrame,
    rules: ScanRules = ScanRules(),
    token_counter: tokens.TokenCounter = tokens.estimate,
) -> DataFrame:
    """``files(project, path, content)`` to one row of facts for each file that counts."""
    path = F.col("path")
    known = keep_scanned(files, rules).withColumn("lang", paths.language(path))
    return known.select(
        "project",
        "path",
        "lang",
        token_counter(F.col("content")).alias("tokens"),
        F.length("content").cast("bigint").alias("chars"),
        paths.is_entrypoint(path, F.col("lang")).alias("is_entrypoint"),
        paths.group_key(path).alias("grp"),
    )


def doc_rank(path: Column) -> Column:
    """Position of the documentation pattern that finds the path, NULL for none."""
    rank = None
    for n, pattern in enumerate(fixed.DOC_PATTERNS):
        found = path.rlike(globs.tree_regex(pattern)) if "*" in pattern else path == pattern
        rank = F.when(found, n) if rank is None else rank.when(found, n)
    return rank


def find_docs(files: DataFrame) -> DataFrame:
    """Documentation files ``(project, rank, path, place)`` of ``files(project, path)``.

    They come in pattern order, by path within a pattern. Excludes do not apply.
    """
    rank = doc_rank(F.col("path"))
    found = files.select("project", "path", rank.alias("rank")).where("rank IS NOT NULL")
    return found.withColumn("place", F.struct("rank", paths.parts_key(F.col("path")).alias("parts")))


def walk_order(files: DataFrame) -> DataFrame:
    """Position of each file in a walk of its project."""
    keyed = files.select("project", "path", paths.walk_key(F.col("path")).alias("walk"))
    return number_rows(keyed, ["project"], ["walk"]).select("project", "pos", "path")
