"""Files that reviews mention, resolved to files of the project.

A review writes ``b.py``, ``a/b.py`` or ``./src/a/b.py:12`` for one file. The ends of all paths at their
slashes are an index, so a mention meets the files that end in it by an equi-join. The index holds one row for
each end with the number of files, not the files, so a name that very many files bear is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_mention(mention: Column) -> Column:
    """The path in a mention: no quotes, no place in the file (``:12``, ``:3-9``, ``#L4``), no ``./`` or ``/`` before it."""
    path = F.replace(F.regexp_replace(mention, r"\A[\s`'\"]+|[\s`'\"]+\z", ""), F.lit("\\"), F.lit("/"))
    path = F.regexp_replace(path, r"(:[0-9]+(-[0-9]+)?(:[0-9]+)?|#L[0-9]+(-L?[0-9]+)?)\z", "")
    return F.regexp_replace(path, r"\A(\.?/)+", "")


def ends(path: Column) -> Column:
    """A path and every end of it that begins after a slash."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))


def resolve_mentions(mentions: DataFrame, files: DataFrame) -> DataFrame:
    """``mentions(project, mention, ...)`` with ``status``, ``path`` and ``n_files``.

    ``exact``: a file has this path. ``unique``: one file ends in it. ``ambiguous``: ``n_files`` do, and
    ``path`` is NULL. ``unknown``: none does. The whole path wins over files that end in it.
    """
    asked = mentions.withColumn("_end", clean_mention(F.col("mention")))
    # Only ends whose last name is mentioned are kept.
    name = F.regexp_extract("_end", r"([^/]*)\z", 1).alias("_name")
    wanted = asked.select("project", name).distinct()
    near = files.select("project", "path", F.regexp_extract("path", r"([^/]*)\z", 1).alias("_name")).join(wanted, ["project", "_name"], "left_semi")
    index = near.select("project", "path", F.explode(ends(F.col("path"))).alias("_end")).groupBy("project", "_end").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.min("path").alias("_first"),
        F.max(F.col("path") == F.col("_end")).alias("_whole"),
    )
    whole = F.coalesce("_whole", F.lit(False))
    status = F.when(whole, "exact").when(F.col("n_files") == 1, "unique").when(F.col("n_files") > 1, "ambiguous").otherwise("unknown")
    path = F.when(whole, F.col("_end")).when(F.col("n_files") == 1, F.col("_first"))
    found = asked.join(index, ["project", "_end"], "left")
    return found.select(*mentions.columns, status.alias("status"), path.alias("path"), F.coalesce("n_files", F.lit(0)).alias("n_files"))


def mentioned_files(mentions: DataFrame, files: DataFrame) -> DataFrame:
    """``(run_id, path, n_models)``: models of a run that mean the same file, however they write it.

    ``mentions(run_id, project, model, mention)``; mentions that are no one file are left out.
    """
    meant = resolve_mentions(mentions, files).where("path IS NOT NULL")
    return meant.groupBy("run_id", "path").agg(F.count_distinct("model").alias("n_models"))
