"""Manifest: totals, language statistics, groups, the default sequence and the summary text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlens.functions import paths, text
from arborlens.operators.ordering import assemble, number_rows
from arborlens.session import hand_over

# Items of an enumeration per block of text, so that a list of any length stays assemblable.
ITEMS_PER_BLOCK = 50_000


def scan_totals(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("project").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum("tokens").alias("total_tokens"),
        F.sum("chars").alias("total_chars"),
    )


def language_stats(manifest: DataFrame) -> DataFrame:
    """Files and tokens by language, ranked by tokens; the language met first in a walk wins ties.

    Sums need no sort. Walk order is looked up for languages of equal tokens only.
    """
    known = manifest.where("lang IS NOT NULL")
    sums = hand_over(
        known.groupBy("project", "lang").agg(F.count(F.lit(1)).alias("files"), F.sum("tokens").alias("tokens")),
        "languages",
    )
    # One row per known language: a few dozen in a project.
    equal = Window.partitionBy("project", "tokens")
    tied = hand_over(sums.withColumn("_n", F.count(F.lit(1)).over(equal)).where("_n > 1").select("project", "lang"), "tied")
    # The first row of each language is cut out before rows are shuffled.
    in_walk = Window.partitionBy("project", "lang").orderBy("_met")
    walks = known.join(tied, ["project", "lang"], "left_semi").select(
        "project", "lang", paths.walk_key(F.col("path")).alias("_met")
    )
    first = walks.withColumn("_n", F.row_number().over(in_walk)).where("_n = 1").drop("_n")
    by_size = Window.partitionBy("project").orderBy(F.desc("tokens"), "_met")
    ranked = sums.join(first, ["project", "lang"], "left")
    return ranked.withColumn("rank", F.row_number().over(by_size).cast("bigint")).drop("_met")


def language_share(stats: DataFrame) -> DataFrame:
    """Whole percent of the tokens of known languages, and a label."""
    total = F.sum("tokens").over(Window.partitionBy("project"))
    whole = F.when(total == 0, F.lit(1)).otherwise(total)
    shares = stats.withColumn("_whole", whole)
    return shares.select("project", "lang", "rank", F.expr("tokens * 100 div _whole").alias("pct")).withColumn(
        "label", F.concat(F.initcap("lang"), F.lit(" ("), F.col("pct").cast("string"), F.lit("%)"))
    )


def entrypoints(manifest: DataFrame) -> DataFrame:
    return manifest.where("is_entrypoint").select("project", "path", "lang")


def entrypoint_list(manifest: DataFrame) -> DataFrame:
    """Entrypoints with their place in walk order."""
    found = entrypoints(manifest).select("project", "path", paths.walk_key(F.col("path")).alias("walk"))
    return number_rows(found, ["project"], ["walk"]).select("project", "pos", "path", "walk")


def group_files(manifest: DataFrame) -> DataFrame:
    """Files of each top folder, numbered by path."""
    return number_rows(manifest.select("project", "grp", "path"), ["project", "grp"], ["path"])


def sequence_leaves(manifest: DataFrame) -> DataFrame:
    """The default sequence as ordered leaves.

    ``(major, minor)`` places a leaf: entrypoints in walk order, then a group per top folder by
    name. ``by_path`` says that files within one place are ordered by path. ``chars`` comes along.
    """
    walk = paths.walk_key(F.col("path"))
    entry = F.col("is_entrypoint")
    return manifest.select(
        "project",
        F.array(F.when(entry, 0).otherwise(1).cast("bigint")).alias("major"),
        F.when(entry, walk).otherwise(F.col("grp")).alias("minor"),
        (~entry).alias("by_path"),
        "path",
        "chars",
    )


def default_sequence(manifest: DataFrame) -> DataFrame:
    """Position and section of each file in the default sequence."""
    leaves = sequence_leaves(manifest).withColumn(
        "section", F.when(F.col("by_path"), F.col("minor")).otherwise(F.lit("entrypoints"))
    )
    numbered = number_rows(leaves.drop("by_path", "chars"), ["project"], ["major", "minor", "path"])
    return numbered.select("project", "pos", "section", "path")


def enumeration(items: DataFrame, head: Column) -> DataFrame:
    """Lines of the form ``head a, b, c`` as pieces ``(project, block, item, text)``.

    ``items(project, pos, path)`` may be long, so every name is a piece of its own.
    """
    glue = F.when(F.col("pos") == 0, head).otherwise(F.lit(", "))
    return items.select(
        "project",
        F.expr(f"pos div {ITEMS_PER_BLOCK}").alias("block"),
        F.col("pos").alias("item"),
        F.concat(glue, "path").alias("text"),
    )


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """Summary text of each project in blocks ``(project, section, block, text)``.

    Section 0 holds sizes and languages, section 1 the list of entrypoints.
    """
    totals = manifest.groupBy("project").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum("tokens").alias("total_tokens"),
        F.count_if("is_entrypoint").alias("n_entrypoints"),
    )
    names = language_stats(manifest).groupBy("project").agg(
        F.expr("listagg(lang, ', ') WITHIN GROUP (ORDER BY rank)").alias("names")
    )
    facts = totals.join(names, "project", "left")
    lines = F.concat(
        F.lit("- Files: "), F.col("total_files").cast("string"),
        F.lit("\n- Tokens: ~"), text.thousands(F.col("total_tokens")),
        F.lit("\n- Languages: "), F.coalesce("names", F.lit("")),
        F.lit("\n- Entrypoints: "), F.when(F.col("n_entrypoints") == 0, "none detected").otherwise(""),
    )
    zero = F.lit(0).cast("bigint")
    head = facts.select("project", F.lit(0).alias("section"), zero.alias("block"), lines.alias("text"))
    pieces = enumeration(entrypoint_list(manifest), F.lit(""))
    listed = assemble(pieces, ["project", "block"]).select(
        "project", F.lit(1).alias("section"), "block", "text"
    )
    return head.unionByName(listed)
