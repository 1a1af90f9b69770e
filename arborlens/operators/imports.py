"""Import graph: specifiers in the text, resolved to files of the same project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens.functions import fixed, paths


def import_specs(content: Column, lang: Column) -> Column:
    """Import specifiers: pattern by pattern, in text order, repeats kept."""
    result = None
    for language, patterns in fixed.IMPORT_PATTERNS:
        found = F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in patterns])
        condition = lang == language
        result = F.when(condition, found) if result is None else result.when(condition, found)
    return result


def extract_imports(files: DataFrame) -> DataFrame:
    """``files(project, path, content)`` to ``(project, path, pos, spec)``."""
    lang = paths.language(F.col("path"))
    known = files.select("project", "path", "content", lang.alias("lang")).where(
        F.col("lang").isin(*[language for language, _ in fixed.IMPORT_PATTERNS])
    )
    specs = import_specs(F.col("content"), F.col("lang"))
    return known.select("project", "path", F.posexplode(specs).alias("pos", "spec")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


def candidates(spec: Column, source: Column) -> Column:
    """Files a specifier may mean, best first.

    A leading dot makes it relative to the folder of the source; a path that leaves the root means
    nothing. A specifier with a dot and no slash may be a dotted module name as well.
    """
    relative = spec.startswith(".")
    base = paths.normalise(F.concat(paths.parent(source), F.lit("/"), spec))
    dotted = F.contains(spec, F.lit(".")) & ~F.contains(spec, F.lit("/"))
    module = F.replace(spec, F.lit("."), F.lit("/"))
    none = F.array().cast("array<string>")
    near = F.when(relative, F.array(*[F.concat(base, F.lit(end)) for end in fixed.RELATIVE_ENDINGS]))
    far = F.when(dotted, F.array(*[F.concat(module, F.lit(end)) for end in fixed.DOTTED_ENDINGS]))
    both = F.concat(F.coalesce(near, none), F.coalesce(far, none))
    return F.when(relative & base.isNull(), none).otherwise(both)


def import_edges(specs: DataFrame, files: DataFrame) -> DataFrame:
    """Edges ``(project, src, dst, n)``; ``n`` counts the specifiers that mean the same file.

    A source usually repeats few specifiers, but many sources share the same ones. Repeats within a
    source are counted before the candidates are spread and joined.
    """
    counted = specs.groupBy("project", F.col("path").alias("src"), "spec").agg(
        F.count(F.lit(1)).alias("n")
    )
    meant = candidates(F.col("spec"), F.col("src"))
    spread = counted.select("project", "src", "spec", "n", F.posexplode(meant).alias("rank", "path"))
    found = spread.join(files.select("project", "path"), ["project", "path"])
    # Only the rank is aggregated, which stays a hash aggregate; the file follows from it.
    best = found.groupBy("project", "src", "spec", "n").agg(F.min("rank").alias("rank"))
    first = best.withColumn("dst", F.get(meant, F.col("rank")))
    return first.where("dst <> src").groupBy("project", "src", "dst").agg(F.sum("n").alias("n"))


def dependency_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Files a file imports and files that import it, repeats counted."""
    out = edges.select("project", F.col("src").alias("path"), F.col("n").alias("imports"), F.lit(0).alias("importers"))
    into = edges.select("project", F.col("dst").alias("path"), F.lit(0).alias("imports"), F.col("n").alias("importers"))
    zero = nodes.select("project", "path", F.lit(0).alias("imports"), F.lit(0).alias("importers"))
    return (
        zero.unionByName(out)
        .unionByName(into)
        .groupBy("project", "path")
        .agg(F.sum("imports").alias("imports"), F.sum("importers").alias("importers"))
    )
