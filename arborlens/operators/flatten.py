"""Flat snapshot of a project: header, file tree, documentation and cleaned sources, in order.

The snapshot is a table of parts ``(project, section, block, item, text)``. The flat text is the
plain concatenation of the parts in that order; a block is bounded in size, so blocks can be put
together (``flat_blocks``) even where a project is far larger than one row may be. Every part ends
its lines itself, hence no separator has to be known between parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens.functions import fixed, paths, text, tokens
from arborlens.operators import classify
from arborlens.operators import manifest as mf
from arborlens.operators.ordering import assemble
from arborlens.operators.sequence import UNKNOWN_CHARS
from arborlens.session import hand_over

HEADER, ENTRYPOINTS, TREE, DOCS, SOURCE = range(5)
PART = ["project", "section", "block", "item", "text"]

# The line above a text of documentation, as a separator.
DOCS_LINE = "--- {filepath} [tokens: ~{tokens}, chars: {chars}] ---"


@dataclass(frozen=True)
class SnapshotOptions:
    """Settings of one flatten job. ``None`` leaves the value stored for the project."""

    generated: str = ""
    title: str = "CODEBASE SNAPSHOT"
    strip_comments: bool | None = None
    include_docs: bool | None = None
    block_chars: int = UNKNOWN_CHARS


def default_projects(manifest: DataFrame) -> DataFrame:
    """Stored settings with their default values, one row per scanned project."""
    return manifest.select("project").distinct().select(
        "project",
        F.col("project").alias("root"),
        F.lit(True).alias("strip_comments"),
        F.lit("aggressive").alias("whitespace"),
        F.lit(True).alias("include_docs"),
        F.lit("unverified").alias("trust_level"),
        F.lit(True).alias("file_tree"),
        F.lit(fixed.SEPARATOR).alias("separator"),
    )


def separator_line(template: Column, path: Column, count: Column, chars: Column, lang: Column) -> Column:
    """Fill ``{filepath} {tokens} {chars} {lang}`` in one pass; ``{{`` and ``}}`` are braces."""
    pieces = F.regexp_extract_all(template, F.lit(r"(\{\{|\}\}|\{[^{}]*\}|[^{}]+|[{}])"), F.lit(1))

    def fill(piece: Column) -> Column:
        unknown = F.raise_error(F.concat(F.lit("unknown separator field: "), piece))
        return (
            F.when(piece == "{filepath}", path)
            .when(piece == "{tokens}", text.thousands(count))
            .when(piece == "{chars}", text.thousands(chars))
            .when(piece == "{lang}", F.coalesce(lang, F.lit("text")))
            .when(piece == "{{", F.lit("{"))
            .when(piece == "}}", F.lit("}"))
            .when(piece.rlike(r"\A[{}]"), unknown.cast("string"))
            .otherwise(piece)
        )

    return F.array_join(F.transform(pieces, fill), "")


def clean_files(
    files: DataFrame, token_counter: tokens.TokenCounter = tokens.estimate
) -> DataFrame:
    """Clean ``files(project, path, content, strip_comments, whitespace, separator, ...)``.

    Adds ``lang``, ``content`` (cleaned), ``tokens``, ``chars`` and ``line`` (the separator).
    """
    lang = F.col("lang")
    stripped = F.when(F.col("strip_comments"), text.strip_comments(F.col("content"), lang)).otherwise(
        F.col("content")
    )
    return (
        files.withColumn("lang", paths.language(F.col("path")))
        .withColumn("content", stripped)
        .withColumn("content", text.collapse_whitespace(F.col("content"), F.col("whitespace")))
        .withColumns(
            {"tokens": token_counter(F.col("content")), "chars": F.length("content").cast("bigint")}
        )
        .withColumn(
            "line",
            separator_line(F.col("separator"), F.col("path"), F.col("tokens"), F.col("chars"), lang),
        )
    )


def file_tree(positions: DataFrame) -> DataFrame:
    """One indented line per file, in sequence order."""
    return positions.select("project", "pos", paths.tree_line(F.col("path")).alias("line"))


def _header(manifest: DataFrame, positions: DataFrame, projects: DataFrame, options: SnapshotOptions):
    shares = (
        mf.language_share(mf.language_stats(manifest))
        .groupBy("project")
        .agg(F.expr("listagg(label, ', ') WITHIN GROUP (ORDER BY rank)").alias("languages"))
    )
    listed = positions.groupBy("project").agg(F.count(F.lit(1)).alias("n_files"))
    facts = (
        projects.select("project", "root")
        .join(mf.scan_totals(manifest), "project", "left")
        .join(listed, "project", "left")
        .join(shares, "project", "left")
        .na.fill(0, ["n_files", "total_tokens", "total_chars"])
    )
    lines = F.array(
        F.lit(f"═══ {options.title} ═══"),
        F.lit(f"generated: {options.generated}"),
        F.concat(F.lit("root: "), "root"),
        F.concat(F.lit("total_files: "), F.col("n_files").cast("string")),
        F.concat(F.lit("total_tokens: ~"), text.thousands(F.col("total_tokens"))),
        F.concat(F.lit("total_chars: "), text.thousands(F.col("total_chars"))),
        F.concat(F.lit("languages: "), "languages"),
    )
    return facts.select("project", F.posexplode(F.array_compact(lines)).alias("n", "line")).select(
        "project",
        F.lit(HEADER).alias("section"),
        F.lit(0).cast("bigint").alias("block"),
        F.col("n").cast("bigint").alias("item"),
        F.concat("line", F.lit("\n")).alias("text"),
    )


def _entrypoints(manifest: DataFrame) -> DataFrame:
    """The line of entrypoints in pieces; the last piece ends the line."""
    items = mf.entrypoint_list(manifest)
    last = items.groupBy("project").agg(F.max("pos").alias("item"), F.lit("\n").alias("stop"))
    pieces = mf.enumeration(items, F.lit("entrypoints: "))
    return pieces.join(last, ["project", "item"], "left").select(
        "project",
        F.lit(ENTRYPOINTS).alias("section"),
        "block",
        "item",
        F.concat("text", F.coalesce("stop", F.lit(""))).alias("text"),
    )


def _title(projects: DataFrame, section: int, lines: Column) -> DataFrame:
    """Opening part of a section; it comes before item 0 and starts with an empty line."""
    return projects.select(
        "project",
        F.lit(section).alias("section"),
        F.lit(0).cast("bigint").alias("block"),
        F.lit(-1).cast("bigint").alias("item"),
        F.concat(F.lit("\n"), lines, F.lit("\n")).alias("text"),
    )


def _tree(positions: DataFrame, projects: DataFrame) -> DataFrame:
    shown = projects.where("file_tree")
    lines = file_tree(positions).join(shown.select("project"), "project", "left_semi")
    body = lines.select(
        "project",
        F.lit(TREE).alias("section"),
        F.expr(f"pos div {mf.ITEMS_PER_BLOCK}").alias("block"),
        F.col("pos").alias("item"),
        F.concat("line", F.lit("\n")).alias("text"),
    )
    empty = shown.join(positions.select("project").distinct(), "project", "left_anti").select(
        "project",
        F.lit(TREE).alias("section"),
        F.lit(0).cast("bigint").alias("block"),
        F.lit(0).cast("bigint").alias("item"),
        F.lit("\n").alias("text"),
    )
    return _title(shown, TREE, F.lit(fixed.TREE_TITLE)).unionByName(body).unionByName(empty)


def _placed(order: DataFrame, block_chars: int) -> DataFrame:
    """Cut an order ``(project, pos, path, before)`` into blocks by the raw size of earlier files.

    Cleaning only shortens a text, so raw sizes bound a block. Blocks are known before any text is
    shuffled.
    """
    block = F.expr(f"before div {block_chars}").alias("block")
    return order.select("project", "path", block, F.col("pos").alias("item"))


def _bodies(placed: DataFrame, files: DataFrame, token_counter: tokens.TokenCounter) -> DataFrame:
    """Line and cleaned text of each file of ``placed(project, path, section, block, item, …settings)``."""
    cleaned = clean_files(placed.join(files, ["project", "path"]), token_counter)
    text_ = F.concat(F.lit("\n"), "line", F.lit("\n"), "content", F.lit("\n")).alias("text")
    return cleaned.select("project", "section", "block", "item", text_)


def _place_docs(docs: DataFrame, projects: DataFrame, block_chars: int) -> DataFrame:
    """Places of documentation, with settings that leave the texts as they are."""
    shown = projects.where("include_docs").select("project")
    return _placed(docs.join(shown, "project", "left_semi"), block_chars).withColumns(
        {
            "section": F.lit(DOCS),
            "strip_comments": F.lit(False),
            "whitespace": F.lit("none"),
            "separator": F.lit(DOCS_LINE),
        }
    )


def _place_sources(positions: DataFrame, projects: DataFrame, block_chars: int) -> DataFrame:
    settings = projects.select("project", "strip_comments", "whitespace", "separator")
    return _placed(positions, block_chars).join(settings, "project").withColumn("section", F.lit(SOURCE))


def _docs_title(docs: DataFrame, projects: DataFrame) -> DataFrame:
    shown = projects.where("include_docs").join(docs.select("project").distinct(), "project", "left_semi")
    title = F.when(F.col("trust_level") == "unverified", "\n".join(fixed.DOCS_TITLE_UNVERIFIED))
    return _title(shown, DOCS, title.otherwise(fixed.DOCS_TITLE_TRUSTED))


def _source_title(projects: DataFrame) -> DataFrame:
    """The empty line after the title belongs to the first file; an empty project has none."""
    return _title(projects, SOURCE, F.lit(fixed.SOURCE_TITLE))


def flat_docs(
    docs: DataFrame,
    files: DataFrame,
    projects: DataFrame,
    block_chars: int = SnapshotOptions.block_chars,
    token_counter: tokens.TokenCounter = tokens.estimate,
) -> DataFrame:
    """Documentation section. The texts are taken as they are. ``docs`` is an order of
    files that documentation patterns find."""
    # Documentation is a small part of the files, so other texts are not shuffled to be matched.
    texts = files.where(classify.doc_rank(F.col("path")).isNotNull())
    body = _bodies(_place_docs(docs, projects, block_chars), texts, token_counter)
    return _docs_title(docs, projects).unionByName(body)


def flat_sources(
    positions: DataFrame,
    files: DataFrame,
    projects: DataFrame,
    block_chars: int = SnapshotOptions.block_chars,
    token_counter: tokens.TokenCounter = tokens.estimate,
) -> DataFrame:
    """Source section: separator and cleaned text of each file."""
    body = _bodies(_place_sources(positions, projects, block_chars), files, token_counter)
    return _source_title(projects).unionByName(body)


def flat_header(
    manifest: DataFrame, positions: DataFrame, projects: DataFrame, options: SnapshotOptions
) -> DataFrame:
    """Header section with the line of entrypoints."""
    return _header(manifest, positions, projects, options).unionByName(_entrypoints(manifest))


def flat_parts(
    manifest: DataFrame,
    files: DataFrame,
    positions: DataFrame,
    docs: DataFrame,
    projects: DataFrame,
    options: SnapshotOptions = SnapshotOptions(),
    token_counter: tokens.TokenCounter = tokens.estimate,
) -> DataFrame:
    """All parts of all snapshots. ``positions`` and ``docs`` are orders
    ``(project, pos, path, before)`` of sources and documentation. Arguments given in ``options`` win over stored settings."""
    projects = projects.withColumns(
        {
            "strip_comments": F.coalesce(F.lit(options.strip_comments), "strip_comments"),
            "include_docs": F.coalesce(F.lit(options.include_docs), "include_docs"),
        }
    )
    size = options.block_chars
    # Sources and documentation meet the texts in one join: a text is shuffled to its places once, or not
    # at all where ``files`` is bucketed by project and path.
    placed = _place_docs(docs, projects, size).unionByName(_place_sources(positions, projects, size))
    fronts = [
        _header(manifest, positions, projects, options),
        _entrypoints(manifest),
        _tree(positions, projects),
        _docs_title(docs, projects).unionByName(_source_title(projects)),
    ]
    parts = _bodies(placed, files, token_counter).select(*PART)
    # What stands before the texts is written first, in small jobs: one plan of everything takes the driver too much memory.
    for front in fronts:
        parts = parts.unionByName(hand_over(front.select(*PART), "front"))
    return parts


def flat_blocks(parts: DataFrame) -> DataFrame:
    """Blocks of the flat text: ``(project, section, block, text)``."""
    return assemble(parts, ["project", "section", "block"])
