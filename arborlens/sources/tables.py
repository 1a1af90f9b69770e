"""Reading: code trees as text, manifest tables, runs and catalogues."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens import schemas
from arborlens.functions import paths, text
from arborlens.session import hand_over
from arborlens.sources.tree import Piece, TreeReader


#: Content that one task reads, about.
TASK_BYTES = 128 * 1024 * 1024
#: Files that one task lists before it hands back the folders it has not opened.
LIST_FILES = 20_000


def list_tree(reader: TreeReader, spark: SparkSession, budget: int = LIST_FILES) -> DataFrame:
    """``(project, path, size)`` of every file of a tree.

    The folders are dealt to tasks. A task lists until it has seen ``budget`` files and hands back the
    folders it has not opened; these are dealt out again. So a project of any size is listed by as
    many tasks as its files ask for, wherever in the tree they lie.
    """
    pieces = [(p.project, p.folder, p.deep, p.share, p.shares) for p in reader.partitions()]
    tasks = spark.sparkContext.defaultParallelism
    schema = "project string, path string, size bigint, deep boolean, share int, shares int"
    open_ = spark.createDataFrame(pieces, "project string, path string, deep boolean, share int, shares int")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from reader.listed((Piece(*row.values()) for row in batch.to_pylist()), budget)

    found = None
    while True:
        rows = hand_over(open_.repartition(tasks).mapInArrow(walk, schema), "listing")
        files = rows.where("size IS NOT NULL").select("project", "path", "size")
        found = files if found is None else found.unionByName(files)
        open_ = rows.where("size IS NULL").drop("size")
        if open_.isEmpty():
            return found


def read_tree(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """``source_files(project, path, content)`` of a tree, decoded to text.

    The tree is listed first. Its files are then dealt to tasks by a hash, as many as the listed sizes
    ask for, so neither a project nor a folder is a task of its own. ``options`` are those of
    ``codetree``; ``only`` and ``under`` name the projects and the path prefix that are listed at all.
    """
    reader = TreeReader({**options, "path": root})
    listing = list_tree(reader, spark)
    total = listing.agg(F.sum("size")).first()[0] or 0
    tasks = max(total // TASK_BYTES + 1, spark.sparkContext.defaultParallelism)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from reader.contents(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))

    dealt = listing.select("project", "path").repartition(tasks, "project", "path")
    raw = dealt.mapInArrow(read, "project string, path string, content binary")
    return raw.withColumn("content", text.decode(F.col("content")))


def read_flat_text(spark: SparkSession, path: str) -> DataFrame:
    """``(project, part, text)`` of texts that ``sinks.write_flat_text`` wrote: joined by ``part`` they are the text."""
    # With the type given, a project named 01 is not read as a number.
    schema = "path string, modificationTime timestamp, length bigint, content binary, project string"
    files = spark.read.schema(schema).format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    number = F.regexp_extract("path", r"/part-([0-9]+)-([0-9]+)\.txt$", 1).cast("long") * 1_000_000
    number += F.regexp_extract("path", r"/part-([0-9]+)-([0-9]+)\.txt$", 2).cast("long")
    return files.select("project", number.alias("part"), F.col("content").cast("string").alias("text"))


def read_table(spark: SparkSession, path: str, schema: str, format: str = "parquet") -> DataFrame:
    """A table of this library from Parquet or JSON, with defaults filled and values checked."""
    return schemas.validated(spark.read.schema(schema).format(format).load(path), schema)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue documents, one JSON document per file, as a ``json`` column."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "json")


def read_consultations(spark: SparkSession, root: str) -> DataFrame:
    """Consultation files ``<run>/<model key>.md`` as ``(run_id, model, raw_response)``.

    Read as a tree: the text source leaves out empty files, which failed models leave behind.
    """
    files = read_tree(spark, root, projects="true").where(F.col("path").rlike(r"\A[^/]+\.md\z"))
    key = F.regexp_replace("path", r"\.md\z", "")
    return files.select(
        F.col("project").alias("run_id"),
        paths.model_from_key(key).alias("model"),
        F.col("content").alias("raw_response"),
    )
