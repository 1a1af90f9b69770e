"""Writing: tables by run, bucketed source files, flat texts, responses as JSON and as text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from arborlens.operators import runs
from arborlens.sources.flattext import FlatTextSource


def write_table(rows: DataFrame, path: str, mode: str = "overwrite", by: tuple[str, ...] = ()) -> None:
    """A Parquet table. ``by`` names partition columns: their rows are brought together first, and
    adaptive execution splits those that are large."""
    if by:
        rows = rows.hint("rebalance", *by)
    rows.write.mode(mode).partitionBy(*by).parquet(path)


def write_source_table(files: DataFrame, table: str, buckets: int | None = None, path: str | None = None) -> None:
    """Source files as a table bucketed by project and path, so that joins on them leave the texts in place.

    Buckets hash the path as well, so a project of any size is spread over all of them. Without
    ``buckets`` there are as many as shuffle partitions, which makes the other side of a join follow the buckets. The
    rows are brought together first: a bucket is one file. ``path`` puts the table elsewhere than the warehouse.
    """
    buckets = buckets or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ("project", "path")
    dealt = files.repartition(buckets, *keys)
    dealt.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table, path=path)


def write_flat_text(blocks: DataFrame, path: str) -> None:
    """Flat texts as text files under ``project=<name>``; see ``flattext.py``.

    Blocks are range-partitioned, so a large project becomes several files; read in name order they
    are its text, byte for byte, wherever its blocks end.
    """
    blocks.sparkSession.dataSource.register(FlatTextSource)
    order = ["project", "section", "block"]
    sorted_ = blocks.select(*order, "text").repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_.write.format("flattext").mode("overwrite").save(path)


def write_responses(responses: DataFrame, path: str, mode: str = "append") -> None:
    """Responses of every status, by run: key, JSON document and text side by side."""
    rows = runs.response_json(responses, keep=("raw_response",))
    write_table(rows, path, mode, ("run_id",))


def write_comparisons(comparisons: DataFrame, path: str) -> None:
    """Comparison texts by run; those of a run that was compared before are replaced."""
    rows = comparisons.hint("rebalance", "run_id").write.mode("overwrite")
    rows.option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
