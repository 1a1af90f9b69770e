"""Positions and running totals within a key, without one task per key.

A window over ``(project ORDER BY path)`` puts a whole project into one task, and one project may
hold a third of all rows. Here the rows are range-partitioned on (key, order), so a large key is
spread over many tasks; each row is numbered inside its own task, and the few totals per task are
then added up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlens.session import hand_over


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    out: str = "pos",
    running: dict[str, str] | None = None,
) -> DataFrame:
    """Add ``out``, the 0-based position of each row in its key.

    ``running`` maps a new column to a number column: its sum over the earlier rows of the key.
    (keys, order) must identify a row. The placement is written down, because the range bounds are
    sampled and a second evaluation may draw others; so pass the narrow columns only.
    """
    running = running or {}
    keys = list(keys)
    slots = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    placed = hand_over(slots, "slots").withColumn("_task", F.shiftright("_slot", 33))
    totals = placed.groupBy(*keys, "_task").agg(
        F.min("_slot").alias("_first"),
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(column).alias(f"_sum_{name}") for name, column in running.items()],
    )
    # At most one row per task and key: a key has no more rows here than there are tasks.
    earlier = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_task",
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        *[
            F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_base_{name}")
            for name in running
        ],
    )
    joined = placed.join(offsets, [*keys, "_task"]).withColumn(out, F.col("_slot") + F.col("_shift"))
    if running:
        within = (
            Window.partitionBy(*keys, "_task")
            .orderBy("_slot")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        joined = joined.withColumns(
            {
                name: F.coalesce(F.sum(column).over(within), F.lit(0)) + F.col(f"_base_{name}")
                for name, column in running.items()
            }
        )
    return joined.select(*df.columns, out, *running)


def assemble(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Concatenate ``text`` in ``item`` order within ``keys``, which must name blocks of bounded size."""
    return parts.groupBy(*keys).agg(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY item)").alias("text"))
