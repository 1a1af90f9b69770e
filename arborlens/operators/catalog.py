"""Model catalogue: flatten, search and list with prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlens.functions import text

DOCUMENT = (
    "struct<data:array<struct<id:string,name:string,context_length:bigint,"
    "pricing:struct<prompt:string,completion:string>>>>"
)
LISTING_ROWS = 50
SORTS = ("context", "price", "name")


def flatten_catalog(documents: DataFrame, column: str = "json") -> DataFrame:
    """Catalogue documents to one row per model. Missing values become empty or 0."""
    parsed = documents.select(F.from_json(column, DOCUMENT).alias("doc"))
    models = parsed.select(F.explode("doc.data").alias("m"))

    def price(field: str) -> Column:
        return F.coalesce(F.col(f"m.pricing.{field}").try_cast("double"), F.lit(0.0))

    return models.select(
        F.coalesce("m.id", F.lit("")).alias("id"),
        F.coalesce("m.name", F.lit("")).alias("name"),
        F.coalesce("m.context_length", F.lit(0)).alias("context_length"),
        price("prompt").alias("prompt_price"),
        price("completion").alias("completion_price"),
    )


def search_catalog(catalog: DataFrame, wanted: str) -> DataFrame:
    """Models whose id or name holds the text, in any case."""
    wanted = wanted.lower()
    return catalog.where(F.lower("id").contains(wanted) | F.lower("name").contains(wanted))


def price_label(per_million: Column) -> Column:
    return F.when(per_million != 0, F.concat(F.lit("$"), text.fixed_point(per_million, 2))).otherwise("free")


def _labels(rows: DataFrame) -> DataFrame:
    context = F.col("context_length")
    prompt, completion = F.col("prompt_price") * 1_000_000, F.col("completion_price") * 1_000_000
    return rows.withColumns(
        {
            "context_label": F.when(context != 0, text.thousands(context)).otherwise("-"),
            "prompt_per_m": price_label(prompt),
            "completion_per_m": price_label(completion),
        }
    )


def sort_columns(sort: str) -> list[Column]:
    if sort == "context":
        return [F.desc("context_length"), F.col("id")]
    if sort == "price":
        return [F.col("prompt_price"), F.col("id")]
    return [F.col("id")]


def list_catalog(catalog: DataFrame, sort: str = "name", rows: int = LISTING_ROWS) -> DataFrame:
    """The first models by ``sort`` with labels, and how many more there are.

    A top-k: every task keeps its own best rows, so nothing is sorted as a whole.
    """
    top = catalog.orderBy(*sort_columns(sort)).limit(rows)
    total = catalog.agg(F.count(F.lit(1)).alias("total"))
    overflow = F.greatest(F.col("total") - rows, F.lit(0)).alias("overflow")
    # The window sees at most ``rows`` rows.
    place = F.row_number().over(Window.partitionBy("sort").orderBy(*sort_columns(sort)))
    ranked = top.withColumn("sort", F.lit(sort)).withColumn("rank", place.cast("bigint"))
    # One total joins at most ``rows`` rows.
    return (
        _labels(ranked)
        .join(F.broadcast(total.withColumn("sort", F.lit(sort))), "sort")
        .select("sort", "rank", "id", "context_label", "prompt_per_m", "completion_per_m", overflow)
    )
