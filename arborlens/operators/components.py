"""Weakly connected components of many graphs at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.session import hand_over


def connected_components(edges: DataFrame, keys: Sequence[str], a: str = "src", b: str = "dst") -> DataFrame:
    """``(*keys, node, component)``; the component is its smallest node. Nodes without edges do not occur.

    ``keys`` name the graph an edge belongs to. Every round hangs the larger neighbours of a node, then
    the smaller ones, on the smallest node it sees, so long paths fold up and the number of rounds grows with
    the logarithm of a component's size. Minima are partial aggregates, so a node with very many
    edges is no hot task. Each round is written down.
    """
    keys = list(keys)
    links = edges.where(F.col(a) != F.col(b)).select(*keys, F.greatest(a, b).alias("_u"), F.least(a, b).alias("_v")).distinct()
    links = hand_over(links, "links")
    before = None
    while True:
        # Larger neighbours go to the smallest node around.
        around = links.unionByName(links.select(*keys, F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        low = around.groupBy(*keys, "_u").agg(F.min("_v").alias("_m")).withColumn("_m", F.least("_u", "_m"))
        hung = around.where("_v > _u").join(low, [*keys, "_u"]).select(*keys, F.col("_v").alias("_u"), F.col("_m").alias("_v"))
        hung = hand_over(hung.distinct(), "links")
        # Then a node's smaller neighbours, and the node itself, go to the smallest of them.
        low = hung.groupBy(*keys, "_u").agg(F.min("_v").alias("_m"))
        pairs = hung.join(low, [*keys, "_u"]).select(*keys, "_m", F.explode(F.array("_u", "_v")).alias("_u"))
        links = hand_over(pairs.where("_u <> _m").select(*keys, "_u", F.col("_m").alias("_v")).distinct(), "links")
        seen = tuple(links.agg(F.count("*"), F.sum(F.xxhash64(*keys, "_u", "_v").cast("decimal(38, 0)"))).first())
        if seen == before:
            break
        before = seen
    stars = links.select(*keys, F.col("_u").alias("node"), F.col("_v").alias("component"))
    return stars.unionByName(stars.select(*keys, F.col("component").alias("node"), "component")).distinct()
