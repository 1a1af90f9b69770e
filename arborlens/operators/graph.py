"""Dependency order of files, for graphs of any size.

The order wanted is the one a priority queue gives: dependencies first, and of all files that are
ready always the smallest name next. It need not be produced one file at a time, because it is a
plain sort by a key that each file gets from its dependencies:

* ``chain`` of a file = the elements greater than its own name in the largest chain among its
  dependencies, followed by its own name.

Why. Let M be the largest name among a file and all it depends on. A file cannot come before M is
out, and once M is out nothing larger than M is taken while a part of the file's dependencies is
still open; so files come in order of M. Files that share M come after M itself, and among them the
same argument holds again with M taken away. The list of these maxima is ``chain``: it falls
strictly and ends in the file. Chains compare element by element, a prefix first.

So one pass over the graph gives level and chain, and one distributed sort gives the order. Files on
a cycle, or waiting for one, get no level and come last by name.

The pass is made in blocks. The files of a project, by weakly connected component and name, are cut
into blocks of bounded weight (files and imports). A task works off a block as far as it can, many
levels at once. What its files are to files of other blocks is told after the round, and blocks that
were told something go on. A project that fits one block needs one round; a larger one needs as many as
the longest way through it changes blocks, not one for each level.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.operators.components import connected_components
from arborlens.operators.ordering import number_rows
from arborlens.session import hand_over

#: Files and imports of a block. A file with more imports than that is a block of its own.
BLOCK = 200_000

# ``(top, ord, chain)`` sorts the files of a project. ``top`` is the first element of the chain.
# Where one block holds a project, ``ord`` (the place within the task) stands for the rest of the chain.
PLACED = "project string, path string, level bigint, top string, ord bigint, chain array<string>"


def next_chain(name: str, largest: tuple[str, ...]) -> tuple[str, ...]:
    """Chain of a file from the largest chain of its dependencies (empty for none)."""
    return (*(x for x in largest if x > name), name)


def _work_off(rows: pd.DataFrame, step: int) -> pd.DataFrame:
    """Place what can be placed in a block and was not in an earlier round.

    Rows without ``dst`` name the files, rows with a ``level`` tell of a file of another block (in
    round ``told``), the others are imports. Python compares strings by code point, which is
    the byte order of UTF-8 that Spark uses.
    """
    whole = bool(rows["whole"].iloc[0])
    files = rows["dst"].isna()
    news = rows["level"].notna() & ~files
    waits = dict.fromkeys(rows["src"][files], 0)
    level = dict.fromkeys(waits, 0)
    fresh = dict.fromkeys(waits, step == 0)
    largest: dict[str, tuple[str, ...]] = dict.fromkeys(waits, ())
    users = defaultdict(list)
    for src, dst in rows[["src", "dst"]][~files & ~news].itertuples(index=False):
        waits[src] += 1
        users[dst].append(src)

    def open_up(dst: str, at: int, chain: tuple[str, ...], new: bool) -> list[str]:
        ready = []
        for src in users[dst]:
            level[src] = max(level[src], at + 1)
            largest[src] = max(largest[src], chain)
            fresh[src] |= new
            waits[src] -= 1
            if waits[src] == 0:
                ready.append(src)
        return ready

    queue = [name for name, n in waits.items() if n == 0]
    told = rows[news].drop_duplicates("dst")
    for dst, at, chain, when in told[["dst", "level", "chain", "told"]].itertuples(index=False):
        queue += open_up(dst, int(at), tuple(chain), when == step)
    heapq.heapify(queue)
    out, top, n = [], "", 0
    while queue:
        name = heapq.heappop(queue)
        n += 1
        top = max(top, name)
        chain = () if whole else next_chain(name, largest[name])
        if fresh[name]:
            out.append((rows["project"].iloc[0], name, level[name], top if whole else chain[0], n if whole else 0, list(chain)))
        for user in open_up(name, level[name], chain, fresh[name]):
            heapq.heappush(queue, user)
    return pd.DataFrame(out, columns=["project", "path", "level", "top", "ord", "chain"])


def _blocks(linked: DataFrame, edges: DataFrame, block: int) -> tuple[DataFrame, DataFrame | None]:
    """``(project, path, block, whole)`` of every file with imports, and the imports between blocks, if any."""
    weights = edges.groupBy("project", F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("_imports"))
    weighed = linked.join(weights, ["project", "path"], "left").withColumn("weight", F.coalesce("_imports", F.lit(0)) + 1)
    totals = weighed.groupBy("project").agg(F.sum("weight").alias("_total"))
    wide = hand_over(totals.where(F.col("_total") > block).select("project"), "wide")
    rest = linked.join(wide, "project", "left_anti").select("project", "path", F.lit(0).cast("bigint").alias("block"), F.lit(True).alias("whole"))
    if wide.isEmpty():
        return rest, None
    links = edges.join(wide, "project", "left_semi")
    parts = connected_components(links, ["project"]).withColumnRenamed("node", "path")
    # A file that imports itself only is in no component.
    sorted_ = weighed.join(wide, "project", "left_semi").join(parts, ["project", "path"], "left")
    sorted_ = sorted_.select("project", F.coalesce("component", "path").alias("component"), "path", "weight")
    numbered = number_rows(sorted_, ["project"], ["component", "path"], running={"_before": "weight"})
    placed = numbered.select("project", "path", F.expr(f"_before div {block}").alias("block"), F.lit(False).alias("whole"))
    members = hand_over(rest.unionByName(placed), "blocks")
    ends = members.where("NOT whole").select("project", "path", "block")
    between = links.join(ends.withColumnRenamed("path", "src"), ["project", "src"]).join(
        ends.select("project", F.col("path").alias("dst"), F.col("block").alias("_from")), ["project", "dst"]
    )
    return members, hand_over(between.where("block <> _from").drop("_from"), "between")


def place_files(nodes: DataFrame, edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """Place every file that can be placed; see ``PLACED`` for the columns.

    ``nodes(project, path)``, ``edges(project, src, dst)`` with sources that are nodes. A repeated
    edge counts once, and an edge to something that is no node never opens. Files without edges
    take no part in the graph work.
    """
    nodes = nodes.select("project", "path")
    edges = hand_over(edges.select("project", "src", "dst").distinct(), "edges")
    ends = edges.select("project", F.col("src").alias("path")).unionByName(
        edges.select("project", F.col("dst").alias("path"))
    )
    zero = F.lit(0).cast("bigint")
    alone = nodes.join(ends, ["project", "path"], "left_anti").select(
        "project", "path", zero.alias("level"), F.col("path").alias("top"), zero.alias("ord"),
        F.array().cast("array<string>").alias("chain"),
    )
    members, between = _blocks(nodes.join(ends, ["project", "path"], "left_semi"), edges, block)
    nothing = {
        "level": F.lit(None).cast("bigint"), "chain": F.lit(None).cast("array<string>"), "told": F.lit(None).cast("int"),
    }
    named = members.withColumnsRenamed({"path": "src"})
    imports = edges.join(named, ["project", "src"]).withColumns(nothing)
    rows = named.withColumn("dst", F.lit(None).cast("string")).withColumns(nothing).unionByName(imports)
    if between is None:
        return alone.unionByName(_round(rows, 0))
    rows = hand_over(rows, "graph")
    news, told, step = hand_over(_round(rows, 0), "placed"), None, 0
    placed = alone.unionByName(news)
    while True:
        step += 1
        heard = between.join(news.select("project", F.col("path").alias("dst"), "level", "chain"), ["project", "dst"])
        heard = hand_over(heard.withColumns({"whole": F.lit(False), "told": F.lit(step)}), "told")
        if heard.isEmpty():
            return placed
        told = heard if told is None else told.unionByName(heard)
        going = rows.unionByName(told).join(heard.select("project", "block"), ["project", "block"], "left_semi")
        news = hand_over(_round(going, step), "placed")
        placed = placed.unionByName(news)


def _round(rows: DataFrame, step: int) -> DataFrame:
    return rows.groupBy("project", "block").applyInPandas(lambda group: _work_off(group, step), PLACED)


def dependency_levels(nodes: DataFrame, edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """Longest path to a file without dependencies; NULL for cycles and what waits for them."""
    placed = place_files(nodes, edges, block).select("project", "path", "level")
    return nodes.select("project", "path").join(placed, ["project", "path"], "left")


def dependency_order(nodes: DataFrame, edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every file with its position, dependencies first."""
    placed = place_files(nodes, edges, block).drop("level")
    keyed = nodes.select("project", "path").join(placed, ["project", "path"], "left")
    keyed = keyed.withColumn("stuck", F.col("top").isNull())
    numbered = number_rows(keyed, ["project"], ["stuck", "top", "ord", "chain", "path"])
    return numbered.select("project", "pos", "path")


def cycle_remainder(nodes: DataFrame, edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """Files that are on a cycle or wait for one."""
    placed = place_files(nodes, edges, block)
    return nodes.select("project", "path").join(placed, ["project", "path"], "left_anti")
