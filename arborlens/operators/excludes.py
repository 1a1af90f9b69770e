"""Exclude globs as a table: every project has its own.

One expression for all files cannot hold them, and comparing every file with every glob of its
project would be a join without a key. So the globs of a project become a trie over path segments, a table
of steps ``(project, state, literal, wild, next, last)``. Globs that begin alike share their states; ``**``
is a state that steps to itself. The folders of a project walk down the trie, one equi-join for each depth: on
the state and the literal segment, or on the state alone for the few segments with a wildcard. Files
meet the states of their folder with their name only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens.functions import globs
from arborlens.session import hand_over

STEPS = "project string, state string, literal string, wild string, next string, last boolean"
#: What ``**`` may stand for inside one segment.
_DEEP = r"[^/\n]*"


class _Segment:
    """A piece of a glob between slashes: its text while it is literal, and its expression."""

    def __init__(self, text: str | None = "", body: str = ""):
        self.text, self.body = text, body

    def literal(self, text: str) -> _Segment:
        return _Segment(None if self.text is None else self.text + text, self.body + globs.exclude_body(text))

    def wild(self, body: str) -> _Segment:
        return _Segment(None, self.body + body)

    def key(self) -> tuple[str | None, str | None]:
        return (self.text, None) if self.text is not None else (None, self.body)


def steps_of(pattern: str) -> set[tuple]:
    """Steps ``(state, literal, wild, next, last)`` of one exclude glob; the first state is the empty one.

    A state is named after the pieces that lead to it, so equal beginnings are equal states.
    """
    found: set[tuple] = set()

    def step(state: str, segment: _Segment, loop: bool = False) -> str:
        text, body = segment.key()
        after = f"{state}/{'=' + text if text is not None else '~' + body}{'/**' if loop else ''}"
        found.add((state, text, body, after, False))
        if loop:
            found.add((after, None, _DEEP, after, False))
        return after

    # Ways to have come this far: a state, and the piece of a segment since its last slash.
    ways = {("", "", ""): _Segment()}

    def put(out: dict, state: str, segment: _Segment) -> None:
        out[(state, segment.text, segment.body)] = segment

    for token in re.findall(r"\*\*/|\*\*|\*|\?|/|[^*?/]+", pattern):
        out: dict = {}
        for (state, _, _), segment in ways.items():
            if token == "/":
                put(out, step(state, segment), _Segment())
            elif token == "**/":
                # Nothing at all, or the rest of this segment and any number of further ones.
                put(out, state, segment)
                put(out, step(state, segment.wild(_DEEP), loop=True), _Segment())
            elif token == "**":
                put(out, state, segment.wild(_DEEP))
                put(out, step(state, segment.wild(_DEEP), loop=True), _Segment().wild(_DEEP))
            elif token in "*?":
                put(out, state, segment.wild("[^/]*" if token == "*" else "[^/]"))
            else:
                put(out, state, segment.literal(token))
        ways = out
    for (state, _, _), segment in ways.items():
        text, body = segment.key()
        found.add((state, text, body, None, True))
    return found


def exclude_steps(patterns: DataFrame) -> DataFrame:
    """Trie of ``patterns(project, pattern)``; see ``STEPS``."""

    def translate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(project, *step) for project, pattern in batch.itertuples(index=False) for step in steps_of(pattern)]
            yield pd.DataFrame(rows, columns=["project", "state", "literal", "wild", "next", "last"])

    known = patterns.select("project", "pattern").where("project IS NOT NULL AND pattern IS NOT NULL").distinct()
    return known.mapInPandas(translate, STEPS).distinct()


def _walked(rows: DataFrame, steps: DataFrame, segment: Column, last: bool, keep: list[str]) -> DataFrame:
    """``rows`` that take a step, with what it leads to."""
    mine = steps.where("last" if last else "NOT last")
    exact = mine.where("literal IS NOT NULL").select("project", "state", F.col("literal").alias("_segment"), "next")
    wild = mine.where("wild IS NOT NULL").select("project", "state", "wild", "next")
    named = rows.withColumn("_segment", segment)
    spelled = named
    if last:  # a final newline of a path is free
        bare = F.regexp_replace("_segment", r"\n\z", "")
        spelled = named.unionByName(named.where(bare != F.col("_segment")).withColumn("_segment", bare))
    by_name = spelled.join(exact, ["project", "state", "_segment"])
    body = F.concat(F.lit(r"\A(?:"), "wild", F.lit(r")\n?\z" if last else r")\z"))
    by_form = named.join(wild, ["project", "state"]).where(F.rlike("_segment", body))
    return by_name.select(*keep, "next").unionByName(by_form.select(*keep, "next"))


def excluded_files(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(project, path)`` of the files that an exclude glob of their project covers.

    Paths may use ``\\`` for ``/``. Projects without patterns lose nothing.
    """
    steps = hand_over(exclude_steps(patterns), "steps")
    clean = F.replace("path", F.lit("\\"), F.lit("/"))
    folder = F.regexp_replace(clean, r"(\A|/)[^/]*\z", "")
    top = ~F.contains(clean, F.lit("/"))
    placed = files.join(patterns.select("project").distinct(), "project", "left_semi").select(
        "project", "path", F.regexp_extract(clean, r"([^/]*)\z", 1).alias("_full"),
        F.when(top, F.array().cast("array<string>")).otherwise(F.split(folder, "/")).alias("_folders"),
    )
    folders = hand_over(placed.select("project", "_folders").distinct(), "folders")
    deepest = folders.agg(F.max(F.size("_folders"))).first()[0] or 0
    start = folders.select("project", F.lit("").alias("state")).distinct()
    states = folders.where(F.size("_folders") == 0).join(start, "project").select("project", "_folders", "state")
    # Every folder that has files below it, by depth.
    active = start.withColumn("_folders", F.array().cast("array<string>"))
    for depth in range(deepest):
        here = folders.where(F.size("_folders") > depth).select("project", F.slice("_folders", 1, depth + 1).alias("_here")).distinct()
        above = here.withColumn("_folders", F.slice("_here", 1, depth)).join(active, ["project", "_folders"])
        walked = _walked(above.drop("_folders"), steps, F.element_at("_here", depth + 1), False, ["project", "_here"])
        active = hand_over(walked.select("project", F.col("_here").alias("_folders"), F.col("next").alias("state")).distinct(), "states")
        states = states.unionByName(active)
    met = placed.join(states, ["project", "_folders"])
    return _walked(met, steps, F.col("_full"), True, ["project", "path"]).select("project", "path").distinct()


def drop_excluded(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """``files`` without those that a glob of ``patterns(project, pattern)`` covers."""
    return files.join(excluded_files(files.select("project", "path"), patterns), ["project", "path"], "left_anti")
