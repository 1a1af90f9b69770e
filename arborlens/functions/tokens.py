"""Token counts. A counter is any function from a text column to a count column."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TokenCounter = Callable[[Column], Column]


def estimate(text: Column) -> Column:
    """Four characters per token, rounded down for every text."""
    return F.shiftright(F.length(text), 2).cast("bigint")


def counter_from(make_encoder: Callable[[], Callable[[str], list]]) -> TokenCounter:
    """A counter over a real encoder.

    ``make_encoder`` runs once in each Python worker, for instance
    ``lambda: tiktoken.get_encoding("cl100k_base").encode``.
    """
    held: list = []

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(make_encoder())
        return texts.map(lambda t: len(held[0](t)))

    return count
