"""Table schemas for data that comes from outside, with defaults and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens.functions import fixed

SOURCE_FILES = "project string, path string, content string"
MANIFEST_FILES = (
    "project string, path string, lang string, tokens bigint, chars bigint, "
    "is_entrypoint boolean, grp string"
)
PROJECTS = (
    "project string, root string, strip_comments boolean, whitespace string, "
    "include_docs boolean, trust_level string, file_tree boolean, separator string"
)
SEQUENCE_NODES = (
    "project string, node_id string, parent_id string, pos bigint, path string, name string, ord string"
)
RESPONSES = (
    "run_id string, project string, model string, provider string, status string, latency_ms bigint, "
    "tokens_prompt bigint, tokens_completion bigint, cost_usd double, finish_reason string, "
    "generation_id string, raw_response string, error string"
)

# Defaults of stored settings, and the words a setting may take.
DEFAULTS = {
    "root": ".",
    "strip_comments": True,
    "whitespace": "aggressive",
    "include_docs": True,
    "trust_level": "unverified",
    "file_tree": True,
    "separator": fixed.SEPARATOR,
    "ord": "dependency",
}
WORDS = {
    "whitespace": fixed.WHITESPACE_MODES,
    "trust_level": fixed.TRUST_LEVELS,
    "status": fixed.STATUSES,
    "ord": ("dependency", "manual", "alphabetical"),
}
# Columns that a row cannot do without.
REQUIRED = {
    MANIFEST_FILES: ("project", "path", "tokens", "chars"),
    PROJECTS: ("project",),
    SEQUENCE_NODES: ("project", "node_id"),
    RESPONSES: (
        "model", "provider", "status", "latency_ms", "tokens_prompt", "tokens_completion",
        "cost_usd", "finish_reason", "generation_id", "raw_response",
    ),
}


def validated(rows: DataFrame, schema: str) -> DataFrame:
    """Fill defaults; a missing required value or an unknown word fails the job when read."""

    def check(name: str) -> Column:
        value = F.coalesce(name, F.lit(DEFAULTS[name])) if name in DEFAULTS else F.col(name)
        bad = F.lit(False)
        if name in REQUIRED.get(schema, ()):
            bad = bad | value.isNull()
        if name in WORDS:
            bad = bad | ~value.isin(*WORDS[name])
        return F.when(bad, F.raise_error(F.lit(f"bad value in column {name}"))).otherwise(value).alias(name)

    checked = set(DEFAULTS) | set(WORDS) | set(REQUIRED.get(schema, ()))
    return rows.select(*[check(n) if n in checked else F.col(n) for n in rows.columns])
