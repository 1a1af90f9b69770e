"""Columns derived from a relative path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborlens.functions import fixed, globs


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def suffix(path: Column) -> Column:
    """Last suffix, lower-cased; empty for ``.env``, ``foo.`` and ``Makefile``."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))


def language(path: Column) -> Column:
    pairs = [F.lit(x) for pair in fixed.LANGUAGE_BY_SUFFIX.items() for x in pair]
    return F.create_map(*pairs)[suffix(path)]


def is_binary(path: Column) -> Column:
    return suffix(path).isin(*fixed.BINARY_SUFFIXES)


def group_key(path: Column) -> Column:
    """First folder, or ``root`` for a file at the top."""
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise(F.lit("root"))


def is_entrypoint(path: Column, lang: Column) -> Column:
    """Whether base name or path matches an entrypoint pattern of the language."""
    name = base_name(path)
    tests = F.lit(False)
    for language_name, patterns in fixed.ENTRYPOINT_PATTERNS.items():
        plain = [p for p in patterns if not set(p) & set("*?[")]
        hit = name.isin(*plain)
        for pattern in (p for p in patterns if p not in plain):
            expression = globs.shell_regex(pattern)
            hit = hit | name.rlike(expression) | path.rlike(expression)
        tests = tests | ((lang == language_name) & hit)
    return F.coalesce(tests, F.lit(False))


def walk_key(path: Column) -> Column:
    """Sorts like a walk: the files of a folder by name, then its sub-folders by name.

    Every segment gets a mark (0 file, 1 folder) and folders end in NUL, which no name can hold.
    """
    marked = F.regexp_replace(path, r"([^/]+)\z", "0$1")
    return F.regexp_replace(marked, r"([^/]*)/", "1$1\x00")


def parts_key(path: Column) -> Column:
    """Sorts like the list of segments: ``a/x`` before ``a-b/x``."""
    return F.replace(path, F.lit("/"), F.lit("\x00"))


def tree_line(path: Column) -> Column:
    return F.concat(F.repeat(F.lit("  "), depth(path)), base_name(path))


def folders(path: Column) -> Column:
    """Every folder above the file, the root (empty) first."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )


def normalise(path: Column) -> Column:
    """Resolve ``.`` and ``..``; NULL when the path leaves the root, ``.`` for the root itself."""

    def step(done: Column, part: Column) -> Column:
        return (
            F.when(done.isNull() | part.isin("", "."), done)
            .when(part != "..", F.concat(done, F.array(part)))
            .when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1))
        )

    folded = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(F.size(folded) == 0, F.lit(".")).otherwise(F.array_join(folded, "/"))


def model_key(model: Column) -> Column:
    """File-safe model name."""
    return F.replace(model, F.lit("/"), F.lit("--"))


def model_from_key(key: Column) -> Column:
    return F.replace(key, F.lit("--"), F.lit("/"))


def provider(model: Column) -> Column:
    return F.when(F.contains(model, F.lit("/")), F.substring_index(model, "/", 1)).otherwise(F.lit("unknown"))
