"""Excludes of each project against one expression for each glob."""

import random
import re

import pytest

from arborlens.functions import globs
from arborlens.operators import excludes

GIVEN = [
    "**/node_modules/**", "*.lock", "**/*.test.*", "src/**", "a/b.c", "a/*/c", "**/x/**/y", "d**n/**", "**", "a**/b", "?/[m].py",
    "**/.env", "a//b", "", "*", "**/**", "x/**y", "a/**/", "***", "/a", "a+b/(c)",
]


def plain(path, pattern):
    body = globs.anchored([globs.exclude_body(pattern)]).replace(r"\z", r"\Z")
    return re.search(body, path.replace("\\", "/")) is not None


def random_cases(n=70):
    draw = random.Random(8)
    names = ["a", "b", "ab", "x", "y", ".env", "c.py", "[m].py", "b.test.ts", "a+b", "(c)", "node_modules", "x\ny"]
    files = {"/".join(draw.choice(names) for _ in range(draw.randint(1, 5))) for _ in range(n)}
    files |= {"a/b", "a//b", "/a", "src/z\n", "yarn.lock\n", "a\\b", "down/x", "d/n/x", "dn/x", "ab", "axx/b", "a/", "x/y", "x/zy", "x/z/y"}
    return sorted(files)


def walk(pattern, path):
    """A path through the steps of one glob, as the joins take it."""
    steps = excludes.steps_of(pattern)
    *folders, name = path.replace("\\", "/").split("/")
    states = {""}

    def fits(step, segment, last):
        _, literal, wild, _, is_last = step
        tail = r"\n?" if last else ""
        body = wild if literal is None else re.escape(literal)
        return is_last == last and re.fullmatch(f"(?:{body}){tail}", segment) is not None

    for folder in folders:
        states = {s[3] for s in steps if s[0] in states and fits(s, folder, False)}
    return any(s[0] in states and fits(s, name, True) for s in steps)


def test_steps_say_what_the_expression_says():
    for pattern in GIVEN:
        for path in random_cases():
            assert walk(pattern, path) == plain(path, pattern), (pattern, path)


def test_states_are_shared():
    one, two = excludes.steps_of("src/lib/*.c"), excludes.steps_of("src/lib/*.h")
    assert len(one & two) == 2 and len(one | two) == 4


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(9)
    files = [(f"p{k}", f) for k in range(6) for f in random_cases()]
    patterns = [(f"p{k}", p) for k in range(5) for p in draw.sample(GIVEN, 3) * 2 if p not in ("**", "***", "**/**")] + [("p9", "**"), (None, "**"), ("p1", None)]
    return files, patterns


def test_files_of_each_project(spark, tables):
    files, patterns = tables
    frames = spark.createDataFrame(files, "project string, path string"), spark.createDataFrame(patterns, "project string, pattern string")
    kept = excludes.drop_excluded(*frames)
    wanted = sorted((p, f) for p, f in files if not any(q == p and g is not None and plain(f, g) for q, g in patterns))
    assert sorted(map(tuple, kept.collect())) == wanted and 0 < len(wanted) < len(files)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_patterns_and_no_files(spark):
    files = spark.createDataFrame([("p", "a/b")], "project string, path string")
    none = spark.createDataFrame([], "project string, pattern string")
    assert [tuple(r) for r in excludes.drop_excluded(files, none).collect()] == [("p", "a/b")]
    assert excludes.drop_excluded(files.limit(0), spark.createDataFrame([("p", "**")], "project string, pattern string")).collect() == []
