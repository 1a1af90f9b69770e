import random

from pyspark.sql import functions as F

from arborlens import schemas
from arborlens.functions import globs
from arborlens.operators import sequence


def resolve(spark, nodes, paths):
    rows = [("p", *n) for n in nodes]
    tree = spark.createDataFrame(rows, schemas.SEQUENCE_NODES)
    files = spark.createDataFrame([("p", f, "") for f in paths], schemas.SOURCE_FILES)
    found = sequence.resolve_sequence(tree, files).orderBy("pos").collect()
    assert [r.pos for r in found] == list(range(len(found)))
    return [r.path for r in found]


def test_leaves_in_order_and_missing(spark):
    nodes = [("1", None, 0, "b.py", None, None), ("2", None, 1, "./a.py", None, None), ("3", None, 2, "no.py", None, None)]
    assert resolve(spark, nodes, ["a.py", "b.py"]) == ["b.py", "a.py"]


def test_groups(spark):
    nodes = [
        ("g", None, 0, None, "all", "alphabetical"),
        ("1", "g", 0, "b.py", None, None), ("2", "g", 1, "a.py", None, None),
        ("h", "g", 2, None, "inner", "manual"), ("3", "h", 0, "A.py", None, None),
        ("m", None, 1, None, "rest", "manual"),
        ("4", "m", 0, "z.py", None, None), ("5", "m", 1, "c.py", None, None), ("6", "m", 2, "b.py", None, None),
        ("n", None, 2, None, None, None), ("7", "n", 0, "never.py", None, None),
        ("l", None, 3, "y.py", "both", "manual"), ("8", "l", 0, "never.py", None, None),
    ]
    paths = ["a.py", "b.py", "c.py", "z.py", "A.py", "never.py", "y.py"]
    assert resolve(spark, nodes, paths) == ["A.py", "a.py", "b.py", "z.py", "c.py", "y.py"]


def test_globs_sort_by_parts_unless_alphabetical(spark):
    paths = ["s/a-b/q.py", "s/a/x.py", "s/a/deep/y.py", "s/n.txt", "t.py", "s/[x].py", "s/x.py"]
    flat = [("1", None, 0, "s/**/*.py", None, None)]
    assert resolve(spark, flat, paths) == ["s/[x].py", "s/a/deep/y.py", "s/a/x.py", "s/a-b/q.py", "s/x.py"]
    grouped = [("g", None, 0, None, "g", "alphabetical"), ("1", "g", 0, "s/**/*.py", None, None)]
    assert resolve(spark, grouped, paths) == ["s/[x].py", "s/a-b/q.py", "s/a/deep/y.py", "s/a/x.py", "s/x.py"]
    # A name with brackets is a glob, so it does not find itself.
    assert resolve(spark, [("1", None, 0, "s/[x].py", None, None)], paths) == ["s/x.py"]
    assert resolve(spark, [("1", None, 0, "*.py", None, None), ("2", None, 1, "*/*/?.py", None, None)], paths) == [
        "t.py", "s/a/x.py", "s/a-b/q.py",
    ]


def test_names_with_brackets_do_not_stop_the_job(spark):
    names = ["pages/[post-id].ts", "pages/p.ts", "pages/pp.ts", "pages/[!a].ts", "pages/[]a]].ts", "pages/].ts", "pages/a].ts"]
    nodes = [(str(n), None, n, name, None, None) for n, name in enumerate(names)]
    # The range t-i is empty; [!a] takes p and ], []a] takes both of its members.
    assert resolve(spark, nodes, names) == ["pages/p.ts", "pages/pp.ts", "pages/].ts", "pages/a].ts"]


def test_globs_against_every_pair(spark):
    rng = random.Random(5)
    words = ["a", "b", "ab", "a.py", "b.py", "x[", "é.py"]
    files = sorted({"/".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(150)})
    parts = [*words, "*", "?", "**", "*.py", "[ab]", "[!a]*", "[ab].py", "a*", "?b", "[b-a]"]
    patterns = sorted({"/".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(200)})
    rows = [("p", [n], "", False, g) for n, g in enumerate(patterns)]
    leaves = spark.createDataFrame(rows, "project string, major array<bigint>, minor string, by_path boolean, path string")
    found = sequence.glob_files(leaves, spark.createDataFrame([("p", f) for f in files], "project string, path string"))
    got = sorted((r._glob, r.path) for r in found.collect())
    wild = [g for g in patterns if set(g) & set("*?[")]
    tests = spark.createDataFrame([(g, globs.tree_regex(g), f) for g in wild for f in files], "g string, x string, f string")
    assert got == sorted((r.g, r.f) for r in tests.where(F.expr("f RLIKE x")).collect())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_head" in plan and "_tail" in plan and "_length" in plan


def test_deep_trees_and_settings(spark):
    # Deeper than Spark's own limit of 100 levels; the settings are as before afterwards.
    names = ["spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit"]
    before = [spark.conf.get(n) for n in names]
    depth = 110
    nodes = [(f"g{i}", f"g{i - 1}" if i else None, 1, None, f"group {i}", None) for i in range(depth)]
    nodes += [(f"l{i}", f"g{i}", i % 2 * 2, f"f{i:03}.py", None, None) for i in range(depth)]
    # Leaves before the next group come first, those after it when all deeper ones are done.
    want = [f"f{i:03}.py" for i in [*range(0, depth, 2), *range(depth - 1, 0, -2)]]
    assert resolve(spark, nodes, [f"f{i:03}.py" for i in range(depth)]) == want
    assert [spark.conf.get(n) for n in names] == before


def test_nodes_that_no_root_reaches_are_left_out(spark):
    nodes = [("1", None, 0, "a.py", None, None), ("2", "3", 0, None, "x", None), ("3", "2", 0, None, "y", None), ("4", "3", 1, "b.py", None, None)]
    assert resolve(spark, nodes, ["a.py", "b.py"]) == ["a.py"]
