import random

import pytest

from arborlens.operators import components, graph, imports
from arborlens import schemas
from arborlens.functions import paths
from pyspark.sql import functions as F


def queue_order(nodes, edges):
    """One file at a time: of all files whose dependencies are out, the smallest name."""
    out = []
    while True:
        ready = sorted(n for n in nodes if n not in out and all(d in out for s, d in edges if s == n))
        if not ready:
            return out + sorted(set(nodes) - set(out)), set(nodes) - set(out)
        out.append(ready[0])


def tables(spark, graphs):
    nodes = [(p, n) for p, (ns, _) in graphs.items() for n in ns]
    edges = [(p, s, d) for p, (_, es) in graphs.items() for s, d in es]
    return (
        spark.createDataFrame(nodes, "project string, path string"),
        spark.createDataFrame(edges, "project string, src string, dst string"),
    )


def random_graphs():
    draw = random.Random(11)
    graphs = {}
    for p in range(25):
        names = [chr(97 + i) for i in range(draw.randint(1, 14))]
        draw.shuffle(names)
        edges = []
        for _ in range(draw.randint(0, 24)):
            a, b = draw.choice(names), draw.choice(names)
            if a != b and (p % 4 == 0 or names.index(a) < names.index(b)):
                edges.append((a, b))
        graphs[f"p{p}"] = (names, edges + edges[:2])
    graphs["given"] = (
        list("abcmzwxy"), [("a", "b"), ("b", "c"), ("z", "c"), ("x", "y"), ("y", "x"), ("w", "y")],
    )
    graphs["outside"] = (list("abc"), [("a", "nowhere"), ("b", "a")])
    graphs["falling"] = ([f"n{i:02}" for i in range(9)], [(f"n{i:02}", f"n{i + 1:02}") for i in range(8)])
    return graphs


@pytest.mark.parametrize("block", [10**6, 10, 1])
def test_order_is_the_queue_order(spark, block):
    graphs = random_graphs()
    nodes, edges = tables(spark, graphs)
    got = {}
    for r in graph.dependency_order(nodes, edges, block).orderBy("project", "pos").collect():
        got.setdefault(r.project, []).append(r.path)
    assert got == {p: queue_order(*g)[0] for p, g in graphs.items()}
    assert got["given"] == list("cbamzwxy")


@pytest.mark.parametrize("block", [10])
def test_levels_and_remainder(spark, block):
    graphs = random_graphs()
    nodes, edges = tables(spark, graphs)
    levels = {(r.project, r.path): r.level for r in graph.dependency_levels(nodes, edges, block).collect()}
    stuck = {(r.project, r.path) for r in graph.cycle_remainder(nodes, edges, block).collect()}
    for p, (names, links) in graphs.items():
        left = queue_order(names, links)[1]
        assert {n for q, n in stuck if q == p} == left
        for n in names:
            below = [levels[p, d] for s, d in links if s == n and n not in left]
            assert levels[p, n] == (None if n in left else max(below, default=-1) + 1)


@pytest.mark.parametrize("block, most", [(graph.BLOCK, 100), (500, 250)])
def test_a_chain_of_2000_levels_takes_few_jobs(spark, block, most):
    names = [f"n{i:04}" for i in range(2000)]
    nodes, edges = tables(spark, {"p": (names, list(zip(names[1:], names, strict=False)))})
    spark.sparkContext.setJobGroup("chain", "chain")
    rows = graph.dependency_levels(nodes, edges, block).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("chain")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.path: r.level for r in rows} == {n: i for i, n in enumerate(names)}
    assert 0 < len(jobs) < most


def test_components(spark):
    draw = random.Random(5)
    links = [(f"g{draw.randrange(3)}", *(f"n{draw.randrange(60):02}" for _ in range(2))) for _ in range(90)]
    links += [("path", f"v{i:02}", f"v{(i * 7 + 7) % 101:02}") for i in range(60)] + [("loop", "a", "a")]
    found = components.connected_components(spark.createDataFrame(links, "g string, src string, dst string"), ["g"]).collect()
    label = {}
    for g, a, b in links:
        if a != b:
            label |= {(g, x): (g, x) for x in (a, b) if (g, x) not in label}
            x, y = sorted((label[g, a], label[g, b]))
            label = {k: x if v == y else v for k, v in label.items()}
    assert {(r.g, r.node): (r.g, r.component) for r in found} == label and len(found) == len(label)


def specs(column_values, content, path):
    expression = imports.import_specs(F.col("c"), paths.language(F.col("p")))
    return column_values("c string, p string", [(content, path)], expression)[0]


def test_import_specs(column_values):
    assert specs(column_values, "import csv\nx = 1\nfrom decimal import Decimal\n", "a.py") == ["csv", "decimal"]
    script = "import { tick, tock } from './clock';\nlet z = require('left');\nimport up from '../over/up';\n"
    assert specs(column_values, script, "a.ts") == ["./clock", "../over/up", "left"]
    assert specs(column_values, "require( \"q\" )\nexport * from 'z'\nimport x\n from 'n'", "a.js") == ["z", "q"]
    assert specs(column_values, "use std::io;\n  mod x;\nlet use y", "a.rs") == ["std::io", "x"]
    assert specs(column_values, 'import "fmt"\nx := "a.b"', "a.go") == ["fmt", "a.b"]
    assert specs(column_values, "import a.b.C;\n import static x.Y;", "a.java") == ["a.b.C", "static"]
    assert specs(column_values, "import ünï.x\n from .y import z\nximport q\r\nimport r", "a.py") == ["ünï.x", ".y", "r"]
    assert specs(column_values, "import something\n", "a.unknown") is None


def edges_of(spark, tree):
    files = spark.createDataFrame([("p", p, c) for p, c in tree.items()], schemas.SOURCE_FILES)
    found = imports.import_edges(imports.extract_imports(files), files)
    return {(r.src, r.dst): r.n for r in found.collect()}


def test_edges(spark):
    tree = {
        "a.py": "from .a import b\nimport utils\nimport pkg.mod\nimport pkg.mod\nimport pkg.both\nimport pkg.init\n",
        "utils.py": "", "pkg/mod.py": "", "pkg/both.py": "", "pkg/both/__init__.py": "", "pkg/init/__init__.py": "",
        "s/x.ts": "import a from './foo'\nimport b from '../../out'\nimport c from './d'\nimport me from './x'\nimport i from '..'",
        "s/foo.ts": "", "s/foo/index.ts": "", "s/d/index.js": "import x from '../.././s//foo.ts'", "out.ts": "",
        "index.ts": "", "g.go": 'x := "a.b"', "a/b.py": "",
    }
    assert edges_of(spark, tree) == {
        ("a.py", "pkg/mod.py"): 2, ("a.py", "pkg/both.py"): 1, ("a.py", "pkg/init/__init__.py"): 1,
        ("s/x.ts", "s/foo.ts"): 1, ("s/x.ts", "s/d/index.js"): 1, ("s/d/index.js", "s/foo.ts"): 1,
        ("g.go", "a/b.py"): 1,
    }


def test_degrees(spark):
    nodes, edges = tables(spark, {"p": (list("abc"), [("a", "b"), ("a", "c"), ("c", "b")])})
    counted = edges.withColumn("n", F.when(F.col("src") == "c", 2).otherwise(1))
    rows = imports.dependency_degree(nodes, counted).collect()
    assert {r.path: (r.imports, r.importers) for r in rows} == {"a": (2, 0), "b": (0, 3), "c": (2, 1)}
