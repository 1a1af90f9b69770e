from pyspark.sql import functions as F

from arborlens.operators import mentions

FILES = ["src/a/b.py", "lib/a/b.py", "b.py", "src/main.go", "docs/x y.md", "src/a/only.ts", "node_modules/q/index.js"] + [f"d{i}/index.js" for i in range(500)]


def test_ends_and_clean(column_values):
    got = column_values("p string", [("a/b/c.py",), ("c",)], mentions.ends(F.col("p")))
    assert got == [["a/b/c.py", "b/c.py", "c.py"], ["c"]]
    cases = {"`./src/a.py:12`": "src/a.py", "/x/y.c#L3-L9": "x/y.c", " a\\b.py:1-4 ": "a/b.py", "../up.py": "../up.py", "": "", "a:b.py": "a:b.py", "..//q": "..//q"}
    assert column_values("p string", [(c,) for c in cases], mentions.clean_mention(F.col("p"))) == list(cases.values())


def test_resolve(spark):
    files = spark.createDataFrame([("p", f) for f in FILES] + [("q", "main.go")], "project string, path string")
    cases = {
        "b.py": ("exact", "b.py", 3), "a/b.py": ("ambiguous", None, 2), "src/a/b.py:7": ("exact", "src/a/b.py", 1), "./main.go": ("unique", "src/main.go", 1),
        "x y.md": ("unique", "docs/x y.md", 1), "y.md": ("unknown", None, 0), "index.js": ("ambiguous", None, 501), "q/index.js": ("unique", "node_modules/q/index.js", 1),
        "": ("unknown", None, 0), None: ("unknown", None, 0),
    }
    rows = [("r1", "p", m, model) for m in cases for model in "ab"] + [("r1", "p", "a/only.ts", "c"), ("r1", "p", "src/a/only.ts#L3", "a"), ("r2", "q", "only.ts", "a")]
    asked = spark.createDataFrame(rows, "run_id string, project string, mention string, model string")
    found = mentions.resolve_mentions(asked, files)
    assert found.columns == ["run_id", "project", "mention", "model", "status", "path", "n_files"]
    got = found.collect()
    assert len(got) == len(rows)
    assert {r.mention: (r.status, r.path, r.n_files) for r in got if r.mention in cases} == cases
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    counts = {(r.run_id, r.path): r.n_models for r in mentions.mentioned_files(asked, files).collect()}
    assert counts["r1", "src/a/only.ts"] == 2 and counts["r1", "b.py"] == 2 and not [k for k in counts if k[0] == "r2"]
