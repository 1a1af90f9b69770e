import glob
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from arborlens import schemas
from arborlens.functions import fixed
from arborlens.operators import classify, flatten, sequence
from arborlens.operators import manifest as mf
from arborlens.plans import queries
from arborlens.session import hand_over
from arborlens.sources import flattext, sinks, tables

TREE = {
    "main.py": "import os  # x\n\n\nprint('hello')\n",
    "README.md": "# Title\n\n\n\nText  \n",
    "docs/guide.md": "Guide // kept\n",
    "src/{lang}.js": "let a = 1; // one\n/* two\n */ let b = 'http://c';\n",
    "src/empty.c": "",
    "notes": "plain   \n\n\ntext",
}


def snapshot(spark, tree, options=flatten.SnapshotOptions(), **stored):
    rows = [("p", path, content) for path, content in tree.items()]
    files = spark.createDataFrame(rows, schemas.SOURCE_FILES)
    manifest = classify.scan_files(files)
    projects = flatten.default_projects(manifest).withColumns({k: F.lit(v) for k, v in stored.items()})
    positions = sequence.default_positions(mf.sequence_leaves(manifest), files)
    docs = sequence.number_files(sequence.add_sizes(classify.find_docs(files), manifest))
    return flatten.flat_parts(manifest, files, positions, docs, projects, options)


def joined(parts):
    rows = flatten.flat_blocks(parts).orderBy("section", "block").collect()
    return "".join(r.text for r in rows)


def expected(order, docs, strip=True, trust="unverified"):
    """The flat text as a list of lines, put together in one piece."""

    def clean(path, content):
        if strip and path.endswith(".py"):
            content = re.sub(r"#[^\n]*", "", content)
        if strip and path.endswith((".js", ".c")):
            content = re.sub(r"//[^\n]*", "", re.sub(r"/\*[\s\S]*?\*/", "", content))
        content = re.sub(r"[ \t]+$", "", content, flags=re.M)
        return re.sub(r"\n{2,}", "\n", content).strip()

    total = sum(len(c) // 4 for c in TREE.values())
    lines = [
        "═══ CODEBASE SNAPSHOT ═══", "generated: now", "root: p", f"total_files: {len(order)}",
        f"total_tokens: ~{total:,}", f"total_chars: {sum(map(len, TREE.values())):,}",
        "languages: Javascript (40%), Python (27%), Markdown (31%), C (0%)", "entrypoints: main.py", "",
        fixed.TREE_TITLE, *["  " * p.count("/") + p.split("/")[-1] for p in order], "",
    ]
    shares = {"javascript": 0, "python": 0, "markdown": 0, "c": 0}
    for path, content in TREE.items():
        name = {"py": "python", "md": "markdown", "js": "javascript", "c": "c"}.get(path.rsplit(".", 1)[-1])
        if name:
            shares[name] += len(content) // 4
    whole = sum(shares.values())
    ranked = sorted(shares.items(), key=lambda x: -x[1])
    lines[6] = "languages: " + ", ".join(f"{n.title()} ({t * 100 // whole}%)" for n, t in ranked)
    if docs:
        lines += list(fixed.DOCS_TITLE_UNVERIFIED) if trust == "unverified" else [fixed.DOCS_TITLE_TRUSTED]
        lines.append("")
        for path in docs:
            content = TREE[path]
            lines += [f"--- {path} [tokens: ~{len(content) // 4:,}, chars: {len(content):,}] ---", content, ""]
    lines += [fixed.SOURCE_TITLE, ""]
    languages = {"py": "python", "md": "markdown", "js": "javascript", "c": "c"}
    for path in order:
        content = clean(path, TREE[path])
        lang = languages.get(path.rsplit(".", 1)[-1], "text")
        lines += [f"--- {path} [tokens: ~{len(content) // 4:,}, chars: {len(content):,}, lang: {lang}] ---", content, ""]
    return "\n".join(lines)


ORDER = ["main.py", "docs/guide.md", "README.md", "notes", "src/empty.c", "src/{lang}.js"]
DOCS = ["README.md", "docs/guide.md"]


def test_whole_text(spark):
    options = flatten.SnapshotOptions(generated="now")
    assert joined(snapshot(spark, TREE, options)) == expected(ORDER, DOCS)


@pytest.mark.parametrize("block_chars", [1, 30, 1000])
def test_blocks_do_not_change_the_text(spark, block_chars):
    options = flatten.SnapshotOptions(generated="now", block_chars=block_chars)
    assert joined(snapshot(spark, TREE, options)) == expected(ORDER, DOCS)


def test_options(spark):
    trusted = snapshot(spark, TREE, flatten.SnapshotOptions(generated="now"), trust_level="trusted")
    assert joined(trusted) == expected(ORDER, DOCS, trust="trusted")
    options = flatten.SnapshotOptions(generated="now", strip_comments=False, include_docs=False)
    assert joined(snapshot(spark, TREE, options)) == expected(ORDER, [], strip=False)
    stored = snapshot(spark, TREE, flatten.SnapshotOptions(generated="now"), strip_comments=False, include_docs=False)
    assert joined(stored) == expected(ORDER, [], strip=False)
    bare = joined(snapshot(spark, TREE, flatten.SnapshotOptions(generated="now", include_docs=False), file_tree=False))
    assert fixed.TREE_TITLE not in bare and bare.split("\n")[8:11] == ["", fixed.SOURCE_TITLE, ""]


def test_separator_template(spark):
    text = joined(snapshot(spark, TREE, separator="{{{lang}}} {filepath}|{chars}|{tokens}"))
    assert "\n{javascript} src/{lang}.js|" in text
    with pytest.raises(Exception, match="unknown separator field"):
        joined(snapshot(spark, TREE, separator="{name}"))


def exchanges_above_texts(frame):
    """For every scan of a plan that reads contents, how many exchanges its rows pass."""
    found, above = [], []
    for line in frame._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = re.search(r"[A-Za-z(*]", line)
        if not depth:
            continue
        above = [(d, op) for d, op in above if d < depth.start()] + [(depth.start(), line[depth.start():])]
        if "FileScan" in line and "content" in line.split("ReadSchema")[-1]:
            found.append(sum(op.startswith(("Exchange", "BroadcastExchange")) for _, op in above))
    return found


def test_a_text_is_shuffled_once_or_not_at_all(spark, tmp_path):
    files = spark.createDataFrame([("p", *item) for item in TREE.items()], schemas.SOURCE_FILES)
    options = flatten.SnapshotOptions(generated="now")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    files.write.parquet(str(tmp_path / "plain"))
    sinks.write_source_table(files, "bucketed_files", path=str(tmp_path / "bucketed"))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for stored, most in ((spark.read.parquet(str(tmp_path / "plain")), 1), (spark.table("bucketed_files"), 0)):
            manifest = hand_over(classify.scan_files(stored), "manifest")
            positions = hand_over(sequence.default_positions(mf.sequence_leaves(manifest), stored), "positions")
            docs = hand_over(sequence.number_files(sequence.add_sizes(classify.find_docs(stored), manifest)), "docs")
            parts = flatten.flat_parts(manifest, stored, positions, docs, flatten.default_projects(manifest), options)
            assert exchanges_above_texts(parts) == [most]
            assert joined(parts) == expected(ORDER, DOCS)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE IF EXISTS bucketed_files")


def test_text_files_round_trip(spark, tmp_path):
    options = flatten.SnapshotOptions(generated="now", block_chars=30)
    sinks.write_flat_text(flatten.flat_blocks(snapshot(spark, TREE, options)), str(tmp_path / "flat"))
    names = sorted(glob.glob(str(tmp_path / "flat" / "project=p" / "part-*")))
    assert "".join(open(n, encoding="utf-8", newline="").read() for n in names) == expected(ORDER, DOCS)


def test_a_list_of_200000_entrypoints_is_written_byte_for_byte(spark, tmp_path):
    names = spark.range(200_000).selectExpr("'a/b %' AS project", "concat('d', id, '/main.py') AS path", "'' AS content")
    manifest = classify.scan_files(names)
    blocks = flatten.flat_blocks(flatten._entrypoints(manifest))
    assert blocks.count() == 4 and blocks.where(~F.endswith("text", F.lit("\n"))).count() == 3
    for _ in range(2):  # a second time over the first
        sinks.write_flat_text(blocks, str(tmp_path / "flat"))
    rows = tables.read_flat_text(spark, str(tmp_path / "flat")).orderBy("part").collect()
    listed = ", ".join(sorted((f"d{i}/main.py" for i in range(200_000)), key=lambda p: p))
    assert {r.project for r in rows} == {"a/b %"}
    assert "".join(r.text for r in rows) == f"entrypoints: {listed}\n"


def test_long_texts_go_on_in_new_files(spark, tmp_path, monkeypatch):
    rows = [("p", 4, b, f"é{b}\r\n" * 100) for b in range(20)] + [(None, 4, 0, ""), ("q", 4, 0, None), ("1", 0, 0, "x")]
    blocks = spark.createDataFrame(rows, "project string, section int, block bigint, text string").coalesce(1)
    monkeypatch.setattr(flattext, "FILE_BYTES", 1000)
    cloudpickle.register_pickle_by_value(flattext)
    try:
        sinks.write_flat_text(blocks, str(tmp_path / "flat"))
    finally:
        cloudpickle.unregister_pickle_by_value(flattext)
    found = tables.read_flat_text(spark, str(tmp_path / "flat")).orderBy("part").collect()
    assert "".join(r.text for r in found if r.project == "p") == "".join(r[3] for r in rows[:20])
    assert {r.project for r in found} >= {"p", "1"} and sum(r.project == "p" for r in found) > 5


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    good = spark.createDataFrame([("p", 0, 0, "kept")], "project string, section int, block bigint, text string")
    sinks.write_flat_text(good, str(tmp_path / "flat"))
    broken = F.when(F.col("block") == 7, F.raise_error(F.lit("lost"))).otherwise(F.lit("new"))
    bad = spark.range(40).select(F.lit("p").alias("project"), F.lit(0).alias("section"), F.col("id").alias("block")).withColumn("text", broken)
    with pytest.raises(Exception, match="lost"):
        sinks.write_flat_text(bad, str(tmp_path / "flat"))
    left = [p for p in (tmp_path / "flat").rglob("*") if p.is_file()]
    assert [p.read_text() for p in left] == ["kept"] and not list((tmp_path / "flat").glob("_job*"))


def test_tree_of_a_project_without_files(spark):
    projects = spark.createDataFrame(
        [("p", "r", True, "none", True, "trusted", True, fixed.SEPARATOR)], schemas.PROJECTS
    )
    empty = spark.createDataFrame([], schemas.SOURCE_FILES)
    manifest = classify.scan_files(empty)
    positions = sequence.default_positions(mf.sequence_leaves(manifest), empty)
    docs = sequence.number_files(sequence.add_sizes(classify.find_docs(empty), manifest))
    parts = flatten.flat_parts(manifest, empty, positions, docs, projects, flatten.SnapshotOptions("now"))
    assert joined(parts) == "\n".join(
        ["═══ CODEBASE SNAPSHOT ═══", "generated: now", "root: r", "total_files: 0", "total_tokens: ~0",
         "total_chars: 0", "", fixed.TREE_TITLE, "", "", fixed.SOURCE_TITLE, ""]
    )


def test_files_and_batches_of_flat_texts_are_small():
    """What a Python task holds at once follows these two sizes, times four cores and a few copies."""
    from arborlens.session import SETTINGS
    from arborlens.sources import flattext

    assert max(flattext.FILE_BYTES, int(SETTINGS["spark.sql.execution.arrow.maxBytesPerBatch"])) <= 8 << 20


# The clients below travel to the tasks with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def broken_client():
    def answer(request):
        raise RuntimeError("boom")

    return answer


def hasty_client():
    return lambda request: {"content": "d41d8cd98f00b204e9800998ecf8427e", "prompt_tokens": len(next(request["payload"])) - 1}


def test_a_failed_digest_is_no_result(spark, tmp_path, monkeypatch):
    rows = [(k, f"text {k}\nof it", "en") for k in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    for client, said in ((broken_client, "failed boom"), (hasty_client, "no digest of all of project")):
        monkeypatch.setattr(queries, "digest_client", client)
        with pytest.raises(Exception, match=said):
            queries.REGISTERED["flat_text_files"](spark, str(tmp_path)).collect()
