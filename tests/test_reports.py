import datetime
import json

import pytest
from pyspark.sql import functions as F

from arborlens.operators import catalog, reports, runs
from arborlens.sources import sinks, tables

TEXTS = [
    '{"consultation":"x"} junk', '{"consultation":"x","consultation":"y"}', "{'consultation':'x'}",
    '[{"consultation":"x"}]', '{"consultation":null}', '{"consultation":"x","key_concerns":null}',
    '{"consultation":"x","key_concerns":[]}', '{"consultation":"x","key_concerns":["a",1]}',
    '{"consultation":"x","key_concerns":["a",null]}', '{"consultation":"x","key_concerns":[null]}',
    '{"consultation":"x","key_concerns":{"a":1}}', '{"consultation":"x","o":{"z":[1,{}]}}', "5", "null", "", " ",
    '{"consultation":"x"', '{"consultation":"a\\u0041\\n"}', '  {"consultation":"x"}\n', '{"a":NaN,"consultation":"x"}',
    '{"consultation":"x",}', '{"consultation":"a\nb"}', '"text"', '{"Consultation":"x"}', '{"consultation":"x"}]',
    '{"consultation":"x"}]}', '{"consultation":"x"}}', '{"consultation":"x"},{"consultation":"y"}', "[]", "plain prose",
    '{"consultation":5}', '{"key_concerns":["a"]}', '{"consultation":"x","files_referenced":["m.py"],"key_strengths":["s"]}',
    '{"consultation":"x","key_strengths":"s"}', '{"consultation":"x","key_concerns":[["a"]]}', '{"consultation":true}', "{}",
    '```json\n{"consultation":"x"}\n```', '{"consultation":""}', '{"consultation":"x","key_concerns":["",""]}',
]


def by_hand(raw):
    """The report a strict JSON reader and a typed model would give."""
    try:
        value = json.loads(raw)
    except ValueError:
        return None
    if not isinstance(value, dict) or not isinstance(value.get("consultation"), str):
        return None
    lists = [value.get(name, []) for name in reports.LISTS]
    if not all(isinstance(v, list) and all(isinstance(x, str) for x in v) for v in lists):
        return None
    return (value["consultation"], *lists)


def test_report_shapes(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "n int, raw string")
    parsed = reports.parse_reports(frame, F.col("raw")).orderBy("n").collect()
    got = [tuple(r.report) if r.report else None for r in parsed]
    assert got == [by_hand(t) for t in TEXTS]
    assert sum(g is not None for g in got) == 9


def responses(spark, rows):
    """Rows ``(run_id, model, status, text)``."""
    full = [(r, m, s, 1500 + n, 10, 20, f"gen-{n}", t) for n, (r, m, s, t) in enumerate(rows)]
    return spark.createDataFrame(
        full,
        "run_id string, model string, status string, latency_ms bigint, tokens_prompt bigint, "
        "tokens_completion bigint, generation_id string, raw_response string",
    )


def test_gate_and_meta(spark):
    rows = [
        ("0", "a", "failed", ""), ("0", "b", "timeout", ""), ("0", "c", "failed", ""),
        ("1", "a", "complete", "x"), ("1", "b", "failed", ""), ("2", "a", "complete", "x"), ("2", "b", "complete", "y"),
    ]
    frame = responses(spark, rows)
    assert {r.run_id: r.action for r in runs.compare_gate(frame).collect()} == {"0": "error", "1": "skip", "2": "compare"}
    meta = {r.run_id: (r.models_requested, r.completed, r.failed, r.max_latency_ms) for r in runs.run_meta(frame).collect()}
    assert meta == {"0": (3, 0, 3, 1502), "1": (2, 1, 1, 1504), "2": (2, 2, 0, 1506)}


def test_consultations(spark):
    rows = [("r", "a", "complete", "A"), ("r", "a-b", "failed", ""), ("r", "x/y", "complete", "first"), ("r", "x--y", "complete", "last")]
    frame = responses(spark, rows).withColumn("pos", F.substring("generation_id", 5, 3).cast("int"))
    got = [(r.pos, r.model, r.text) for r in reports.load_consultations(frame).orderBy("pos").collect()]
    assert got == [(0, "a-b", ""), (1, "a", "A"), (2, "x/y", "last")]
    done = reports.load_consultations(frame, completed_only=True).orderBy("pos").collect()
    assert [r.model for r in done] == ["a", "x/y"]


def test_bundle(spark):
    frame = responses(spark, [("r", "model-a", "complete", "Report A content"), ("r", "model-b", "complete", "Report B\n")])
    consulted = reports.load_consultations(frame)

    def text(*size):
        blocks = reports.consultation_bundle(consulted, *size).orderBy("section", "block").collect()
        assert not size or all(len(b.text) < 2 * size[0] for b in blocks if b.section in (1, 3))
        return "".join(b.text for b in blocks)

    whole = text()
    assert "2 code review consultations by: model-a, model-b\n" in whole
    for title in ("High-Confidence Findings", "Disputed or Divergent Areas", "Unique Findings", "Prioritized Action Items"):
        assert title in whole
    frames = [
        line
        for m, t in (("model-a", "Report A content"), ("model-b", "Report B\n"))
        for line in (f"=== CONSULTATION FROM: {m} ===", "", t, "", f"=== END {m} ===", "")
    ]
    assert whole.endswith("---\n\n" + "\n".join(frames))
    for size in (1, 7, 60, 10_000):
        assert text(size) == whole


def test_bundle_of_long_and_many_texts(spark):
    """A text of many blocks beside empty ones and a run of many models."""
    rows = [("r", f"m{i:03}", "complete", "é" * (5000 if i == 7 else i % 3)) for i in range(200)] + [("s", "only", "complete", "")]
    consulted = reports.load_consultations(responses(spark, rows))
    whole = {r.run_id: r.text for r in reports.consultation_bundle(consulted).groupBy("run_id").agg(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY section, block)").alias("text")).collect()}
    blocks = reports.consultation_bundle(consulted, 1000).orderBy("section", "block").collect()
    assert max(len(b.text) for b in blocks if b.section != 2) < 2000
    for run in "rs":
        assert "".join(b.text for b in blocks if b.run_id == run) == whole[run]
    assert "é" * 5000 in whole["r"] and whole["r"].count("=== END m") == 200


def test_findings(spark):
    def report(*concerns, files=()):
        return json.dumps({"consultation": "c", "key_concerns": concerns, "files_referenced": files})

    rows = [
        ("r", "a", "complete", report("no tests", "slow", "slow", files=["m.py"])),
        ("r", "b", "complete", report("no tests", files=["m.py", "n.py"])),
        ("r", "c", "failed", report("no tests")), ("r", "d", "complete", "prose"),
    ]
    parsed = reports.with_reports(responses(spark, rows))
    found = {r.concern: (r.n_models, r.verdict, r.confidence) for r in reports.consensus_findings(parsed).collect()}
    assert found == {"no tests": (2, "convergent", "high"), "slow": (1, "unique", "medium")}
    assert {r.file: r.n_models for r in reports.file_mentions(parsed).collect()} == {"m.py": 2, "n.py": 1}
    matrix = {r.concern: (r.a, r.b, r.c) for r in reports.agreement_matrix(parsed, ["a", "b", "c"]).collect()}
    assert matrix == {"no tests": (1, 1, 0), "slow": (1, 0, 0)}
    named = reports.finding_models(parsed).where("concern = 'no tests'").orderBy("pos").collect()
    assert [(r.pos, r.model) for r in named] == [(0, "a"), (1, "b")]


def test_runs(spark):
    moment = datetime.datetime(2026, 3, 9, 14, 32, 0, 999999)
    rows = [("p", moment), ("p", moment.replace(microsecond=1)), ("p", moment.replace(hour=2)), ("q", moment)]
    keyed = runs.with_run_key(spark.createDataFrame(rows, "project string, ts timestamp_ntz"))
    assert runs.rows_of_latest_run(keyed).groupBy("project", "run_id").count().orderBy("project").collect() == [
        ("p", "2026-03-09_143200", 2), ("q", "2026-03-09_143200", 1),
    ]


def test_costs_and_board(spark):
    frame = responses(spark, [("r", "a", "complete", "x"), ("r", "b", "failed", "")])
    stats = spark.createDataFrame([("gen-0", 0.00125)], "generation_id string, cost double")
    priced = runs.enrich_cost(frame, stats)
    assert runs.run_cost(priced).first().cost_micro_usd == 1250
    board = {r.model: tuple(r)[2:] for r in runs.status_board(priced).collect()}
    assert board["a"] == ("complete", "20", "1.5s", f"${0.00125:.4f}") and board["b"][3] == "-"
    assert runs.status_board(priced.withColumn("tokens_completion", F.lit(0))).first().tokens_label == "-"


def test_response_sink(spark, tmp_path):
    frame = responses(spark, [("r1", "a/b", "complete", "Great."), ("r2", "c", "failed", "")])
    sinks.write_responses(frame, str(tmp_path / "responses"))
    back = {r.model_key: r for r in spark.read.parquet(str(tmp_path / "responses")).collect()}
    assert back["a--b"].run_id == "r1" and back["a--b"].raw_response == "Great."
    assert json.loads(back["c"].json)["status"] == "failed" and json.loads(back["c"].json)["raw_response"] == ""
    for run, key, text in (("r1", "a--b", "Great\nreport"), ("r1", "c", ""), ("r2", "c", "x")):
        (tmp_path / "runs" / run).mkdir(parents=True, exist_ok=True)
        (tmp_path / "runs" / run / f"{key}.md").write_text(text)
    read = tables.read_consultations(spark, str(tmp_path / "runs"))
    assert {tuple(r) for r in read.collect()} == {("r1", "a/b", "Great\nreport"), ("r1", "c", ""), ("r2", "c", "x")}


def test_catalogue(spark, tmp_path):
    (tmp_path / "models.json").write_text(
        json.dumps(
            {"data": [
                {"id": "a/b", "name": "Big One", "context_length": 1000000, "pricing": {"prompt": "0.000015", "completion": "0"}},
                {"id": "c", "pricing": {}}, {"name": "bigger", "context_length": 5, "extra": [1]},
            ]}
        )
    )
    models = catalog.flatten_catalog(tables.read_catalog(spark, str(tmp_path / "models.json")))
    assert {tuple(r) for r in models.collect()} == {
        ("a/b", "Big One", 1000000, 0.000015, 0.0), ("c", "", 0, 0.0, 0.0), ("", "bigger", 5, 0.0, 0.0),
    }
    assert sorted(r.id for r in catalog.search_catalog(models, "BIG").collect()) == ["", "a/b"]
    listed = catalog.list_catalog(models, "context", rows=2).orderBy("rank").collect()
    assert [tuple(r)[1:] for r in listed] == [(1, "a/b", "1,000,000", "$15.00", "free", 1), (2, "", "5", "free", "free", 1)]
    assert [r.id for r in catalog.list_catalog(models, "price").orderBy("rank").collect()] == ["", "c", "a/b"]


@pytest.mark.parametrize("sort", catalog.SORTS)
def test_listing_is_a_top_k(spark, sort):
    models = spark.range(200).select(
        F.concat(F.lit("m"), "id").alias("id"), F.lit("").alias("name"), "id", F.lit(0.0).alias("prompt_price"),
        F.lit(0.0).alias("completion_price"), (F.col("id") % 7).alias("context_length"),
    ).toDF("id", "name", "n", "prompt_price", "completion_price", "context_length")
    plan = catalog.list_catalog(models, sort)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert catalog.list_catalog(models, sort).count() == 50
