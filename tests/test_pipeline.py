import sys

from pyspark import cloudpickle

from arborlens import schemas
from arborlens.plans import pipeline


# The client below travels to the tasks with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def client():
    def answer(request):
        if request["model"] == "m/none":
            raise RuntimeError("down")
        return {"content": f"{request['model']} read {sum(map(len, request['payload']))}", "finish_reason": "stop"}

    return answer


def test_scan_flatten_fire_report(spark, tmp_path):
    files = spark.createDataFrame(
        [("p", "main.py", "print(1)\n"), ("p", "lib/a.js", "let a = 1;\n"), ("q", "b.go", "package b\n")], schemas.SOURCE_FILES
    )
    out = str(tmp_path / "out")
    comparisons = pipeline.analyze(files, ["m/a", "m/b", "m/none"], client, out, "m/judge").collect()
    assert len(comparisons) == 2
    run = comparisons[0].run_id.split("/")[0]
    assert {r.run_id for r in comparisons} == {f"{run}/p", f"{run}/q"}
    assert all(r.comparison.startswith("m/judge read ") for r in comparisons)
    meta = spark.read.parquet(f"{out}/runs/{run}/run_meta").collect()
    assert {(r.project, r.root, r.total_files, r.total_cost_usd) for r in meta} == {("p", "p", 2, 0.0), ("q", "q", 1, 0.0)}
    assert {(r.run_id, r.completed, r.failed) for r in meta} == {(f"{run}/p", 2, 1), (f"{run}/q", 2, 1)}
    blocks = spark.read.parquet(f"{out}/runs/{run}/payloads").orderBy("section", "block").collect()
    payloads = {p: "".join(r.text for r in blocks if r.project == p) for p in "pq"}
    assert "print(1)" in payloads["p"] and "package b" in payloads["q"]
    answers = spark.read.parquet(f"{out}/runs/{run}/responses").where("model = 'm/a'").collect()
    assert {r.raw_response for r in answers} == {f"m/a read {len(t)}" for t in payloads.values()}
    documents = spark.read.parquet(f"{out}/runs/{run}/documents").collect()
    assert len(documents) == 6 and all(r.raw_response in r.json for r in documents)
    models = spark.read.parquet(f"{out}/runs/{run}/run_models").where(f"run_id = '{run}/p'").orderBy("pos").collect()
    assert [r.model for r in models] == ["m/a", "m/b", "m/none"]
    latest = pipeline.report_latest(spark.read.parquet(f"{out}/runs/{run}/responses"), "m/judge", client, f"{out}/again")
    assert {r.run_id for r in latest.collect()} == {f"{run}/p", f"{run}/q"}
    summary = pipeline.summary(spark, f"{out}/scan").where("project = 'p'").orderBy("section").collect()
    assert "".join(r.text for r in summary).endswith("- Entrypoints: main.py")


def test_no_comparison_for_one_answer(spark, tmp_path):
    files = spark.createDataFrame([("p", "main.py", "print(1)\n")], schemas.SOURCE_FILES)
    assert pipeline.analyze(files, ["m/a", "m/none"], client, str(tmp_path / "out"), "m/judge").collect() == []
