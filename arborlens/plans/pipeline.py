"""The four steps as jobs over many projects. Each step reads tables and writes tables.

A later step starts from what an earlier one wrote, so texts are cleaned once, responses are asked
for once, and a lost executor costs no more than the tasks it ran.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens.functions import tokens
from arborlens.operators import classify, fanout, flatten, reports, runs, sequence
from arborlens.operators import manifest as mf
from arborlens.sources import sinks


def now() -> datetime:
    return datetime.now(timezone.utc)


def run_name(moment: datetime) -> str:
    """Key of a run that starts now; runs of one second share it."""
    return moment.strftime("%Y-%m-%d_%H%M%S")


def scan(files: DataFrame, out: str, rules: classify.ScanRules = classify.ScanRules()) -> None:
    """Write ``manifest``, ``docs`` and ``projects`` of ``files(project, path, content)``."""
    spark = files.sparkSession
    sinks.write_table(classify.scan_files(files, rules), f"{out}/manifest")
    manifest = spark.read.parquet(f"{out}/manifest")
    docs = sequence.add_sizes(classify.find_docs(files), manifest)
    sinks.write_table(sequence.number_files(docs), f"{out}/docs")
    sinks.write_table(flatten.default_projects(manifest), f"{out}/projects")


def flatten_run(
    files: DataFrame,
    scanned: str,
    out: str,
    positions: DataFrame | None = None,
    options: flatten.SnapshotOptions | None = None,
    token_counter: tokens.TokenCounter = tokens.estimate,
) -> DataFrame:
    """Write ``blocks``, the flat texts, and return them. Default order unless ``positions`` is given."""
    spark = files.sparkSession
    manifest, docs, projects = (
        spark.read.parquet(f"{scanned}/{name}") for name in ("manifest", "docs", "projects")
    )
    if positions is None:
        positions = sequence.default_positions(mf.sequence_leaves(manifest), files)
    options = options or flatten.SnapshotOptions(generated=now().isoformat())
    parts = flatten.flat_parts(manifest, files, positions, docs, projects, options, token_counter)
    sinks.write_table(flatten.flat_blocks(parts), f"{out}/blocks")
    return spark.read.parquet(f"{out}/blocks")


def fire(
    blocks: DataFrame,
    models: Sequence[str] | DataFrame,
    make_client: Callable[[], fanout.Client],
    run_id: str,
    out: str,
    scanned: str | None = None,
    prompt: str = fanout.DEFAULT_PROMPT,
    timeout: int = 600,
    max_concurrent: int | None = None,
    **request: object,
) -> DataFrame:
    """Send every flat text to every model.

    Writes ``payloads``, ``responses``, the same as ``documents`` (JSON and text), ``run_meta`` and
    ``run_models``. The run of a project is ``<run_id>/<project>``. ``scanned`` adds the totals of the scan.
    Answers are booked in ``ledger`` as they come: the same call after a job was killed goes on where it stopped.
    """
    spark = blocks.sparkSession
    started = now().isoformat()
    sinks.write_table(fanout.build_payloads(blocks, prompt), f"{out}/payloads")
    payloads = spark.read.parquet(f"{out}/payloads")
    requests = fanout.fan_out(fanout.payload_sizes(payloads), models, **request).withColumn(
        "run_id", F.concat(F.lit(f"{run_id}/"), "project")
    )
    answers = fanout.dispatch(requests, payloads, make_client, timeout, max_concurrent, ledger=f"{out}/ledger")
    sinks.write_table(answers, f"{out}/responses")
    responses = spark.read.parquet(f"{out}/responses")
    sinks.write_responses(responses, f"{out}/documents", "overwrite")
    sinks.write_table(runs.run_models(responses), f"{out}/run_models")
    meta = runs.run_meta(responses)
    if scanned:
        totals = mf.scan_totals(spark.read.parquet(f"{scanned}/manifest"))
        meta = runs.with_totals(meta, responses, totals, spark.read.parquet(f"{scanned}/projects"))
    sinks.write_table(meta.withColumns({"prompt": F.lit(prompt), "started": F.lit(started)}), f"{out}/run_meta")
    return responses


def report(
    responses: DataFrame,
    model: str,
    make_client: Callable[[], fanout.Client],
    out: str,
    gate: bool = True,
) -> DataFrame:
    """Ask one model to compare the texts of each run, and write the completed ``comparisons``.

    With ``gate``, only runs with two completed models are compared.
    """
    if gate:
        ready = runs.compare_gate(responses).where("action = 'compare'").select("run_id")
        responses = responses.join(ready, "run_id", "left_semi")
    bundle = reports.consultation_bundle(reports.load_consultations(responses))
    spark = responses.sparkSession
    sinks.write_table(bundle.withColumnRenamed("run_id", "project"), f"{out}/bundles")
    payloads = spark.read.parquet(f"{out}/bundles")
    requests = fanout.fan_out(fanout.payload_sizes(payloads), [model], max_tokens=128000)
    requests = requests.withColumn("run_id", F.col("project"))
    sinks.write_table(fanout.dispatch(requests, payloads, make_client), f"{out}/syntheses")
    done = spark.read.parquet(f"{out}/syntheses")
    comparisons = done.where("status = 'complete'").select(
        "run_id", "model", F.col("raw_response").alias("comparison")
    )
    sinks.write_comparisons(comparisons, f"{out}/comparisons")
    return comparisons


def report_latest(responses: DataFrame, model: str, make_client: Callable[[], fanout.Client], out: str) -> DataFrame:
    """``report`` on the latest run of each project among stored ``responses`` of many runs."""
    return report(runs.rows_of_latest_run(responses), model, make_client, out)


def analyze(
    files: DataFrame,
    models: Sequence[str],
    make_client: Callable[[], fanout.Client],
    out: str,
    synthesis_model: str,
    rules: classify.ScanRules = classify.ScanRules(),
    **request: object,
) -> DataFrame:
    """All four steps: scan, flatten, fire and report."""
    run_id = run_name(now())
    scan(files, f"{out}/scan", rules)
    blocks = flatten_run(files, f"{out}/scan", f"{out}/runs/{run_id}")
    responses = fire(blocks, models, make_client, run_id, f"{out}/runs/{run_id}", f"{out}/scan", **request)
    return report(responses, synthesis_model, make_client, f"{out}/runs/{run_id}")


def summary(spark: SparkSession, scanned: str) -> DataFrame:
    """Summary text of a finished scan."""
    return mf.manifest_summary(spark.read.parquet(f"{scanned}/manifest"))
