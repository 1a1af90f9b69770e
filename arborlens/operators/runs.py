"""Runs: keys, the latest run, rollups of responses, the gate and the cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.functions import paths, text
from arborlens.operators.ordering import number_rows


def with_run_key(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Add ``run_id``: rows of the same second belong to the same run."""
    return rows.withColumn("run_id", text.run_key(F.col(ts)))


def latest_run(runs: DataFrame, key: str = "project") -> DataFrame:
    """Greatest run key of each project."""
    return runs.groupBy(key).agg(F.max("run_id").alias("run_id"))


def rows_of_latest_run(rows: DataFrame, key: str = "project") -> DataFrame:
    return rows.join(latest_run(rows, key), [key, "run_id"], "left_semi")


def run_meta(responses: DataFrame) -> DataFrame:
    """Rollup of a run. Whatever is not complete counts as failed."""
    complete = F.col("status") == "complete"
    cost = [F.sum("cost_usd").alias("total_cost_usd")] if "cost_usd" in responses.columns else []
    return responses.groupBy("run_id").agg(
        *cost,
        F.count(F.lit(1)).alias("models_requested"),
        F.count_if(complete).alias("completed"),
        F.count_if(~complete).alias("failed"),
        F.max("latency_ms").alias("max_latency_ms"),
        F.sum(F.col("tokens_prompt") + F.col("tokens_completion")).alias("total_tokens"),
    )


def with_totals(meta: DataFrame, responses: DataFrame, totals: DataFrame, projects: DataFrame) -> DataFrame:
    """Add root, files and tokens of the project of each run."""
    which = responses.groupBy("run_id").agg(F.min("project").alias("project"))
    facts = totals.select("project", "total_files", F.col("total_tokens").alias("total_tokens_est"))
    known = which.join(projects.select("project", "root"), "project", "left").join(facts, "project", "left")
    return meta.join(known, "run_id")


def run_models(responses: DataFrame) -> DataFrame:
    """Models of a run by name, repeats kept: ``(run_id, pos, model)``."""
    rows = responses.select("run_id", "model", "generation_id")
    return number_rows(rows, ["run_id"], ["model", "generation_id"]).drop("generation_id")


def run_cost(costs: DataFrame) -> DataFrame:
    """Total cost of a run in millionths, which add up exactly."""
    return costs.groupBy("run_id").agg(F.sum("cost_micro_usd").alias("cost_micro_usd"))


def compare_gate(responses: DataFrame) -> DataFrame:
    """What follows a run: a comparison needs two completed models."""
    done = responses.groupBy("run_id").agg(F.count_if(F.col("status") == "complete").alias("completed"))
    action = F.when(F.col("completed") >= 2, "compare").when(F.col("completed") == 1, "skip").otherwise("error")
    return done.withColumn("action", action)


def enrich_cost(responses: DataFrame, stats: DataFrame) -> DataFrame:
    """Cost of each response from ``stats(generation_id, cost)``, 0 where none is known."""
    priced = responses.join(stats.select("generation_id", "cost"), "generation_id", "left")
    cost = F.coalesce("cost", F.lit(0.0))
    micro = F.round(cost * 1_000_000).cast("bigint")
    return priced.withColumns({"cost_usd": cost, "cost_micro_usd": micro}).drop("cost")


def status_board(responses: DataFrame) -> DataFrame:
    """One display row per response. ``responses`` carries ``cost_usd``."""
    tokens, cost = F.col("tokens_completion"), F.col("cost_usd")
    seconds = F.col("latency_ms") / 1000
    return responses.select(
        "run_id",
        "model",
        "status",
        F.when(tokens != 0, text.thousands(tokens)).otherwise("-").alias("tokens_label"),
        F.concat(text.fixed_point(seconds, 1), F.lit("s")).alias("seconds_label"),
        F.when(cost != 0, F.concat(F.lit("$"), text.fixed_point(cost, 4))).otherwise("-").alias("cost_label"),
    )


def response_json(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each response as a JSON document beside its file key, and the columns to ``keep``."""
    return responses.select(
        "run_id",
        "generation_id",
        paths.model_key(F.col("model")).alias("model_key"),
        F.to_json(F.struct(*responses.columns), {"ignoreNullFields": "false"}).alias("json"),
        *keep,
    )
