"""The registered queries: each operator over the given tables, as a function of (spark, folder)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens.functions import fixed, paths, text, tokens
from arborlens.operators import (
    catalog, classify, excludes, fanout, flatten, graph, imports, mentions, ordering, reports, runs, sequence, topics,
)
from arborlens.operators import manifest as mf
from arborlens.plans import views
from arborlens.session import configure, hand_over, scratch_path
from arborlens.sources import sinks, tables

# Small enough that a project fills several blocks at every scale of the test data.
BLOCK_CHARS = 50_000
MODELS = ("anthropic/a", "openai/b", "google/c", "mistral/d", "local")
OPTIONS = flatten.SnapshotOptions(generated="2024-01-01T00:00:00+00:00", block_chars=BLOCK_CHARS)
PROMPT = "Review this code."

REGISTERED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run: Callable[[views.Inputs], DataFrame]):
    """Register a query under the name of its function."""

    def call(spark: SparkSession, folder: str) -> DataFrame:
        return run(views.Inputs(configure(spark), folder))

    REGISTERED[run.__name__] = call
    return run


def digest(column: Column | str) -> list[Column]:
    column = F.col(column) if isinstance(column, str) else column
    return [F.md5(column).alias("md5"), F.length(column).cast("bigint").alias("chars")]


def kept(data: views.Inputs) -> DataFrame:
    return classify.keep_scanned(data.files)


# Scan


@query
def scan_files(data):
    return classify.scan_files(data.files)


@query
def language_detect(data):
    return data.files.select("project", "path", paths.language(F.col("path")).alias("lang"))


@query
def binary_filter(data):
    return data.files.where(~paths.is_binary(F.col("path"))).select("project", "path")


@query
def exclude_filter(data):
    return data.files.where(~classify.is_excluded(F.col("path"))).select("project", "path")


@query
def project_excludes(data):
    """Files that the excludes of their own project leave."""
    files = data.files.select("project", "path")
    return excludes.drop_excluded(files, data.sql(views.PROJECT_EXCLUDES, files=files))


@query
def prune_dirs(data):
    rules = classify.ScanRules(extra_exclude=("cmd/*", "app/fr/**"))
    return data.files.where(~classify.in_pruned_folder(F.col("path"), rules)).select("project", "path")


@query
def entrypoints(data):
    return mf.entrypoints(classify.scan_files(data.files))


@query
def doc_discovery(data):
    return sequence.number_files(classify.find_docs(data.files))


@query
def walk_order(data):
    return classify.walk_order(kept(data))


@query
def group_files(data):
    return mf.group_files(classify.scan_files(data.files))


@query
def scan_totals(data):
    return mf.scan_totals(classify.scan_files(data.files))


@query
def language_stats(data):
    return mf.language_stats(classify.scan_files(data.files))


@query
def language_share(data):
    shares = mf.language_share(mf.language_stats(classify.scan_files(data.files)))
    return shares.select("project", "lang", "pct", "label")


@query
def default_sequence(data):
    return mf.default_sequence(classify.scan_files(data.files))


@query
def manifest_summary(data):
    summary = mf.manifest_summary(classify.scan_files(data.files))
    return summary.withColumn("section", F.col("section").cast("bigint"))


@query
def manifest_roundtrip(data):
    from arborlens import schemas

    scanned = classify.scan_files(data.files)
    path = scratch_path(scanned.sparkSession, "manifest")
    sinks.write_table(scanned, path)
    return tables.read_table(scanned.sparkSession, path, schemas.MANIFEST_FILES)


# Clean


@query
def token_estimate(data):
    content = F.col("content")
    return data.files.select(
        "project", "path", F.length(content).cast("bigint").alias("chars"),
        tokens.estimate(content).alias("tokens"),
    )


@query
def decode_text(data):
    raw = data.sql("""
        SELECT doc_id, concat(x'61ff62e282', CAST(text AS BINARY), x'0d0a',
               CASE WHEN doc_id % 2 = 0 THEN x'efbfbdc3' ELSE x'eda080f09f' END,
               CAST(lang AS BINARY), x'0d', x'f09f9880', x'0a') AS content
        FROM documents""")
    decoded = raw.select("doc_id", text.decode(F.col("content")).alias("text"))
    return decoded.select("doc_id", *digest("text"))


@query
def strip_comments(data):
    web = data.sql(views.PAGES)
    files = kept(data).unionByName(web).withColumn("lang", paths.language(F.col("path")))
    cleaned = files.withColumn("text", text.strip_comments(F.col("content"), F.col("lang")))
    return cleaned.select("project", "path", "lang", *digest("text"))


@query
def collapse_whitespace(data):
    modes = F.explode(F.array(*[F.lit(m) for m in fixed.WHITESPACE_MODES])).alias("mode")
    spread = kept(data).select("project", "path", "content", modes)
    cleaned = spread.withColumn("text", text.collapse_whitespace(F.col("content"), F.col("mode")))
    return cleaned.select("project", "path", "mode", *digest("text"))


# Flatten


class Snapshot:
    """What the flatten queries share."""

    def __init__(self, data: views.Inputs):
        self.files = data.files
        self.manifest = hand_over(classify.scan_files(data.files), "manifest")
        self.projects = flatten.default_projects(self.manifest)

    @cached_property
    def positions(self) -> DataFrame:
        """Written down, as parts use it many times over."""
        return hand_over(sequence.default_positions(mf.sequence_leaves(self.manifest), self.files), "positions")

    @cached_property
    def docs(self) -> DataFrame:
        return hand_over(sequence.number_files(sequence.add_sizes(classify.find_docs(self.files), self.manifest)), "docs")

    def parts(self) -> DataFrame:
        return flatten.flat_parts(
            self.manifest, self.files, self.positions, self.docs, self.projects, OPTIONS
        )


def part_digest(parts: DataFrame) -> DataFrame:
    return parts.select(
        "project", F.col("section").cast("bigint").alias("section"), "block", "item", *digest("text")
    )


@query
def file_tree(data):
    return flatten.file_tree(Snapshot(data).positions)


@query
def file_separators(data):
    settings = kept(data).withColumns(
        {
            "strip_comments": F.lit(True),
            "whitespace": F.lit("aggressive"),
            "separator": F.lit(fixed.SEPARATOR),
        }
    )
    return flatten.clean_files(settings).select("project", "path", "line")


@query
def flat_header(data):
    shot = Snapshot(data)
    header = flatten.flat_header(shot.manifest, shot.positions, shot.projects, OPTIONS)
    return header.select("project", F.col("section").cast("bigint").alias("section"), "block", "item", "text")


@query
def flat_docs(data):
    shot = Snapshot(data)
    return part_digest(flatten.flat_docs(shot.docs, shot.files, shot.projects, BLOCK_CHARS))


@query
def flat_parts(data):
    return part_digest(Snapshot(data).parts())


@query
def flat_text(data):
    blocks = flatten.flat_blocks(Snapshot(data).parts())
    return blocks.select(
        "project", F.col("section").cast("bigint").alias("section"), "block", *digest("text")
    )


@query
def flat_text_files(data):
    """Flat texts written as files and read back: length and MD5 of what the files of a project hold."""
    folder = scratch_path(data.spark, "flat")
    sinks.write_flat_text(flatten.flat_blocks(Snapshot(data).parts()), folder)
    files = tables.read_flat_text(data.spark, folder)
    sent = files.select("project", F.lit(0).alias("section"), F.col("part").alias("block"), "text")
    requests = fanout.fan_out(fanout.payload_sizes(sent), ["local"])
    answers = whole(fanout.dispatch(requests, sent, digest_client))
    return answers.select("project", F.col("tokens_prompt").alias("chars"), F.col("raw_response").alias("md5"))


# Sequences


def sequence_nodes(data: views.Inputs) -> DataFrame:
    paths_only = kept(data).select("file_id", "project", "path")
    return hand_over(data.sql(views.SEQUENCE_NODES, kept=paths_only), "nodes")


@query
def sequence_resolve(data):
    return sequence.resolve_sequence(sequence_nodes(data), data.files)


@query
def sequence_glob(data):
    found = sequence.glob_files(sequence.tree_leaves(sequence_nodes(data)), data.files)
    found = found.withColumn("_parts", paths.parts_key(F.col("path")))
    numbered = ordering.number_rows(
        found.select("project", "_glob", "path", "_parts"), ["project", "_glob"], ["_parts"]
    )
    return numbered.select("project", F.col("_glob").alias("pattern"), "pos", "path")


@query
def sequence_dedup(data):
    found = sequence.leaf_files(sequence.tree_leaves(sequence_nodes(data)), data.files)
    times = found.groupBy("project", "path").agg(F.count(F.lit(1)).alias("n"))
    return sequence.number_files(found).join(times, ["project", "path"]).select("project", "pos", "path", "n")


# Imports and dependency order


def dependency_graph(data: views.Inputs) -> tuple[DataFrame, DataFrame]:
    nodes = kept(data).select("project", "path")
    return nodes, imports.import_edges(imports.extract_imports(kept(data)), nodes)


@query
def extract_imports(data):
    return imports.extract_imports(kept(data))


@query
def import_edges(data):
    return dependency_graph(data)[1]


@query
def dependency_degree(data):
    return imports.dependency_degree(*dependency_graph(data))


@query
def dependency_levels(data):
    return graph.dependency_levels(*dependency_graph(data))


@query
def dependency_order(data):
    return graph.dependency_order(*dependency_graph(data))


@query
def cycle_remainder(data):
    return graph.cycle_remainder(*dependency_graph(data))


# Fan-out


@query
def model_list(data):
    listed = data.catalog.select(
        "id", F.concat(F.lit(" "), "id", F.lit(", ,"), "name", F.lit("\t,"), "id", F.lit(",")).alias("models")
    )
    models = fanout.parse_models(F.col("models"))
    return listed.select("id", F.posexplode(models).alias("pos", "model")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


def payloads(data: views.Inputs) -> DataFrame:
    blocks = hand_over(flatten.flat_blocks(Snapshot(data).parts()), "blocks")
    return fanout.build_payloads(blocks, PROMPT)


def digest_client() -> fanout.Client:
    """Answers with what it was sent: length and MD5 of the streamed payload."""

    def answer(request: dict) -> dict:
        seen, chars = hashlib.md5(), 0
        for block in request["payload"]:
            seen.update(block.encode())
            chars += len(block)
        return {"content": seen.hexdigest(), "prompt_tokens": chars}

    return answer


def whole(answers: DataFrame) -> DataFrame:
    """Answers of ``digest_client``, of which none may have failed, run out of time or read less than its payload."""
    found = (F.col("status") == "complete") & F.col("tokens_prompt").eqNullSafe(F.coalesce("payload_chars", F.lit(0)))
    said = F.concat_ws(" ", F.lit("no digest of all of project"), "project", F.lit("-"), "status", "error")
    return answers.where(F.when(found, True).otherwise(F.raise_error(said).cast("boolean")))


@query
def payload_build(data):
    sent = payloads(data)
    requests = fanout.fan_out(fanout.payload_sizes(sent), ["local"])
    answers = fanout.dispatch(requests, sent, digest_client)
    return answers.select("project", F.col("tokens_prompt").alias("payload_chars"), F.col("raw_response").alias("md5"))


@query
def request_fanout(data):
    requests = fanout.fan_out(fanout.payload_sizes(payloads(data)), MODELS, max_tokens=128000, response_format="json")
    return requests.select(
        "project", "payload_chars", "model", "provider",
        F.col("max_tokens").cast("bigint").alias("max_tokens"), "effort", "json_mode",
    )


@query
def model_key_roundtrip(data):
    key = paths.model_key(F.col("model"))
    return data.responses.select(
        "generation_id", "model", key.alias("model_key"), paths.model_from_key(key).alias("back")
    )


def scripted_client() -> fanout.Client:
    """Answers from the request alone: one provider is slow, one fails, the others report."""

    def answer(request: dict) -> dict:
        size = sum(map(len, request["payload"]))
        if request["provider"] == "mistral":
            raise TimeoutError
        if request["provider"] == "unknown":
            raise ValueError("no such model")
        return {
            "content": f'{{"consultation": "{size} characters"}}',
            "finish_reason": "stop" if request["provider"] != "google" else None,
            "id": f"gen-{size}",
            "prompt_tokens": size // 4,
            "completion_tokens": 7,
        }

    return answer


@query
def batch_infer(data):
    sent = payloads(data)
    requests = fanout.fan_out(fanout.payload_sizes(sent), MODELS, response_format="json")
    answers = fanout.dispatch(requests, sent, scripted_client, timeout=600)
    return answers.select(
        "project", "model", "status", "tokens_prompt", "tokens_completion", "finish_reason",
        "generation_id", "error", F.col("report.consultation").alias("consultation"),
    )


# Runs


@query
def run_key(data):
    return runs.with_run_key(data.table("events")).select("event_id", "run_id")


@query
def latest_run(data):
    keyed = runs.with_run_key(data.table("events"))
    return runs.rows_of_latest_run(keyed, "user_id").select("user_id", "run_id", "event_id")


@query
def run_meta(data):
    return runs.run_meta(data.responses)


@query
def run_models(data):
    return runs.run_models(data.responses)


def priced(data: views.Inputs) -> DataFrame:
    return runs.enrich_cost(data.responses, data.sql(views.GENERATION_STATS))


@query
def status_board(data):
    return runs.status_board(priced(data))


@query
def compare_gate(data):
    return runs.compare_gate(data.responses)


@query
def cost_enrich(data):
    return priced(data).select("generation_id", "cost_micro_usd")


@query
def run_cost(data):
    return runs.run_cost(priced(data))


@query
def load_consultations(data):
    return reports.load_consultations(data.responses).select("run_id", "pos", "model", "text")


@query
def response_json(data):
    document = F.from_json("json", "model string, status string, latency_ms bigint, raw_response string")
    read = runs.response_json(data.responses).withColumn("r", document)
    return read.select("generation_id", "model_key", "r.model", "r.status", "r.latency_ms", "r.raw_response")


# Reports


def parsed(data: views.Inputs) -> DataFrame:
    """Parsed reports as the table that a run leaves behind."""
    reported = reports.with_reports(data.responses).select("run_id", "model", "report")
    return hand_over(reported, "reports")


@query
def report_parse(data):
    report = F.col("report")
    return reports.with_reports(data.responses).select(
        "generation_id",
        report.isNotNull().alias("has_report"),
        report["consultation"].alias("consultation"),
        F.size(report["files_referenced"]).cast("bigint").alias("n_files"),
        F.size(report["key_concerns"]).cast("bigint").alias("n_concerns"),
    )


@query
def consultation_bundle(data):
    blocks = reports.consultation_bundle(reports.load_consultations(data.responses))
    return blocks.select("run_id", F.col("section").cast("bigint").alias("section"), "block", *digest("text"))


@query
def consensus_findings(data):
    return reports.consensus_findings(parsed(data))


def worded(data: views.Inputs) -> DataFrame:
    """Lines of the documents as concerns in words: many runs, every document a review by one model."""
    lines = data.table("documents").select(
        (F.col("doc_id") % 16).alias("run_id"),
        F.get(F.array(*map(F.lit, MODELS)), (F.col("doc_id") % 5).cast("int")).alias("model"),
        F.when(F.col("doc_id") % 3 == 0, "Note: ").otherwise("").alias("opening"),
        F.explode(F.split("text", "\n")).alias("line"),
    )
    return lines.where("line <> ''").select("run_id", "model", F.concat("opening", "line").alias("concern")).distinct()


@query
def concern_topics(data):
    return topics.concern_topics(worded(data)).select(
        "run_id", F.md5("concern").alias("concern"), F.md5("topic").alias("topic")
    )


@query
def topic_findings(data):
    found = topics.topic_findings(worded(data))
    return found.withColumn("topic", F.md5("topic"))


@query
def disputed_areas(data):
    return topics.disputed_areas(parsed(data))


@query
def finding_models(data):
    return reports.finding_models(parsed(data))


@query
def agreement_matrix(data):
    return reports.agreement_matrix(parsed(data), MODELS)


@query
def file_mentions(data):
    return reports.file_mentions(parsed(data))


@query
def mention_files(data):
    files = data.files.select("file_id", "project", "path")
    return mentions.resolve_mentions(data.sql(views.MENTIONS, files=files), files)


@query
def mentioned_files(data):
    files = data.files.select("file_id", "project", "path")
    return mentions.mentioned_files(data.sql(views.MENTIONS, files=files), files)


# Catalogue


@query
def catalog_flatten(data):
    return catalog.flatten_catalog(data.sql(views.CATALOG_DOCUMENTS))


@query
def catalog_search(data):
    return catalog.search_catalog(data.catalog, "Rand-1").select("id", "name")


@query
def catalog_listing(data):
    listings = [catalog.list_catalog(data.catalog, sort) for sort in catalog.SORTS]
    return listings[0].unionByName(listings[1]).unionByName(listings[2])
