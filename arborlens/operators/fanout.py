"""Fan-out: payloads, one request per project and model, and the batch job that sends them."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator, Sequence
from itertools import chain, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens.functions import fixed, paths, text
from arborlens.operators.ordering import number_rows
from arborlens.operators.reports import parse_reports
from arborlens.session import hand_over
from arborlens.sources.ledger import OUTCOME, Ledger

DEFAULT_PROMPT = """\
Review the complete source code below as an independent software consultant.

You see the whole project once. Point to real files, functions and patterns. Say what is sound,
what is fragile and what you would change first, at the level of detail each finding deserves.
"""

PAYLOAD = ["project", "section", "block", "text"]


def parse_models(models: Column) -> Column:
    """Comma-separated model names to an array: trimmed, no empty names, repeats kept."""
    trimmed = F.transform(F.split(models, ","), text.trim_space)
    return F.filter(trimmed, lambda name: name != "")


def load_prompt(spark, path: str | None = None) -> str:
    """The prompt of a job: the default one, or a text file, which must exist."""
    if path is None:
        return DEFAULT_PROMPT
    found = spark.read.text(path, wholetext=True).first()
    # An empty file has no row. Line ends are those of the texts it stands before.
    return found["value"].replace("\r\n", "\n").replace("\r", "\n") if found else ""


def build_payloads(blocks: DataFrame, prompt: str) -> DataFrame:
    """Payloads as blocks ``(project, section, block, text)``, the prompt before those of the flat text.

    No row and no group holds a whole payload, so there is no limit to its length.
    """
    first = blocks.select("project").distinct().select(
        "project",
        F.lit(-1).alias("section"),
        F.lit(0).cast("bigint").alias("block"),
        F.lit(f"{prompt}\n\n").alias("text"),
    )
    return first.unionByName(blocks.select(*PAYLOAD))


def payload_sizes(payloads: DataFrame) -> DataFrame:
    return payloads.groupBy("project").agg(F.sum(F.length("text")).alias("payload_chars"))


def fan_out(
    projects: DataFrame,
    models: Sequence[str] | DataFrame,
    max_tokens: int = 16384,
    reasoning_effort: str | None = "high",
    response_format: str = "markdown",
) -> DataFrame:
    """One request per project and model, without the payload text.

    ``models`` is the list of one job, spread from a literal, or a table ``(project, pos, model)``
    joined on the project. ``pos`` tells repeats of a model apart.
    """
    if isinstance(models, DataFrame):
        spread = projects.join(models.select("project", "pos", "model"), "project")
    else:
        names = F.array(*[F.lit(m) for m in models])
        spread = projects.select("*", F.posexplode(names).alias("pos", "model"))
    provider = paths.provider(F.col("model"))
    cap = F.create_map(*[F.lit(x) for pair in fixed.PROVIDER_CAPS.items() for x in pair])[provider]
    effort = F.lit(reasoning_effort).cast("string")
    return spread.withColumns(
        {
            "provider": provider,
            "max_tokens": F.least(F.lit(max_tokens), F.coalesce(cap, F.lit(max_tokens))),
            "effort": F.when(~effort.isin("", "none"), effort),
            "json_mode": F.lit(response_format == "json"),
        }
    )


Client = Callable[[dict], dict]
#: Payloads above this many characters go to a task for each request, not one for all of the project.
SPLIT_CHARS = 16_000_000


def _within(timeout: float, client: Client, request: dict) -> dict:
    """The client's answer, or ``TimeoutError`` after ``timeout`` seconds whatever the client does.

    A call that goes on is left to its thread, which does not keep the process alive.
    """
    done: dict = {}

    def call() -> None:
        try:
            done["answer"] = client(request)
        except BaseException as problem:
            done["problem"] = problem

    thread = threading.Thread(target=call, daemon=True)
    thread.start()
    thread.join(timeout)
    if "problem" in done:
        raise done["problem"]
    if "answer" not in done:
        raise TimeoutError
    return done["answer"]


class _Blocks:
    """Text blocks of one request, in order. They end early once the call is given up.

    A call that was given up may still hold them; the lock keeps it from reading what the next
    request is about to read.
    """

    def __init__(self, texts: Iterator[str]):
        self._texts, self._lock, self._open = texts, threading.Lock(), True

    def __iter__(self) -> _Blocks:
        return self

    def __next__(self) -> str:
        with self._lock:
            if not self._open:
                raise StopIteration
            return next(self._texts)

    def close(self) -> None:
        with self._lock:
            self._open = False


def _outcome(client: Client, request: dict, texts: Iterator[str], timeout: float) -> dict:
    """Call the client for one request; whatever happens becomes a row."""
    started = time.monotonic()
    row = dict(
        status="complete", tokens_prompt=0, tokens_completion=0, cost_usd=0.0,
        generation_id="", raw_response="", error=None,
    )
    blocks = _Blocks(texts)
    try:
        answer = _within(timeout, client, {**request, "payload": blocks, "timeout": timeout})
        row.update(
            raw_response=answer.get("content") or "",
            finish_reason=answer.get("finish_reason") or "unknown",
            generation_id=answer.get("id") or "",
            tokens_prompt=answer.get("prompt_tokens") or 0,
            tokens_completion=answer.get("completion_tokens") or 0,
        )
    except TimeoutError:
        row.update(status="timeout", finish_reason="timeout", error=f"Timed out after {timeout}s")
    except Exception as problem:  # a failed call is a result, not a failed task
        row.update(status="failed", finish_reason="error", error=str(problem))
    finally:
        blocks.close()
    row["latency_ms"] = int((time.monotonic() - started) * 1000)
    return row


def dispatch(
    requests: DataFrame,
    payloads: DataFrame,
    make_client: Callable[[], Client],
    timeout: int = 600,
    max_concurrent: int | None = None,
    ledger: str | None = None,
    split_chars: int = SPLIT_CHARS,
) -> DataFrame:
    """Send ``requests(project, pos, model, ...)`` and return one response row each.

    ``payloads`` are those of ``build_payloads``. ``make_client`` runs in the task; the client takes
    a dict and returns a dict with ``content``, ``finish_reason``, ``id``, ``prompt_tokens`` and
    ``completion_tokens``, or raises. The ``payload`` of a request is an iterator of text blocks to
    stream or join. A call that takes longer than ``timeout`` is given up and becomes a ``timeout``
    row. At most ``max_concurrent`` calls run at once, as many as the cluster has cores by default;
    then each request of a payload above ``split_chars`` is a task that reads no other payload.

    ``ledger`` is the folder of this run's answers (see ``sources/ledger.py``). What is in it is not
    asked again, neither by a retried task nor by a rerun after the job was killed; calls that
    failed or timed out are. Without one a retried task calls again. Either way write the result
    once, before anything reads it twice.

    A text is shuffled to its project once and spread over the models inside the task, where the
    sort, which can spill, lays the blocks of each request side by side. Only a payload above
    ``split_chars`` is spread before the shuffle: then each of its requests is a task's work of its own.
    """
    spark = requests.sparkSession
    columns = requests.columns
    book = Ledger(ledger) if ledger else None
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields) + ", " + OUTCOME

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        rows = (row for batch in batches for row in batch.to_dict("records"))
        for _, group in groupby(rows, lambda r: (r["project"], r["pos"], r["_n"])):
            first = next(group)
            request = {c: first[c] for c in columns}
            texts = (r["_text"] for r in chain([first], group) if r["_text"] is not None)
            outcome = book.find(request) if book else None
            if outcome is None:
                outcome = _outcome(client, request, texts, timeout)
                if book:
                    book.add(request, outcome)
            yield pd.DataFrame([request | outcome])

    answered = None
    if book:
        done = hand_over(book.answers(spark).dropDuplicates(["project", "pos", "model"]), "answered")
        answered = requests.join(done, ["project", "pos", "model"]).select(*columns, *done.columns[3:])
        requests = requests.join(done.select("project", "pos", "model"), ["project", "pos", "model"], "left_anti").select(*columns)
    large = payload_sizes(payloads).where(F.col("payload_chars") > split_chars).select("project", F.lit(True).alias("_large"))
    # The requests of a project are as many as the models of a job. Those of a large one get a row each.
    placed = requests.join(large, "project", "left").withColumn("_place", F.when(F.col("_large"), F.col("pos")).otherwise(F.lit(0)))
    placed = hand_over(placed, "placed")
    # Large requests are dealt in turn: no task gets a second one before all have one.
    counted = number_rows(placed.where("_large").select("project", "pos"), [], ["project", "pos"], out="_turn")
    counted = hand_over(counted, "turns")
    tasks = max_concurrent or max(spark.sparkContext.defaultParallelism, counted.count())
    placed = placed.join(counted, ["project", "pos"], "left")
    asked = placed.groupBy("project", "_place", "_turn").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_requests"))
    asked = hand_over(asked, "asked")
    blocks = payloads.select("project", "section", "block", F.col("text").alias("_text"))
    # Every request is opened by a row without text, so the texts need no outer join: one would hold all texts of a project at
    # once. Here the few requests of a project wait for its texts, which stream by.
    none = [F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in ("section", "block", "_text")]
    opened = asked.select("project", *none, "_turn", "_requests")
    filled = blocks.join(asked, "project").select(*opened.columns)
    task = F.pmod(F.coalesce("_turn", F.xxhash64("project")), F.lit(tasks)).cast("int")
    sent = (
        filled.unionByName(opened)
        .repartitionById(tasks, task)
        .select("section", "block", "_text", F.posexplode("_requests").alias("_n", "_request"))
        .sortWithinPartitions("_request.project", "_request.pos", "_n", "section", "block")
        .select("_n", "_text", "_request.*")
        .mapInPandas(call, schema)
    )
    if answered is not None:
        sent = sent.unionByName(answered)
    wanted = F.col("json_mode") & (F.col("status") == "complete")
    return parse_reports(sent, F.when(wanted, F.col("raw_response")))
