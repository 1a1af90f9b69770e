"""Ledger of answered requests: one small file for each answer, written by the task that got it.

A Spark job commits its rows when it ends, so the answers of a job that is killed are lost with it,
although they were paid for. The ledger holds an answer from the moment it is there. A retried task finds
it before it calls again, and a rerun leaves the request out before any text moves.

The folder must be one that every executor reaches through ``pyarrow.fs``: a shared folder, or an
object store or HDFS with its client installed.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from arborlens.sources.files import locate

KEY = "project string, pos int, model string"
OUTCOME = (
    "status string, latency_ms bigint, tokens_prompt bigint, tokens_completion bigint, "
    "cost_usd double, finish_reason string, generation_id string, raw_response string, error string"
)


@dataclass(frozen=True)
class Ledger:
    """The answers of one run under ``path``. Only calls that ``ended`` this way count as answered."""

    path: str
    ended: tuple[str, ...] = ("complete",)

    def _file(self, request: dict) -> tuple:
        """File system and name of the entry of a request."""
        key = json.dumps([str(request["project"]), int(request["pos"]), str(request["model"])])
        system, folder = locate(self.path)
        return system, f"{folder}/{hashlib.sha256(key.encode()).hexdigest()}.json"

    def find(self, request: dict) -> dict | None:
        """The outcome of a request that was answered."""
        from pyarrow import fs

        system, name = self._file(request)
        if system.get_file_info(name).type == fs.FileType.NotFound:
            return None
        with system.open_input_stream(name) as file:
            entry = json.loads(file.read())
        return {k: v for k, v in entry.items() if k not in ("project", "pos", "model")}

    def add(self, request: dict, outcome: dict) -> None:
        """Write an answer under another name first, so nobody reads half of one."""
        if outcome["status"] not in self.ended:
            return
        system, name = self._file(request)
        key = {k: request[k] for k in ("project", "pos", "model")}
        folder, _, last = name.rpartition("/")
        part = f"{folder}/_{uuid.uuid4().hex}-{last}"  # readers of tables pass over such names
        with system.open_output_stream(part) as file:
            file.write(json.dumps(key | outcome, default=int).encode())
        system.move(part, name)

    def answers(self, spark: SparkSession) -> DataFrame:
        """``project, pos, model`` and outcome of every answered request."""
        schema = f"{KEY}, {OUTCOME}"
        spark.createDataFrame([], schema).write.mode("append").json(self.path)  # makes the folder
        return spark.read.schema(schema).json(self.path)
