"""Writer for flat texts: ``df.write.format("flattext").mode("overwrite").save(folder)``.

Rows ``(project, section, block, text)`` that are range-partitioned and sorted by their first three columns
become files ``project=<name>/part-<task>-<number>.txt``. The bytes of the texts follow each other
with nothing between them, so a block may end inside a line; the files of a project, read in the order
of their names, are its text.

Tasks write under a folder of the job and report what they wrote. Only a job whose tasks all came
through moves its files to their place; what a failed, retried or speculative task left goes with
the job's folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from arborlens.sources.files import locate

#: A task goes on in a new file from here, so no file needs one large row to be read. Rows of a file are copied and sorted whole.
FILE_BYTES = 1024 * 1024
# Fixed value: the folder that Spark reads as a null partition value.
NO_PROJECT = "__HIVE_DEFAULT_PARTITION__"


@dataclass
class Written(WriterCommitMessage):
    """``(name under the job's folder, name under the target)`` of every file of a task."""

    files: list[tuple[str, str]]


def folder_name(project: str | None) -> str:
    """Partition folder; what is not plain stands as ``%XX``, which Spark turns back."""
    return f"project={NO_PROJECT if project is None else quote(project, safe=' -_.,;+@~()')}"


class FlatTextWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        if not overwrite:
            raise ValueError("flat texts are written whole: use mode overwrite")
        self.path, self.job = path, f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = locate(self.path)
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        files: list[tuple[str, str]] = []
        held: tuple[str | None] | None = None
        stream, size = None, 0
        try:
            for batch in iterator:
                for project, text in zip(batch.column("project").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if held != (project,) or size >= FILE_BYTES:
                        if stream:
                            stream.close()
                        number = len(files)
                        files.append((f"{attempt}-{number}", f"{folder_name(project)}/part-{task:06}-{number:06}.txt"))
                        system.create_dir(f"{base}/{self.job}", recursive=True)
                        stream, size, held = system.open_output_stream(f"{base}/{self.job}/{files[-1][0]}"), 0, (project,)
                    size += stream.write((text or "").encode())
        finally:
            if stream:
                stream.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, base = locate(self.path)
        system.create_dir(base, recursive=True)
        for old in system.get_file_info(fs.FileSelector(base)):
            if old.base_name != self.job:
                (system.delete_dir if old.type == fs.FileType.Directory else system.delete_file)(old.path)
        for mine, name in (f for m in messages if m for f in m.files):
            system.create_dir(f"{base}/{name.rpartition('/')[0]}", recursive=True)
            system.move(f"{base}/{self.job}/{mine}", f"{base}/{name}")
        self._drop(system, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(*locate(self.path))

    def _drop(self, system, base: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{base}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{self.job}")


class FlatTextSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flattext"

    def writer(self, schema, overwrite: bool) -> FlatTextWriter:
        return FlatTextWriter(self.options["path"], overwrite)
