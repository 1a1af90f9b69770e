"""Reader for code trees on a file system that every executor mounts.

``spark.read.format("codetree").load(root)`` gives ``(project, path, content BINARY)``. The built-in
file sources cannot be used: they leave out names that start with ``_`` or ``.``. Folders are listed
on the driver only until there are enough of them to share out; the walk below them and all reading
happen in tasks. A large flat folder is shared out by a hash of the names. With ``content`` set to
``false`` no file is opened and the rows are ``(project, path, size)``. ``tables.read_tree`` lists a
tree in rounds and deals the files to its own tasks, so one large project is no large task.

Options: ``projects`` (``true``: every folder under the root is a project, ``false``: the root is
one), ``tasks``, ``extra_exclude`` (comma-separated globs), ``scan`` (``true``: leave out what a
scan leaves out before any file is opened), ``only`` (comma-separated projects) and ``under`` (a path
prefix): folders that cannot hold a wanted path are not opened. These are options and not pushed filters
because Spark 4.1 keeps the filters that one query pushed for the next query of the same load.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from arborlens.functions import fixed, globs
from arborlens.operators.classify import ScanRules

FLAT_FOLDER = 5_000
BATCH_BYTES = 16 * 1024 * 1024
BATCH_ROWS = 10_000
SCHEMA = pa.schema([("project", pa.string()), ("path", pa.string()), ("content", pa.binary())])
OPENED = pa.schema(
    [("project", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("deep", pa.bool_()), ("share", pa.int32()), ("shares", pa.int32())]
)
LISTING = pa.schema([("project", pa.string()), ("path", pa.string()), ("size", pa.int64())])


class Piece(InputPartition):
    """A folder, its whole subtree or its own files, or one share of its own files."""

    def __init__(self, project: str, folder: str, deep: bool, share: int = 0, shares: int = 1):
        self.project, self.folder, self.deep = project, folder, deep
        self.share, self.shares = share, shares


class Gate:
    """The scan filters for names and relative paths, as the reader needs them."""

    def __init__(self, rules: ScanRules | None):
        self.rules = rules
        if rules:
            def python(bodies: list[str]) -> re.Pattern:
                return re.compile(globs.anchored(bodies).replace(r"\z", r"\Z"))

            self.excluded = python([globs.exclude_body(p) for p in rules.excludes])
            self.pruned = set(rules.pruned)

    def enters(self, folder: str) -> bool:
        if not self.rules:
            return True
        probe = f"{folder}/x".lstrip("./").replace("\\", "/")
        return os.path.basename(folder) not in self.pruned and not self.excluded.search(probe)

    def reads(self, path: str) -> bool:
        if not self.rules:
            return True
        path = path.replace("\\", "/")
        name = os.path.basename(path)
        # As the column does: the last dot counts unless it is first or last.
        at = name.rfind(".")
        suffix = name[at:].lower() if 0 < at < len(name) - 1 else ""
        return suffix not in fixed.BINARY_SUFFIXES and not self.excluded.search(path)


def entries(root: str, folder: str) -> tuple[list[str], list[str]]:
    """Names of the sub-folders (links not followed) and of the regular files of a folder."""
    try:
        found = list(os.scandir(os.path.join(root, folder)))
    except OSError:
        return [], []
    below = [e.name for e in found if e.is_dir(follow_symlinks=False)]
    files = []
    for entry in found:
        try:
            if entry.is_file():
                files.append(entry.name)
        except OSError:
            pass
    return sorted(below), sorted(files)


def joined(folder: str, name: str) -> str:
    return f"{folder}/{name}" if folder else name


def encodes(path: str) -> bool:
    try:
        path.encode()
    except UnicodeError:
        return False
    return True


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.many = options.get("projects", "false") == "true"
        self.tasks = int(options.get("tasks", "64"))
        self.opens = options.get("content", "true") == "true"
        extra = tuple(g for g in options.get("extra_exclude", "").split(",") if g)
        self.rules = ScanRules(extra) if options.get("scan", "false") == "true" else None
        only = [p for p in options.get("only", "").split(",") if p]
        self.only: set[str] | None = set(only) if only else None
        self.prefixes = [p for p in [options.get("under", "")] if p]

    def wants(self, folder: str) -> bool:
        """Whether paths below a folder can begin with every prefix."""
        inside = f"{folder}/" if folder else ""
        return all(inside.startswith(p) or p.startswith(inside) for p in self.prefixes)

    def base(self, project: str) -> str:
        return os.path.join(self.root, project) if self.many else self.root

    def partitions(self) -> list[Piece]:
        """Open the folders level by level until there are enough pieces."""
        if not os.path.isdir(self.root):
            raise ValueError(f"not a folder: {self.root}")
        gate = Gate(self.rules)
        names = entries(self.root, "")[0] if self.many else [os.path.basename(os.path.abspath(self.root))]
        names = [n for n in names if self.only is None or n in self.only]
        open_pieces, pieces = [Piece(name, "", True) for name in names], []
        while open_pieces and len(open_pieces) + len(pieces) < self.tasks:
            below = []
            for piece in open_pieces:
                folders, files = entries(self.base(piece.project), piece.folder)
                shares = 1 + len(files) // FLAT_FOLDER
                pieces += [Piece(piece.project, piece.folder, False, n, shares) for n in range(shares)]
                wanted = [joined(piece.folder, name) for name in folders]
                below += [Piece(piece.project, f, True) for f in wanted if gate.enters(f) and self.wants(f)]
            open_pieces = below
        return pieces + open_pieces

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        """Arrow batches of the files of a piece, with their content or their sizes."""
        if self.opens:
            yield from self.contents((piece.project, path) for path in self.paths(piece))
            return
        rows = []
        for path in self.paths(piece):
            try:
                size = os.stat(os.path.join(self.base(piece.project), path)).st_size
            except OSError:
                continue
            rows.append({"project": piece.project, "path": path, "size": size})
            if len(rows) == BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(rows, LISTING)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, LISTING)

    def contents(self, files: Iterator[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        """Arrow batches of about ``BATCH_BYTES`` of content; unreadable files do not exist for a scan."""
        rows, size = [], 0
        for project, path in files:
            try:
                with open(os.path.join(self.base(project), path), "rb") as handle:
                    content = handle.read()
            except OSError:
                continue
            rows.append({"project": project, "path": path, "content": content})
            size += len(content)
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    def paths(self, piece: Piece) -> Iterator[str]:
        """Paths that pass the filters; names that are not UTF-8 are left out."""
        gate, pieces = Gate(self.rules), [piece]
        while pieces:
            below, found = self.opened(pieces.pop(), gate)
            pieces += below
            yield from found

    def opened(self, piece: Piece, gate: Gate) -> tuple[list[Piece], list[str]]:
        """What lies below a folder, and the files in it that are this piece's."""
        folders, files = entries(self.base(piece.project), piece.folder)
        below = []
        if piece.deep:
            wanted = (joined(piece.folder, name) for name in folders)
            below = [Piece(piece.project, f, True) for f in wanted if gate.enters(f) and self.wants(f)]
        found = []
        for name in files:
            path = joined(piece.folder, name)
            mine = piece.shares == 1 or zlib.crc32(os.fsencode(name)) % piece.shares == piece.share
            if mine and all(path.startswith(p) for p in self.prefixes) and gate.reads(path) and encodes(path):
                found.append(path)
        return below, found

    def listed(self, pieces: Iterable[Piece], budget: int) -> Iterator[pa.RecordBatch]:
        """Files with their sizes, and without a size the pieces left once ``budget`` files were seen.

        The files of a large folder are handed back in shares, unless this piece is one.
        """
        gate, seen = Gate(self.rules), 0
        todo, rows = list(pieces), []
        while todo:
            piece = todo.pop()
            left = [piece]
            if seen < budget:
                left, found = self.opened(piece, gate)
                shares = 1 + len(found) // FLAT_FOLDER
                if shares > 1 and piece.shares == 1:
                    left += [Piece(piece.project, piece.folder, False, n, shares) for n in range(shares)]
                    found = []
                seen += len(found)
                for path in found:
                    try:
                        size = os.stat(os.path.join(self.base(piece.project), path)).st_size
                    except OSError:
                        continue
                    rows.append((piece.project, path, size, None, None, None))
            if seen < budget and piece.shares == 1:
                todo += [p for p in left if p.deep]
                left = [p for p in left if not p.deep]
            rows += [(p.project, p.folder, None, p.deep, p.share, p.shares) for p in left]
            if rows and (len(rows) >= BATCH_ROWS or not todo):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), OPENED.types, strict=True)], schema=OPENED)
                rows = []


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "codetree"

    def schema(self) -> str:
        last = "content binary" if self.options.get("content", "true") == "true" else "size bigint"
        return f"project string, path string, {last}"

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))
