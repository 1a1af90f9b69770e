"""File systems by address, for code in tasks."""

from __future__ import annotations

from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyarrow.fs import FileSystem


def locate(path: str) -> tuple[FileSystem, str]:
    """File system and path inside it of an address; without a scheme it is a folder every machine mounts."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
