"""Byte ranges of files on a file system that the executors share: local paths, or URIs of any file system that Arrow knows."""

from __future__ import annotations

import os
from typing import BinaryIO


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def local_path(path: str) -> str | None:
    """The path of a local file; None for URIs of other file systems."""
    if path.startswith("file:"):
        return path.removeprefix("file:").replace("//", "", 1) if path.startswith("file://") else path.removeprefix("file:")
    return None if "://" in path else path


def size_of(path: str) -> int:
    local = local_path(path)
    if local is not None:
        return os.path.getsize(local)
    system, inner = _system(path)
    return system.get_file_info(inner).size


def open_range(path: str) -> BinaryIO:
    """The file for reading at any position."""
    local = local_path(path)
    if local is not None:
        return open(local, "rb")
    system, inner = _system(path)
    return system.open_input_file(inner)
