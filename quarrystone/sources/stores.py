"""Stores by address, for Python workers that write or read single files."""

from __future__ import annotations

import pyarrow.fs


def file_system(path: str):
    """Any store that pyarrow knows by its address, and the path within it; plain paths are local or shared folders."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
