"""Places that tasks read and write within files."""

from __future__ import annotations

import os


def located(path: str):
    """The file system that pyarrow knows for a path or URI, and the place in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))
