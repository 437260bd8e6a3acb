"""Files read at places, by path or URI: mounted folders and any store that Arrow's file systems reach."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def store(path: str):
    """The file system of a path or URI, and the path inside it."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def open_at(path: str):
    """A file for reading at places."""
    held, inside = store(path)
    return held.open_input_file(inside)


def seekable(files: DataFrame) -> bool:
    """Whether the first of ``files`` (path) can be read at places; otherwise Spark's reader must bring whole files."""
    first = files.select("path").first()
    try:
        if first is not None:
            open_at(first["path"]).close()
        return True
    except Exception:  # noqa: BLE001  no such file system here, for whatever reason
        return False
