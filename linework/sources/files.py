"""Files that tasks write and read themselves."""

from __future__ import annotations

import os


def local_fs(path: str):
    """pyarrow file system and path of a Hadoop-style path."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path.removeprefix("file:")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)
