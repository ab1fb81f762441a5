"""Files of any store that Python can open: local and mounted ones directly, others (object stores, HDFS) by pyarrow's file systems.

A store that only Spark's readers can open (a Hadoop file system without a library for Python) is told by reachable(); text formats are then read by Spark's text
reader, and others by its binaryFile reader, a task a file.
"""

from __future__ import annotations

import os
from typing import BinaryIO
from urllib.parse import unquote, urlparse

from pyarrow import fs


def _place(path: str) -> tuple[fs.FileSystem | None, str]:
    """The file system of a path (None: local) and the path within it."""
    scheme = urlparse(path).scheme
    if scheme in ("", "file"):
        return None, unquote(urlparse(path).path) if scheme else path
    return fs.FileSystem.from_uri(path)


def reachable(path: str) -> bool:
    """Can Python open the store of these paths (comma-separated)?"""
    try:
        for p in path.split(","):
            _place(p)
    except (OSError, ValueError, ImportError):
        return False
    return True


def files(path: str) -> list[tuple[str, int]]:
    """The files of a path, a comma-separated list or a folder, with their sizes; hidden ones are left out."""
    out = []
    for p in path.split(","):
        system, at = _place(p)
        if system is None:
            found = sorted(os.path.join(at, f) for f in os.listdir(at) if not f.startswith((".", "_"))) if os.path.isdir(at) else [at]
            out += [(f, os.path.getsize(f)) for f in found]
            continue
        info = system.get_file_info(at)
        if info.type == fs.FileType.Directory:
            inside = sorted((i for i in system.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))), key=lambda i: i.path)
        elif info.type == fs.FileType.File:
            inside = [info]
        else:
            raise FileNotFoundError(p)
        parts = urlparse(p)
        root = f"{parts.scheme}://{parts.netloc}" if not at.startswith(parts.netloc) or not parts.netloc else f"{parts.scheme}://"
        out += [(root + i.path, i.size) for i in inside]
    return out


def opened(path: str) -> BinaryIO:
    """A file to read and seek in."""
    system, at = _place(path)
    return open(at, "rb") if system is None else system.open_input_file(at)
