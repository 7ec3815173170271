"""Files of any file system that pyarrow knows (local, HDFS, S3, GCS), for readers and writers in Python."""

from __future__ import annotations

import fnmatch
import glob
import io
import os
import posixpath
import shutil
from typing import BinaryIO


def _remote(path: str):
    """(file system, path in it, what stands before it) of a path with a scheme; None for a local path."""
    if "://" not in path or path.startswith("file:"):
        return None
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path)
    return system, inside, path[: len(path) - len(inside)]


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def expand(path: str) -> list[str]:
    """Files of a path, a folder or a pattern, in order."""
    remote = _remote(path)
    if not remote:
        path = local(path)
        if os.path.isdir(path):
            return sorted(p for p in glob.glob(os.path.join(path, "**"), recursive=True) if os.path.isfile(p))
        return sorted(glob.glob(path))
    from pyarrow import fs

    system, inside, scheme = remote
    info = system.get_file_info(inside)
    if info.type == fs.FileType.File:
        return [path]
    # a pattern is looked for below the last folder without one
    parts = inside.split("/")
    base = "/".join(parts[: next((i for i, p in enumerate(parts) if any(c in p for c in "*?[")), len(parts))])
    found = [f.path for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True)) if f.type == fs.FileType.File]
    return sorted(scheme + f for f in found if info.type == fs.FileType.Directory or fnmatch.fnmatchcase(f, inside))


def size(path: str) -> int:
    remote = _remote(path)
    return remote[0].get_file_info(remote[1]).size if remote else os.path.getsize(local(path))


def open_read(path: str) -> BinaryIO:
    remote = _remote(path)
    return io.BufferedReader(remote[0].open_input_file(remote[1]), 1 << 20) if remote else open(local(path), "rb")


def open_write(path: str) -> BinaryIO:
    """A new file; its folder is made if it isn't there."""
    remote = _remote(path)
    if remote:
        remote[0].create_dir(posixpath.dirname(remote[1]), recursive=True)
        return remote[0].open_output_stream(remote[1])
    os.makedirs(os.path.dirname(local(path)) or ".", exist_ok=True)
    return open(local(path), "wb")


def remove_folder(path: str) -> None:
    """Deletes a folder with all in it, if it is there."""
    remote = _remote(path)
    if not remote:
        shutil.rmtree(local(path), ignore_errors=True)
    elif remote[0].get_file_info(remote[1]).is_file is False and remote[0].get_file_info(remote[1]).type.name == "Directory":
        remote[0].delete_dir(remote[1])
