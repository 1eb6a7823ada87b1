"""Folders and files of any store, from within tasks.

Paths of the local file system are listed and opened by the system's own calls,
which tell links and files that are filled on demand.  Paths with a scheme go
through Arrow's file systems (s3, gs, abfs, and through libhdfs whatever Hadoop
is configured for), with names as they are: none is hidden.
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs

# Attributes of entries that a cloud service fills when they are read: offline, recall on data access.
ON_DEMAND = 0x1000 | 0x400000
SCHEME = re.compile(r"(?!file:)[A-Za-z][A-Za-z0-9+.-]+://")


@dataclass(frozen=True)
class Entry:
    """kind: file, folder, link, demand (filled by a cloud service when it is opened) or other (a device)."""

    path: str
    kind: str
    size: int


def on_demand(about: os.stat_result) -> bool:
    return bool(getattr(about, "st_file_attributes", 0) & ON_DEMAND)


def is_remote(path: str) -> bool:
    return bool(SCHEME.match(path))


def local_path(path: str) -> str:
    """Without the scheme `file`."""
    return re.sub(r"^file:(?://)?(?=/)", "", path)


def _remote(uri: str) -> tuple[arrow_fs.FileSystem, str, str]:
    """The file system, the path in it, and what has to stand before its paths."""
    try:
        system, path = arrow_fs.FileSystem.from_uri(uri)
    except (ValueError, NotImplementedError):  # a scheme that only Hadoop knows
        scheme, _, rest = uri.partition("://")
        host, slash, path = rest.partition("/")
        system, path = arrow_fs.HadoopFileSystem(f"{scheme}://{host}"), slash + path
    at = uri.find(path.rstrip("/")) if path.strip("/") else len(uri.rstrip("/"))
    return system, path, uri[:at]


def _kind(about: os.stat_result) -> str:
    if on_demand(about):
        return "demand"
    mode = about.st_mode
    return "folder" if stat.S_ISDIR(mode) else "file" if stat.S_ISREG(mode) else "link" if stat.S_ISLNK(mode) else "other"


def look(path: str, follow: bool = False) -> Entry:
    """What a path is; `follow` looks through a link.  An OSError if it isn't there."""
    if not is_remote(path):
        about = os.stat(local_path(path)) if follow else os.lstat(local_path(path))
        return Entry(path, _kind(about), about.st_size)
    system, inner, _ = _remote(path)
    info = system.get_file_info([inner])[0]
    if info.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return Entry(path, "folder" if info.type == arrow_fs.FileType.Directory else "file", info.size or 0)


def entries(folder: str) -> Iterator[Entry]:
    """What is in a folder, one after another; links aren't followed."""
    if not is_remote(folder):
        with os.scandir(local_path(folder)) as found:
            for e in found:
                if e.is_symlink():
                    yield Entry(e.path, "link", 0)
                else:
                    about = e.stat(follow_symlinks=False)
                    yield Entry(e.path, _kind(about), about.st_size)
        return
    system, inner, before = _remote(folder)
    for info in system.get_file_info(arrow_fs.FileSelector(inner)):
        yield Entry(before + info.path, "folder" if info.type == arrow_fs.FileType.Directory else "file", info.size or 0)


def read(path: str, most: int) -> bytes:
    """At most `most` bytes of a file; all if that is negative."""
    if not is_remote(path):
        with open(local_path(path), "rb") as f:
            return f.read(most)
    system, inner, _ = _remote(path)
    with system.open_input_stream(inner) as f:
        return f.read(None if most < 0 else most)
