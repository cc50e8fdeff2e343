"""Access to shared storage from Python workers."""

from __future__ import annotations

import re

from pyarrow import fs

_registered: set[tuple[str, str]] = set()


def register_source(spark, source: type) -> None:
    """Register a Python data source once per application."""
    key = (spark.sparkContext.applicationId, source.name())
    if key not in _registered:
        spark.dataSource.register(source)
        _registered.add(key)


# Stores that Spark's connectors and pyarrow name differently, and those that pyarrow opens.
SAME_STORE = {"s3a": "s3", "s3n": "s3"}
STORES = ("s3", "gs", "gcs", "hdfs", "viewfs", "abfs", "abfss")


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute path; Spark writes local URIs with one slash.

    A store that Python workers cannot open is an error, never taken for a local path.
    """
    named = re.match(r"([A-Za-z][A-Za-z0-9+.-]+):(?=/)", uri)
    if not named:
        return fs.LocalFileSystem(), uri
    scheme, rest = named[1].lower(), uri[named.end():]
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    scheme = SAME_STORE.get(scheme, scheme)
    if scheme not in STORES:
        raise ValueError(f"Python workers cannot open {scheme}: paths; known: file, {', '.join((*SAME_STORE, *STORES))}")
    return fs.FileSystem.from_uri(f"{scheme}:{rest}")


def literal(path: str) -> str:
    """A path as a pattern that matches nothing else: glob characters are escaped."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def plain(pattern: str) -> str:
    """The path that ``literal`` was given."""
    return re.sub(r"\\(.)", r"\1", pattern)


def list_files(uris: list[str], suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """``(uri, size)`` of the files named, or found directly in the directories named, in name order.

    ``directory/*.ext`` narrows a directory to one extension, ``directory/start*.ext`` to names that begin so as well.
    """
    found = []
    for uri in uris:
        start, system, path = "", *locate(uri)
        info = system.get_file_info(path)
        folder, _, name = uri.rpartition("/")
        if "*" in name and info.type == fs.FileType.NotFound:
            uri, (start, _, extension) = folder, name.partition("*")
            suffixes = (extension,)
            system, path = locate(uri)
            info = system.get_file_info(path)
        if info.type == fs.FileType.Directory:
            inside = system.get_file_info(fs.FileSelector(path))
            prefix = uri.rstrip("/")
            found += sorted(
                (f"{prefix}/{i.base_name}", i.size) for i in inside
                if i.type == fs.FileType.File and i.base_name.startswith(start) and i.base_name.endswith(suffixes)
            )
        elif info.type == fs.FileType.File:
            found.append((uri, info.size))
    return found


#: A task reads small files up to so many bytes, or fewer where that would leave less than so many tasks.
TASK_BYTES = 32 << 20
TASKS = 64


def in_tasks(ranges: list, sizes: list[int]) -> list:
    """Ranges of files dealt to tasks in order, so that tasks follow the bytes and not the number of files.

    The first range of a task stands for it; its ``after`` takes the others.
    """
    most = min(TASK_BYTES, sum(sizes) // TASKS)
    tasks, held = [], 0
    for one, size in zip(ranges, sizes):
        if tasks and held + size <= most:
            tasks[-1].after.append(one)
            held += size
        else:
            tasks.append(one)
            held = size
    return tasks
