"""Files that tasks write to the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """``folder`` is a URI, as ``common.shared_dir`` gives it: a bare path could mean another file system to Spark."""
    if ":/" not in folder:
        raise ValueError(f"not a URI: {folder}")
    return fs.FileSystem.from_uri(folder)


@contextmanager
def new_file(folder: str, suffix: str) -> Iterator[tuple[pa.NativeFile, str]]:
    """A file with a name of its own: a task that runs twice leaves two files, and only the one it reports is read."""
    system, root = open_folder(folder)
    system.create_dir(root, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    with system.open_output_stream(f"{root}/{name}", compression=None) as out:
        yield out, name


@contextmanager
def old_file(folder: str, name: str) -> Iterator[pa.NativeFile]:
    """A written file: memory-mapped where the folder is local, else opened for random access."""
    system, root = open_folder(folder)
    path = f"{root}/{name}"
    with pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path) as source:
        yield source
