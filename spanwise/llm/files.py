"""Binary files in the shared folder, written and read by tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs


def place(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder given as a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(folder.rstrip("/"))


def put(folder: str, name: str, content: bytes) -> str:
    """Write a file whole under a name of this attempt's own; return that name.

    A task that runs twice leaves two files; the reader is only told of the one whose
    task was committed.
    """
    system, path = place(folder)
    own = f"{name}-{uuid.uuid4().hex}"
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{own}") as out:
        out.write(content)
    return own


def get(folder: str, name: str) -> bytes:
    system, path = place(folder)
    with system.open_input_file(f"{path}/{name}") as source:
        return source.read()
