"""Plain files in folders that all executors reach, by URI."""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_whole(folder: str, name: str, chunks) -> int:
    """Writes a file under another name and moves it into place when it is complete; bytes written.

    A task that runs again, or twice at once, puts the same content in place.
    """
    store, path = opened(folder)
    store.create_dir(path, recursive=True)
    part, size = posixpath.join(path, f".{name}.{uuid.uuid4().hex}"), 0
    with store.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    store.move(part, posixpath.join(path, name))
    return size
