"""Files that tasks write to, and read from, the folder shared by all executors.

A task attempt writes under a name of its own and reports it in its output row; only files
named in a written manifest count, so that attempts that failed or ran twice do no harm.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs), or the local one for a plain path."""
    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


def create(folder: str, stem: str, suffix: str) -> tuple[str, object]:
    """A new file in `folder`: its URI and a stream to write to."""
    uri = f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"
    system, path = at(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return uri, system.open_output_stream(path, compression=None)  # not by the name's ending


def read(uri: str) -> bytes:
    system, path = at(uri)
    with system.open_input_stream(path, compression=None) as f:
        return f.read()
