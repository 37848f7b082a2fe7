"""Files that tasks write and read in the shared folder, by any file system that Arrow can reach."""

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs as pafs


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, or of an absolute local path."""
    return pafs.FileSystem.from_uri(uri)


def write_whole(uri: str, body: Callable[[pa.NativeFile], None]) -> None:
    """Write a file under another name and move it in place, so that a lost or repeated attempt leaves no torn file."""
    system, path = locate(uri)
    folder, name = path.rsplit("/", 1)
    system.create_dir(folder, recursive=True)
    draft = f"{folder}/_draft-{uuid.uuid4().hex}-{name}"
    with system.open_output_stream(draft, compression=None) as sink:
        body(sink)
    system.move(draft, path)
