"""Binary files in the shared folder, from tasks and from the driver.

A ``file:`` URI or a plain path is a mounted folder; any other scheme goes through Arrow's file systems.
Files are written under a name of the attempt's own and renamed when whole, so a repeated or speculative
attempt leaves the same file and a reader never sees half of one.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
from pyarrow import fs as afs


def resolve(uri: str) -> tuple[afs.FileSystem, str]:
    if uri.startswith("file:"):
        return afs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return afs.LocalFileSystem(), uri
    return afs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    fs, path = resolve(uri)
    fs.create_dir(path, recursive=True)


@contextmanager
def whole_file(uri: str):
    """A binary stream whose file appears under ``uri`` only when the block ends well."""
    fs, path = resolve(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    stream = fs.open_output_stream(part)
    try:
        yield stream
    except BaseException:
        stream.close()
        fs.delete_file(part)
        raise
    stream.close()
    fs.move(part, path)


def mapped(uri: str, dtype: np.dtype) -> np.ndarray:
    """The file as one flat array: memory-mapped where it is mounted, else read."""
    fs, path = resolve(uri)
    if isinstance(fs, afs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r") if fs.get_file_info(path).size else np.zeros(0, dtype)
    with fs.open_input_stream(path) as f:
        return np.frombuffer(f.read(), dtype)


def mounted(uri: str) -> bool:
    return isinstance(resolve(uri)[0], afs.LocalFileSystem)


def size(uri: str) -> int:
    fs, path = resolve(uri)
    return fs.get_file_info(path).size


def read_range(uri: str, start: int, size: int) -> bytes:
    fs, path = resolve(uri)
    with fs.open_input_file(path) as f:
        f.seek(start)
        return f.read(size)
