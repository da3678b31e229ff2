"""Numpy arrays as plain files in the shared folder, written by tasks and memory-mapped by other tasks.

Files appear whole or not at all (written aside, then renamed), so that repeated or lost tasks do no harm. A folder of a store
without a local path is reached through pyarrow's file systems; its files are fetched to the task's own temporary folder and
unlinked once mapped, so that nothing stays behind.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

import numpy as np


def local(folder: str) -> str | None:
    """The local path of a folder, None if it has another scheme."""
    url = urlparse(folder)
    return unquote(url.path) if url.scheme in ("", "file") else None


def save(folder: str, name: str, array: np.ndarray) -> None:
    path = local(folder)
    if path is None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        aside = f"{base}/.{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(aside) as f:
            f.write(np.ascontiguousarray(array).tobytes())
        store.move(aside, f"{base}/{name}")
        return
    os.makedirs(path, exist_ok=True)
    aside = f"{path}/.{name}-{uuid.uuid4().hex}"
    np.ascontiguousarray(array).tofile(aside)
    os.replace(aside, f"{path}/{name}")


def exists(folder: str, name: str) -> bool:
    path = local(folder)
    if path is not None:
        return os.path.exists(f"{path}/{name}")
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    return store.get_file_info(f"{base}/{name}").type == fs.FileType.File


def load(folder: str, name: str, dtype) -> np.ndarray:
    path = local(folder)
    if path is not None:
        return _mapped(f"{path}/{name}", dtype)
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    fd, copy = tempfile.mkstemp()
    try:
        with os.fdopen(fd, "wb") as out, store.open_input_stream(f"{base}/{name}") as f:
            while part := f.read(1 << 22):
                out.write(part)
        return _mapped(copy, dtype)
    finally:
        os.unlink(copy)


def _mapped(path: str, dtype) -> np.ndarray:
    return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype=dtype)
