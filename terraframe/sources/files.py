"""Files in any store that pyarrow opens: local paths and URIs."""

from __future__ import annotations

import atexit
import os
import posixpath
import shutil
import tempfile
from contextlib import contextmanager


def shared(spark) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where both are on one machine is one made if that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        at = f"file://{at}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def store(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def read(path: str, offset: int = 0, length: int | None = None) -> bytes:
    files, at = store(path)
    with files.open_input_file(at) as f:
        return f.read_at(f.size() - offset if length is None else length, offset)


@contextmanager
def opened(path: str):
    """``fetch(offset, length)`` on a file that stays open; it returns less at the end of the file."""
    files, at = store(path)
    with files.open_input_file(at) as f:
        yield lambda offset, length: f.read_at(length, offset)


def size(path: str) -> int:
    files, at = store(path)
    return files.get_file_info(at).size or 0


def version(path: str) -> tuple[int, int]:
    """Length and time of the last change."""
    files, at = store(path)
    info = files.get_file_info(at)
    return info.size or 0, info.mtime_ns or 0


def exists(path: str) -> bool:
    from pyarrow import fs

    files, at = store(path)
    return files.get_file_info(at).type == fs.FileType.File


def write(path: str, data: bytes) -> None:
    files, at = store(path)
    files.create_dir(posixpath.dirname(at), recursive=True)
    with files.open_output_stream(at, compression=None) as f:
        f.write(data)


def expand(path: str, extensions: tuple[str, ...]) -> list[str]:
    """The path itself, or the files of a folder with one of the extensions, by name."""
    from pyarrow import fs

    files, at = store(path)
    info = files.get_file_info(at)
    if info.type == fs.FileType.Directory:
        prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
        found = sorted(x.path for x in files.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File)
        return [prefix + x for x in found if os.path.splitext(x)[1].lower() in extensions]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [path]


def sidecar(path: str, *extensions: str) -> str | None:
    """The first file beside ``path`` with its stem and one of the extensions, in lower or upper case."""
    stem = path[: path.rfind(".")]
    for e in extensions:
        for x in (stem + e, stem + e.upper()):
            if exists(x):
                return x
    return None


def stem(path: str) -> str:
    return os.path.splitext(posixpath.basename(path))[0]
