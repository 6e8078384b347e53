"""Files in shared storage, opened from tasks by their URI (local, HDFS, S3, GCS), as archives and shards need."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def reading(uri: str):
    fs, path = _at(uri)
    return fs.open_input_file(path)


def reading_stream(uri: str):
    fs, path = _at(uri)
    return fs.open_input_stream(path, compression=None)


class Rolled:
    """Output files of a task, a new one when one is full. Names are unique, so a retried task never meets an earlier one's files;
    readers learn of files only from rows that the task returned."""

    def __init__(self, folder: str, suffix: str, most: int):
        self.folder, self.suffix, self.most = folder, suffix, most
        self.out, self.uri, self.at = None, "", 0
        fs, path = _at(folder)
        fs.create_dir(path, recursive=True)

    def room(self) -> None:
        """Make sure that a file is open and not full; call it before a record."""
        if self.out is not None and self.at >= self.most:
            self.close()
        if self.out is None:
            self.uri, self.at = f"{self.folder}/{uuid.uuid4().hex}{self.suffix}", 0
            fs, path = _at(self.uri)
            self.out = fs.open_output_stream(path, compression=None)

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def slices(data: bytes, size: int) -> Iterator[memoryview]:
    view = memoryview(data)
    for at in range(0, max(len(view), 1), size):
        yield view[at : at + size]
