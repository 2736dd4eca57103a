"""Bounded reads by position: of bytes at hand, of files, and of stores that answer to a URI."""

from __future__ import annotations

import os
from typing import Protocol
from urllib.parse import unquote, urlparse


class Ranges(Protocol):
    size: int

    def read(self, at: int, n: int) -> bytes:
        """At most n bytes from at; fewer where the source ends."""


class Held:
    """Bytes that are in memory."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, at: int, n: int) -> bytes:
        return self.data[at : at + n]


class LocalFile:
    """A file on a path that this worker sees; reads at other positions do not touch what lies between."""

    def __init__(self, path: str, block: int = 1 << 16):
        self.handle = os.open(path, os.O_RDONLY)
        self.size, self.block = os.fstat(self.handle).st_size, block
        self.kept: tuple[int, bytes] = (0, b"")

    def read(self, at: int, n: int) -> bytes:
        first, data = self.kept
        if n >= self.block:
            return os.pread(self.handle, n, at)
        if not first <= at <= at + n <= first + len(data):
            self.kept = first, data = at, os.pread(self.handle, self.block, at)  # neighbours are likely to be asked for next
        return data[at - first : at - first + n]

    def close(self) -> None:
        os.close(self.handle)


class Stored:
    """An object of a store that Arrow's file systems know by its URI."""

    def __init__(self, uri: str):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(min(n, max(0, self.size - at)), at) if at < self.size else b""

    def close(self) -> None:
        self.file.close()


def opened(path: str) -> Ranges:
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return LocalFile(unquote(parts.path) if parts.scheme else path)
    return Stored(path)
