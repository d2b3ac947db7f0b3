"""What holds a file tree: a folder that every executor has mounted, or a URI. Used inside tasks, one path at a time."""

from __future__ import annotations

import os
from typing import Protocol

#: path, size, mtime_ms, is_dir, error
Entry = tuple[str, int, float, bool, str | None]


class Store(Protocol):
    """Paths are relative to the root, '' is the root itself. Failures are OSErrors."""

    def entries(self, relative: str) -> list[Entry]: ...

    def stat(self, relative: str) -> tuple[int, float] | None:
        """Size and modification time in milliseconds; None for what is no regular file."""

    def read(self, relative: str) -> bytes: ...

    def write(self, relative: str, content: bytes) -> None: ...


def below(relative: str, name: str) -> str:
    return f"{relative}/{name}" if relative else name


class MountedStore:
    def __init__(self, root: str):
        self.root = root

    def _full(self, relative: str) -> str:
        return os.path.join(self.root, relative)

    def entries(self, relative: str) -> list[Entry]:
        with os.scandir(self._full(relative)) as found:
            rows = [self._entry(below(relative, e.name), e) for e in found]
        return [r for r in rows if r]

    @staticmethod
    def _entry(path: str, entry: os.DirEntry) -> Entry | None:
        try:
            if entry.is_dir(follow_symlinks=False):
                return path, 0, 0.0, True, None
            if not entry.is_file():
                return None
            state = entry.stat()
            return path, state.st_size, state.st_mtime_ns / 1e6, False, None
        except OSError as failure:
            return path, 0, 0.0, False, str(failure)

    def stat(self, relative: str) -> tuple[int, float] | None:
        full = self._full(relative)
        state = os.stat(full) if os.path.isfile(full) else None
        return (state.st_size, state.st_mtime_ns / 1e6) if state else None

    def read(self, relative: str) -> bytes:
        with open(self._full(relative), "rb") as handle:
            return handle.read()

    def write(self, relative: str, content: bytes) -> None:
        os.makedirs(os.path.dirname(self._full(relative)), exist_ok=True)
        with open(self._full(relative), "wb") as handle:
            handle.write(content)


class UriStore:
    """Any file system that Arrow opens by its URI. Unlike Spark's own listing, it also sees names that begin with a dot or _."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.fs = fs
        self.system, self.root = fs.FileSystem.from_uri(root)

    def _full(self, relative: str) -> str:
        return f"{self.root.rstrip('/')}/{relative}" if relative else self.root

    def _state(self, info) -> tuple[int, float]:
        return info.size or 0, (info.mtime_ns or 0) / 1e6

    def entries(self, relative: str) -> list[Entry]:
        kinds = self.fs.FileType
        found = self.system.get_file_info(self.fs.FileSelector(self._full(relative)))
        return [(below(relative, i.base_name), *((0, 0.0) if i.type == kinds.Directory else self._state(i)), i.type == kinds.Directory, None)
                for i in found if i.type in (kinds.File, kinds.Directory)]

    def stat(self, relative: str) -> tuple[int, float] | None:
        info = self.system.get_file_info(self._full(relative))
        return self._state(info) if info.type == self.fs.FileType.File else None

    def read(self, relative: str) -> bytes:
        with self.system.open_input_stream(self._full(relative), compression=None) as handle:
            return handle.read()

    def write(self, relative: str, content: bytes) -> None:
        full = self._full(relative)
        self.system.create_dir(full.rpartition("/")[0], recursive=True)
        with self.system.open_output_stream(full, compression=None) as handle:
            handle.write(content)


def store_of(root: str) -> Store:
    return UriStore(root) if "://" in root else MountedStore(root)
