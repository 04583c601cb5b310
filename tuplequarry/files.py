"""Files of relations, on any store that pyarrow opens: listing, segments, ranges of bytes."""

from __future__ import annotations

import re

import pyarrow.fs as pafs

SKIPPED = ("_fsm", "_vm", "_init")


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def size_of(path: str) -> int:
    """Bytes of a file; -1 if there is none."""
    fs, p = open_store(path)
    info = fs.get_file_info(p)
    return info.size if info.type == pafs.FileType.File else -1


def is_dir(path: str) -> bool:
    fs, p = open_store(path)
    return fs.get_file_info(p).type == pafs.FileType.Directory


def read_range(path: str, start: int = 0, length: int | None = None) -> bytes:
    fs, p = open_store(path)
    with fs.open_input_file(p) as f:
        if start:
            f.seek(start)
        return f.read() if length is None else f.read(length)


def listing(path: str) -> list[tuple[str, int, bool]]:
    """(name, size, is a directory) of a directory's entries, by name."""
    fs, p = open_store(path)
    if fs.get_file_info(p).type != pafs.FileType.Directory:
        return []
    return sorted((x.base_name, x.size or 0, x.type == pafs.FileType.Directory) for x in fs.get_file_info(pafs.FileSelector(p)))


def relation_files(path: str) -> list[tuple[str, int]]:
    """The main fork of each relation in a directory, by number, with the size of all its segments."""
    out: dict[str, int] = {}
    for name, size, folder in listing(path):
        if not folder and (m := re.fullmatch(r"(\d+)(\.\d+)?", name)):
            out[m[1]] = out.get(m[1], 0) + size
    return sorted(out.items(), key=lambda x: int(x[0]))


def segments(path: str) -> list[tuple[str, int]]:
    """A relation's files, path, path.1, path.2 and so on, with their sizes."""
    out: list[tuple[str, int]] = []
    while (size := size_of(name := f"{path}.{len(out)}" if out else path)) >= 0:
        out.append((name, size))
    if not out:
        raise FileNotFoundError(path)
    return out


def parent(path: str) -> str:
    return path.rstrip("/").rpartition("/")[0]


def first_text(path: str) -> str | None:
    return read_range(path, 0, 64).decode("ascii", "replace").strip() if size_of(path) > 0 else None
