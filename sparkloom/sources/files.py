"""Byte access to files of any store that pyarrow reaches, on the driver and on executors."""

from __future__ import annotations

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def read(path: str, start: int, size: int) -> bytes:
    system, at = located(path)
    with system.open_input_file(at) as f:
        return f.read_at(size, start)


def size_of(path: str) -> int | None:
    """Bytes of a file, None if there is no such file."""
    system, at = located(path)
    info = system.get_file_info(at)
    return info.size if info.type == fs.FileType.File else None


def listing(folder: str) -> list[str]:
    """Names of the files of a folder, in order."""
    system, at = located(folder)
    return sorted(i.base_name for i in system.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.File)


def splits(rows: int, bytes_a_row: int, most: int = 32 << 20) -> list[tuple[int, int]]:
    """Ranges of rows of at most about ``most`` bytes."""
    step = max(1, most // max(1, bytes_a_row))
    return [(a, min(rows, a + step)) for a in range(0, rows, step)]
