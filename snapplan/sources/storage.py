"""Files in a shared folder from Python code in tasks, through Arrow's file
systems: local and mounted paths, and the object stores and HDFS that Arrow
was built with."""

from __future__ import annotations

from ..session import local_fs_path


def file_system(path: str):
    """``(file system, path in it)`` of a path or URI."""
    from pyarrow import fs
    plain = local_fs_path(path)
    return (fs.LocalFileSystem(), plain) if "://" not in plain else fs.FileSystem.from_uri(plain)


def exists(path: str) -> bool:
    from pyarrow import fs
    system, name = file_system(path)
    return system.get_file_info(name).type != fs.FileType.NotFound


def read_range(path: str, offset: int, length: int) -> bytes:
    """``length`` bytes of a file from ``offset``; a file that is shorter is an error."""
    system, name = file_system(path)
    with system.open_input_file(name) as fh:
        fh.seek(offset)
        data = fh.read(length)
    if len(data) != length:
        raise OSError(f"{path}: {len(data)} of {length} bytes at {offset}")
    return data
