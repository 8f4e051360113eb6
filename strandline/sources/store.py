"""Files by path or URI, through Arrow's file systems.

A path without a scheme, ``file:`` and every scheme Arrow knows (hdfs, s3, gs, abfs) are opened where they are; any other
scheme is an error, so nothing is ever written to a local folder that happens to have the name of a URI.
"""

from __future__ import annotations

import fnmatch
import os
import posixpath

from pyarrow import fs


def system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def open_in(path: str):
    """A file that can be read from any place."""
    files, name = system(path)
    return files.open_input_file(name)


def open_out(path: str):
    files, name = system(path)
    return files.open_output_stream(name, compression=None)


def size(path: str) -> int:
    files, name = system(path)
    return files.get_file_info(name).size


def is_folder(path: str) -> bool:
    files, name = system(path)
    return files.get_file_info(name).type == fs.FileType.Directory


def make_folder(path: str) -> None:
    files, name = system(path)
    files.create_dir(name, recursive=True)


def remove_folder(path: str) -> None:
    files, name = system(path)
    if files.get_file_info(name).type == fs.FileType.Directory:
        files.delete_dir(name)


def remove(path: str) -> None:
    files, name = system(path)
    files.delete_file(name)


def move(old: str, new: str) -> None:
    files, name = system(old)
    files.move(name, system(new)[1])


def names_in(folder: str) -> list[str]:
    """Names of what lies in a folder, in order."""
    files, name = system(folder)
    return sorted(x.base_name for x in files.get_file_info(fs.FileSelector(name)))


def join(folder: str, name: str) -> str:
    return posixpath.join(folder, name)


def expand(path: str) -> list[str]:
    """The files of a path: itself, those of a folder (hidden ones left out), or those whose names fit a pattern; in order."""
    if is_folder(path):
        return [join(path, n) for n in names_in(path) if not n.startswith((".", "_"))]
    folder, name = posixpath.split(path)
    if any(c in name for c in "*?["):
        return [join(folder, n) for n in names_in(folder or ".") if fnmatch.fnmatchcase(n, name)]
    return [path]
