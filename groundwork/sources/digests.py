"""A data source that lists files with their SHA-256, read in chunks."""

from __future__ import annotations

import fnmatch
import hashlib
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 4 << 20


@dataclass
class _File(InputPartition):
    uri: str
    path: str
    name: str


class FileDigests(DataSource):
    """``name, length, actual`` of the files below a folder (or of one file) whose base names
    match the option ``glob``; hidden files (``.`` or ``_`` first) are left out. ``name`` is
    the path below the folder. Any file system that Arrow opens by URI will do."""

    @classmethod
    def name(cls) -> str:
        return "file_digest"

    def schema(self) -> str:
        return "name string, length long, actual string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options.get("path", ""), self.options.get("glob", "*"))


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; ``file:/x`` and bare paths are local."""
    bare = uri.removeprefix("file://").removeprefix("file:") if uri.startswith("file:") else uri
    return (fs.LocalFileSystem(), bare) if "://" not in bare else fs.FileSystem.from_uri(bare)


class _Reader(DataSourceReader):
    def __init__(self, uri: str, glob: str):
        self.uri, self.glob = uri, glob

    def partitions(self) -> list[_File]:
        system, path = _open(self.uri)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True))
        files = [f for f in found if f.type == fs.FileType.File and f.base_name[:1] not in "._" and fnmatch.fnmatch(f.base_name, self.glob)]
        below = lambda f: f.base_name if info.type == fs.FileType.File else posixpath.relpath(f.path, path)
        return [_File(self.uri, f.path, below(f)) for f in sorted(files, key=lambda f: f.path)] or [_File(self.uri, "", "")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        digest, length = hashlib.sha256(), 0
        system, _ = _open(partition.uri)
        with system.open_input_stream(partition.path, compression=None) as stream:
            while chunk := stream.read(CHUNK):
                digest.update(chunk)
                length += len(chunk)
        yield partition.name, length, digest.hexdigest()
