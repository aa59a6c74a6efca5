"""Compressed comment dumps: zstd NDJSON as a Spark data source.

``spark.dataSource.register(ZstdDump)``, then ``spark.read.format("zstd_ndjson")
.load(glob)``. A zstd frame cannot be split, so there is one partition for each
file; a file is decoded in chunks and never held whole.
"""

from __future__ import annotations

import fnmatch

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 4 << 20


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


def filesystem(path: str):
    """The storage a path or address belongs to, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def find_files(pattern: str) -> list[str]:
    """Files that match a pattern in its last part, or that lie in a folder, in any storage that Arrow reads."""
    from pyarrow import fs

    store, inner = filesystem(pattern)
    folder, _, name = inner.rpartition("/")
    if not any(c in name for c in "*?["):
        if store.get_file_info(inner).type == fs.FileType.File:
            return [pattern]
        folder, name, pattern = inner, "*", f"{pattern}/*"
    head = pattern[: -len(name)]
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    names = [f.base_name for f in found if f.type == fs.FileType.File]
    return sorted(head + n for n in names if fnmatch.fnmatch(n, name) and n[0] not in "._")


def stream_lines(path: str, chunk: int = CHUNK):
    """Lines of a zstd file; a line cut by a chunk is carried over, the tail comes last."""
    store, inner = filesystem(path)
    with store.open_input_stream(inner, compression="zstd") as stream:
        rest = b""
        while data := stream.read(chunk):
            *lines, rest = (rest + data).split(b"\n")
            yield from lines
        if rest:
            yield rest


class ZstdReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [FilePartition(p) for p in find_files(self.path)]

    def read(self, partition: FilePartition):
        import pyarrow as pa

        def batch(lines: list[str]) -> pa.RecordBatch:
            files = pa.array([partition.path] * len(lines), pa.string())
            return pa.RecordBatch.from_arrays([files, pa.array(lines, pa.string())], ["file", "value"])

        lines, size = [], 0
        for line in stream_lines(partition.path):
            if text := line.strip():
                lines.append(text.decode("utf-8", "replace"))
                size += len(text)
                if size >= CHUNK:
                    yield batch(lines)
                    lines, size = [], 0
        if lines:
            yield batch(lines)


class ZstdDump(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zstd_ndjson"

    def schema(self) -> str:
        return "file string, value string"

    def reader(self, schema):
        return ZstdReader(self.options["path"])
