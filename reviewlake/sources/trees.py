"""Repository trees as a Spark data source: folders that aren't read are not listed either, and tasks get even shares of bytes.

`spark.read.format("source_tree")` walks the tree while it is planned, breadth first, and never enters a skipped folder; a file over
the size limit is dropped by its listing. What is left is dealt to partitions by bytes, so only files that are wanted are opened, each
once, in the tasks. Roots of the stores that Arrow opens (local, hdfs, s3, gs, abfs) are read this way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, length long, content binary"
ARROW = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])
PARTITION_BYTES = 64 << 20
#: What opening a file costs, in bytes that could be read meanwhile.
OPEN_BYTES = 256 << 10
BATCH_BYTES = 8 << 20


class Share(InputPartition):
    """Files (path below the root, full path, length) of one task."""

    def __init__(self, files: list[tuple[str, str, int]]):
        super().__init__(None)
        self.files = files


def wanted_files(store: fs.FileSystem, root: str, skipped: frozenset[str], largest: int) -> Iterator[tuple[str, str, int]]:
    """Files below root in sorted order of each folder; skipped folders are not entered."""
    folders = [root]
    while folders:
        found = sorted(store.get_file_info(fs.FileSelector(folders.pop(), recursive=False)), key=lambda i: i.path)
        for info in found:
            if info.type == fs.FileType.Directory and info.base_name not in skipped:
                folders.append(info.path)
            elif info.type == fs.FileType.File and info.size <= largest:
                yield info.path[len(root) :].lstrip("/"), info.path, info.size


def dealt(files: Iterator[tuple[str, str, int]], most: int) -> list[list[tuple[str, str, int]]]:
    """Shares of neighbouring files with about `most` bytes each."""
    shares: list[list[tuple[str, str, int]]] = []
    room = 0
    for f in files:
        cost = f[2] + OPEN_BYTES
        if not shares or cost > room:
            shares.append([])
            room = most
        shares[-1].append(f)
        room -= cost
    return shares


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.skipped = frozenset(x for x in options.get("skipped", "").split("/") if x)
        self.largest = int(options.get("largest", 1 << 62))
        self.share = int(options.get("partition_bytes", PARTITION_BYTES))

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.root)
        return [Share(files) for files in dealt(wanted_files(store, root.rstrip("/"), self.skipped, self.largest), self.share)] or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.root)
        rows, size = [], 0
        for path, full, _length in partition.files:
            with store.open_input_stream(full) as f:
                content = f.read()
            rows.append({"path": path, "length": len(content), "content": content})
            size += len(content)
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)


def opens(root: str) -> bool:
    """Whether Arrow opens the root's store."""
    try:
        fs.FileSystem.from_uri(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True
