"""Members of zip archives as rows, read in place: an archive is several tasks, and names are pruned before anything is unpacked."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of members that one task unpacks, about; a larger member is a task of its own.
TASK_BYTES = 64 << 20


def _open(uri: str):
    """A file on any file system that all machines see."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri)) if re.match(r"[a-z0-9]+:/", uri) else (fs.LocalFileSystem(), uri)
    return store.open_input_file(path)


@dataclass
class _Range(InputPartition):
    archive: str
    names: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.archives = [x for x in options["path"].split("\n") if x]
        self.wanted = re.compile(options.get("names", ""))
        self.most = int(options.get("taskbytes", TASK_BYTES))

    def partitions(self) -> list[_Range]:
        """Ranges of members by the archives' tables of contents; folders and names that don't match are left out."""
        out = []
        for archive in self.archives:
            with _open(archive) as file, zipfile.ZipFile(file) as held:
                members = sorted({m.filename: m for m in held.infolist() if not m.is_dir() and self.wanted.search(m.filename)}.values(), key=lambda m: m.header_offset)
            names, size = [], 0
            for m in members:
                if names and size + m.file_size > self.most:
                    out.append(_Range(archive, names))
                    names, size = [], 0
                names.append(m.filename)
                size += m.file_size
            if names:
                out.append(_Range(archive, names))
        return out or [_Range("", [])]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if not partition.names:
            return
        with _open(partition.archive) as file, zipfile.ZipFile(file) as held:
            for name in partition.names:
                content = held.read(name)
                yield partition.archive, name, len(content), content


class Members(DataSource):
    """format("zip_members"): path (several by line breaks), names (a pattern), taskbytes."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, name string, size long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def members(spark: SparkSession, archives: list[str] | str, names: str = "", task_bytes: int = TASK_BYTES) -> DataFrame:
    """archive, name, size, content of the members of zip archives whose names hold the pattern (Python's syntax).

    Nothing is unpacked to disk and no other member is read. Of members that share a name the last
    one counts, as it does for other readers. A damaged or missing archive is an error.
    """
    spark.dataSource.register(Members)
    paths = [archives] if isinstance(archives, str) else archives
    return spark.read.format("zip_members").option("path", "\n".join(paths)).option("names", names).option("taskbytes", str(task_bytes)).load()
