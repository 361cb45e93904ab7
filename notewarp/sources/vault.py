"""The listing of a directory of notes and media, as a batch source and as a stream of changes."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator

from pyarrow.fs import FileSelector, FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import text as X
from ..settings import MODES

FILES = "path string, rel_path string, mtime double, length bigint"
CHANGES = "path string, event_type string, ts double"


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


def walk(root: str, start: str, deep: bool = True) -> Iterator[tuple[str, str, float, int]]:
    """Files below ``start`` with their paths relative to ``root``; files that go meanwhile are left out."""
    for folder, _, names in os.walk(start):
        for name in names:
            path = os.path.join(folder, name)
            try:
                at = os.stat(path)
            except OSError:
                continue
            yield path, os.path.relpath(path, root), at.st_mtime, at.st_size
        if not deep:
            return


class ListingReader(DataSourceReader):
    """One partition per top folder, so a large tree is listed in parallel."""

    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        tops = [os.path.join(self.root, x) for x in sorted(os.listdir(self.root))]
        return [Folder(self.root, False), *[Folder(x, True) for x in tops if os.path.isdir(x)]]

    def read(self, partition):
        yield from walk(self.root, partition.path, partition.deep)


class ChangesReader(DataSourceStreamReader):
    """Changes between stored listings. An offset is the number of a listing; a batch compares two of them, so it can be
    replayed. Listings are kept in the folder ``state`` of any file system that Arrow opens, which must outlive the query."""

    def __init__(self, root: str, state: str):
        self.root = root
        if "://" in state or state.startswith("file:"):
            self.fs, self.state = FileSystem.from_uri(state)
        else:
            self.fs, self.state = LocalFileSystem(), os.path.abspath(state)
        self.fs.create_dir(self.state, recursive=True)

    def versions(self) -> list[int]:
        names = [f.base_name for f in self.fs.get_file_info(FileSelector(self.state))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def stored(self, version: int) -> dict[str, list]:
        if version not in self.versions():
            return {}
        with self.fs.open_input_stream(f"{self.state}/{version}.json") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        version = max(self.versions(), default=0)
        now = {path: [mtime, size] for path, _, mtime, size in walk(self.root, self.root)}
        if now != self.stored(version):
            version += 1
            part = f"{self.state}/{uuid.uuid4().hex}.part"
            with self.fs.open_output_stream(part) as f:
                f.write(json.dumps(now).encode())
            self.fs.move(part, f"{self.state}/{version}.json")
        return {"version": version}

    def partitions(self, start: dict, end: dict):
        return [Folder(f"{start['version']}:{end['version']}", False)]

    def read(self, partition):
        before, after = (self.stored(int(x)) for x in partition.path.split(":"))
        ts = time.time()
        for path in sorted(before.keys() | after.keys()):
            kind = "created" if path not in before else "deleted" if path not in after else "modified"
            if before.get(path) != after.get(path):
                yield path, kind, ts

    def commit(self, end: dict) -> None:
        for version in self.versions():
            if version < end["version"]:
                self.fs.delete_file(f"{self.state}/{version}.json")


class VaultSource(DataSource):
    """Format ``vault``: option ``path``; for streams also ``state``."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self):
        return FILES

    def reader(self, schema):
        return ListingReader(self.options["path"])


class VaultChanges(VaultSource):
    @classmethod
    def name(cls) -> str:
        return "vault_changes"

    def schema(self):
        return CHANGES

    def streamReader(self, schema):
        return ChangesReader(self.options["path"], self.options["state"])


def listed(files: DataFrame, mode: str = "full", file_type: str | None = None, directory: str | None = None) -> DataFrame:
    """The files (path, rel_path, ...) that count: of the mode's extensions, not hidden, below ``directory``."""
    files = files.withColumn("ext", X.extension(F.col("rel_path"))).withColumn("file_type", X.file_type(F.col("ext")))
    files = files.where(F.col("ext").isin(*MODES[mode]) & ~X.hidden(F.col("rel_path")))
    if file_type:
        files = files.where(F.col("file_type") == file_type)
    if directory and directory.strip("/"):
        files = files.where(F.col("rel_path").startswith(directory.strip("/") + "/"))
    return files


def scan(spark: SparkSession, root: str, **options) -> DataFrame:
    spark.dataSource.register(VaultSource)
    return listed(spark.read.format("vault").option("path", root).load(), **options)


def changes(spark: SparkSession, root: str, state: str) -> DataFrame:
    """The stream of changes to files that count; a path with a hidden part anywhere does not."""
    spark.dataSource.register(VaultChanges)
    events = spark.readStream.format("vault_changes").option("path", root).option("state", state).load()
    return events.where(X.file_type(X.extension(F.col("path"))).isNotNull() & ~X.hidden(F.col("path")))
