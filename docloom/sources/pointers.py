"""Pointer files of published sources as a stream: a row for each source whose pointer has changed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "source string, generation string"


def pointed(path: str) -> dict[str, str]:
    """The generation that each source's pointer below path names; folders without a pointer are none."""
    fs, folder = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    out = {}
    for f in fs.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True)):
        if f.type == pyarrow.fs.FileType.Directory:
            try:
                with fs.open_input_stream(f"{f.path}/CURRENT") as file:
                    out[f.base_name] = file.read().decode().partition("\n")[0]
            except FileNotFoundError:
                continue
    return out


class Reader(SimpleDataSourceStreamReader):
    """The offset holds what has been told and what was seen last; a change is told once two looks agree on it."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"told": {}, "seen": {}}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = pointed(self.path)
        quiet = now == start["seen"]
        end = {"told": now if quiet else start["told"], "seen": now}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        before, after = start["told"], end["told"]
        return iter([(s, after.get(s)) for s in sorted(before.keys() | after.keys()) if before.get(s) != after.get(s)])


class SourcePointers(DataSource):
    """`sourcepointers`: option path, the folder of the sources."""

    @classmethod
    def name(cls) -> str:
        return "sourcepointers"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> Reader:
        return Reader(self.options["path"])


def changes(spark: SparkSession, path: str):
    """A stream of (source, generation): the generation is null when a source has gone."""
    spark.dataSource.register(SourcePointers)
    return spark.readStream.format("sourcepointers").option("path", path).load()
