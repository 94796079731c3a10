"""A file sink: one file per row, under its safe name.

``df.write.format("safe_files").mode("append").save(folder)`` takes rows of ``key``, ``name`` and ``text`` and writes
``folder/key/name`` with the text in UTF-8. The only Python on executors in this part of the library, as no built-in writer lets a row
choose its file's name. Folders may be on any store that pyarrow knows.

A task writes each file under ``_temporary`` first and moves it to its place when it is whole, so a lost or repeated task leaves no half
files, and a second attempt puts the same bytes in the same place. Commit writes ``_SUCCESS`` with the number of files and clears what
lost attempts left; a failed job has no ``_SUCCESS``. Slashes in keys and names become ``_``; a null text is an empty file; a null
key or name is refused.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "key string, name string, text string"


@dataclass
class Written(WriterCommitMessage):
    n: int


def _store(path: str):
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


class SafeFileWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType):
        self.path, self.job = path, uuid.uuid4().hex
        missing = {"key", "name", "text"} - set(schema.names)
        if missing:
            raise ValueError(f"no column {sorted(missing)}")

    def write(self, iterator: Iterator[Row]) -> Written:
        store, base = _store(self.path)
        attempt, n = f"{base}/_temporary/{self.job}/{uuid.uuid4().hex}", 0
        store.create_dir(attempt)
        for row in iterator:
            if row["key"] is None or row["name"] is None:
                raise ValueError("a file needs a key and a name")
            folder = f"{base}/{row['key'].replace('/', '_')}"
            store.create_dir(folder)
            with store.open_output_stream(f"{attempt}/{n}") as out:
                out.write((row["text"] or "").encode("utf-8", "replace"))
            store.move(f"{attempt}/{n}", f"{folder}/{row['name'].replace('/', '_')}")
            n += 1
        store.delete_dir(attempt)
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = _store(self.path)
        self._clear()
        store.create_dir(base)
        with store.open_output_stream(f"{base}/_SUCCESS") as out:
            out.write(str(sum(m.n for m in messages if m)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, base = _store(self.path)
        if store.get_file_info(f"{base}/_temporary/{self.job}").type.name == "Directory":
            store.delete_dir(f"{base}/_temporary/{self.job}")


class SafeFileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "safe_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("files are added; choose a new folder to replace them")
        return SafeFileWriter(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
    spark.dataSource.register(SafeFileSink)


def write_files(files: DataFrame, folder: str) -> None:
    """Write rows of ``key``, ``name`` and ``text`` as files."""
    register(files.sparkSession)
    files.select("key", "name", "text").write.format("safe_files").mode("append").save(folder)


def read_files(keys: DataFrame, folder: str) -> DataFrame:
    """Every file in the folders of the given keys (column ``key``, distinct), hidden ones included, as ``key``, ``name`` and ``content``."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = _store(folder)
        for batch in batches:
            for key in batch.column("key").to_pylist():
                listed = store.get_file_info(fs.FileSelector(f"{base}/{key.replace('/', '_')}", allow_not_found=True))
                for info in listed:
                    content = store.open_input_stream(info.path).readall()
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([info.base_name]), pa.array([content], pa.binary())], names=["key", "name", "content"])

    return keys.select("key").mapInArrow(run, "key string, name string, content binary")
