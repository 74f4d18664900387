"""Documents as files, each whole or not there: tasks write staged files, and one commit gives them their names.

Written through df.write.format("whole_files").save(folder) with (name, text). A reader that looks in between sees the old file or
the new one; a job that fails leaves none of its own behind. The folder is a path, or an address that pyarrow knows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ledgerloom.sources.lines import plain_path


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    names: list[str]


class WholeFilesWriter(DataSourceWriter):
    """Every attempt of a task stages in a folder of its own, so that only what was committed is published."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.run, self.overwrite = options["path"], uuid.uuid4().hex, overwrite

    def _staging(self) -> str:
        return f"{_store(self.path)[1].rstrip('/')}/.staged-{self.run}"

    def write(self, rows: Iterator[Row]) -> Staged:
        store, _ = _store(self.path)
        folder, names = f"{self._staging()}/{uuid.uuid4().hex}", []
        store.create_dir(folder, recursive=True)
        for row in rows:
            name = row["name"]
            if not name or "/" in name or name.startswith("."):
                raise ValueError(f"no name for a file: {name!r}")
            with store.open_output_stream(f"{folder}/{name}") as f:
                f.write((row["text"] or "").encode())
            names.append(name)
        return Staged(folder, names)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = _store(self.path)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("two documents have one name")
        for m in done:
            for name in m.names:
                store.move(f"{m.folder}/{name}", f"{root.rstrip('/')}/{name}")
        if self.overwrite:  # what the new documents do not replace goes, once they are all there
            for old in store.get_file_info(fs.FileSelector(root)):
                if old.is_file and old.base_name not in set(names):
                    store.delete_file(old.path)
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, _ = _store(self.path)
        if store.get_file_info(self._staging()).type == fs.FileType.Directory:
            store.delete_dir(self._staging())


class WholeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> WholeFilesWriter:
        return WholeFilesWriter(self.options, overwrite)


def write_documents(documents: DataFrame, folder: str, replace: bool = False) -> None:
    """Write documents(name, text), a file each. replace: files that are no document of these go."""
    documents.sparkSession.dataSource.register(WholeFiles)
    documents.select("name", "text").write.format("whole_files").mode("overwrite" if replace else "append").save(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(file, text) of the documents in a folder."""
    return spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(plain_path(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("text"))
