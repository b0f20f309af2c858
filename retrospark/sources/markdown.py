"""A folder with one file for each row, written by the executors and there as a whole or not at all.

Tasks write to a staging folder beside the target, a file for each row under its own name; an attempt that is made again
writes the same files again. When all tasks are done and all files are there, one rename puts the folder in its place; if a
task fails for good, the staging folder is deleted. The folder is any that Arrow's file systems know and that the driver and
all executors share; it must not exist before.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class FolderWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        self.staging = f"{self.folder}.staging-{uuid.uuid4().hex}"

    def _at(self, folder: str) -> tuple[fs.FileSystem, str]:
        # A path without a scheme is one of this machine.
        return fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder.removeprefix("file:")))

    def write(self, iterator: Iterator[Row]) -> Written:
        store, at = self._at(self.staging)
        names = []
        for row in iterator:
            with store.open_output_stream(f"{at}/{row.file_name}") as out:
                out.write((row.text or "").encode())
            names.append(row.file_name)
        return Written(names)  # kept by Spark until all tasks are done: a name for each row

    def commit(self, messages: list[Written | None]) -> None:
        store, staged = self._at(self.staging)
        _, target = self._at(self.folder)
        names = {n for m in messages if m is not None for n in m.names}
        there = {i.base_name for i in store.get_file_info(fs.FileSelector(staged)) if i.type == fs.FileType.File}
        if store.get_file_info(target).type != fs.FileType.NotFound or not names <= there:
            self.abort(messages)
            raise RuntimeError(f"{self.folder} exists already" if names <= there else f"the driver and the executors don't share {self.folder}")
        store.move(staged, target)

    def abort(self, messages: list[Written | None]) -> None:
        store, staged = self._at(self.staging)
        for left in range(5, -1, -1):  # a task that is being stopped may be writing a last file
            if store.get_file_info(staged).type == fs.FileType.NotFound:
                return
            try:
                store.delete_dir(staged)
            except OSError:
                if not left:
                    raise
                time.sleep(0.2)


class TextFolder(DataSource):
    """Rows (file_name, text) to files of a new folder."""

    @classmethod
    def name(cls) -> str:
        return "text_folder"

    def schema(self) -> str:
        return "file_name string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> FolderWriter:
        writer = FolderWriter(self.options["path"])
        # Made once, here: tasks that still run when the folder is deleted find none.
        store, at = writer._at(writer.staging)
        store.create_dir(at, recursive=True)
        return writer


def write_folder(files: DataFrame, folder: str) -> None:
    """Write rows (file_name, text), with names that differ, to a new folder."""
    files.sparkSession.dataSource.register(TextFolder)
    safe = F.regexp_replace("file_name", r"[/\\\x00]", "_")
    files.select(safe.alias("file_name"), "text").write.format(TextFolder.name()).mode("append").save(folder)
