"""One file per row, as a data source writer with commit and abort."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the place in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path if ":/" in path else os.path.abspath(path))


class PromptFiles(DataSource):
    """Writes rows ``(name, text)`` to files; ``name`` must be unique and a file name."""

    @classmethod
    def name(cls) -> str:
        return "prompt_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _PromptFilesWriter(self.options["path"].rstrip("/"))


class _PromptFilesWriter(DataSourceArrowWriter):
    """Tasks write into a folder beside the target. The commit moves it into place; an abort deletes it.

    A task that runs twice writes the same files again.
    """

    def __init__(self, path: str):
        self.path = path
        self.partial = f"{path}.{uuid.uuid4().hex}.part"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, folder = open_folder(self.partial)
        files.create_dir(folder)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None:
                    raise ValueError(f"no text for {name!r}")
                with files.open_output_stream(f"{folder}/{name}", compression=None) as out:
                    out.write(text.encode())
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        files, partial = open_folder(self.partial)
        _, target = open_folder(self.path)
        files.create_dir(partial)
        if files.get_file_info(target).type == fs.FileType.NotFound:
            files.move(partial, target)
            return
        # Other files of an existing folder stay.
        for found in files.get_file_info(fs.FileSelector(partial)):
            files.move(found.path, f"{target}/{found.base_name}")
        files.delete_dir(partial)

    def abort(self, messages) -> None:
        files, partial = open_folder(self.partial)
        if files.get_file_info(partial).type != fs.FileType.NotFound:
            files.delete_dir(partial)
