"""Texts of files by pluggable extractors: a function for each extension, whose failures are rows of their own.

`extracted` runs on rows of files' contents, which Spark reads from any store. `ExtractedFiles` is a data source over
a folder that the executors reach themselves: spark.dataSource.register(ExtractedFiles), spark.read.format("extracted").load(folder).
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Callable, Iterator
from hashlib import md5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import html

Extractor = Callable[[bytes], str]

#: By extension, in lower case with its dot.
EXTRACTORS: dict[str, Extractor] = {
    ".txt": lambda b: b.decode("utf-8"),
    ".html": lambda b: html.text_of(b.decode("utf-8", "replace")),
    ".htm": lambda b: html.text_of(b.decode("utf-8", "replace")),
}
SCHEMA = "path string, file_name string, file_ext string, document_id string, text string, error_message string"


def extract(path: str, content: bytes | None, extractors: dict[str, Extractor]) -> tuple:
    """A row of SCHEMA. What an extractor raises becomes the error, and the text is null."""
    name = posixpath.basename(path)
    ext = os.path.splitext(name)[1].lower()
    own = md5("_".join((path, name, ext)).encode()).hexdigest()
    if ext not in extractors:
        return path, name, ext, own, None, f"unsupported file type: {ext}"
    try:
        return path, name, ext, own, extractors[ext](content or b""), None
    except Exception as error:  # noqa: BLE001  one bad file must not end the job
        return path, name, ext, own, None, f"{type(error).__name__}: {error}"


def extracted(files: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """SCHEMA of files (path, content)."""
    known = extractors or EXTRACTORS
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([extract(p, c, known) for p, c in zip(pdf["path"], pdf["content"], strict=True)], columns=columns)

    return files.select("path", "content").mapInPandas(rows, SCHEMA)


class FileRange(InputPartition):
    def __init__(self, files: list[str]) -> None:
        self.files = files


class FilesReader(DataSourceReader):
    def __init__(self, folder: str, files_per_task: int, extractors: dict[str, Extractor]) -> None:
        self.folder, self.files_per_task, self.extractors = folder, files_per_task, extractors

    def partitions(self) -> list[InputPartition]:
        files = sorted(os.path.join(d, f) for d, _, names in os.walk(self.folder) for f in names if not f.startswith((".", "_")))
        return [FileRange(files[i : i + self.files_per_task]) for i in range(0, len(files), self.files_per_task)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.files if partition else ():  # no files are no partitions
            try:
                with open(path, "rb") as file:
                    content = file.read()
            except OSError as error:
                yield (*extract(path, None, {})[:4], None, f"{type(error).__name__}: {error}")
            else:
                yield extract(path, content, self.extractors)


class ExtractedFiles(DataSource):
    """The files below a folder as rows of SCHEMA, in tasks of `files_per_task` (100) files. Subclasses may bring extractors of their own."""

    extractors = EXTRACTORS

    @classmethod
    def name(cls) -> str:
        return "extracted"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FilesReader(self.options["path"], int(self.options.get("files_per_task", 100)), self.extractors)
