"""Files as documents: the manifest of a folder, and a Spark data source that reads what it lists."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexward.functions.paths import is_scanned_name

#: Bytes of files that one task reads, about; and files.
TASK_BYTES = 64 << 20
TASK_FILES = 2_000

_SCHEMA = "file string, content string, reason string, is_folder boolean"


def describe(error: Exception) -> str:
    """Why a file can't be read, in plain words."""
    if isinstance(error, UnicodeDecodeError):
        return "not valid UTF-8 text"
    if isinstance(error, PermissionError):
        return "permission denied"
    if isinstance(error, FileNotFoundError):
        return "not found, or a broken link"
    return getattr(error, "strerror", None) or root_cause(error)


def root_cause(error: BaseException) -> str:
    """The message of the error at the end of the chain of causes."""
    while error.__cause__ is not None:
        error = error.__cause__
    return str(error)


def read_text(path: str) -> str:
    """A whole file as it is: line ends and a byte order mark stay."""
    with open(path, "rb") as f:
        return f.read().decode("utf-8")


def walk(folder: str) -> tuple[list[tuple[str, int]], list[tuple[str, str]]]:
    """(path, bytes) of the files below folder that are scanned, and (folder, reason) of those left out.

    Hidden names and empty files count; links are followed, but a folder is entered once, so a cycle of links
    ends; a dangling link is neither file nor folder. folder itself must be readable.
    """
    files: list[tuple[str, int]] = []
    skipped: list[tuple[str, str]] = []
    seen: set[tuple[int, int]] = set()
    waiting = [folder]
    while waiting:
        here = waiting.pop()
        try:
            mark = os.stat(here)
            if (mark.st_dev, mark.st_ino) in seen:
                continue
            seen.add((mark.st_dev, mark.st_ino))
            names = sorted(os.listdir(here))
        except OSError as e:
            if here == folder:
                raise
            skipped.append((here, describe(e)))
            continue
        below = []
        for name in names:
            path = os.path.join(here, name)
            try:
                info = os.stat(path)
            except OSError:
                continue
            if stat.S_ISDIR(info.st_mode):
                below.append(path)
            elif stat.S_ISREG(info.st_mode) and is_scanned_name(name):
                files.append((path, info.st_size))
        waiting.extend(reversed(below))
    return sorted(files), skipped


@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]
    folders: tuple[tuple[str, str], ...] = ()


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[_Files]:
        """Files in runs of about TASK_BYTES, and with the last the folders that can't be entered: the tree is walked once."""
        out: list[_Files] = []
        run: list[str] = []
        size = 0
        files, folders = walk(self.folder)
        for path, n in files:
            if run and (size + n > TASK_BYTES or len(run) >= TASK_FILES):
                out.append(_Files(tuple(run)))
                run, size = [], 0
            run.append(path)
            size += n
        return [*out, _Files(tuple(run), tuple(folders))]

    def read(self, partition: _Files) -> Iterator[tuple[str, str | None, str | None, bool]]:
        for path in partition.paths:
            try:
                yield path, read_text(path), None, False
            except (OSError, UnicodeDecodeError) as e:
                yield path, None, describe(e), False
        for path, reason in partition.folders:
            yield path, None, reason, True


class FolderSource(DataSource):
    """spark.read.format('lexward_files').load(folder): one row a file, with its text or the reason there is none, and
    one for each folder that can't be entered."""

    @classmethod
    def name(cls) -> str:
        return "lexward_files"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def folder_table(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content, reason, is_folder) of every scanned file below a folder that all executors see."""
    spark.dataSource.register(FolderSource)
    return spark.read.format("lexward_files").load(folder)


def documents(table: DataFrame) -> DataFrame:
    return table.where("reason IS NULL").select("file", "content")


def skipped_files(table: DataFrame) -> DataFrame:
    """(file, reason, is_folder) of what couldn't be read."""
    return table.where("reason IS NOT NULL").select("file", "reason", "is_folder")


def single(spark: SparkSession, name: str, content: str) -> DataFrame:
    """One document, as of a file named on the command line or of standard input."""
    return spark.createDataFrame([(name, content)], "file string, content string")


def binary_table(table: DataFrame, path: str = "path", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(documents, skipped) of a table with binary contents, by a check of the bytes on the executors."""
    from pyspark.sql import functions as F

    told = table.select(F.col(path).alias("file"), F.try_validate_utf8(F.col(content).cast("string")).alias("content"))
    good = told.where("content IS NOT NULL")
    return good, told.where("content IS NULL").select("file", F.lit("not valid UTF-8 text").alias("reason"))
