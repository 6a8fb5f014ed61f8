"""Which files are scanned, by their names."""

from __future__ import annotations

from pathlib import PurePath

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Case counts.
EXTENSIONS = ("md", "yaml", "yml", "txt", "toml")


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; null without a dot, and where the only dot comes first."""
    name = F.element_at(F.split(path, "/", -1), -1)
    return F.when(F.locate(".", F.substring(name, 2, 1 << 30)) > 0, F.element_at(F.split(name, r"\.", -1), -1))


def is_scanned(path: Column) -> Column:
    return F.coalesce(extension(path).isin(*EXTENSIONS), F.lit(False))


def is_scanned_name(name: str) -> bool:
    """The same on the driver."""
    return PurePath(name).suffix[1:] in EXTENSIONS
