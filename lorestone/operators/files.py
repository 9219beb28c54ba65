"""Admission of files by globs, size and change."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 1_048_576


def glob_regex(glob: str) -> str:
    """A regular expression for a shell glob, for whole texts; built once, when the plan is made."""
    return fnmatch.translate(glob).replace(r"\z", r"\Z").replace("(?s:", "(?s)(?:")


def matches(path: Column, globs: list[str]) -> Column:
    """A glob fits the path, its last part or any part; one that ends in a slash fits a folder on the way."""
    name = F.element_at(F.split(path, "/"), -1)
    def fits(glob: str) -> Column:
        if glob.endswith("/"):
            return F.contains(F.concat(F.lit("/"), path), F.lit("/" + glob))
        rx = glob_regex(glob)
        return path.rlike(rx) | name.rlike(rx) | F.exists(F.split(path, "/"), lambda p: p.rlike(rx))

    out = F.lit(False)
    for glob in globs:
        out = out | fits(glob)
    return out


def admitted(files: DataFrame, include: list[str], exclude: list[str], max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files that an include glob fits by name and no exclude glob fits, up to a size; each path once."""
    return files.where(matches(F.col("path"), include) & ~matches(F.col("path"), exclude) & (F.col("length") <= max_bytes)).dropDuplicates(["path"])
