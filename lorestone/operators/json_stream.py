"""Objects of large JSON files, one after the other: a file's arrays are read item by item and leave in batches, so that no parsed file is held."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lorestone.operators.extract import item_name, item_text

#: Arrays that are streamed. Fixed values.
ARRAYS = ("site_pages", "items", "articles", "posts", "data", "entries", "records", "results", "content", "messages", "documents")
BATCH = 1000
SPACE = re.compile(r"\s*")
KEY = re.compile(r'\s*"((?:[^"\\]|\\.)*)"\s*:\s*')


def skip(text: str, at: int) -> int:
    return SPACE.match(text, at).end()


def streamed(text: str, most: int | None = None) -> Iterator[tuple[str, int, dict]]:
    """(array, index, item) of the objects in the top level's arrays, in order, at most ``most`` of each. A text that breaks off gives what came before."""
    read = json.JSONDecoder().raw_decode
    at = skip(text, 0)
    if text[at : at + 1] != "{":
        return
    at += 1
    while m := KEY.match(text, at):
        at = m.end()
        if m[1] in ARRAYS and text[at : at + 1] == "[":
            at, i = skip(text, at + 1), 0
            while at < len(text) and text[at] != "]":
                try:
                    item, at = read(text, at)
                except ValueError:
                    return
                if isinstance(item, dict) and (most is None or i < most):
                    yield m[1], i, item
                i += 1
                at = skip(text, at)
                if text[at : at + 1] == ",":
                    at = skip(text, at + 1)
            at += 1
        else:
            try:
                _, at = read(text, at)
            except ValueError:
                return
        at = skip(text, at)
        if text[at : at + 1] != ",":
            return
        at += 1


def is_streamed(file: str, content_only: bool) -> bool:
    """Only JSON files whose contents alone are wanted."""
    return content_only and file.lower().endswith(".json")


def items(files: DataFrame, most: int | None = None, batch: int = BATCH) -> DataFrame:
    """(file, field, index, batch, name, text). ``files``: file, text. Batches of ``batch`` items leave a task as they are read."""

    def run(batches):
        for table in batches:
            for file, text in zip(table.column(0).to_pylist(), table.column(1), strict=True):
                held: list[tuple] = []
                n = 0

                def out(rows, number, file=file):
                    arrays, index, found = zip(*rows, strict=True)
                    return pa.RecordBatch.from_arrays([
                        pa.array([file] * len(rows)), pa.array(arrays), pa.array(index, pa.int32()), pa.array([number] * len(rows), pa.int32()),
                        pa.array([item_name(a, i, x) for a, i, x in rows]), pa.array([item_text(x) for x in found]),
                    ], names=["file", "field", "index", "batch", "name", "text"])

                for found in streamed(text.as_py() or "", most):
                    held.append(found)
                    if len(held) == batch:
                        yield out(held, n)
                        held, n = [], n + 1
                if held:
                    yield out(held, n)

    return files.select("file", "text").mapInArrow(run, "file string, field string, index int, batch int, name string, text string")
