"""The rows that parsers give."""

from __future__ import annotations

from typing import NamedTuple


class Row(NamedTuple):
    """``row`` is entity, relation, chunk or error. ``detail`` is JSON: the observations of an entity, what the code of a chunk uses."""

    row: str
    name: str
    other: str | None
    kind: str
    line: int
    content: str | None = None
    detail: str | None = None
