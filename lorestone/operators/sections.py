"""Markdown sections and the chunks they are grouped into: boundaries by levels, oversized sections parted, small ones joined, neighbours overlapping."""

from __future__ import annotations

import re
from typing import NamedTuple

LEAST, TARGET, LARGEST, BUDGET = 100, 600, 1000, 850  # tokens of a section that stands alone, of a chunk that is joined no more, of a chunk at most, of a group at most
SMALL_PART, MOST_SECTIONS, MOST_JOINED, OVERLAP, EMPTY = 100, 10, 8, 200, 5
#: Where an oversized section is parted: blank lines, paragraphs, list items, sentences, code fences. Fixed values, in this order.
BOUNDARIES = (r"\n\n\n+", r"\n\n(?=[A-Z])", r"\n(?=[-*+] |\d+\.)", r"(?<=\.)\s+(?=[A-Z])", r"\n(?=```)", r"(?<=```)\n")


class Section(NamedTuple):
    title: str
    level: int
    line: int  # of the header, from 1
    end: int  # the last line, from 1
    content: str
    path: tuple[str, ...]  # titles from the top down

    @property
    def tokens(self) -> int:
        return tokens(f"{self.title}\n\n{self.content}")


def tokens(text: str) -> int:
    return max(1, len(text) // 4)


def headers(lines: list[str]) -> list[tuple[str, int, int]]:
    """(title, level, index) of header lines outside code fences."""
    out, fenced = [], False
    for i, line in enumerate(lines):
        s = line.strip()
        fenced ^= s.startswith("```")
        if not fenced and s.startswith("#") and (title := s.lstrip("#").strip()):
            out.append((title, len(s) - len(s.lstrip("#")), i))
    return out


def ends_before(level: int, following: int) -> bool:
    """Whether a section of ``level`` ends at a header of ``following``: one of the first level at the next of level two or less, others at one as high or right below."""
    return following <= 2 if level == 1 else following <= level + 1


def sections(text: str) -> list[Section]:
    """Sections with text; the titles of empty ones go to the next that has some, and are counted in its title."""
    lines = text.split("\n")
    found, out, stack, waiting = headers(lines), [], [], []
    before = "\n".join(lines[: found[0][2]] if found else lines).strip()
    if before:  # text ahead of the first header has no title
        out.append(Section("", 1, 1, found[0][2] if found else len(lines), before, ()))
    for k, (title, level, i) in enumerate(found):
        end = next((at for _, other, at in found[k + 1 :] if ends_before(level, other)), len(lines))
        content = "\n".join(lines[i + 1 : end]).strip()
        if len(content) <= EMPTY:
            waiting.append(title)
            continue
        stack = [*stack[: level - 1], title]
        out.append(Section(f"{title} (+{len(waiting)} more)" if waiting else title, level, i + 1, end, content, tuple(stack)))
        waiting = []
    return out


def parted(s: Section) -> list[Section]:
    """An oversized section cut where the boundaries allow, pattern by pattern; small parts join the one before."""
    if s.tokens <= LARGEST:
        return [s]
    parts = [s.content]
    for pattern in BOUNDARIES:
        parts = [p for part in parts for p in ((x.strip() for x in re.split(pattern, part)) if tokens(f"{s.title}\n\n{part}") > LARGEST else [part]) if p.strip()]
    out: list[Section] = []
    for i, part in enumerate(parts):
        if out and tokens(f"{s.title}\n\n{part}") < SMALL_PART:
            out[-1] = out[-1]._replace(content=f"{out[-1].content}\n\n{part}")
        else:
            out.append(s._replace(title=f"{s.title} (Part {i + 1})" if len(parts) > 1 else s.title, content=part))
    return out


def grouped(found: list[Section]) -> list[list[Section]]:
    """Neighbours joined under the budget: those of one parent, up to six not too deep, always up to three; a section of LEAST tokens starts its own."""
    out: list[list[Section]] = []
    size, parent = 0, None
    for s in found:
        own = s.path[:-1]
        fits = bool(out) and size + s.tokens <= BUDGET and len(out[-1]) < MOST_SECTIONS and s.tokens < LEAST
        if fits and (own == parent or len(s.path) <= 3 and len(out[-1]) < 6 or len(out[-1]) < 3):
            out[-1].append(s)
            size += s.tokens
        else:
            out.append([s])
            size, parent = s.tokens, own
    return out


def redistributed(groups: list[list[Section]]) -> list[list[Section]]:
    """Groups under TARGET joined with the next one, else with the one before, within LARGEST tokens and MOST_JOINED sections."""
    size = lambda g: sum(s.tokens for s in g)
    fit = lambda a, b: size(a) + size(b) <= LARGEST and len(a) + len(b) <= MOST_JOINED
    out: list[list[Section]] = []
    todo = list(reversed(groups))
    while todo:
        g = todo.pop()
        if len(groups) > 1 and size(g) < TARGET:
            if todo and fit(g, todo[-1]):
                out.append(g + todo.pop())
                continue
            if out and fit(out[-1], g):
                out[-1] = out[-1] + g
                continue
        out.append(g)
    return out


class Chunk(NamedTuple):
    title: str
    line: int
    end: int
    content: str
    overlap: str  # the end of the chunk before
    titles: tuple[str, ...]
    tokens: int


def chunks(text: str) -> list[Chunk]:
    out: list[Chunk] = []
    last = ""
    for g in redistributed(grouped([p for s in sections(text) for p in parted(s)])):
        title = g[0].title + (f" (+{len(g) - 1} more)" if len(g) > 1 else "")
        content = g[0].content if len(g) == 1 else "\n\n".join(f"{'#' * s.level} {s.title}\n\n{s.content}" for s in g)
        out.append(Chunk(title, min(s.line for s in g), max(s.end for s in g), content, last, tuple(s.title for s in g), sum(s.tokens for s in g)))
        last = g[-1].content[-OVERLAP:]
    return out


def metadata_text(c: Chunk) -> str:
    """What is said of a chunk where its text is not at hand."""
    preview = c.content[:300] + ("..." if len(c.content) > 300 else "")
    return f"Sections: {', '.join(c.titles)} | Tokens: {c.tokens} | Preview: {preview} | Lines: {c.content.count(chr(10)) + 1} | Words: {len(c.content.split())}"
