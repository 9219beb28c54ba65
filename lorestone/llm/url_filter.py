"""URL filters by a bit-parallel wildcard automaton.

Every glob is a chain of states, one bit each; all globs lie side by side in one bit string of as many 64-bit words as needed.
Reading a byte shifts the string by one, keeps the states whose symbol fits the byte, and keeps a wildcard's state alive while
its loop accepts the byte (Shift-And with self-loops). Thus one pass over a URL simulates all globs at once; numpy does so for
all URLs of a batch together. Globs: ``*`` any run without a slash, ``**`` any run, ``?`` one character, ``\\`` escapes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, lower_ascii, read

#: (host, path, verdict); a rule holds for its host and all subdomains where the path starts with the rule's.
HOST_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Globs over "." + host + path that block a URL no rule speaks about.
BLOCK_GLOBS = ("*.ads.**", "*.adserver.**", "*.cheap-*.**", "*.casino-*.**", "**/ads/**", "**/wp-login.php**")
SLASH = 47
FEW = 24  # strings


def escaped(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


@dataclass
class Automaton:
    """``keep[c]``: states that byte c enters; ``loop[c]``: states that byte c lets stay; ``final[p]``: (word, bit) of glob p."""

    start: np.ndarray
    keep: np.ndarray
    loop: np.ndarray
    word: np.ndarray
    bit: np.ndarray


def compiled(globs: list[str]) -> Automaton:
    states: list[tuple[object, set[int]]] = []  # (set of entering bytes, set of looping bytes); a glob's first state is entered by none
    starts, finals = [], []
    anything, in_segment = set(range(256)), set(range(256)) - {SLASH}
    heads, tails = set(range(0x80)) | set(range(0xC0, 0x100)), set(range(0x80, 0xC0))
    for glob in globs:
        starts.append(len(states))
        states.append((set(), set()))
        i = 0
        while i < len(glob):
            c = glob[i]
            if c == "*":
                whole = glob[i : i + 2] == "**"
                states[-1][1].update(anything if whole else in_segment)
                i += 1 + whole
                continue
            if c == "?":
                states.append((heads - {SLASH}, set(tails)))
            else:
                if c == "\\" and i + 1 < len(glob):
                    i += 1
                    c = glob[i]
                for b in c.encode():
                    states.append(({b}, set()))
            i += 1
        finals.append(len(states) - 1)
    words = max(1, -(-len(states) // 64))
    start, keep, loop = np.zeros(words, np.uint64), np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
    for s in starts:
        start[s // 64] |= np.uint64(1 << (s % 64))
    for s, (enter, stay) in enumerate(states):
        m = np.uint64(1 << (s % 64))
        for b in enter:
            keep[b, s // 64] |= m
        for b in stay:
            loop[b, s // 64] |= m
    at = np.array(finals, dtype=np.int64)
    return Automaton(start, keep, loop, at // 64, (at % 64).astype(np.uint64))


def _finish(a: Automaton, state: np.ndarray, text: bytes) -> np.ndarray:
    """The state of one string after ``text``."""
    whole = lambda words: int.from_bytes(words.astype("<u8").tobytes(), "little")
    keep, loop = [whole(x) for x in a.keep], [whole(x) for x in a.loop]
    now = whole(state)
    for c in text:
        now = (now << 1) & keep[c] | now & loop[c]
    return np.frombuffer(now.to_bytes(8 * len(state), "little"), "<u8")


def run_all(a: Automaton, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Booleans (URL, glob): which globs fit which of the byte strings data[offsets[i]:offsets[i + 1]]."""
    n = len(offsets) - 1
    length = offsets[1:] - offsets[:-1]
    order = np.argsort(-length, kind="stable")
    begin, length = offsets[:-1][order], length[order]
    state = np.tile(a.start, (n, 1))
    for t in range(int(length[0]) if n else 0):
        m = int(np.searchsorted(-length, -t, side="left"))  # those still longer than t
        if m <= FEW:  # a step over so few costs more than its numbers: these go on one by one, all words in one integer
            for i in range(m):
                state[i] = _finish(a, state[i], data[begin[i] + t : begin[i] + length[i]].tobytes())
            break
        c, s = data[begin[:m] + t], state[:m]
        moved = s << np.uint64(1)
        if s.shape[1] > 1:
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
        state[:m] = (moved & a.keep[c]) | (s & a.loop[c])
    out = np.empty((n, len(a.word)), dtype=bool)
    out[order] = (state[:, a.word] >> a.bit) & np.uint64(1) != 0
    return out


def host_and_path(url):
    """Columns (host, path). Null, or no ``://``: both are empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def judge(pages: DataFrame, url_col: str = "url", rules=HOST_RULES, block_globs=BLOCK_GLOBS) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``; columns of those names are replaced, all others kept.

    URLs of any length are read whole, in time proportional to it. The rule with the longest host and path decides; rules of equal length: the one listed first. A URL without a rule is
    blocked if one of ``block_globs`` fits "." + host + path, else allowed. A null or malformed URL has no host, so no rule.
    """
    rules = list(rules)
    order = sorted(range(len(rules)), key=lambda i: -len(rules[i][0] + rules[i][1]))
    globs = [f"*.{escaped(rules[i][0])}{escaped(rules[i][1])}**" for i in order] + list(block_globs)
    names = np.array([rules[i][0] + rules[i][1] for i in order] + [None], dtype=object)
    verdicts = np.array([rules[i][2] for i in order], dtype=object)
    k, automaton = len(rules), compiled(globs)

    def run(batches):
        for batch in batches:
            text = batch.column(batch.num_columns - 1).cast(pa.large_binary())
            raw, offs = text.buffers()[2], text.buffers()[1]
            offsets = np.frombuffer(offs, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
            hit = run_all(automaton, np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8), offsets)
            first = np.where(hit[:, :k].any(axis=1), hit[:, :k].argmax(axis=1), k) if k else np.full(len(text), 0)
            blocked = np.where(hit[:, k:].any(axis=1), "block", "allow").astype(object)
            verdict = np.where(first < k, verdicts[np.minimum(first, k - 1)], blocked) if k else blocked
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names[first].tolist(), pa.string()), pa.array(verdict.tolist(), pa.string())], names=[*batch.schema.names[:-1], "rule", "verdict"])

    taken = {"host", "path", "rule", "verdict"}
    host, path = host_and_path(F.col(url_col))
    kept = [c for c in pages.columns if c not in taken]
    base = pages.select(*kept, host.alias("host"), path.alias("path"))
    base = base.withColumn(free_name(base.columns, "canonical"), F.concat(F.lit("."), "host", "path"))
    from pyspark.sql import types as T

    schema = T.StructType([*base.schema.fields[:-1], T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return base.mapInArrow(run, schema)


def op2_wildcard_automaton(spark, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches('.' || host || path, '^[^/]*\.(ads|adserver)\.') OR regexp_matches('.' || host || path, '^[^/]*\.(cheap|casino)-[^/]*\.')
      OR contains(path, '/ads/') OR contains(path, '/wp-login.php') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""
