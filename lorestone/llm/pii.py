"""Personal data by candidate gradient boosting.

Exact rules give base spans that always stay. Beside them high-recall generators propose overlapping candidates (written-out addresses,
phone numbers without a plus, IPv6 addresses, grouped card numbers); boosted trees rate each by its format and its context, the rating is calibrated, and
thresholds for each kind select what is redacted; of overlapping candidates the likelier stays. The trees are trained here, on seeded examples of the
formats and of what only looks like them.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOTTED = re.compile(r"[0-9][0-9.]*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")
DIGIT = re.compile("[0-9]")
# generators
AT = re.compile(r"(?i)\s?[(\[{]\s?at\s?[)\]}]\s?|\s@\s|\sat\s")
AFTER = re.compile(r"(?i)[A-Za-z0-9-]+(?:(?:\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s|\.)[A-Za-z0-9-]+)+")
NUMBER = re.compile(r"(?:\([0-9]{2,5}\)|[0-9]{2,4})(?:[\x20./-]{1,2}[0-9]{2,5}){1,5}(?![0-9])")
HEXES = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4})?(?::[0-9A-Fa-f]{1,4})*")
WORDS = {
    "email": re.compile(r"(?i)e-?mail|contact|write|address|correo|adresse|schreib|écri"),
    "ip": re.compile(r"(?i)\bip\b|host|server|addr|ping|subnet|client"),
    "card": re.compile(r"(?i)card|visa|master|amex|tarjeta|karte|carte|credit"),
    "phone": re.compile(r"(?i)phone|call|tel\b|tel[.:]|mobile|fax|teléfono|telefon|téléphone|anruf|appel"),
}
NEGATIVE = re.compile(r"(?i)version|order|invoice|isbn|serial|page|date|\bid\b|build|section|score|ticket|time|ref\b|no\.")
CONTEXT = 32
SEED, EXAMPLES, TREES, DEPTH, RATE, BINS = 7, 4000, 50, 3, 0.2, 32
PRECISION = 0.98


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((2 * d) // 10 + (2 * d) % 10 for d in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The exact rules: leftmost non-overlapping matches of each kind; failing ones are dropped. In one pass over the text each."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not DIGIT.search(text):
        return out
    for m in DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts, pos = [], m.start()
            for part in m[0].split("."):
                parts = [*parts, (part, pos)] if part else []
                pos += len(part) + 1
                if len(parts) == 4:
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p, _ in parts):
                        out.append(("ip", parts[0][1], pos - 1))
                    parts = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that could be personal data in other notations; they may overlap and most are not."""
    out = []
    for m in AT.finditer(text):
        start = m.start()
        while start > 0 and text[start - 1] in LOCAL:  # as far as a name goes; what parts two of these matches is in no name
            start -= 1
        right = AFTER.match(text, m.end()) if start < m.start() else None
        if right:
            out.append(("email", start, right.end()))
    if DIGIT.search(text):
        for m in NUMBER.finditer(text):
            n = len(NOT_DIGIT.sub("", m[0]))
            if 8 <= n <= 15:
                out.append(("phone", *m.span()))
            if 13 <= n <= 19:
                out.append(("card", *m.span()))
    if text.count(":") > 2:
        out += [("ip", *m.span()) for m in HEXES.finditer(text) if m.end() - m.start() >= 6]
    return out


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    near = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
    digits = NOT_DIGIT.sub("", s)
    groups = [g for g in NOT_DIGIT.split(s) if g]
    marks = {c for c in s if not c.isalnum()}
    return [
        float(KINDS.index(kind)), len(s), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), len(groups[-1]) if groups else 0, len(groups[0]) if groups else 0,
        len(marks), float(any(c in s for c in "([{")), float(" at " in s.lower()), float(" dot " in s.lower() or "dot)" in s.lower() or "dot]" in s.lower()), float("." in s), float("/" in s), float("-" in s),
        float(bool(digits) and luhn(digits)), float(s[:1] == "("), s.count(":"), sum(c in "abcdefABCDEF" for c in s), float(max((int(g) for g in groups if len(g) < 5), default=0) > 255),
        float(start > 0 and text[start - 1].isalnum()), float(end < len(text) and text[end].isalnum()), float(bool(WORDS[kind].search(near))), float(bool(NEGATIVE.search(near))), float(len(re.split(r"[\s.]+", s)[-1])),
    ]


def examples(n: int = EXAMPLES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of seeded snippets: other notations of personal data, and look-alikes."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("an", "the", "re", "on", "de", "la", "un", "er", "ti", "ing", "st", "or")) for _ in range(r.randint(1, 3)))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    tlds, bare = ("com", "org", "net", "de", "fr", "es", "io"), ("mail", "web", "post", "uni", "firm")

    def valid_card(size: int) -> str:
        body = d(size - 1)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def positive() -> tuple[str, str, list[str]]:
        kind = r.choice(KINDS)
        cues = {"email": ["email ", "contact: ", "write to "], "ip": ["ip ", "host ", "server "], "card": ["card ", "visa ", "credit card: "], "phone": ["call ", "phone: ", "tel. ", "fax "]}[kind]
        if kind == "email":
            at, dot = r.choice(((" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), (" at ", " dot "), ("(at)", "."), (" @ ", "."), ("{at}", "{dot}")))
            return kind, f"{word()}{r.choice(('', '.', '_'))}{word()}{r.choice(('', d(2)))}{at}{r.choice(bare)}{d(1)}{dot}{r.choice(tlds)}", cues
        if kind == "ip":
            return kind, ":".join(hexes(r.randint(3, 4)) for _ in range(8)), cues
        if kind == "card":
            c = valid_card(r.choice((13, 15)))
            return kind, f"{c[:4]}-{c[4:10]}-{c[10:]}" if len(c) == 15 else f"{c[:4]} {c[4:7]} {c[7:10]} {c[10:]}", cues
        sep = r.choice(" .-")
        return kind, r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)} {d(4)}", f"{d(3)}{sep}{d(3)}{sep}{d(4)}", f"({d(4)}) {d(3)} {d(4)}")), cues

    def negative() -> tuple[str, str, list[str]]:
        kind = r.choice(KINDS)
        cues = ["version ", "order ", "invoice ", "isbn ", "serial ", "score ", "build ", "time ", "page "]
        if kind == "email":
            return kind, f"{word()} at {word()}{r.choice(('.', '. ', ' '))}{word().capitalize()}", cues + [word() + " "] * 8
        if kind == "ip":
            return kind, r.choice((f"{d(2)}:{d(2)}:{d(2)}", f"{d(2)}:{d(2)}:{d(2)}:{d(2)}", ":".join(hexes(2) for _ in range(6)))), cues
        if kind == "card":
            return kind, r.choice((f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(4)} {d(4)} {d(4)} {d(3)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}")), cues
        return kind, r.choice((f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.20{d(2)}", f"{d(4)}-{d(4)}", f"{d(2)} {d(2)} {d(2)} {d(2)}", f"20{d(2)}/{d(2)}/{d(2)} {d(2)}", f"{d(4)} {d(4)} {d(4)} {d(3)}", f"19{d(2)} {d(4)} 20{d(2)}")), cues

    rows, labels = [], []
    while len(rows) < n:
        y = r.random() < 0.4
        kind, s, cues = (positive if y else negative)()
        cue = r.choice(cues) if r.random() < 0.6 else word() + " "
        text = f"{word()} {word()} {cue}{s} {word()} {word()}"
        at = text.index(s, len(cue))
        for k, a, b in candidates(text):
            if k == kind and a >= at - 1 and b <= at + len(s) + 1:
                rows.append(features(text, k, a, b))
                labels.append(y)
    return np.array(rows[:n]), np.array(labels[:n], float)


class Boosted:
    """Gradient-boosted regression trees of fixed depth on binned features, for the logistic loss, with a calibrated rating."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        fit = np.arange(len(y)) % 3 != 0
        b, t = self._binned(x[fit]), y[fit]
        self.prior = float(np.log((t.mean() + 1e-6) / (1 - t.mean() + 1e-6)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        z = np.full(len(t), self.prior)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            tree, leaf = self._tree(b, t - p, p * (1 - p))
            self.trees.append(tree)
            z += tree[2][leaf]
        self.slope, self.shift = 1.0, 0.0
        held, h = self.margin(x[~fit]), y[~fit]
        self.slope, self.shift = self._calibrated(held, h)
        p = self.rate(x[~fit])
        kinds = x[~fit][:, 0].astype(int)
        self.threshold = np.full(len(KINDS), 1.01)
        for k in range(len(KINDS)):
            for t0 in np.linspace(0.5, 0.99, 50):
                on = (kinds == k) & (p >= t0)
                if on.any() and h[on].mean() >= PRECISION:
                    self.threshold[k] = t0
                    break

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        inner = (1 << DEPTH) - 1
        feature, cut, node = np.zeros(inner, int), np.full(inner, BINS + 1), np.zeros(len(b), int)
        for n in range(inner):
            rows = np.flatnonzero(node == n)
            best = 1e-9
            if len(rows) > 1:
                gs, hs = g[rows].sum(), h[rows].sum()
                for j in range(b.shape[1]):
                    gl = np.cumsum(np.bincount(b[rows, j], g[rows], BINS + 1))
                    hl = np.cumsum(np.bincount(b[rows, j], h[rows], BINS + 1))
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    c = int(gain.argmax())
                    if gain[c] > best:
                        best, feature[n], cut[n] = gain[c], j, c
            node[rows] = 2 * n + 1 + (b[rows, feature[n]] > cut[n])
        leaf = node - inner
        value = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        return (feature, cut, value), leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, z = self._binned(x), np.full(len(x), self.prior)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[np.arange(len(x)), feature[node]] > cut[node])
            z += value[node - len(cut)]
        return z

    @staticmethod
    def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Platt's slope and shift, by Newton's method with a small ridge towards (1, 0)."""
        w, m = np.array([1.0, 0.0]), np.stack([z, np.ones_like(z)], axis=1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(m @ w, -50, 50)))
            w = w - np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + np.eye(2), m.T @ (p - y) + (w - [1, 0]))
        return float(w[0]), float(w[1])

    def rate(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -50, 50)))


@functools.lru_cache(maxsize=1)
def default_model() -> Boosted:
    return Boosted(*examples())


class _Cover:
    """Whether a range meets any of some spans, by binary search."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        ordered = sorted((a, b) for _, a, b in spans)
        self.starts = [a for a, _ in ordered]
        self.ends = list(itertools.accumulate((b for _, b in ordered), max))

    def meets(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start


def all_spans(texts: list[str], model: Boosted) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """For each text its base spans and all its spans, each by kind and then start."""
    bases = [base_spans(t) for t in texts]
    found = [(i, c) for i, t in enumerate(texts) for c in candidates(t)]
    covers = {i: _Cover(bases[i]) for i in {i for i, _ in found}}
    found = [(i, c) for i, c in found if not covers[i].meets(c[1], c[2])]
    extra: dict[int, list[tuple[float, str, int, int]]] = {}
    if found:
        p = model.rate(np.array([features(texts[i], *c) for i, c in found]))
        for (i, (k, a, b)), q in zip(found, p.tolist(), strict=True):
            if q >= model.threshold[KINDS.index(k)]:
                extra.setdefault(i, []).append((q, k, a, b))
    key = lambda s: (KINDS.index(s[0]), s[1], s[2])
    out = []
    for i, base in enumerate(bases):
        chosen: list[tuple[str, int, int]] = []
        end = -1
        groups: list[list[tuple[float, str, int, int]]] = []
        for c in sorted(extra.get(i, []), key=lambda c: c[2]):  # runs of overlapping candidates
            if c[2] < end:
                groups[-1].append(c)
            else:
                groups.append([c])
            end = max(end, c[3])
        for group in groups:
            taken: list[tuple[str, int, int]] = []
            for _, k, a, b in sorted(group, key=lambda c: (-c[0], c[2], c[3], c[1])):
                if not any(x < b and a < y for _, x, y in taken):
                    taken.append((k, a, b))
            chosen += taken
        out.append((sorted(base, key=key), sorted(base + chosen, key=key)))
    return out


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SLICE_ROWS = 256


def _mapped(docs: DataFrame, text_col: str, model: Boosted | None, added: list[T.StructField], finish) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(k, SLICE_ROWS)
                texts = part.column(at).to_pylist()
                yield finish(part, texts, all_spans([t or "" for t in texts], shared.value))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def find(docs: DataFrame, text_col: str = "text", model: Boosted | None = None) -> DataFrame:
    """Adds ``base`` and ``spans``, arrays of (kind, start, end) in code points, to every row; a null or empty text has none. Columns of these names are refused (ValueError)."""
    clash = {"base", "spans"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are in use")
    dicts = lambda s: [{"kind": k, "start": a, "end": b} for k, a, b in s]

    def finish(part, _, found):
        return pa.RecordBatch.from_arrays([*part.columns, pa.array([dicts(b) for b, _ in found], ARROW_SPAN), pa.array([dicts(s) for _, s in found], ARROW_SPAN)], names=[*part.schema.names, "base", "spans"])

    return _mapped(docs, text_col, model, [T.StructField("base", SPAN), T.StructField("spans", SPAN)], finish)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Every run of overlapping spans becomes the name of its first kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", model: Boosted | None = None) -> DataFrame:
    """The documents with their columns, personal data in the text replaced; a null text stays null, a text without any stays as it is."""
    at = docs.columns.index(text_col)

    def finish(part, texts, found):
        new = [t if t is None or not s else redacted(t, s) for t, (_, s) in zip(texts, found, strict=True)]
        columns = list(part.columns)
        columns[at] = pa.array(new, part.schema.field(at).type)
        return pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return _mapped(docs, text_col, model, [], finish)


def op3_candidate_boosting(spark, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
