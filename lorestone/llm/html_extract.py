"""Main text of web pages by wrapper induction.

A page becomes a tree of its block elements with leaves of text. A host's pages are parted by layout, the set of their containers' tag paths, and the
pages of a layout are aligned to its pivot page by simple tree matching (the largest common top-down tree that keeps the order of siblings). Sums over
all different pages of a layout make its wrapper: pivot leaves that keep their text on most pages are template, and the varying text of every pivot
element says where the content is: the deepest container that holds most of it is the content slot. A page's text is what lies in its counterpart of that
slot, without template leaves and without elements that say what they are (menus, footers, adverts, forms, comments, scripts).

A layout with too few pages takes the wrapper of the host's largest layout. Tag names (article, main) decide only where no wrapper names a slot: hosts
with too few pages, pages without a host, and layouts whose varying text has no container of its own.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, stage
from .url_filter import host_and_path

TOKEN = re.compile(r"""<!--|<[!?]|</?[A-Za-z]""")
ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
RAW = frozenset("script style textarea title noscript template iframe xmp svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of these ends an open one of the second, unless one of the third lies between.
BLOCKS_THAT_END_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
TEMPLATE_TAGS = frozenset("head nav footer aside form button select dialog menu object embed canvas audio video map input".split()) | RAW
TEMPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Class and id tokens of page furniture: a word, perhaps behind a place or ahead of a kind of box.
TEMPLATE_WORDS = re.compile(
    r"(?:(?:site|page|main|top|bottom|left|right|global|primary|secondary|user|reader)[-_]?)?"
    r"(?:ads?|adv|advert\w*|adsense|sponsor\w*|promos?|promotions?|banners?|nav|navbar|navigation|menus?|side-?bars?|footers?|masthead|comments?|respond|disqus\w*|repl(?:y|ies)|cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|modal|overlay|newsletters?|subscribe|subscription|shar(?:e|ing)|social|related|breadcrumbs?|pagination|pager|widgets?|toolbar|login|signup|search)"
    r"(?:[-_]+(?:area|areas|block|box|container|wrapper|wrap|list|section|item|items|bar|banner|notice|message|links?|unit|slot|inner|form|thread|posts?|buttons?|icons?|panel|top|bottom|left|right|menu|share|media|body|text|author|meta|\d+))*", re.I)  # fmt: skip
CONTENT_TAGS = frozenset(("article", "main"))
NEVER_TEMPLATE = frozenset(("html", "body", "article", "main"))
#: Elements that hold text rather than sections; they and what they hold say nothing about a page's layout.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table thead tbody tfoot tr td th caption hr figure figcaption address img br details summary center".split())

LEAF, SHARE, LEAST_PAGES = "#", 0.6, 3  # a pivot leaf is template if it keeps its text on SHARE of the layout's other different pages, and at least LEAST_PAGES of them align to it
INSIDE_PAGES = 10  # as many are asked for a leaf inside an article or main element, as its text may be a copied article
SLOT_SHARE = 0.6  # of a layout's varying text is in its content slot
SLOT_LEAVES = 1.5  # leaves that the slot holds on average at least; what holds one is a paragraph
CELLS = 4_000_000  # of an alignment's table that are held at once; larger ones are halved until they fit
BY_NAME, BY_TAG, HEADER = 1, 2, 3
SALTS = 16
BROADCAST_BYTES = 16 << 20
FLUSH = 200_000


class Page:
    """By node, in document order: ``tag`` (LEAF for text), ``parent``, ``text``, ``links`` (characters inside links) and ``own``, what an element says of itself: BY_NAME, BY_TAG, HEADER or 0."""

    def __init__(self, source: str):
        self.tag, self.parent, self.text, self.links, self.own = ["html"], [-1], [""], [0], [0]
        self._stack = [0]
        self._pieces: list[str] = []
        self._linked = 0
        self._in_link = 0
        self._parse(source)
        self._leaf()
        # inside an article; dropped: by what an element around says. An article in an element of a telling name is kept, one in an aside is not
        self.inside, self.dropped = [False], [0]
        for i in range(1, len(self.tag)):
            p, own = self.parent[i], self.own[i]
            around, inside = self.dropped[p], self.inside[p]
            article = self.tag[i] in CONTENT_TAGS and not own
            if own == HEADER:
                own = 0 if inside else BY_TAG
            self.dropped.append(max(own, 0 if article and around == BY_NAME else around))
            self.inside.append(inside or article)

    def _leaf(self) -> None:
        if self._pieces:
            text = " ".join("".join(self._pieces).split())
            if text:
                self._add(LEAF, self._stack[-1], 0)
                self.text[-1] = text
                self.links[-1] = min(len(text), self._linked)
            self._pieces, self._linked = [], 0

    def _add(self, tag: str, parent: int, own: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.text.append("")
        self.links.append(0)
        self.own.append(own)
        return len(self.tag) - 1

    def _say(self, raw: str) -> None:
        if raw:
            text = html_lib.unescape(raw) if "&" in raw else raw
            self._pieces.append(text)
            if self._in_link:
                self._linked += len(text)

    def _end(self, names, until) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[k]]
            if tag in names:
                self._leaf()
                del self._stack[k:]
                return
            if tag in until:
                return

    def _open(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            self._in_link += tag == "a"
            return
        if tag == "br":
            self._pieces.append(" ")
            return
        self._leaf()
        if tag in BLOCKS_THAT_END_P:
            self._end({"p"}, {"table", "td", "th", "button", "article", "section", "div", "li", "blockquote"} - {tag} if tag != "p" else {"table", "td", "th", "button"})
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag == "html":
            return
        at = self._add(tag, self._stack[-1], self._template(tag, attributes))
        if tag not in VOID:
            self._stack.append(at)

    @staticmethod
    def _template(tag: str, attributes: str) -> int:
        if tag in TEMPLATE_TAGS:
            return BY_TAG
        if "=" not in attributes and "hidden" not in attributes:
            return HEADER if tag == "header" else 0
        named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        if named.get("role", "").lower() in TEMPLATE_ROLES or named.get("aria-hidden") == "true" or re.search(r"(?:^|\s)hidden(?:\s|/|$)", re.sub(r"""=\s*(?:"[^"]*"|'[^']*')""", "", attributes)) or re.search(r"display\s*:\s*none", named.get("style", "")):
            return BY_TAG if tag not in NEVER_TEMPLATE or tag == "article" else 0
        names = f"{named.get('class', '')} {named.get('id', '')}".split()
        if tag in NEVER_TEMPLATE:
            return BY_TAG if tag == "article" and any(re.fullmatch(r"(?:comments?|repl(?:y|ies)|ads?)(?:[-_].*)?", n, re.I) for n in names) else 0
        return BY_NAME if any(TEMPLATE_WORDS.fullmatch(n) for n in names) else HEADER if tag == "header" else 0

    def _close(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a" and self._in_link:
                self._in_link -= 1
            return
        if tag == "br":
            self._pieces.append(" ")
            return
        if tag == "p":
            self._end({"p"}, {"article", "section", "div", "li", "td", "th", "body", "blockquote"})
            return
        self._leaf()
        for k in range(len(self._stack) - 1, 0, -1):
            if self.tag[self._stack[k]] == tag:
                del self._stack[k:]
                self._in_link = 0
                return

    def _parse(self, s: str) -> None:
        at, n = 0, len(s)
        quoted = True  # False once a quote is known to stay open
        while at < n:
            m = TOKEN.search(s, at)
            if not m:
                break
            self._say(s[at : m.start()])
            if m[0] == "<!--":
                end = s.find("-->", m.end())
                if s.startswith(">", m.end()) or s.startswith("->", m.end()):  # an empty comment
                    end = s.find(">", m.end()) - 2
                    at = end + 3
                    continue
                at = n if end < 0 else end + 3
                continue
            if m[0] in ("<!", "<?"):
                end = s.find(">", m.end())
                at = n if end < 0 else end + 1
                continue
            name = NAME.match(s, m.end() - 1)[0]
            start = m.end() - 1 + len(name)
            whole = ATTRIBUTES.match(s, start) if quoted else None
            if whole:
                end = whole.end()
            else:
                quoted = False
                end = s.find(">", start) + 1
                if end == 0:
                    return
            name = name.lower()
            at = end
            if m[0][1] == "/":
                self._close(name)
                continue
            attributes = s[start : end - 1]
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(s, end)
                at = close.end() if close else n
                if name not in ("svg", "math"):
                    self._leaf()
                continue
            self._open(name, attributes)
        else:
            return
        self._say(s[at:])

    def leaves(self) -> list[int]:
        return [i for i, t in enumerate(self.tag) if t == LEAF]


class Skeleton:
    """What alignment needs of a page: tag numbers, parents, text checksums, lengths of text outside links and of furniture, and what lies inside articles; kept as bytes."""

    def __init__(self, tag: np.ndarray, parent: np.ndarray, text: np.ndarray, plain: np.ndarray, inside: np.ndarray):
        self.tag, self.parent, self.text, self.plain, self.inside = tag, parent, text, plain, inside
        n = len(tag)
        self.children: list[list[int]] = [[] for _ in range(n)]
        for i, p in enumerate(parent.tolist()):
            if p >= 0:
                self.children[p].append(i)
        self.size, self.shape = [1] * n, [0] * n
        tags, parents = tag.tolist(), parent.tolist()
        for i in range(n - 1, -1, -1):
            self.shape[i] = hash((tags[i], *[self.shape[c] for c in self.children[i]]))
            if i and parents[i] >= 0:
                self.size[parents[i]] += self.size[i]

    @classmethod
    def of(cls, page: Page) -> Skeleton:
        tag = np.array([zlib.crc32(t.encode()) for t in page.tag], np.uint32)
        text = np.array([zlib.crc32(t.encode()) | zlib.adler32(t.encode()) << 32 if t else 0 for t in page.text], np.uint64)
        plain = np.array([0 if d else len(t) - k for t, k, d in zip(page.text, page.links, page.dropped, strict=True)], np.int32)
        return cls(tag, np.array(page.parent, np.int32), text, plain, np.array(page.inside, np.uint8))

    def packed(self) -> bytes:
        return b"".join([np.array([len(self.tag)], "<u4").tobytes(), *(x.tobytes() for x in (self.tag, self.parent, self.text, self.plain, self.inside))])

    @classmethod
    def unpacked(cls, raw: bytes) -> Skeleton:
        n, at, parts = int(np.frombuffer(raw, "<u4", 1)[0]), 4, []
        for kind in (np.uint32, np.int32, np.uint64, np.int32, np.uint8):
            parts.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        return cls(*parts)

    def sums(self, value: np.ndarray) -> np.ndarray:
        """The sum of ``value`` below every node, itself included."""
        out = value.astype(np.int64).tolist()
        parents = self.parent.tolist()
        for i in range(len(out) - 1, 0, -1):
            out[parents[i]] += out[i]
        return np.array(out)


def layout(page: Page) -> int:
    """A number for the set of tag paths of the page's containers: pages that differ in their text elements alone have one layout."""
    path, held = [""] * len(page.tag), [False] * len(page.tag)
    found = set()
    for i, tag in enumerate(page.tag):
        p = page.parent[i]
        held[i] = tag == LEAF or tag in TEXT_TAGS or (p >= 0 and held[p])
        if not held[i] and tag != "head" and (p < 0 or page.tag[p] != "head"):
            path[i] = f"{path[p] if p >= 0 else ''}/{tag}"
            found.add(path[i])
    return zlib.crc32("\n".join(sorted(found)).encode())


def chain(weights, p: int, q: int, cells: int = CELLS) -> list[tuple[int, int]]:
    """Pairs of a heaviest order-keeping matching of 0..p-1 with 0..q-1, where ``weights(i)`` gives the weights of i with all of q. Tables over ``cells`` are halved (Hirschberg)."""

    def rows(lo: int, hi: int, a: int, b: int, back: bool) -> np.ndarray:
        row = np.zeros(b - a + 1, np.int64)
        for i in range(hi - 1, lo - 1, -1) if back else range(lo, hi):
            w = weights(i)[a:b]
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (w[::-1] if back else w)))
        return row

    out, todo = [], [(0, p, 0, q)]
    while todo:
        lo, hi, a, b = todo.pop()
        if hi <= lo or b <= a:
            continue
        if (hi - lo + 1) * (b - a + 1) <= cells or hi - lo == 1:
            table = np.zeros((hi - lo + 1, b - a + 1), np.int64)
            for i in range(lo, hi):
                above, row = table[i - lo], table[i - lo + 1]
                row[1:] = np.maximum.accumulate(np.maximum(above[1:], above[:-1] + weights(i)[a:b]))
            i, k = hi - lo, b - a
            while i and k:
                if table[i, k] == table[i - 1, k]:
                    i -= 1
                elif table[i, k] == table[i, k - 1]:
                    k -= 1
                else:
                    i, k = i - 1, k - 1
                    out.append((lo + i, a + k))
            continue
        middle = (lo + hi) // 2
        cut = a + int(np.argmax(rows(lo, middle, a, b, False) + rows(middle, hi, a, b, True)[::-1]))
        todo += [(lo, middle, a, cut), (middle, hi, cut, b)]
    return out


def aligned(a: Skeleton, b: Skeleton, cells: int = CELLS) -> list[tuple[int, int]]:
    """Pairs of nodes of a largest top-down, order-keeping common tree of ``a`` and ``b`` (simple tree matching). A score depends on two shapes alone, so equal shapes are compared once."""
    known: dict[tuple[int, int], int] = {}

    def ends(x: int, y: int) -> tuple[int, int]:
        """How many children surely match from either end: those of equal shapes."""
        p, q = a.children[x], b.children[y]
        lo, hi, n = 0, 0, min(len(p), len(q))
        while lo < n and a.shape[p[lo]] == b.shape[q[lo]]:
            lo += 1
        while hi < n - lo and a.shape[p[-1 - hi]] == b.shape[q[-1 - hi]]:
            hi += 1
        return lo, hi

    def inner(x: int, y: int) -> tuple[list[int], list[int]]:
        lo, hi = ends(x, y)
        return a.children[x][lo : len(a.children[x]) - hi], b.children[y][lo : len(b.children[y]) - hi]

    def kinds(side: Skeleton, nodes: list[int]) -> dict[int, int]:
        return {side.shape[i]: i for i in nodes}

    def weigher(p: list[int], q: list[int]):
        """Row i of the weights: scores of the shapes that stand in q, dealt out to their places; rows of equal shapes are made once."""
        shapes, place = np.unique(np.array([b.shape[j] for j in q], np.int64), return_inverse=True)
        first = {b.shape[j]: j for j in q}
        made: dict[int, np.ndarray] = {}

        def row(i: int) -> np.ndarray:
            shape = a.shape[p[i]]
            if shape not in made:
                if len(made) > 64:
                    made.clear()
                made[shape] = np.array([score(p[i], first[s]) for s in shapes.tolist()], np.int64)[place]
            return made[shape]

        return row

    def score(x: int, y: int) -> int:
        """Of nodes whose children's scores are known."""
        if a.tag[x] != b.tag[y]:
            return 0
        if a.shape[x] == b.shape[y]:
            return a.size[x]
        if a.size[x] == 1 or b.size[y] == 1:
            return 1
        return known[a.shape[x], b.shape[y]]

    def heaviest(x: int, y: int) -> int:
        lo, hi = ends(x, y)
        p, q = inner(x, y)
        sure = sum(a.size[i] for i in a.children[x][:lo]) + sum(a.size[i] for i in a.children[x][len(a.children[x]) - hi :])
        if not p or not q:
            return 1 + sure
        row, weights = np.zeros(len(q) + 1, np.int64), weigher(p, q)
        for i in range(len(p)):
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights(i)))
        return 1 + sure + int(row[-1])

    todo = [(0, 0, False)]
    while todo:  # a pair is scored after the pairs of its children's shapes
        x, y, ready = todo.pop()
        key = (a.shape[x], b.shape[y])
        if a.tag[x] != b.tag[y] or key[0] == key[1] or a.size[x] == 1 or b.size[y] == 1 or key in known:
            continue
        if ready:
            known[key] = heaviest(x, y)
            continue
        todo.append((x, y, True))
        p, q = inner(x, y)
        others = kinds(b, q)
        todo += [(i, j, False) for i in kinds(a, p).values() for j in others.values()]
    out, todo = [], [(0, 0)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        if a.size[x] == 1 or b.size[y] == 1:
            continue
        (lo, hi), (p, q) = ends(x, y), inner(x, y)
        todo += zip(a.children[x][:lo], b.children[y][:lo], strict=True)
        if hi:
            todo += zip(a.children[x][-hi:], b.children[y][-hi:], strict=True)
        if p and q:
            todo += [(p[i], q[k]) for i, k in chain(weigher(p, q), len(p), len(q), cells)]
    return out


#: Checksums of tags, as skeletons hold them.
_TEXT, _HEADS, _ARTICLE, _LEAF = ({zlib.crc32(t.encode()) for t in tags} for tags in (TEXT_TAGS, ("h1", "h2", "h3"), ("article",), (LEAF,)))


class Wrapper:
    """A layout's pivot, its template leaves, and its content slot: -1 where no container below the body holds most of the varying text.

    ``marks``: (node, pages, same, mass, leaves) sums over the layout's different pages. For a pivot leaf, on how many pages it has a counterpart and
    on how many one of equal text; for a pivot element, the varying text of its counterparts, outside links and furniture, and their leaves.
    """

    def __init__(self, pivot: Skeleton, pages: int, marks: list[tuple[int, int, int, int, int]]):
        self.pivot = pivot
        others = pages - 1
        leaf = {m[0]: m for m in marks if pivot.text[m[0]]}
        # the pivot itself is one of the pages and always the same
        self.fixed = {y: n for y, n, same, _, _ in leaf.values() if n - 1 >= LEAST_PAGES and same - 1 >= SHARE * others}
        self.slot = self._slot({m[0]: m for m in marks if m[0] not in leaf}) if others >= LEAST_PAGES else -1

    def _slot(self, element: dict[int, tuple[int, int, int, int, int]]) -> int:
        tag, children = self.pivot.tag.tolist(), self.pivot.children
        mass = lambda y: element[y][3] if y in element else 0
        at, total, depth = 0, mass(0), 0
        while total:
            below = [c for c in children[at] if tag[c] not in _LEAF]
            best = max(below, key=lambda c: (mass(c), -c), default=None)
            headed = any(tag[c] in _HEADS for c in below)  # a headline belongs to the text beside it
            if best is None or tag[at] in _ARTICLE or headed or tag[best] in _TEXT or mass(best) < SLOT_SHARE * total or element[best][4] < SLOT_LEAVES * element[best][1]:
                break
            at, depth = best, depth + 1
        return at if depth > 1 else -1  # deeper than the body

    def parts(self, page: Skeleton, cells: int = CELLS) -> tuple[set[int], list[int]]:
        """The page's template leaves and the counterparts of the content slot: with an article those beside it too."""
        template, slots = set(), []
        for x, y in aligned(page, self.pivot, cells):
            if y == self.slot:
                beside = page.children[page.parent[x]]
                slots = [i for i in beside if page.tag[i] == page.tag[x]] if page.tag[x] in _ARTICLE else [x]
            if y in self.fixed and page.text[x] == self.pivot.text[y] and (not page.inside[x] or self.fixed[y] > INSIDE_PAGES):
                template.add(x)
        return template, slots


def counted(page: Skeleton, pivot: Skeleton) -> list[tuple[int, int, int, int]]:
    """(pivot node, same, mass, leaves) of a page's alignment; a Wrapper is made of their sums."""
    pairs = aligned(page, pivot)
    varying = page.plain.copy()
    for x, y in pairs:
        if page.text[x] and page.text[x] == pivot.text[y]:
            varying[x] = 0
    mass, leaves = page.sums(varying), page.sums(page.text != 0)
    return [(y, int(page.text[x] == pivot.text[y]), 0, 0) if pivot.text[y] else (y, 0, int(mass[x]), int(leaves[x])) for x, y in pairs]


def main_text(page: Page, template: set[int], slots: list[int] | None = None) -> str:
    """Blocks of the page that are content: in the slots, less what says that it is furniture; without slots, inside its articles if they have any text, else anywhere."""
    leaves = [i for i in page.leaves() if i not in template]
    if slots:
        state = [-1] * len(page.tag)  # -1 outside the slots; a name outside a slot does not count, nor does a header inside
        for i in range(1, len(page.tag)):
            around = state[page.parent[i]]
            own = page.own[i] if page.own[i] != HEADER else 0
            state[i] = max(around, own) if around >= 0 else (own == BY_TAG if i in slots else -1)
        return "\n".join(page.text[i] for i in leaves if state[i] == 0)
    kept = [i for i in leaves if not page.dropped[i]]
    return "\n".join(page.text[i] for i in [i for i in kept if page.inside[i]] or kept)


def _skeletons(pages: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                parsed = [Page(h or "") for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([layout(p) for p in parsed], pa.int64()), pa.array([Skeleton.of(p).packed() for p in parsed], pa.binary())], names=["host", "order", "layout", "skeleton"])

    return pages.select("host", "order", "html").mapInArrow(run, "host string, order string, layout long, skeleton binary")


def _laid_out(rows: DataFrame) -> DataFrame:
    """Adds ``_layout``, the number of the layout of ``_html``, the last column."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                numbers = [layout(Page(h or "")) for h in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(numbers, pa.int64())], names=[*part.schema.names, "_layout"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_layout", T.LongType())]))


def induce(pages: DataFrame) -> DataFrame:
    """(host, layout, pages, skeleton, marks): each layout's pivot page and the sums that make its Wrapper. ``pages`` has host, order and html.

    Every different page of a layout is aligned to its pivot, the page with the smallest ``order``; copies of a page are no evidence of a template.
    Salting spreads a large host over many tasks.
    """
    skeletons = stage(_skeletons(pages).groupBy("host", "layout", "skeleton").agg(F.min("order").alias("order")), "html-skeletons")
    pivots = skeletons.groupBy("host", "layout").agg(F.min_by("skeleton", F.struct("order", F.xxhash64("skeleton"))).alias("pivot"), F.count(F.lit(1)).alias("pages")).where(F.col("pages") > LEAST_PAGES)
    salted = skeletons.withColumn("salt", F.pmod(F.xxhash64("skeleton"), F.lit(SALTS)))
    both = salted.join(pivots.drop("pages").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["host", "layout", "salt"]).select("host", "layout", "skeleton", "pivot")

    def run(batches):
        sums: dict[tuple[str, int, int], list[int]] = {}
        last = (None, None)

        def flush():
            keys = list(sums)
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int32()), *(pa.array([sums[k][i] for k in keys], pa.int64()) for i in range(4))], names=["host", "layout", "node", "n", "same", "mass", "leaves"])
            sums.clear()
            return out

        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                for host, number, raw, pivot_raw in zip(*(c.to_pylist() for c in batch.slice(start, 128).columns), strict=True):
                    if last[0] != pivot_raw:
                        last = (pivot_raw, Skeleton.unpacked(pivot_raw))
                    for y, *more in counted(Skeleton.unpacked(raw), last[1]):
                        s = sums.setdefault((host, number, y), [0, 0, 0, 0])
                        s[0] += 1
                        for i in range(3):
                            s[i + 1] += more[i]
                    if len(sums) >= FLUSH:
                        yield flush()
        yield flush()

    counts = both.mapInArrow(run, "host string, layout long, node int, n long, same long, mass long, leaves long").groupBy("host", "layout", "node").agg(*(F.sum(c).alias(c) for c in ("n", "same", "mass", "leaves")))
    marks = counts.groupBy("host", "layout").agg(F.collect_list(F.struct("node", "n", "same", "mass", "leaves")).alias("marks"))  # at most the pivot's nodes
    return pivots.join(marks, ["host", "layout"]).select("host", "layout", "pages", F.col("pivot").alias("skeleton"), "marks")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", order_col: str = "page_id") -> DataFrame:
    """Adds ``text`` to every row: its main text, empty if there is none; a column of that name is replaced.

    A null or empty page has no text. Pages whose URL is null or has no host have no wrapper. Repeated pages are each extracted; of ties for the pivot the
    smaller checksum counts. Nothing is cut: tags that stay open end with their parents, an unfinished tag or comment ends the page, lists of any length are
    aligned whole. Columns named _host, _html and _wrappers must not be there (ValueError).
    """
    clash = {"_host", "_html", "_layout", "_wrapper", "_main", "_salt"} & set(pages.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are in use")
    kept = [c for c in pages.columns if c != "text"]
    host, _ = host_and_path(F.col(url_col))
    order = F.coalesce(F.col(order_col).cast("string"), F.lit(""))
    wrappers = stage(induce(pages.select(host.alias("host"), order.alias("order"), F.col(html_col).alias("html")).where("host <> ''")), "html-wrappers")
    base = pages.select(*kept, host.alias("_host"), F.col(html_col).alias("_html"))
    size = wrappers.agg(F.sum(F.octet_length("host") + F.octet_length("skeleton") + 36 * F.size("marks"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return _extracted_here(base, wrappers)
    one = F.struct("layout", "pages", "skeleton", "marks")
    own = wrappers.select(F.col("host").alias("_host"), F.col("layout").alias("_layout"), one.alias("_wrapper"))
    main = wrappers.groupBy(F.col("host").alias("_host")).agg(F.max_by(one, F.struct("pages", "layout")).alias("_main"))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    salted = _laid_out(base).withColumn("_salt", F.pmod(F.xxhash64("_html"), F.lit(SALTS)))
    joined = salted.join(own.withColumn("_salt", salts), ["_host", "_layout", "_salt"], "left").join(main.withColumn("_salt", salts), ["_host", "_salt"], "left")
    return _extracted(joined.select(*kept, "_host", "_html", F.coalesce("_wrapper", "_main").alias("_wrapper")))


def _made(w: dict) -> Wrapper:
    return Wrapper(Skeleton.unpacked(w["skeleton"]), w["pages"], [tuple(m.values()) for m in w["marks"]])


def _texts(rows: DataFrame, fields: list[T.StructField], text_of) -> DataFrame:
    """``fields`` of the rows and the text that ``text_of`` (batch, row number, page) gives; the page is the column behind the fields and the host."""
    n = len(fields)

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 128):
                batch = whole.slice(k, 128)
                texts = [text_of(batch, i, Page(source or "")) for i, source in enumerate(batch.column(n + 1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], names=[*batch.schema.names[:n], "text"])

    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType())]))


def _extracted_here(rows: DataFrame, wrappers: DataFrame) -> DataFrame:
    """With all wrappers, few as they are, in every task: (fields, _host, _html)."""
    found = [r.asDict(recursive=True) for r in wrappers.toLocalIterator()]
    shared = rows.sparkSession.sparkContext.broadcast(found)
    made: dict[tuple[str, int], Wrapper] = {}
    raw: dict[str, dict[int, dict]] = {}
    n = rows.columns.index("_host")

    def text_of(batch: pa.RecordBatch, i: int, page: Page) -> str:
        if not raw and shared.value:
            for w in shared.value:
                raw.setdefault(w["host"], {})[w["layout"]] = w
        of_host = raw.get(batch.column(n)[i].as_py())
        if not of_host:
            return main_text(page, set())
        w = of_host.get(layout(page)) or max(of_host.values(), key=lambda w: (w["pages"], w["layout"]))
        key = (w["host"], w["layout"])
        if key not in made:
            made[key] = _made(w)
        return main_text(page, *made[key].parts(Skeleton.of(page)))

    return _texts(rows, rows.schema.fields[:-2], text_of)


def _extracted(rows: DataFrame) -> DataFrame:
    """With each row's wrapper beside it: (fields, _host, _html, _wrapper)."""
    known: dict[tuple[str, int], Wrapper] = {}
    n = rows.columns.index("_host")

    def text_of(batch: pa.RecordBatch, i: int, page: Page) -> str:
        found = batch.column(n + 2)[i]
        if not found.is_valid:
            return main_text(page, set())
        key = (batch.column(n)[i].as_py(), found["layout"].as_py())
        if key not in known:
            if len(known) >= 256:
                known.clear()
            known[key] = _made(found.as_py())
        return main_text(page, *known[key].parts(Skeleton.of(page)))

    return _texts(rows, rows.schema.fields[:-3], text_of)


def op5_wrapper_induction(spark, sf_dir: str) -> DataFrame:
    found = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
