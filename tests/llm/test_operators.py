"""Each training-data operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.cloudpickle import register_pickle_by_value, unregister_pickle_by_value

from lorestone.llm import bpe, decontaminate, distributed_suffixes, html_extract, near_dedup, packing, pii, sharding, suffix_dedup, toxicity, url_filter, vptree

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, "x" * 300_000), (4, "same words in here"), (5, "same words in here"), (5, "same words in here"), (None, "no id"), (7, " \t\n"), (8, "é" * 5000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with every oddity, and columns that clash with names used inside."""
    rows = [(i, t, 1, "x", 2) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, n long, key string, part long")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, n long, key string, part long")


# 1


def test_permutation_is_one():
    for n in (1, 2, 3, 5, 64, 65, 1000):
        assert sorted(sharding.permute(np.arange(n), n)) == list(range(n))
    assert (sharding.permute(np.arange(50), 50, 1) != sharding.permute(np.arange(50), 50, 2)).any()


def test_shards(spark, sf):
    got = sharding.op1_feistel_sharding(spark, sf).collect()
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    slots = collections.defaultdict(list)
    order = sorted(rows, key=lambda i: (i, zlib.crc32(rows[i].encode())))
    for r in got:
        data = (rows[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "rows", None)
        assert (r["shard"], r["slot"]) == sharding.place(order.index(r["doc_id"]), len(rows), 40)
        slots[r["shard"]].append(r["slot"])
    sizes = [len(s) for s in slots.values()]
    assert len(sizes) == 40 and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_odd_rows(odd, nothing):
    got = sharding.shard(odd.select("doc_id", "n", "key"), ["doc_id", "n"], 4).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted((p % 4, p // 4) for p in range(len(ODD)))
    assert sharding.shard(nothing.select("doc_id"), ["doc_id"], 3).count() == 0


# 2


def fits(glob: str, text: str) -> bool:
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + r"[\s\S]*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return re.fullmatch(out, text) is not None


def test_automaton_is_a_matcher():
    r = random.Random(2)
    globs = ["".join(r.choice(["a", "b", "/", "*", "**", "?", "\\*", "é"]) for _ in range(r.randint(0, 9))) for _ in range(60)]
    texts = ["".join(r.choice("aab/*é") for _ in range(r.randint(0, 12))) for _ in range(400)]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    got = url_filter.run_all(url_filter.compiled(globs), np.frombuffer(b"".join(data), np.uint8), offsets)
    assert got.tolist() == [[fits(g, t) for g in globs] for t in texts]


URLS = [
    ("https://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"), ("http://example.net", "example.net", "", None, "allow"), ("http://b.net/", "b.net", "/", "net/", "block"), ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    ("http://example.com/de/a", "example.com", "/de/a", "example.com/de/", "block"), ("x://org/fr/", "org", "/fr/", "org/fr/", "allow"), (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"), ("http://a.com/ads/1", "a.com", "/ads/1", None, "block"), ("http://" + "a" * 50_000 + ".net/" + "b" * 50_000, "a" * 50_000 + ".net", "/" + "b" * 50_000, "net/", "block"),
]


def test_long_urls_and_clashing_columns(spark):
    """A URL of a megabyte in linear time, ties of equally long rules, and the caller's own helper-like columns."""
    long = "http://h.ads.net/" + "a/" * 500_000
    began = time.time()
    rows = [(1, long, "x", "y"), (2, "http://e.com/ads/" + "b" * 300_000 + "/ads/", "x", "y"), (3, None, "x", "y"), (4, "http://t.io/aa", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, canonical string, _url string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, rules=[("net", "/", "block"), ("t.io", "/", "allow"), ("io", "/aa", "block")]).collect()}
    assert time.time() - began < 30
    assert [(got[i]["rule"], got[i]["verdict"]) for i in (1, 2, 3, 4)] == [("net/", "block"), (None, "block"), (None, "allow"), ("t.io/", "allow")]
    assert all(r["canonical"] == "x" and r["_url"] == "y" for r in got.values()) and got[1]["path"] == long[len("http://h.ads.net") :]


def test_urls(spark):
    rows = spark.createDataFrame([(i, u[0], "clash") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(rows).collect()}
    assert got == {i: u[1:] for i, u in enumerate(URLS)}
    assert url_filter.judge(rows.where("false")).count() == 0
    assert {r["verdict"] for r in url_filter.judge(rows, rules=(), block_globs=()).collect()} == {"allow"}


# 3

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def valid(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)] + [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and valid(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans():
    r = random.Random(5)
    for alphabet, size, n in (("a@@..b-1+9 ()%_0:2é", 40, 4000), ("0123456789 -", 60, 3000), ("+1234567890 ()-.", 40, 3000), ("012345.", 40, 2000)):
        for _ in range(n):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(0, size)))
            assert sorted(pii.base_spans(t)) == sorted(brute_spans(t)), t


def test_base_spans_in_linear_time():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1 " * 50_000, "@" * 200_000):
        pii.base_spans(t)
        pii.candidates(t)


def test_boosting():
    model = pii.default_model()
    x, y = pii.examples(2000, 99)
    chosen = model.rate(x) >= model.threshold[x[:, 0].astype(int)]
    assert y[chosen].mean() > 0.97 and chosen[y == 1].mean() > 0.9
    base, spans = pii.all_spans(["mail john.doe (at) web1 (dot) com or call (212) 555-1234, 4 at noon. See 2024-01-02"], model)[0]
    assert base == [] and [s[0] for s in spans] == ["email", "phone"]


def test_long_names_are_whole():
    text = "write to " + "a" * 80 + " at " + "b" * 70 + " dot org now"
    found = [s for s in pii.candidates(text) if s[0] == "email"]
    assert found == [("email", 9, len(text) - 4)]


def plain_rating(model, x):
    """The trees' sum for one candidate, node by node."""
    z = model.prior
    bins = [sum(e < v for e in edges) for edges, v in zip(model.edges, x, strict=True)]
    for feature, cut, value in model.trees:
        node = 0
        while node < len(cut):
            node = 2 * node + (2 if bins[feature[node]] > cut[node] else 1)
        z += value[node - len(cut)]
    return 1 / (1 + np.exp(-(model.slope * z + model.shift)))


def test_added_spans_against_plain_rating():
    """Every candidate rated by itself; of overlapping ones the likelier stays, and none that meets a base span."""
    r = random.Random(17)
    bits = ["call (212) 555-1234", "jo.e [at] web (dot) org", "a at b dot com", "4111 1111 1111 1111", "fe80::1:2:3", "version 1.2.3.4", "212-555-1234-77", "+1 212 555 1234", "x@y.org", "order 1234 5678 90", "the", "12:30:45:10", "mail a_b at c.org or 030 123 4567"]
    model = pii.default_model()
    texts = [" ".join(r.choice(bits) for _ in range(r.randint(0, 8))) for _ in range(600)] + [""]
    added = 0
    for text, (base, spans) in zip(texts, pii.all_spans(texts, model), strict=True):
        assert sorted(base) == sorted(brute_spans(text))
        rated = []
        for k, a, b in pii.candidates(text):
            q = plain_rating(model, pii.features(text, k, a, b))
            if q >= model.threshold[pii.KINDS.index(k)] and not any(x < b and a < y for _, x, y in base):
                rated.append((-q, a, b, k))
        kept = []
        for q, a, b, k in sorted(rated):
            if not any(x < b and a < y for _, x, y in kept):
                kept.append((k, a, b))
        assert sorted(spans) == sorted(base + kept), text
        added += len(kept)
    assert added > 300


def test_pii_rows(spark, odd, nothing):
    rows = spark.createDataFrame([(1, "é a@b.de x"), (2, None), (3, ""), (4, "10.0.0.1 10.0.0.1"), (4, "10.0.0.1 10.0.0.1")], "doc_id long, text string")
    assert [r["text"] for r in pii.redact(rows).orderBy("doc_id").collect()] == ["é [EMAIL] x", None, "", "[IP] [IP]", "[IP] [IP]"]
    assert [(s["start"], s["end"]) for s in pii.find(rows).where("doc_id = 1").first()["base"]] == [(2, 8)]
    assert pii.find(odd).count() == len(ODD) and pii.find(nothing).count() == 0


def test_op3(spark, sf):
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pii.op3_candidate_boosting(spark, sf).collect():
        base = sorted(brute_spans(rows[r["doc_id"]]), key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert set(listed) <= set(r["spans"].split(","))


# 4


def test_merges_equal_the_tokenizer():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    merges, r = bpe.WordMerges(packing.default_tokenizer()), random.Random(4)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéüßABC") for _ in range(r.randint(1, 25))) for _ in range(3000)] + ["a", "aaaaaaa", "ÿ", "banana" * 50]
    assert merges.encode(words) == [np.array(whole.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]


TEXTS = ["", "The end. It's done, isn't it?", "a\n\nb  c\t d", "Stop.", "e.g., x", "É E\u0301 H\u0331 İI", "<|endoftext|> <|ENDOFTEXT|>", "x.,. y,", "1234 5.6", "日本語 text ½", "\u00a0a\u2003b\u001cc", "word " * 3000]


def test_texts_equal_the_tokenizer():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    coder = packing.WordTokenizer(packing.default_tokenizer(), 2)
    assert coder.encode(TEXTS) == [np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for t in TEXTS]


def test_packing(spark, odd, nothing):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    pieces = packing.pack(odd, window=64).collect()
    by = collections.defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] and p["length"] > 0
        by[p["sequence_id"]].append((p["offset"], p["length"]))
    assert sorted(by) == list(range(len(by)))
    for k, parts in by.items():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) == 64 or k == max(by)
    want = collections.Counter()
    for i, t in ODD:
        want[i] += len(whole.encode(t or "", add_special_tokens=False).ids) + 1
    got = collections.Counter()
    for p in pieces:
        got[p["doc_id"]] += p["length"]
    assert got == want
    assert packing.pack(nothing).count() == 0


def test_op4(spark, sf):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    ids = {r["doc_id"]: [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    covered = collections.defaultdict(list)
    for r in packing.op4_concatenate_and_cut(spark, sf).collect():
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        covered[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
    assert {i: sorted(c) for i, c in covered.items()} == {i: list(range(len(x))) for i, x in ids.items()}


# 5

PAGE = "<html><head><title>T</title></head><body><nav><a href=/>x</a></nav><div class='ad'>buy</div><article><h1>Head &amp; more</h1><p>One<br>two<p><b>three</b> &eacute;<ul><li>a<li>b</ul><div class=comments><p>me</p></div></article><footer>end</footer></body></html>"


def text_of(source):
    return html_extract.main_text(html_extract.Page(source), set())


@pytest.mark.parametrize(("source", "text"), [(PAGE, "Head & more\nOne two\nthree é\na\nb"), ("", ""), ("<p>a", "a"), ("plain", "plain"), ("<p>a<!-- <p>no", "a"), ("<p>a <", "a <"), ("<script>x</script><p>b", "b"), ("<style>x", ""), ("<p title='a>b'>c</p>", "c"), ("<p x=\"open>c</p><p>d", "c\nd"), ("<div><p>a</div>b", "a\nb"), ("<p>a&nbsp;&nbsp;b", "a b"), ("<main><form>f</form>x<aside>y</aside></main>", "x"), ("<div hidden>h</div><div id=cookie-notice>c</div><div>t</div>", "t"), ("<p>" * 3000 + "deep", "deep"), ("<div>" * 3000 + "deep", "deep")])
def test_main_text(source, text):
    assert text_of(source) == text


def matched(a, b):
    """Simple tree matching by its recurrence."""

    def score(x, y):
        if a.tag[x] != b.tag[y]:
            return 0
        p, q = a.children[x], b.children[y]
        m = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i in range(1, len(p) + 1):
            for j in range(1, len(q) + 1):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + score(p[i - 1], q[j - 1]))
        return 1 + m[-1][-1]

    return score(0, 0)


def test_tree_matching():
    r = random.Random(6)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1) if depth else 'x'}</{t}>" for t in (r.choice(["div", "section", "h1"]) for _ in range(r.randint(0, 4))))

    for _ in range(200):
        a, b = (html_extract.Skeleton.of(html_extract.Page(tree(3))) for _ in range(2))
        pairs = html_extract.aligned(a, b)
        assert len(pairs) == matched(a, b)
        assert len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs)
        assert all(a.tag[x] == b.tag[y] for x, y in pairs)
        assert html_extract.Skeleton.unpacked(a.packed()).children == a.children


def test_wrapper(spark):
    """What stays the same on a host's pages goes, what varies stays; a host with one page keeps all."""
    page = "<body><div>Welcome to our site</div><div>{}</div><section>Call us today</section></body>"
    rows = [(i, f"http://h.org/{i}", page.format(f"Story number {i} with its own words")) for i in range(8)] + [(20, "http://one.org/", page.format("Alone")), (21, None, None), (22, "bad", "<p>x"), (22, "bad", "<p>x")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = collections.defaultdict(list)
    for r in html_extract.extract(pages).collect():
        got[r["page_id"]].append(r["text"])
    assert all(got[i] == [f"Story number {i} with its own words"] for i in range(8))
    assert got[20] == ["Welcome to our site\nAlone\nCall us today"] and got[21] == [""] and got[22] == ["x", "x"]
    assert html_extract.extract(pages.where("false")).count() == 0


def test_copies_are_no_template(spark):
    """Equal pages count once, and a leaf that only a group of near copies has is no template of the host."""
    copy = "<body><div>Long read</div><div>Its second part</div></body>"
    article = "<body><article><p>Head {}</p>{}</article></body>"
    long = "".join(f"<p>Part {k}</p>" for k in range(6))
    rows = [(i, f"http://c.org/{i}", copy) for i in range(4)] + [(100 + i, f"http://m.org/{i}", article.format(i, long)) for i in range(12)] + [(200 + i, f"http://m.org/x{i}", article.format(f"x{i}", "")) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "Long read\nIts second part" for i in range(4))
    assert all(got[100 + i] == "\n".join([f"Head {i}", *(f"Part {k}" for k in range(6))]) for i in range(12))


SOUP = "<body><div><a href=/a>Home {i}</a></div><div>Buy now {i}: the best offer number {i}</div><div><div>Headline {i}</div>{paragraphs}</div><div>Copyright {i} of us</div></body>"


def soup(i, n=3):
    return SOUP.format(i=i, paragraphs="".join(f"<p>Paragraph {k} of story {i} goes on for a while and says more than any offer does.</p>" for k in range(n + i % 3)))


def story(i, n=3):
    return "\n".join([f"Headline {i}", *(f"Paragraph {k} of story {i} goes on for a while and says more than any offer does." for k in range(n + i % 3))])


def other(i):
    """Another layout: a table of cells ahead of the text, in sections."""
    return f"<body><section><span>Login {i}</span></section><section><section><p>News {i} has its words, which are many here.</p><p>And {i} more of them follow in this place.</p></section><section>Tags {i}</section></section></body>"


def layouts():
    rows = [(i, "http://soup.org/%d" % i, soup(i)) for i in range(7)] + [(10 + i, "http://soup.org/n%d" % i, other(i)) for i in range(6)]
    rows += [(20, "http://soup.org/odd", "<body><article><p>Odd one</p></article></body>"), (21, "http://lone.org/", soup(21)), (22, None, soup(22)), (23, "http://soup.org/e", None), (24, "http://soup.org/0", soup(0))]
    want = {i: story(i) for i in range(7)} | {10 + i: f"News {i} has its words, which are many here.\nAnd {i} more of them follow in this place." for i in range(6)}
    return rows, want | {20: "Odd one", 23: "", 24: story(0)}


def test_varying_slots_choose_the_content(spark, monkeypatch):
    """Pages without any telling element, in two layouts of one host: the wrapper finds the text; without it, all the rest stays."""
    rows, want = layouts()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert {i: got[i] for i in want} == want
    assert "Buy now 21" in got[21] and "Buy now 22" in got[22]  # no host to learn from
    alone = {i: text_of(h or "") for i, _, h in rows}
    assert alone[20] == "Odd one" and all(alone[i] != want[i] for i in [*range(7), *range(10, 16)])
    with pytest.raises(ValueError, match="_html"):
        html_extract.extract(pages.withColumn("_html", pages["url"]))


def test_large_wrappers_are_joined(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", -1)
    rows, want = layouts()
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in want} == want


def plain_alignment(a, b):
    """Pairs of simple tree matching by its recurrence, children compared one by one."""

    def solve(x, y):
        p, q = a.children[x], b.children[y]
        if a.tag[x] != b.tag[y]:
            return 0, []
        table = [[(0, [])] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i in range(1, len(p) + 1):
            for j in range(1, len(q) + 1):
                s, pairs = solve(p[i - 1], q[j - 1])
                n, before = table[i - 1][j - 1]
                table[i][j] = max(table[i - 1][j], table[i][j - 1], (n + s, before + pairs) if s else (0, []), key=lambda t: t[0])
        n, pairs = table[-1][-1]
        return n + 1, [(x, y), *pairs]

    return solve(0, 0)[1]


def test_whole_query_against_brute_force(spark):
    """Wrappers from plain alignments of all different pages of a layout to its first page, and every page's text by them."""
    rows, _ = layouts()
    parsed = {i: html_extract.Page(h or "") for i, _, h in rows}
    skeletons = {i: html_extract.Skeleton.of(p) for i, p in parsed.items()}
    groups = collections.defaultdict(list)
    for i, url, _ in rows:
        if url:
            groups[url.split("/")[2], html_extract.layout(parsed[i])].append(i)
    wrappers = {}
    for key, ids in groups.items():
        different = {skeletons[i].packed(): i for i in sorted(ids, key=str, reverse=True)}
        if len(different) > 3:
            pivot = skeletons[min(different.values(), key=str)]
            sums = collections.defaultdict(lambda: [0, 0, 0, 0])
            for i in different.values():
                page, pairs = skeletons[i], plain_alignment(skeletons[i], pivot)
                below = lambda x, page=page: {z for z in range(len(page.tag)) if z == x or any(u == x for u in ancestors(page, z))}
                equal = {x for x, y in pairs if page.text[x] and page.text[x] == pivot.text[y]}
                for x, y in pairs:
                    new = (1, int(x in equal), 0, 0) if pivot.text[y] else (1, 0, sum(int(page.plain[z]) for z in below(x) - equal), sum(bool(page.text[z]) for z in below(x)))
                    sums[y] = [s + n for s, n in zip(sums[y], new, strict=True)]
            wrappers[key] = html_extract.Wrapper(pivot, len(different), [(y, *s) for y, s in sums.items()]), len(different)
    want = {}
    for i, url, _ in rows:
        host = url.split("/")[2] if url else None
        of_host = [(n, key[1], w) for key, (w, n) in wrappers.items() if key[0] == host]
        own = wrappers.get((host, html_extract.layout(parsed[i])))
        wrapper = own[0] if own else max(of_host)[2] if of_host else None
        if wrapper is None:
            want[i] = html_extract.main_text(parsed[i], set())
            continue
        pairs = plain_alignment(skeletons[i], wrapper.pivot)
        template = {x for x, y in pairs if y in wrapper.fixed and skeletons[i].text[x] == wrapper.pivot.text[y]}
        want[i] = html_extract.main_text(parsed[i], template, [x for x, y in pairs if y == wrapper.slot])
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def ancestors(page, z):
    while page.parent[z] >= 0:
        z = int(page.parent[z])
        yield z


def test_long_lists_are_aligned_whole():
    """A table that is halved gives matchings of the same weight, and constant blocks amid thousands of siblings are found."""
    r = random.Random(3)
    for _ in range(100):
        p, q = r.randint(1, 12), r.randint(1, 12)
        w = np.array([[r.randint(0, 3) for _ in range(q)] for _ in range(p)])
        whole, halved = (html_extract.chain(lambda i: w[i], p, q, cells) for cells in (10**6, 8))
        for pairs in (whole, halved):
            assert sum(w[i, k] for i, k in pairs) == sum(w[i, k] for i, k in whole) and sorted(i for i, _ in pairs) == sorted({i for i, _ in pairs})
            assert [k for _, k in sorted(pairs)] == sorted(k for _, k in pairs)
    page = lambda n: html_extract.Skeleton.of(html_extract.Page("<body>" + "".join(f"<p>{k}</p>" if k % 7 else f"<div><i>{k}</i></div>" for k in range(n)) + "</body>"))
    a, b = page(3000), page(2900)
    assert len(html_extract.aligned(a, b)) == len(b.tag)


@pytest.mark.parametrize(("source", "text"), [("<body class=layout><div class='layout has-sidebar'><article><div class='article-header'><h1>H</h1></div><p>t</p></article></div></body>", "H\nt"), ("<div class='content with-nav'>a</div><div class='site-footer'>f</div><div class='comments-area'>c</div>", "a"), ("<div id=sidebar><article>kept</article></div>", "kept"), ("<aside><article>teaser</article></aside><p>a", "a"), ("<header><h1>Site</h1></header><article><header><h1>H</h1></header></article>", "H"), ("<ul><li><a href=x>one</a></ul><p>a", "one\na")])
def test_names_of_layouts_drop_no_article(source, text):
    assert text_of(source) == text


def test_op5(spark, sf):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html_extract.op5_wrapper_induction(spark, sf).collect():
        inside = re.search("<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inside))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


# 6


def shingle_set(text, words):
    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def brute_components(rows, words, percent):
    sets = {i: shingle_set(t, words) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            n = len(sets[i] & sets[j])
            if i < j and n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_components_of_random_copies(spark, monkeypatch):
    r = random.Random(8)
    rows = []
    for i in range(220):
        if rows and r.random() < 0.7:
            words = r.choice(rows)[1].split()
            for _ in range(r.randint(0, max(1, len(words) // 12))):
                if words:
                    words[r.randrange(len(words))] = r.choice("abcdefgh")
        else:
            words = [r.choice("abcdefghijklmnopqrstuvwxyz") * r.randint(1, 3) for _ in range(r.choice((1, 2, 6, 30, 80)))]
        rows.append((i, " ".join(words)))
    want = brute_components(rows, 2, 80)
    for block, few in ((2048, 32), (16, 2), (5, 1)):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        monkeypatch.setattr(near_dedup, "REPRESENTATIVES", few)
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dedup.cluster(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
        assert got == want


def test_a_large_group_takes_linear_work(spark, monkeypatch):
    """Near copies of one text over many blocks: representatives join them, so that hardly any row goes to another block than its own; distant texts of the same bucket stay apart."""
    monkeypatch.setattr(near_dedup, "BLOCK", 50)
    r = random.Random(19)
    base = [f"w{r.randint(0, 10_000)}" for _ in range(60)]
    rows = []
    for i in range(1500):
        words = list(base)
        for _ in range(2 if i % 3 else 0):
            words[r.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(words)))
    guests, staged = [], near_dedup.stage

    def spy(df, name):
        out = staged(df, name)
        if name == "near-apart":
            guests.append(out.where("guest").count())
        return out

    monkeypatch.setattr(near_dedup, "stage", spy)
    got = near_dedup.cluster(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert {x["component_id"] for x in got} == {0} and len(got) == 1500
    assert guests and sum(guests) < 20_000  # of 75 buckets of up to 30 blocks, and of the coarse group; pairs of blocks would be 75 * 1500 * 30


def test_recall_near_the_threshold():
    """Pairs of a similarity just above 0.8 share a key and are within the distance; the stated chance of a miss is 5.2e-5."""
    r = np.random.default_rng(20)
    missed = 0
    for _ in range(2000):
        both = r.integers(0, 2**63, 80, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, r.integers(0, 2**63, 10, dtype=np.uint64)])) for _ in range(2))
        sa, sb = (np.frombuffer(near_dedup.signature(x), np.uint8) for x in (a, b))
        near = (sa != sb).sum() <= near_dedup.MOST
        missed += not near
        if near:
            assert (near_dedup.chunk_keys(sa[None]) == near_dedup.chunk_keys(sb[None])).any()
    assert missed <= 3


def test_keys_meet_within_the_distance():
    r = np.random.default_rng(3)
    a = r.integers(0, 256, (200, near_dedup.SIZE)).astype(np.uint8)
    b = a.copy()
    for row in b:
        row[r.choice(near_dedup.SIZE, near_dedup.MOST, replace=False)] ^= 1
    assert (near_dedup.chunk_keys(a) == near_dedup.chunk_keys(b)).any(axis=1).all()


def test_near_copies_of_odd_rows(odd, nothing):
    got = sorted(((x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in near_dedup.cluster(odd, words=5).collect()), key=repr)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (None, 1, None, True), (7, 0, 7, True), (8, 1, 8, True)], key=repr)
    assert near_dedup.cluster(nothing).count() == 0
    assert near_dedup.keep_one(odd).columns == odd.columns and near_dedup.keep_one(odd).count() == len(ODD) - 2


# 7

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_in(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_hits(docs, items, window):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words_in(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows[tuple(w[k : k + window])].add(str(i))
    out = []
    for t in docs:
        w, hit, found = words_in(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 30])
def test_benchmark_words(spark, block_bytes):
    r = random.Random(9)
    text = lambda n: " ".join(r.choice(("a", "b", "Ab", "é", "x1")) for _ in range(r.randint(0, n)))
    docs = [text(60) for _ in range(120)] + [None, "", "a" * 100_000]
    items = [(i, text(9)) for i in range(12)] + [(99, ""), (98, None), (97, "a b"), (97, "a b")]
    found = decontaminate.find_benchmark(spark.createDataFrame([(i, t, "c") for i, t in enumerate(docs)], "doc_id long, text string, item string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), window=4, block_bytes=block_bytes)
    got = {x["doc_id"]: (x["n_words"], sum(s["end"] - s["start"] for s in x["spans"]), x["items"]) for x in found.collect()}
    assert [got[i] for i in range(len(docs))] == brute_hits(docs, items, 4)


def test_suffix_array_by_doubling():
    r = np.random.default_rng(2)
    for n in (1, 2, 5, 200):
        for sigma in (2, 5, 300):
            s = np.concatenate([r.integers(1, sigma, n), [0]])
            assert decontaminate.suffix_array(s).tolist() == sorted(range(n + 1), key=lambda i: s[i:].tolist())


def test_phrases_are_arrays():
    """Windows, and the items that have them, against sets; a benchmark of a few megabytes is held in a few times its size."""
    r = random.Random(18)
    items = [(str(i), " ".join(r.choice("abc") for _ in range(r.randint(0, 9))).encode()) for i in range(60)]
    p = decontaminate.Phrases(items, 3)
    word = {n: w for w, n in p.number.items()}
    want, got = collections.defaultdict(set), {}
    for name, text in items:
        w = text.split()
        for k in range(max(1, len(w) - 2) if w else 0):
            want[tuple(w[k : k + 3])].add(name)
    for length, (places, starts, owners) in p.by_length.items():
        for i, at in enumerate(places.tolist()):
            got[tuple(word[x] for x in p.ids[at : at + length].tolist())] = {p.names[o] for o in owners[starts[i] : starts[i + 1]].tolist()}
    assert got == want
    text = b" ".join(b"w%d" % r.randint(0, 50_000) for _ in range(300_000))
    p = decontaminate.Phrases([("x", text)], 10)
    assert sum(a.nbytes for parts in p.by_length.values() for a in parts) + p.ids.nbytes < 5 * len(text)


def test_fm_index():
    r = np.random.default_rng(4)
    text = r.integers(1, 4, 300)
    index = decontaminate.FMIndex(text, 4)
    for size in (1, 2, 5):
        phrases = r.integers(1, 4, (20, size))
        for p, lo, hi in zip(phrases, *index.search(phrases), strict=True):
            want = [i for i in range(len(text) - size + 1) if (text[i : i + size] == p).all()]
            assert sorted(index.locate(np.arange(lo, hi)).tolist()) == want


def test_decontaminate_odd(spark, odd, nothing):
    bench = spark.createDataFrame([(1, "same words in here")], "item_id long, text string")
    assert decontaminate.decontaminate(odd, bench).columns == odd.columns
    assert decontaminate.decontaminate(odd, bench).count() == len(ODD) - 3
    assert decontaminate.decontaminate(odd, bench.where("false")).count() == len(ODD) and decontaminate.decontaminate(nothing, bench).count() == 0


def test_op7(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.op7_fm_index(spark, sf).collect()}
    for (i, _), (n, hit, found) in zip(docs, brute_hits([t for _, t in docs], items, 10), strict=True):
        assert got[i] == (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0)


# 8


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(10)
    make = lambda bad: " ".join([r.choice(("the", "house", "river", "stone", "walks", "near")) for _ in range(40)] + (["scumbags"] * 2 if bad else []))
    rows = [(i, make(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(*x, 1) for x in rows] + [(900, None, 1), (901, "", 1), (902, "x " * 100_000, 1)], "doc_id long, text string, n long")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (5, None), (12345, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, "doc_id", "text", "toxic", bits=14)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(300, 400)) and len(got) == 403
    assert got[900] == got[901] and all(0 <= s <= 1 for s in got.values())
    assert toxicity.score(docs.where("false"), model).count() == 0
    none = toxicity.train(docs, labels.where("false"), "doc_id", "text", "toxic", bits=14)
    assert all(x["score"] < 0.01 for x in toxicity.score(docs, none).collect())


def test_regression_against_a_dense_one(spark):
    """Sets of n-grams as strings, naive Bayes ratios from their counts, and Newton's method on the dense matrix give the same scores."""
    r = random.Random(16)
    words, bad = ["stone", "river", "walk", "near", "house"], ["scum", "vile"]
    texts = [" ".join(r.choice(words + bad * (i % 3 == 0)) for _ in range(12)) for i in range(240)]
    y = np.array([int(i % 3 == 0) if i % 17 else 1 - int(i % 3 == 0) for i in range(240)])
    grams = [{f" {t} "[k : k + n] for n in toxicity.SIZES for k in range(len(t) + 3 - n)} for t in texts]
    names = sorted(set().union(*grams))
    x = np.array([[float(g in s) for g in names] for s in grams])
    found, rows = np.stack([x[y == c].sum(0) for c in (0, 1)]), np.array([(y == c).sum() for c in (0, 1)])
    ratio = np.log(((found[1] + 1) / (rows[1] + 2)) / ((found[0] + 1) / (rows[0] + 2)))
    total, share = found.sum(0), rows[1] / rows.sum()
    use = (np.abs(found[1] - total * share) / np.sqrt(total * share * (1 - share) + 0.5) >= toxicity.TELLING) & (total > 1)
    a = np.hstack([x[:, use] * ratio[use], np.ones((240, 1))])
    weight, ridge, w = 0.5 / rows[y], np.append(np.full(use.sum(), toxicity.PENALTY), 0.0), np.zeros(use.sum() + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-12), a.T @ (weight * (p - y)) + ridge * w)
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(y)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels, "doc_id", "text", "toxic"))
    got = {x["doc_id"]: x["score"] for x in out.collect()}
    assert use.sum() > 5 and out.columns == ["doc_id", "text", "score"]
    assert max(abs(got[i] - 1 / (1 + np.exp(-z))) for i, z in enumerate(a @ w)) < 5e-3


def test_op8(spark):
    sf = "/root/testdata/sf0.01"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = toxicity.op8_naive_bayes_ngrams(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in toxic]
    assert sum(p == t for p, t in held) / len(held) > 0.9


# 9


def test_neighbours_against_brute_force(spark):
    r = np.random.default_rng(11)
    x = r.integers(-3, 4, (600, 4)).astype(float)  # many equal vectors and ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (800, [0.0] * 4), (900, [1.0, None, 0.0, 0.0]), (1000, [float("nan"), 1.0, 0.0, 0.0]), (1100, [float("inf"), 1.0, 0.0, 0.0]), (None, [1.0] * 4), (1200, [])]
    vectors = spark.createDataFrame([(*v, "c") for v in rows], "vec_id long, embedding array<double>, size string")
    good = [(i, np.array(v)) for i, v in rows[:600] if any(v)]
    for shard_rows, block in ((100_000, 4096), (64, 3)):
        found = collections.defaultdict(list)
        for y in vptree.nearest(vectors, vectors.where("vec_id % 100 = 0"), 10, shard_rows=shard_rows, block=block).orderBy("query_id", "rank").collect():
            found[y["query_id"]].append((y["score"], y["vec_id"]))
        asked = [(i, v) for i, v in good if i % 100 == 0]
        assert sorted(found) == [i for i, _ in asked]
        for i, q in asked:
            assert found[i] == sorted((float(np.sqrt(((q - v) ** 2).sum())), j) for j, v in good if j != i)[:10]


def test_relaxed_search_finds_most():
    r = np.random.default_rng(12)
    x, q = r.normal(size=(2000, 8)), r.normal(size=(20, 8))
    tree = vptree.Tree(x, 32)
    exact, _ = tree.search(q, 5)
    assert np.allclose(exact, np.sort(np.sqrt(((q[:, None] - x[None]) ** 2).sum(-1)), axis=1)[:, :5])
    loose, _ = tree.search(q, 5, factor=3.0)
    assert (loose >= exact - 1e-12).all() and (np.isclose(loose, exact)).mean() > 0.3


def test_tree_prunes_and_loses_nothing():
    """Clustered vectors: factor one gives the exact neighbours from a part of the distances; vectors whose squares overflow are compared too."""
    r = np.random.default_rng(14)
    centres = r.normal(size=(40, 6)) * 10
    x, q = centres[r.integers(40, size=4000)] + r.normal(size=(4000, 6)), centres[r.integers(40, size=30)]
    tree = vptree.Tree(x, 32)
    best, rows = tree.search(q, 10)
    every = vptree.distances(q, x)
    assert (best == np.sort(every, axis=1)[:, :10]).all() and (every[np.arange(30)[:, None], rows] == best).all()
    assert tree.computed < 0.2 * every.size
    wild = vptree.Tree(np.array([[1e200], [-1e200], [0.5]]), 1)
    assert wild.search(np.array([[1.0]]), 4)[1].tolist() == [[2, 0, 1, -1]]


@pytest.mark.parametrize(("factor", "least"), [(1.0, 1.0), (1.5, 0.9)])
def test_recall_of_factors(factor, least):
    r = np.random.default_rng(15)
    x = r.normal(size=(6000, 16)) * (0.7 ** np.arange(16))
    q = x[::100] + 0.0
    truth = np.argsort(vptree.distances(q, x), axis=1, kind="stable")[:, :11]
    _, rows = vptree.Tree(x).search(q, 11, factor)
    assert np.mean([len(set(a) & set(b)) / 11 for a, b in zip(truth.tolist(), rows.tolist(), strict=True)]) >= least


@pytest.mark.parametrize("shard_rows", [4, 1000])
def test_repeated_rows_are_one_neighbour(spark, shard_rows):
    """A near row that stands there often takes one rank, in one shard or many, and hides no other neighbour."""
    rows = [(0, [1.0, 0.0])] + [(1, [1.0, 0.1])] * 15 + [(1, [1.0, 0.2])] + [(i, [1.0, float(i)]) for i in range(2, 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vptree.nearest(vectors, vectors.where("vec_id = 0"), k=4, shard_rows=shard_rows).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 1), (2, 1), (3, 2), (4, 3)]


def test_few_neighbours(spark):
    v = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vptree.nearest(v, v.where("vec_id = 0")).collect()] == [(0, 1, 1, 1.0)]
    assert vptree.nearest(v.where("false"), v.where("false")).count() == 0


# 10


def brute_repeats(docs, length):
    count = collections.Counter(t[p : p + length] for t in docs for p in range(len(t) - length + 1))
    out = []
    for t in docs:
        cover = np.zeros(len(t) + 1, int)
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                cover[p] += 1
                cover[p + length] -= 1
        gone = np.cumsum(cover)[: len(t)] > 0
        out.append((int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("length", "many", "piece"), [(2, 1000, 1 << 15), (5, 3, 16), (12, 3, 1 << 15), (20, 1000, 16)])
def test_repeats(spark, monkeypatch, length, many, piece):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    r, docs = random.Random(length), []
    for _ in range(40):
        k = r.random()
        if docs and k < 0.4:
            u = r.choice(docs)
            a = r.randint(0, len(u))
            docs.append(u[a : a + r.randint(0, 60)] + "".join(r.choice("abé") for _ in range(r.randint(0, 9))))
        else:
            docs.append("a" * r.randint(0, 90) if k < 0.5 else "".join(r.choice("abcdefghijkl mnopé") for _ in range(r.randint(0, 90))))
    rows = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(docs)], "doc_id long, text string, lo int, _d string").repartition(3)
    got = {x["doc_id"]: x for x in suffix_dedup.remove_repeats(rows, length=length).collect()}
    for i, want in enumerate(brute_repeats([t.encode() for t in docs], length)):
        spans = got[i]["spans"]
        assert (sum(s["end"] - s["start"] for s in spans), len(spans), bytes(got[i]["kept"])) == want


def test_common_passage_is_no_large_shard(spark, monkeypatch):
    """A passage in very many documents with different surroundings: no suffix array gets more than two shards' text, and results stay exact."""
    one = suffix_dedup.repeated_windows

    def small(texts, length):
        if (n := sum(map(len, texts))) > 800_000:
            raise ValueError(f"{n} bytes in one shard")
        return one(texts, length)

    monkeypatch.setattr(suffix_dedup, "repeated_windows", small)
    register_pickle_by_value(suffix_dedup)  # so that the workers get the patched function
    try:
        r = random.Random(5)
        passage, letters = "".join(r.choices("abcdefghij", k=230)), "klmnopqrstuvwxyz"
        docs = ["".join(r.choices(letters, k=60)) + passage + "".join(r.choices(letters, k=60)) for _ in range(5000)]
        rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
        got = {x["doc_id"]: x for x in suffix_dedup.remove_repeats(rows).collect()}
    finally:
        unregister_pickle_by_value(suffix_dedup)
    for i, want in enumerate(brute_repeats([t.encode() for t in docs], 200)):
        spans = got[i]["spans"]
        assert (sum(s["end"] - s["start"] for s in spans), len(spans), bytes(got[i]["kept"])) == want


@pytest.mark.parametrize(("length", "bucket", "alphabet"), [(3, 40, "ab"), (20, 64, "abc"), (200, 500, "abcdefgh")])
def test_distributed_difference_cover(spark, monkeypatch, length, bucket, alphabet):
    """Over tables, in many buckets: the windows that start elsewhere too, for pieces that overlap in all residues."""
    monkeypatch.setattr(distributed_suffixes, "BUCKET", bucket)
    r = random.Random(length)
    base = "".join(r.choices(alphabet, k=3 * length))
    pieces = ["".join(r.choices(alphabet, k=r.randint(0, length))) + base[(a := r.randint(0, len(base) - 1)) : a + r.randint(1, 2 * length)] + "".join(r.choices(alphabet, k=r.randint(0, 9))) for _ in range(30)]
    pieces += ["", "a", base, base + "a" * length, "b" * (2 * length)]
    rows = [(i, i * 7, bytearray(p.encode())) for i, p in enumerate(pieces)]
    got = {(x["f1"], k) for x in distributed_suffixes.repeated(spark.createDataFrame(rows, "f1 long, f2 long, piece binary").repartition(3), length).collect() for k in range(x["lo"], x["hi"])}
    count = collections.Counter(p[k : k + length] for p in pieces for k in range(len(p) - length + 1))
    assert got == {(i, k) for i, p in enumerate(pieces) for k in range(len(p) - length + 1) if count[p[k : k + length]] > 1}
    assert distributed_suffixes.repeated(spark.createDataFrame([], "f1 long, f2 long, piece binary"), length).count() == 0


@pytest.mark.parametrize(("length", "rounds", "merges"), [(200, 2, 0), (700, 4, 2)])
def test_distributed_names_take_few_rounds(spark, monkeypatch, length, rounds, merges):
    """Places are named by up to 69 bytes, then by three names, for 200 bytes in two rounds of jobs and not in five; passages a byte too short, zeros and pieces that end in others do not mislead them."""
    monkeypatch.setattr(distributed_suffixes, "BUCKET", 300)
    staged, one = [], distributed_suffixes.stage
    monkeypatch.setattr(distributed_suffixes, "stage", lambda df, name: staged.append(name) or one(df, name))
    r = random.Random(69)
    letters, base = bytes([0, 1, 127, 128, 255]), bytes(r.choices(range(256), k=900))
    pieces = [bytes(r.choices(letters, k=r.randint(0, 9))) + base[(a := r.randint(0, 190)) : a + n] + bytes(r.choices(letters, k=r.randint(0, 9))) for n in (68, 69, 70, 137, 138, 139, 206, 207, 208, length - 1, length, length + 1) for _ in range(3)]
    pieces += [base[:800], base[:800] + b"\0", base[:799], base[50:800], b"\0" * (length + 50), b"\0" * (length + 1), b"\0" * (length - 1), b"\0" * (length + 100) + b"\1"]
    rows = [(i, i * 7, bytearray(p)) for i, p in enumerate(pieces)]
    got = {(x["f1"], k) for x in distributed_suffixes.repeated(spark.createDataFrame(rows, "f1 long, f2 long, piece binary").repartition(3), length).collect() for k in range(x["lo"], x["hi"])}
    count = collections.Counter(p[k : k + length] for p in pieces for k in range(len(p) - length + 1))
    assert got == {(i, k) for i, p in enumerate(pieces) for k in range(len(p) - length + 1) if count[p[k : k + length]] > 1}
    assert (staged.count("suffixes-names"), staged.count("suffixes-merged")) == (rounds, merges)


def test_a_line_in_many_contexts(spark, monkeypatch):
    """A line shorter than a window with other text around it everywhere: its names fit no shard, and nothing but planted copies goes."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4000)
    ran, whole = [], suffix_dedup.repeated
    monkeypatch.setattr(suffix_dedup, "repeated", lambda pieces, length: ran.append(pieces.count()) or whole(pieces, length))
    r = random.Random(21)
    line, letters = "".join(r.choices("abcdefghij", k=184)), "klmnopqrstuvwxyz"
    docs = ["".join(r.choices(letters, k=16)) + line + "".join(r.choices(letters, k=16)) for _ in range(600)]
    docs += [docs[3], docs[5][:210], "x" + docs[7][5:]]
    got = {x["doc_id"]: x for x in suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)).collect()}
    assert ran[0] > 100
    for i, want in enumerate(brute_repeats([t.encode() for t in docs], 200)):
        spans = got[i]["spans"]
        assert (sum(s["end"] - s["start"] for s in spans), len(spans), bytes(got[i]["kept"])) == want


def test_suffix_array_of_many_symbols():
    """More names than 21 bits hold, and symbols of 40 bits."""
    r = np.random.default_rng(22)
    s = r.integers(1, 2**40, 4_000_000)
    sa = suffix_dedup.suffix_array(s)
    assert (np.diff(s[sa]) >= 0).all() and len(np.unique(sa)) == len(s)
    small = [np.array([r.integers(1, 4) * (1 << 40) for _ in range(n)]) for n in range(3, 40)]
    assert all(suffix_dedup.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i, s=s: s[i:].tolist()) for s in small)


@pytest.mark.parametrize("name", ["spans", "kept"])
def test_repeats_refuse_their_own_columns(spark, name):
    with pytest.raises(ValueError, match=name):
        suffix_dedup.remove_repeats(spark.createDataFrame([(1, "x", 1)], f"doc_id long, text string, {name} int"))


def test_difference_cover():
    r = random.Random(3)
    for _ in range(300):
        s = np.array([r.randint(1, 3) for _ in range(r.randint(1, 60))])
        assert suffix_dedup.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i, s=s: s[i:].tolist())


def test_repeats_of_odd_rows(odd, nothing):
    got = suffix_dedup.remove_repeats(odd, length=10).collect()
    kept = collections.defaultdict(list)
    for x in got:
        kept[x["doc_id"]].append(bytes(x["kept"]))
    assert kept[4] == [b""] and kept[5] == [b"", b""] and kept[3] == [b""] and kept[1] == kept[2] == [b""] and kept[None] == [b"no id"] and kept[7] == [b" \t\n"]
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_op10(spark, sf):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.op10_difference_cover(spark, sf).collect()}
    for (i, t), (gone, spans, kept) in zip(docs, brute_repeats([t for _, t in docs], 200), strict=True):
        assert got[i] == (len(t), gone, spans, hashlib.sha256(kept).hexdigest())
