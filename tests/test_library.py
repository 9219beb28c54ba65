"""Operators on small inputs: nulls, empty tables, ties, and what the twins cannot state."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lorestone.functions import text as X
from lorestone.operators import chunking as K
from lorestone.operators import extract as E
from lorestone.operators import graph as G
from lorestone.operators import search as S
from lorestone.operators import sections as M
from lorestone.operators import state as T
from lorestone.sources.store import Catalog, Collection, chat_lines, files, store


def test_entry_without_training_operators(spark, sf):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "id", "score", "rank"]


def test_search_on_empty_and_zero(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0])], "id long, vector array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, query array<double>")
    assert [(r["id"], r["rank"]) for r in S.dense(rows, asked, 2).orderBy("rank").collect()] == [(2, 1), (3, 2)]
    assert S.dense(rows.where("false"), asked).count() == 0
    assert S.keyword(spark.createDataFrame([], "id long, text string"), spark.createDataFrame([(1, "word")], "query_id long, text string")).count() == 0


def test_search_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, vector array<double>")
    asked = rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    whole = sorted(map(tuple, S.dense(rows, asked, 3, "euclid").collect()))
    monkeypatch.setattr(S, "QUERY_ROWS", 6)
    assert sorted(map(tuple, S.dense(rows, asked, 3, "euclid").collect())) == whole


def test_fusion_of_one_leg(spark):
    leg = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id long, id long, rank int")
    got = S.fused(leg, leg.where("false")).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [(5, round(0.5 / 61, 6)), (6, round(0.5 / 62, 6))]


def test_difference_with_null_hashes(spark):
    a = spark.createDataFrame([("x", None), ("y", "1"), ("_meta", "z")], "path string, hash string")
    b = spark.createDataFrame([("x", None), ("y", None), ("w", "2")], "path string, hash string")
    assert {r["path"]: r["change"] for r in T.difference(a, b, ["path"]).collect()} == {"x": "unchanged", "y": "modified", "w": "added"}


def test_orphans_of_an_empty_graph(spark):
    relations = spark.createDataFrame([("a", "b", "calls")], "src string, dst string, kind string")
    assert G.hash_orphans(relations, spark.createDataFrame([], "name string")).count() == 1
    assert G.hash_orphans(relations.where("false"), spark.createDataFrame([("a",)], "name string")).count() == 0


def test_external_files(spark):
    rows = spark.createDataFrame([("a/data.CSV",), ("module.name",), ("csv",)], "n string")
    assert [r[0] for r in rows.select(G.external_file(F.col("n"))).collect()] == [True, False, False]


@pytest.mark.parametrize(("text", "cut"), [("short", "short"), ("a" * 50, "a" * 40 + "..."), ("a" * 38 + " bbbbbbbb", "a" * 38 + "..."), ("aa " + "b" * 50, "aa " + "b" * 37 + "..."), (None, None)])
def test_truncated(spark, text, cut):
    assert spark.createDataFrame([(text,)], "t string").select(X.truncated(F.col("t"), 10)).first()[0] == cut


def test_collection_versions(spark, tmp_path):
    c = Collection(spark, "t", f"file://{tmp_path}")
    c.write(spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"))
    c.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string"))
    c.delete(spark.createDataFrame([(1,)], "id long"))
    assert sorted(map(tuple, c.read().collect())) == [(2, "c"), (3, "d")]
    assert sorted(map(tuple, c.read(1).collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError, match="metric"):
        Collection(spark, "t", metric="manhattan")


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "m.py").write_text("x = 1\n")
    (tmp_path / "c.jsonl").write_text('{"role": "user"}\nbad\n')
    assert [r["text"] for r in files(spark, str(tmp_path), "*.py").collect()] == ["x = 1\n"]
    assert chat_lines(spark, str(tmp_path / "c.jsonl")).count() == 2


def test_python_extractor():
    code = 'import os\nfrom .a import b\n\nclass A(Base):\n    """Doc."""\n    def m(self):\n        return helper(open("f.txt"))\n\n(x, *y), LIMIT = 1, 2\nif (n := 3):\n    z = 4\n'
    rows = [tuple(r[:6]) for r in E.rows_of("m.py", code)]
    assert ("entity", "A", "Doc.", "class", 4, None) in rows
    assert ("relation", "A", "Base", "inherits", 4, None) in rows
    assert ("relation", "m", "helper", "calls", 6, None) in rows
    assert ("relation", "m.py", "f.txt", "file_open", 7, None) in rows
    assert {r[1] for r in rows if r[3] in ("variable", "constant")} == {"x", "y", "LIMIT", "n", "z"}
    assert E.rows_of("m.py", "def (")[0][0] == "error"
    assert E.rows_of("m.unknown", "")[0][3] == "no parser"


def test_markdown_groups():
    """Small sections are joined, those without text give their titles to the next; large ones are parted, and neighbours overlap."""
    text = "# A\nshort text\n## B\nsome more\n# C\n" + "word " * 200 + "\n```\n# no header\n```\n"
    assert [c.titles for c in M.chunks(text)] == [("A", "B", "C")] and M.chunks(text)[0].title == "A (+2 more)"
    assert [s.title for s in M.sections("# A\n## B\nx\n### C\nhas a text")] == ["C (+2 more)"]
    assert M.chunks("") == []
    big = M.chunks("# T\n" + "\n\n".join("Word " * 300 for _ in range(5)))
    assert len(big) > 1 and big[1].overlap == big[0].content[-200:] and all(c.tokens <= M.LARGEST for c in big)


@pytest.mark.parametrize(("file", "text", "names"), [("a.json", '{"k": {"l": [1]}}', {"a.json", "k", "k.l"}), ("a.ini", "[s]\nk = v", {"a.ini", "s", "s.k"}), ("a.csv", "x,y\n1,2", {"a.csv", "x", "y"}), ("a.yaml", "a:\n  b: 1\nc: 2", {"a.yaml", "a", "a.b", "c"}), ("a.css", ".k { --v: 1 }", {"a.css", "k", "--v"})])
def test_other_extractors(file, text, names):
    assert {r[1] for r in E.rows_of(file, text) if r[0] == "entity"} == names


def test_extractors_never_fail_a_job():
    """Whatever stands where a list or a text is expected; what cannot be parsed is an error row."""
    for text in ('{"items": [{"comments": 3, "title": "t"}, {"replies": null, "text": "x"}, 5]}', '{"items": 3}', "[]", '{"dependencies": [1]}'):
        assert all(r.row != "error" for r in E.rows_of("package.json", text))
    assert [r.kind for r in E.rows_of("a.json", "{")] == ["JSONDecodeError"] and [r.kind for r in E.rows_of("a.py", "def (")] == ["SyntaxError"]
    assert [r.row for r in E.rows_of("a.bin", "x")] == ["error"]
    for name in ("a.py", "a.js", "a.md", "a.css", "a.json", "a.yaml", "a.html", "a.csv", "a.ini", "a.txt"):
        assert all(isinstance(r, tuple) for r in E.rows_of(name, None)) and E.rows_of(name, "\x00{[(\"'`<")


def test_python_classes():
    text = 'class Shop(Base, x.Y):\n    """Sells. More."""\n    def __init__(self):\n        self.items = []\n        self.name: str = ""\n    def create_item(self): pass\n    def notify_all(self): pass\n'
    said = {r.name: json.loads(r.detail) for r in E.rows_of("s.py", text) if r.row == "entity"}
    assert said["Shop"] == ["Responsibility: Sells", "Key methods: __init__, create_item, notify_all", "Inherits from: Base, x.Y", "Factory pattern", "Observer pattern", "Attributes: items, name"]


def test_javascript_patterns():
    text = "const { one, two: renamed, three = four(5), ...rest } = cfg\nlet [h, [m]] = list\nclass A {\n  size = 1\n  static kind = 'x';\n  @Input() go(a) { if (a) { const inner = 1 } }\n}\n@Injectable()\nclass Svc { }\nfor (const t of list) { }\n"
    rows = E.rows_of("a.ts", text)
    names = {r.name for r in rows if r.row == "entity"}
    assert {"one", "renamed", "three", "rest", "h", "m", "size", "kind", "go", "A", "Svc"} <= names and not names & {"two", "four", "inner", "t", "cfg"}
    assert ("Svc", "Injectable") in {(r.name, r.other) for r in rows if r.kind == "decorated_by"}


def test_sections_keep_all_text():
    """However sections are parted, grouped and joined, no word of their texts is lost. A header two levels down does not end a section, so its text stands in both."""
    r = random.Random(4)
    for _ in range(60):
        lines, n = [], 0
        for _ in range(r.randint(1, 12)):
            lines.append("#" * r.randint(1, 4) + f" Title {r.randint(0, 99)}")
            for _ in range(r.choice((0, 1, 3, 30))):
                words = [f"w{n + k}" for k in range(r.randint(3, 60))]
                n += len(words)
                lines += [" ".join(words) + ".", ""] if r.random() < 0.7 else [" ".join(words)]
        found = M.chunks("\n".join(lines))
        assert set(re.findall(r"\bw\d+\b", " ".join(c.content for c in found))) == {f"w{k}" for k in range(n)}
        groups = M.grouped([p for s in M.sections("\n".join(lines)) for p in M.parted(s)])
        assert all(len(g) == 1 or sum(s.tokens for s in g) <= M.BUDGET for g in groups)


def test_search_refuses(spark):
    queries = spark.createDataFrame([(1, "x")], "query_id long, text string")
    for mode, options in (("other", {}), ("semantic", {}), ("hybrid", {"docs": queries}), ("keyword", {})):
        with pytest.raises(ValueError, match="mode|needs"):
            S.search(mode, queries, **options)


def test_dense_in_slices(spark, monkeypatch):
    """Many rows a task, slices of few, ties by id, vectors of other lengths and none."""
    monkeypatch.setattr(S, "SLICE", 7)
    data = [(i, [float(i % 5), 1.0]) for i in range(100)] + [(200, None), (201, [1.0]), (202, [0.0, 0.0])]
    rows = spark.createDataFrame(data, "id long, vector array<float>").repartition(3)
    asked = spark.createDataFrame([(9, [1.0, 1.0]), (8, [2.0])], "query_id long, query array<double>")
    got = [(r["query_id"], r["id"], r["rank"]) for r in S.dense(rows, asked, 4, "euclid").orderBy("query_id", "rank").collect()]
    assert got == [(8, 201, 1), (9, 1, 1), (9, 6, 2), (9, 11, 3), (9, 16, 4)]
    assert S.dense(rows, asked, 200, "cosine").where("query_id = 9").count() == 100


def test_batches_of_an_unsorted_group(spark):
    rows = spark.createDataFrame([("a", i, c) for i, c in enumerate((5, 9, 1, None, 4, 20))] + [("b", 0, 30)], "g string, i int, c int").repartition(3)
    got = {(r["g"], r["i"]): r["batch"] for r in K.budget_batches(rows, "g", "i", "c", 10, 3).collect()}
    assert got == {("a", 0): 0, ("a", 1): 1, ("a", 2): 1, ("a", 3): 1, ("a", 4): 2, ("a", 5): 3, ("b", 0): 0}


def test_collections_are_found_again(spark, tmp_path):
    root = f"file://{tmp_path}"
    first = Catalog(spark, root).create("notes", metric="dot", dense=8)
    first.upsert(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, v string"))
    (tmp_path / "notes" / "v2").mkdir()  # a write that broke off
    again = Catalog(spark, root).open("notes")
    assert again.count() == 2 and again.version == 1 and again.info()["metric"] == "dot" and again.info()["dense_size"] == 8
    again.upsert(spark.createDataFrame([(3, "d")], "id long, v string"))
    assert again.version == 2 and first.count() == 3
    with pytest.raises(ValueError, match="already"):
        Catalog(spark, root).create("notes")
    with pytest.raises(KeyError):
        Catalog(spark, root).open("other")
    assert Catalog(spark, root).drop("notes") and not Catalog(spark, root).drop("notes") and Catalog(spark, root).names() == []
    with pytest.raises(ValueError, match="backend"):
        store(spark, {"backend": "other"})


def test_keyword_by_products(spark, monkeypatch):
    """Blocks of queries, slices of few texts, frequent and rare terms, ties, repeated and missing ids, against plain sums over all pairs."""
    import math

    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    text = lambda: " ".join(w for i, w in enumerate(words) if r.random() < (0.4 if i < 6 else 0.08))
    docs = [(i if i < 90 else i % 4 if i < 97 else None, text()) for i in range(100)] + [(200 + i, "w1 w7 w9") for i in range(30)] + [(300, None), (301, "")]
    asked = [(i, text() if i else None) for i in range(12)] + [(3, "w1 w30"), (20, "w9"), (21, "none")]
    split = lambda t: set((t or "").split())
    weight = {w: round(max(0.0, math.log((len(docs) - df + 0.5) / (df + 0.5))), 6) for w in words for df in [sum(w in split(t) for _, t in docs)]}
    sums = {}
    for q, a in asked:
        for d, t in docs:
            for w in split(a) & split(t):
                if weight[w] > 0:
                    sums[q, d] = sums.get((q, d), 0.0) + weight[w] ** 2
    want = []
    for q in {q for q, _ in sums}:
        order = sorted((-round(s, 6), d is not None, d or 0) for (p, d), s in sums.items() if p == q)[:7]
        want += [(q, d if given else None, -s, k + 1) for k, (s, given, d) in enumerate(order)]
    d = spark.createDataFrame(docs, "id long, text string").repartition(3)
    a = spark.createDataFrame(asked, "query_id long, text string")
    rows = lambda df: sorted(((x["query_id"], x["id"], round(x["score"], 6), x["rank"]) for x in df.collect()), key=repr)
    assert rows(S.keyword(d, a, 7)) == sorted(want, key=repr)
    for terms, products, often in ((40, 30, 9.0), (10**6, 100, 0.0)):
        for name, value in (("QUERY_TERMS", terms), ("PRODUCTS", products), ("OFTEN", often)):
            monkeypatch.setattr(S, name, value)
        assert rows(S.keyword(d, a, 7)) == sorted(want, key=repr)
    named = S.keyword(d.withColumn("id", F.concat(F.lit("d"), "id")), a.withColumn("query_id", F.concat(F.lit("q"), "query_id")), 1000)
    assert {(x["query_id"], x["id"], round(x["score"], 6)) for x in named.collect()} == {(f"q{q}", d if d is None else f"d{d}", round(s, 6)) for (q, d), s in sums.items()}


def most_written(spark, act):
    """The most rows that a stage of ``act`` shuffles."""
    context, java = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm

    def stages():
        context.listenerBus().waitUntilEmpty()
        found = context.statusStore().stageList(java.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(java.double, 0), java.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    earlier = max(stages(), default=-1)
    act()
    return max(n for stage, n in stages().items() if stage > earlier)


def test_keyword_shuffles_no_pairs(spark):
    """Pairs of a text and a query stay in their task: of 600 * 600 pairs, a task hands on k for each query."""
    docs = spark.range(600).select("id", F.concat(F.lit("common"), F.col("id") % 3, F.lit(" w"), F.col("id")).alias("text")).repartition(2)
    assert 0 < most_written(spark, lambda: S.keyword(docs, docs.withColumnRenamed("id", "query_id"), 5).collect()) <= 2 * 600 * 5


def test_modes_shuffle_no_pairs(spark):
    """Every mode of a search, over the same tables: both legs of the hybrid one hand on 50 rows for each query of a task."""
    docs = spark.range(600).select("id", F.concat(F.lit("common"), F.col("id") % 3, F.lit(" w"), F.col("id")).alias("text")).repartition(2)
    rows = spark.range(600).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector")).repartition(2)
    queries = docs.withColumnRenamed("id", "query_id").join(rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query")), "query_id")
    for mode, k in (("semantic", 5), ("keyword", 5), ("hybrid", 50)):
        got = []
        assert 0 < most_written(spark, lambda: got.extend(S.search(mode, queries, rows, docs, 5).collect())) <= 2 * 600 * k  # noqa: B023
        assert len(got) == 600 * 5


def test_modes_read_texts_once(spark, sf, monkeypatch):
    """The keyword mode and the keyword leg of the hybrid one are one search; what they share is what each finds alone."""
    from lorestone.query_sets.reports import search_modes

    docs = spark.createDataFrame([(i, f"common w{i % 7} w{i % 11}") for i in range(90)], "id long, text string")
    rows = spark.range(90).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector"))
    queries = docs.where("id % 9 = 0").join(rows, "id").select(F.col("id").alias("query_id"), "text", F.col("vector").alias("query"))
    sparse = S.keyword(docs, queries.select("query_id", "text"), 50)
    for mode in S.MODES:
        assert sorted(S.search(mode, queries, rows, docs, 5, sparse=sparse).collect()) == sorted(S.search(mode, queries, rows, docs, 5).collect())
    read, plain = [], S._places
    monkeypatch.setattr(S, "_places", lambda *a: read.append(1) or plain(*a))
    assert {r["mode"] for r in search_modes(spark, sf).select("mode").distinct().collect()} == set(S.MODES)
    assert len(read) == 1


def test_searches_hand_on_by_few_tasks(spark):
    """A table in many partitions: the rows handed on for a query are bounded by the cores, not by the partitions; the result is the same."""
    docs = spark.range(600).select("id", F.concat(F.lit("common"), F.col("id") % 3, F.lit(" w"), F.col("id")).alias("text"))
    rows = spark.range(600).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector"))
    queries = docs.join(rows, "id").select(F.col("id").alias("query_id"), "text", F.col("vector").alias("query"))
    most = max(S.LEAST_TASKS, S.TASKS * spark.sparkContext.defaultParallelism) * 600
    for search in (lambda n: S.keyword(docs.repartition(n), queries.select("query_id", "text"), 1), lambda n: S.dense(rows.repartition(n), queries.select("query_id", "query"), 1)):
        got = []
        assert 600 <= most_written(spark, lambda: got.extend(search(300).collect())) <= most  # noqa: B023
        assert sorted(got) == sorted(search(2).collect())
        assert len(got) == 600
