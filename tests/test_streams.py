"""Streams: debounced sessions against the batch form, watchers, incremental indexing."""

import os

import pytest
from pyspark.sql import functions as F

from lorestone.plans import chat_index
from lorestone.plans import lifecycle as L
from lorestone.plans.embedding import hash_embedder
from lorestone.sources.store import Collection, chat_files, conversations, modified_since
from lorestone.streaming import debounce
from lorestone.streaming.service import Watchers


def test_stream_equals_batch_up_to_the_watermark(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("path"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    batch = {tuple(r) for r in debounce.sessions(events, "2 hours").collect()}
    stream = {tuple(r) for r in debounce.run_available(spark, f"{sf}/events.parquet", "2 hours", "1 day").collect()}
    newest = events.agg(F.max("ts")).first()[0]
    assert stream < batch
    assert all((newest - r[2]).total_seconds() < 86_400 + 7_200 for r in batch - stream)


def test_moves_and_cancelling(spark):
    rows = spark.createDataFrame([("a", "b", "2024-01-01 00:00:00", "moved"), ("c", None, "2024-01-01 00:00:00", "created"), ("c", None, "2024-01-01 00:00:01", "deleted")], "path string, target string, ts string, event_type string")
    moved = debounce.moves(rows).withColumn("ts", F.to_timestamp("ts"))
    assert {r["path"]: r["action"] for r in debounce.sessions(moved, "2 seconds").collect()} == {"a": "delete", "b": "index", "c": "none"}


def test_watchers(spark, tmp_path):
    spark.range(5).withColumn("path", F.col("id").cast("string")).write.parquet(f"{tmp_path}/in")
    seen, first = [], []
    w = Watchers(spark)
    changes = spark.readStream.schema("id long, path string").parquet(f"{tmp_path}/in")
    w.add("p", changes, lambda df, _: seen.append(df.count()), initial=lambda: first.append(1), available=True)
    w.queries["p"].awaitTermination()
    assert sum(seen) == 5 and first == [1] and w.status() == {"p": False}
    with pytest.raises(ValueError, match="watched"):
        w.add("p", changes, lambda df, _: None)
    w.stop()
    assert w.status() == {}


def test_indexing_twice_adds_nothing(spark, tmp_path):
    files = spark.createDataFrame([("a.py", "def f(): return g()\n"), ("bad.py", "def ("), ("e.md", None)], "file string, text string")
    store = Collection(spark, "twice", f"file://{tmp_path}")
    first = {r["id"] for r in L.index(store, files).collect()}
    assert first and {r["id"] for r in L.index(store, files).collect()} == first
    assert L.points(files.where("false")).count() == 0


def test_same_content_in_two_files(spark, tmp_path):
    """A function of the same text in a second file is stored for both, its vector made once; one that moves keeps its id, one that vanished goes."""
    store = Collection(spark, "two", f"file://{tmp_path}")
    made, plain = [], hash_embedder(4)

    def embed(contents):
        made.append(contents.count())
        return plain(contents)

    schema = "file string, text string"
    L.index(store, spark.createDataFrame([("a.py", "def add(x):\n    return x\n\ndef gone():\n    pass\n")], schema), embed)
    both = L.index(store, spark.createDataFrame([("a.py", "\n\ndef add(x):\n    return x\n"), ("b.py", "def add(x):\n    return x\n")], schema), embed)
    rows = both.where("chunk_type = 'implementation'").select("id", "file_path", "entity_name", F.size("vector").alias("n")).collect()
    assert sorted((r["file_path"], r["entity_name"], r["n"]) for r in rows) == [("a.py", "add", 4), ("b.py", "add", 4)]
    before = store.read(1).where("entity_name = 'add' AND chunk_type = 'implementation'").first()["id"]
    assert before in {r["id"] for r in rows} and made[1] < both.count()
    assert store.state.statistics() == {"points": float(both.count()), "files": 2.0}


def test_corrupt_state_is_empty(spark, tmp_path):
    store = Collection(spark, "broken", f"file://{tmp_path}")
    store.state.write(spark.createDataFrame([(1,)], "other int"))
    assert store.state.load().count() == 0
    L.index(store, spark.createDataFrame([("a.ini", "[s]\nk = 1")], "file string, text string"))
    assert store.state.load().count() == 1


def test_chat_files(spark, tmp_path):
    """Conversations from files, the newest ones first; broken lines are skipped, files without a message left out."""
    line = '{{"type": "user", "message": {{"role": "user", "content": "{}"}}}}\n'
    for i, (name, text) in enumerate((("one", line.format("hi") + "broken\n" + line.format("there")), ("two", line.format("new")), ("none", "broken\n"))):
        (tmp_path / f"{name}.jsonl").write_text(text)
        os.utime(tmp_path / f"{name}.jsonl", (1_700_000_000 + i, 1_700_000_000 + i))
    path = f"file://{tmp_path}"
    assert [r["file"].rsplit("/", 1)[1] for r in chat_files(spark, path).collect()] == ["none.jsonl", "two.jsonl", "one.jsonl"]
    assert sorted((r["conv_id"], r["text"]) for r in conversations(spark, path).collect()) == [("one", "hi"), ("one", "there"), ("two", "new")]
    assert {r["conv_id"] for r in conversations(spark, path, 2).collect()} == {"two"}


def test_chat_index(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "user", "fix the crash"), (1, 1, "assistant", "done")], "conv_id long, turn long, role string, text string")
    store = Collection(spark, "chat", f"file://{tmp_path}")
    assert [r["category"] for r in chat_index.index(store, rows).collect()] == ["debugging_pattern"]
    assert chat_index.index(store, rows).count() == 1


def test_chat_index_of_long_conversations(spark, tmp_path):
    """A change behind the extract updates the stored row, and conversations that begin alike are all stored."""
    head, schema = "same system prompt " * 30, "conv_id long, turn long, role string, text string"
    store = Collection(spark, "chat", f"file://{tmp_path}")
    first = {r["conv_id"]: r["content_hash"] for r in chat_index.index(store, spark.createDataFrame([(1, 0, "user", head)], schema)).collect()}
    rows = spark.createDataFrame([(1, 0, "user", head), (1, 1, "user", "fix the crash"), (2, 0, "user", head), (3, 0, "user", head)], schema)
    got = {r["conv_id"]: r["content_hash"] for r in chat_index.index(store, rows).collect()}
    assert sorted(got) == [1, 2, 3] and len(set(got.values())) == 3 and got[1] != first[1]


def test_modified_since(spark):
    found = spark.sql("SELECT 'a' AS file, TIMESTAMP '2024-01-02' AS modified UNION ALL SELECT 'b', TIMESTAMP '2024-01-01'")
    state = spark.sql("SELECT 'b' AS path, unix_timestamp(TIMESTAMP '2024-01-01') * 1.0D AS mtime")
    assert [r["file"] for r in modified_since(found, state).collect()] == ["a"]
    assert modified_since(found, state.where("false")).count() == 2
    assert modified_since(found, state.withColumn("path", F.lit("gone"))).count() == 2  # a state of another tree
