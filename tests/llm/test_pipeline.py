"""The pipeline against a brute-force version of every stage."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorestone.llm import packing, pii, toxicity
from lorestone.llm.common import shared_dir
from test_operators import brute_components, brute_hits, brute_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small corpus with planted toxic documents, near copies, benchmark passages and personal data."""
    r, at = random.Random(21), tmp_path_factory.mktemp("corpus")
    words = ["the", "house", "river", "stone", "walks", "near", "green", "lamp", "under", "seven", "paper", "glass"]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    bench = [(i, make(14)) for i in range(4)]
    rows = []
    for i in range(240):
        text = make(60)
        if i % 8 == 1:
            text += " scumbags scumbags"
        elif i % 8 == 2 and i > 8:
            text = rows[i - 2][1] + " end"
        elif i % 8 == 3:
            text += " " + bench[i % 4][1] + " tail"
        elif i % 8 == 4:
            text += " a.b@c.de and 10.1.2.3"
        rows.append((i, text, "en", "s", len(text)))
    rows += [(500, None, None, None, None), (501, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, 0, int(i % 8 == 1)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), rows, bench


def test_stages(spark, tables):
    sf_dir, rows, bench = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "personal_data", "packing"]
    found = {}
    for name, step in list(steps.items())[:-1]:
        docs = step(spark, docs, sf_dir)
        assert docs.columns == COLUMNS
        found[name] = {r["doc_id"]: r for r in docs.collect()}
    kept = [(i, t) for i, t, *_ in rows if not (t or "").endswith("scumbags")]
    assert set(found["toxicity"]) == {i for i, _ in kept}
    parts = brute_components(kept, 5, 80)
    kept = [(i, t) for i, t in kept if parts[i][1] == i]
    assert set(found["near_dedup"]) == {i for i, _ in kept} and 10 not in found["near_dedup"]
    hits = brute_hits([t for _, t in kept], bench, 10)
    kept = [(i, t) for (i, t), (_, hit, _) in zip(kept, hits, strict=True) if not hit]
    assert set(found["decontamination"]) == {i for i, _ in kept} and 3 not in found["decontamination"]
    for i, t in kept:
        want = pii.redacted(t, brute_spans(t)) if t else t
        assert found["personal_data"][i]["text"] == want
        assert found["personal_data"][i]["n_chars"] == (None if t is None else len(want))
    assert found["personal_data"][4]["text"].endswith("[EMAIL] and [IP]")


def test_run(spark, tables):
    from tokenizers import Tokenizer

    sf_dir, *_ = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, sf_dir)
    whole = Tokenizer.from_file(packing.default_tokenizer())
    ids = {r["doc_id"]: [*whole.encode(r["text"] or "", add_special_tokens=False).ids, packing.END_ID] for r in docs.collect()}
    got, fill = collections.defaultdict(list), collections.Counter()
    for p in corpus_pipeline.run(spark, sf_dir).collect():
        own = ids[p["doc_id"]]
        assert p["ids_crc32"] == zlib.crc32(np.array(own[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) and p["doc_tokens"] == len(own)
        got[p["doc_id"]] += range(p["start"], p["start"] + p["length"])
        fill[p["sequence_id"]] += p["length"]
    assert {i: sorted(x) for i, x in got.items()} == {i: list(range(len(x))) for i, x in ids.items()}
    assert all(n == packing.WINDOW for k, n in fill.items() if k < max(fill))


def test_empty_corpus(spark, tables, tmp_path):
    sf_dir, *_ = tables
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_shared_folder(spark):
    assert shared_dir(spark) == shared_dir(spark)
    assert toxicity.THRESHOLD == 0.7
