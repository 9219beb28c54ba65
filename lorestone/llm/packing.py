"""Packing by concatenate and cut: two passes of prefix sums over partition token totals.

Pass one tokenizes each document once and writes its ids with the partition and the running total inside it. The totals of
the partitions, one number each, become global offsets by prefix sums. Pass two adds a document's offset to its partition's and
cuts at multiples of the window; a document that crosses a boundary leaves one record on either side. No row is shuffled.
"""

from __future__ import annotations

import functools
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SIMPLE, WordMerges
from .common import prefix_sums, read, stage

WINDOW = 4096
END_ID = 2
KEPT_WORDS = 600_000  # words whose ids a worker keeps; beyond these it begins anew, with the same result
SLICE_CHARS = 1_000_000
SLICE_ROWS = 256
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Letters between runs of ASCII punctuation, which are pre-tokens of their own; apostrophes and what could begin a special token are left out.
MARKS = r"[!-&(-/:;=-@\[-`{}~]*"
PARTS = re.compile(f"({MARKS})({SIMPLE.pattern})({MARKS})")
COMBINING = re.compile("[\u0300-\u036f]")


class WordTokenizer:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    Ids are looked up word by word between spaces and line feeds. That equals the tokenizer's own result on the whole text if its
    normalizer lowers case and its pre-tokenizer drops white space, never joins characters across it and splits letters from
    punctuation, as word_bpe_49k's do; ``spaced`` says so. Else texts are encoded whole.
    """

    def __init__(self, path: str, end_id: int, spaced: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([end_id], "<u4").tobytes()
        self.spaced = spaced
        self.kept: dict[str, bytes] = {}
        try:
            self.merges = WordMerges(path) if spaced else None
        except ValueError:
            self.merges = None

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        """Afterwards ``kept`` has all of ``words``."""
        kept = self.kept
        kept[""] = b""
        simple, parted, other = set(), [], []
        for w in words.difference(kept):
            if not self.merges:
                other.append(w)
            elif w.isalpha() and (w.isascii() or SIMPLE.fullmatch(w)):
                simple.add(w)
            elif m := PARTS.fullmatch(w):
                a, b, c = m.groups()
                parted.append((w, a, b, c))
                if b not in kept:
                    simple.add(b)
                other += [x for x in (a, c) if x not in kept]
            else:
                other.append(w)
        if simple:
            kept.update(zip(simple, self.merges.encode(list(simple)), strict=True))
        for i in range(0, len(other), 5000):
            kept.update(zip(other[i : i + 5000], self._ids(other[i : i + 5000]), strict=True))
        kept.update([(w, kept[a] + kept[b] + kept[c]) for w, a, b, c in parted])

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.spaced:
            return [ids + self.end for ids in self._ids(texts)]
        split = [_lowered(t).replace("\n", " ").split(" ") for t in texts]
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        self._learn(set().union(*split))
        get = self.kept.__getitem__
        return [b"".join(map(get, words)) + self.end for words in split]


def _lowered(text: str) -> str:
    """A-Z lowered ahead of the tokenizer, unless that could make a special token or another composed character."""
    if "<|" in text or not text.isascii() and COMBINING.search(text):
        return text
    return text.encode().translate(ASCII_LOWER).decode()


@functools.lru_cache(maxsize=2)
def coder_for(path: str, end_id: int, spaced: bool) -> WordTokenizer:
    """One for each worker process, so that its words outlive a task."""
    return WordTokenizer(path, end_id, spaced)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def slices(batches):
    """Arrow batches of few rows, for bounded memory."""
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(k, SLICE_ROWS)


def _short(texts: list[str]):
    """Lists of about SLICE_CHARS characters, or of one longer text."""
    out, chars = [], 0
    for t in texts:
        if out and chars + len(t) > SLICE_CHARS:
            yield out
            out, chars = [], 0
        out.append(t)
        chars += len(t)
    if out:
        yield out


#: Texts in which a tokenizer that does not take each word with the space ahead of it differs from one that does.
PROBES = ("The quick  brown\nfox can't jump.", " a b  c ", "don't stop-me 3.14 x_y, über Straße — 東京 <|x|>", "A\tB\r\nC")


def _hold_to(path: str, end_id: int) -> None:
    """Refuses a tokenizer whose ids are not those of its words one by one; such a one needs ``spaced=False``."""
    coder = WordTokenizer(path, end_id, True)
    if coder.encode(list(PROBES)) != WordTokenizer(path, end_id, False).encode(list(PROBES)):
        raise ValueError("this tokenizer does not read texts word by word: give spaced=False")


def tokenize(docs: DataFrame, id_col: str, text_col: str, tokenizer: str | None, end_id: int = END_ID, spaced: bool = True) -> DataFrame:
    """One row per document: doc_id, ids (end id included), part, before (the ids ahead of it in its partition). A null text is an empty one.

    ``tokenizer`` is a path that every executor can open; None stands for the installed word_bpe_49k.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    if spaced and tokenizer is not None:
        _hold_to(tokenizer, end_id)

    def run(batches):
        from pyspark import TaskContext

        coder = coder_for(tokenizer or default_tokenizer(), end_id, spaced)
        part, before = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            ids = [x for part_texts in _short([t or "" for t in batch.column(1).to_pylist()]) for x in coder.encode(part_texts)]
            counts = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            starts = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts)], names=["doc_id", "ids", "part", "before"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary, part int, before long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, tokenizer: str | None = None, end_id: int = END_ID, spaced: bool = True) -> DataFrame:
    """Pieces of all documents, laid end to end and cut every ``window`` ids: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Only the last sequence can be short. Null and empty texts hold the end id alone; repeated rows are packed each for itself; an
    empty table gives no piece. Other columns are ignored. A document of any length is cut as often as it needs.
    """
    if window < 1:
        raise ValueError("window must be positive")
    held = stage(tokenize(docs, id_col, text_col, tokenizer, end_id, spaced), "packing")
    totals = held.groupBy("part").agg(F.sum(F.octet_length("ids") / 4).cast("long").alias("n")).collect()  # a row for each partition
    first, _ = prefix_sums([(r["part"], r["n"]) for r in totals])
    firsts = held.sparkSession.createDataFrame(list(first.items()), "part int, first long")
    at = held.join(F.broadcast(firsts), "part").select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("doc_tokens"), (F.col("first") + F.col("before")).alias("at"))
    size = F.lit(window).cast("long")
    reached = F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("doc_tokens") - 1) / size))
    cut = at.select("*", F.explode(reached).alias("sequence_id"))
    start = F.greatest(F.col("sequence_id") * size, F.col("at")) - F.col("at")
    end = F.least((F.col("sequence_id") + 1) * size, F.col("at") + F.col("doc_tokens")) - F.col("at")
    cut = cut.withColumns({"start": start, "length": end - start})
    piece = F.substring(F.col("ids"), (4 * F.col("start") + 1).cast("int"), (4 * F.col("length")).cast("int"))
    return cut.select("doc_id", "start", "length", piece.alias("ids"), "doc_tokens", "sequence_id", (F.col("at") + F.col("start") - F.col("sequence_id") * size).alias("offset"))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_concatenate_and_cut(spark, sf_dir: str) -> DataFrame:
    return digest(pack(read(spark, sf_dir, "documents")))
