"""Byte-pair encoding of many words at once, with numpy.

For vocabularies with a word-end suffix whose tokenizer lowers case and maps UTF-8 bytes to characters ahead of the merges. All words
lie in one array of symbols; every round finds each word's pair of lowest rank and merges it wherever it stands in the word.
A merge's product has a later rank than the merge itself, so this gives what merging one place at a time gives.
"""

from __future__ import annotations

import json
import re

import numpy as np

NONE = np.iinfo(np.int32).max
#: Letters of ASCII and Latin-1: one pre-token, composed, and lowered letter by letter.
SIMPLE = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def byte_letters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others counted from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordMerges:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix")
        if model["type"] != "BPE" or not suffix or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("no merges by word in this tokenizer")
        vocab, letters = model["vocab"], byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        a = np.array([vocab[x] for x, _ in pairs], np.int64)
        b = np.array([vocab[y] for _, y in pairs], np.int64)
        self.made = np.array([vocab[x + y] for x, y in pairs] + [0], np.int64)
        self.shift = max(1, int(max(vocab.values())).bit_length())
        self._table((a << self.shift) | b)

    def _table(self, keys: np.ndarray) -> None:
        """Open addressing: slot -> key and rank. The first of equal keys holds."""
        self.bits = max(8, (4 * len(keys)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        keys, ranks = keys[::-1], np.arange(len(keys) - 1, -1, -1, dtype=np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            self.keys[slot[free]], self.ranks[slot[free]] = keys[free], ranks[free]
            lost = self.keys[slot] != keys
            keys, ranks, slot = keys[lost], ranks[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], NONE)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word (not empty, all of it SIMPLE) as little-endian unsigned 32-bit bytes."""
        if not words:
            return []
        raw = np.frombuffer(("\n".join(words).lower() + "\n").encode(), np.uint8)
        ends = np.flatnonzero(raw == 10)
        symbol = self.inner[raw]
        symbol[ends - 1] = self.last[raw[ends - 1]]
        keep = raw != 10
        word = np.cumsum(~keep)[keep]
        symbol = symbol[keep]
        done_symbols, done_words = [], []
        while len(symbol):
            rank = np.full(len(symbol), NONE, np.int32)
            same = np.flatnonzero(word[1:] == word[:-1])
            rank[same] = self._rank((symbol[same] << self.shift) | symbol[same + 1])
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.concatenate([first, [len(symbol)]]))
            least = np.repeat(np.minimum.reduceat(rank, first), size)
            over = least == NONE
            if over.any():
                done_symbols.append(symbol[over])
                done_words.append(word[over])
                symbol, word, rank, least = symbol[~over], word[~over], rank[~over], least[~over]
            at = np.flatnonzero(rank == least)
            if not len(at):
                continue
            run = np.concatenate([[True], at[1:] != at[:-1] + 1])  # of overlapping places every second one is merged, from the left
            if not run.all():
                begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            symbol, word = symbol[stay], word[stay]
        symbol, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        flat = symbol[order].astype("<u4").tobytes()
        cuts = (4 * np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])).tolist()
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
