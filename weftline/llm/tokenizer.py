"""Encoding a corpus with a public byte-level BPE vocabulary (problem 6).

Texts are split by the vocabulary's public pattern; the distinct words of a batch are encoded together: their byte
symbols lie in one flat numpy array, every round looks all adjacent pairs up by binary search over the sorted pair keys
and merges, in every word, the pair of lowest rank. Words that have no pair left leave the array.

Defined results
    * empty and null texts give an empty list (never null); special-token strings in a text are ordinary text.
    * texts are taken exactly as stored and whole, however long; equal texts get equal ids; each row gives one row.
    * empty tables give empty results; only the key and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the public vocabulary lies; always a parameter, the file is never copied.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words whose ids a Python worker keeps between batches (a speed bound, it never changes a result).
CACHE_WORDS = 200_000

NO_RANK = np.int32(2**31 - 1)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: visible Latin-1 stays, the rest follows from 256."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """The merges of a vocabulary as arrays sorted by pair key; a few megabytes whatever the corpus."""

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        self.size = max(vocab.values()) + 1
        self.byte_ids = np.zeros(256, np.int32)
        for char, byte in byte_alphabet().items():
            self.byte_ids[byte] = vocab[char]
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], np.arange(len(keys), dtype=np.int32)[order]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)[order]

    @classmethod
    def load(cls, path: str) -> PairTable:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return cls(model["vocab"], model["merges"])

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and the offset of each word's first id (one more than words)."""
        sizes = np.fromiter((len(w) for w in words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
        done_symbols, done_words = [], []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank, at = np.full(len(symbols), NO_RANK), np.zeros(len(symbols), np.int64)
            inner = np.flatnonzero(word[1:] == word[:-1])
            if len(inner):
                keys = symbols[inner].astype(np.int64) * self.size + symbols[inner + 1]
                pos = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                hit = self.keys[pos] == keys
                rank[inner[hit]], at[inner[hit]] = self.rank[pos[hit]], pos[hit]
            lowest = np.minimum.reduceat(rank, starts)
            per_symbol = np.repeat(lowest, np.diff(np.r_[starts, len(symbols)]))
            finished = per_symbol == NO_RANK
            if finished.any():
                done_symbols.append(symbols[finished])
                done_words.append(word[finished])
            chosen = np.flatnonzero((rank == per_symbol) & ~finished)
            # equal pairs that overlap ("aaa") merge from the left: keep every other one of a run
            new_run = np.r_[True, np.diff(chosen) != 1] if len(chosen) else np.zeros(0, bool)
            run_start = np.maximum.accumulate(np.where(new_run, chosen, 0)) if len(chosen) else chosen
            chosen = chosen[(chosen - run_start) % 2 == 0]
            symbols = symbols.copy()
            symbols[chosen] = self.merged[at[chosen]]
            keep = ~finished
            keep[chosen + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_symbols:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        symbols = symbols[np.argsort(word, kind="stable")]
        return symbols, np.r_[0, np.cumsum(np.bincount(word, minlength=len(words)))]


class BatchEncoder:
    """Encodes texts; keeps the ids of words already seen, up to ``CACHE_WORDS``."""

    def __init__(self, table: PairTable, pattern: str = PATTERN) -> None:
        import regex

        self.table, self.find = table, regex.compile(pattern).findall
        self.cache: dict[str, np.ndarray] = {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.find(t) if t else [] for t in texts]
        fresh = list({w for words in split for w in words if w not in self.cache})
        local = self.cache
        if fresh:
            if len(self.cache) + len(fresh) > CACHE_WORDS:
                self.cache = {}
                fresh, local = list({w for words in split for w in words}), {}
            ids, offsets = self.table.encode_words([w.encode("utf-8") for w in fresh])
            local.update(zip(fresh, (ids[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), strict=True))
            if len(local) <= CACHE_WORDS:
                self.cache = local
        empty = np.zeros(0, np.int32)
        return [np.concatenate([local[w] for w in words]) if words else empty for words in split]


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "ids", vocabulary: str = BYTE_BPE_50K, chunk: int = 256) -> DataFrame:
    """``(key, out)``: the token ids of every row's text, without special tokens.

    Map-only: no shuffle beyond spreading a few large files. The merge table is broadcast (its size is the vocabulary's).
    ``chunk`` texts are encoded at a time, which bounds a worker's memory.
    """
    from weftline.plans.runtime import parallel

    shared = docs.sparkSession.sparkContext.broadcast(PairTable.load(vocabulary))
    schema = T.StructType([docs.schema[key], T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BatchEncoder(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, chunk):
                batch = whole.slice(at, chunk)
                rows = encoder.encode(batch.column(1).to_pylist())
                offsets = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, out])

    return parallel(docs.select(key, text)).mapInArrow(run, schema)
