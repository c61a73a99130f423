"""Evaluation passages inside training text (problem 7).

Size-partitioned MinHash containment search. Texts become words in one typography; runs of three words are shingles. The
sketch of a text is the minimum hash of every window of three consecutive shingles, so two texts that share five words
in a row share a sketch entry for certain - a sketch of the whole item, as plain MinHash has it, loses a fifteen-word part
of a long item. Items are partitioned by size: each class has its own sorted sketch table and its own threshold, the number
of the item's shingles that a document must contain near the hits (a class of items shorter than two passages asks for what
its shortest item leaves after the errors allowed, the others for what a passage leaves). Hits are verified by exact shingle
containment against that threshold, and then by a banded alignment that counts changed, dropped and added words.

The search is map-only over the corpus: the item tables are broadcast in blocks of at most ``BLOCK_ITEMS`` items and
``BLOCK_CHARS`` characters (a larger item set costs further scans, never memory), and nothing of a document but its findings
leaves its partition.

Defined results
    * a document leaks an item when an aligned stretch has at least ``MATCHED`` equal words and at most one error in
      ``ERROR_IN`` words; items shorter than that and null or empty texts on either side are never found.
    * each (document, item) comes out once, however often the passage stands there; repeated item rows count once.
    * very long documents are searched whole, ``STRIDE`` words at a time with an overlap wider than any item.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.visual_form import letter_map

#: Words in a shingle, and shingles in a window whose minimum hash enters the sketch.
SHINGLE, WINDOW = 3, 3
#: Equal words an aligned stretch must have; one error is allowed in so many words of it.
MATCHED, ERROR_IN = 11, 6
#: Items and characters of items in one broadcast block.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 20_000_000
#: Words of a document searched at a time.
STRIDE = 200_000
#: Upper ends, in words, of the item size classes; beyond them sizes go by powers of two.
SIZE_CLASSES = (32, 64, 128, 256)

WORD = re.compile(r"[^\W_]+")
HYPHENATED = re.compile(r"(?<=\w)[-‐­]\r?\n[ \t]*(?=[^\W\d_])")
UNSEEN = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁯︀-️﻿]")
LETTERS = str.maketrans(letter_map())


def words(text: str) -> list[str]:
    """The words of a text in one typography: character references, width, case, look-alikes, emphasis and line breaks aside."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = UNSEEN.sub("", text)
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).translate(LETTERS))
    return WORD.findall(HYPHENATED.sub("", text).casefold())


def hashes(tokens: list[str], known: dict[str, int]) -> np.ndarray:
    out = np.empty(len(tokens), np.uint64)
    for i, w in enumerate(tokens):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        out[i] = h
    return out


def shingles(h: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every run of ``SHINGLE`` words."""
    n = max(0, len(h) - SHINGLE + 1)
    s = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        s = (s * np.uint64(0x9E3779B97F4A7C15)) ^ (h[i : i + n] + np.uint64(i))
    return (s ^ (s >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def left_of(matched: int) -> int:
    """Shingles that at least stay whole where ``matched`` equal words stand with one error in ``ERROR_IN`` words."""
    errors = matched // (ERROR_IN - 1)
    return max(1, matched - (SHINGLE - 1) * (errors + 1))


def sketch(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(minimum, position)``: the distinct window minima of a text's shingles and where each shingle starts."""
    n = len(s)
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n <= WINDOW:
        at = np.array([int(np.argmin(s))])
    else:
        at = np.unique(np.argmin(np.lib.stride_tricks.sliding_window_view(s, WINDOW), axis=1) + np.arange(n - WINDOW + 1))
    return s[at], at


class SizeClass:
    """The sketches of the items of one size class, sorted by hash, and how many shingles a leak of one must contain."""

    def __init__(self, items: list[int], hashed: list[np.ndarray]) -> None:
        self.need = left_of(MATCHED) if min(map(len, hashed)) + SHINGLE - 1 > MATCHED else 1
        entries = [(v, p, i) for i, h in zip(items, hashed, strict=True) for v, p in zip(*sketch(h), strict=True)]
        value = np.array([e[0] for e in entries], np.uint64)
        order = np.argsort(value, kind="stable")
        self.value = value[order]
        self.place = np.array([(i, p) for _, p, i in entries], np.int64).reshape(-1, 2)[order]

    def hits(self, value: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(item, item position, text position)`` of every sketch entry that both share."""
        lo = np.searchsorted(self.value, value, "left")
        hi = np.searchsorted(self.value, value, "right")
        for k in np.flatnonzero(hi > lo):
            for e in range(lo[k], hi[k]):
                yield int(self.place[e, 0]), int(self.place[e, 1]), int(at[k])


class ItemIndex:
    """All size classes of a block of items."""

    def __init__(self, texts: list[str]) -> None:
        known: dict[str, int] = {}
        self.words = [hashes(words(t), known) for t in texts]
        self.shingles = [shingles(h) for h in self.words]
        classes = defaultdict(list)
        for i, h in enumerate(self.words):
            if len(h) >= MATCHED:
                classes[next((c for c in SIZE_CLASSES if len(h) <= c), 1 << len(h).bit_length())].append(i)
        self.classes = [SizeClass(ids, [self.shingles[i] for i in ids]) for _, ids in sorted(classes.items())]
        self.longest = max((len(h) for h in self.words), default=0)

    def leaks(self, h: np.ndarray) -> set[int]:
        """Items of which the text with word hashes ``h`` holds a passage."""
        s = shingles(h)
        value, at = sketch(s)
        found: set[int] = set()
        for c in self.classes:
            seeds = defaultdict(list)
            for item, p, q in c.hits(value, at):
                seeds[item].append((q - p, p, q))
            for item, where in seeds.items():
                if item not in found and self.verified(item, h, s, where, c.need):
                    found.add(item)
        return found

    def verified(self, item: int, h: np.ndarray, s: np.ndarray, where: list[tuple[int, int, int]], need: int) -> bool:
        a = self.words[item]
        slack = len(a) // ERROR_IN + 2
        where.sort()
        group = [where[0]]
        for seed in [*where[1:], None]:
            if seed is not None and seed[0] - group[-1][0] <= slack:
                group.append(seed)
                continue
            low, high = group[0][0] - slack, group[-1][0] + slack
            near = s[max(0, low) : max(0, high + len(a) + 1)]
            if int(np.isin(self.shingles[item], near).sum()) >= need and self.passage(a, h, low, high):
                return True
            group = [seed]
        return False

    @staticmethod
    def passage(a: np.ndarray, h: np.ndarray, low: int, high: int) -> bool:
        """Whether ``a`` has a stretch found in ``h`` on the diagonals ``low..high`` with enough equal words."""
        begin = max(0, low)
        b = h[begin : max(begin, high + len(a) + 1)]
        return len(b) > 0 and best_stretch(a.tolist(), b.tolist(), low - begin, high - begin)


def best_stretch(a: list, b: list, low: int, high: int) -> bool:
    """Local alignment within a band; an equal word counts 1, an error -2. True when some stretch qualifies.

    A second alignment counts an error -4, so that a clean run is not held to the errors of a poorer one before it.
    """
    return any(_stretch(a, b, low, high, price) for price in (2, 4))


def _stretch(a: list, b: list, low: int, high: int, price: int) -> bool:
    width = high - low + 1
    none = (0, 0, 0)  # score, equal words, errors
    before = [none] * (width + 2)
    for i, x in enumerate(a):
        row = [none] * (width + 2)
        for k in range(1, width + 1):
            j = i + low + k - 1
            if not 0 <= j < len(b):
                continue
            s, eq, err = before[k]
            best = (s + 1, eq + 1, err) if x == b[j] else (s - price, eq, err + 1)
            s, eq, err = before[k + 1]  # a word of the item dropped
            if s - price > best[0]:
                best = (s - price, eq, err + 1)
            s, eq, err = row[k - 1]  # a word added
            if s - price > best[0]:
                best = (s - price, eq, err + 1)
            if best[0] > 0:
                row[k] = best
                if best[1] >= MATCHED and best[2] * ERROR_IN <= best[1] + best[2]:
                    return True
        before = row
    return False


def leaked_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", chunk: int = 256) -> DataFrame:
    """``(key, item_key)``: every document that holds a passage of an item, with the item."""
    from weftline.plans.runtime import parallel

    spark = docs.sparkSession
    wanted = items.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["chars"] // BLOCK_CHARS))
    schema = T.StructType([docs.schema[key], items.schema[item_key]])
    kind = items.schema[item_key].dataType
    corpus = parallel(docs.select(key, text).where(F.col(text).isNotNull()))
    out = None
    for n in range(blocks):
        block = wanted.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == n).orderBy("i").collect() if blocks > 1 else wanted.orderBy("i", "t").collect()
        shared = spark.sparkContext.broadcast(([r["i"] for r in block], ItemIndex([r["t"] for r in block])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, index = shared.value
            known: dict[str, int] = {}
            for whole in batches:
                for at in range(0, whole.num_rows, chunk):
                    batch = whole.slice(at, chunk)
                    rows, found = [], []
                    for row, t in enumerate(batch.column(1).to_pylist()):
                        if len(known) > 500_000:
                            known.clear()
                        h = hashes(words(t), known)
                        leaks: set[int] = set()
                        for start in range(0, max(1, len(h) - index.longest), STRIDE):
                            leaks |= index.leaks(h[start : start + STRIDE + 2 * index.longest])
                        rows += [row] * len(leaks)
                        found += sorted(leaks)
                    if rows:
                        keys = batch.column(0).take(pa.array(rows))
                        item_type = pa.int64() if kind.simpleString() == "bigint" else pa.array([ids[0]]).type
                        yield pa.RecordBatch.from_arrays([keys, pa.array([ids[i] for i in found], item_type)], names=[key, item_key])

        part = corpus.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.distinct()
