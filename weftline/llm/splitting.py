"""Splitting oversized texts at natural boundaries (problem 2).

A text over the limit is broken down by a recursive hierarchy of separators - section heading, paragraph, line,
sentence, word, character - until every unit fits; the units are packed greedily into pieces up to the limit, and each
piece but the first repeats the tail of the piece before it, beginning at a word where there is one.

Defined results
    * null text: no piece; empty text and text within the limit: one piece, itself.
    * every character of the text is in exactly one piece's new part (``start`` .. ``end``); ``lead`` characters before
      ``start`` are the repeated tail. Lengths count Unicode code points of the text alone, never of the heading.
    * texts without any boundary are cut at the limit, never between a letter and its combining marks or inside CR LF
      (unless more than 64 marks stand in a row).
    * a null heading stays null on every piece; repeated rows of the key column count once where one is named.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 2000, 200

# Where a text may be cut, strongest first; each pattern ends where the next unit begins.
SEPARATORS = (
    re.compile(r"(?:\r\n|\r|\n)(?=#{1,6}[ \t])"),
    re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*"),
    re.compile(r"(?:\r\n|\r|\n)"),
    re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？｡]+[」』）]*\s*"),
    re.compile(r"\s+|(?<=[、，；])"),
)


def safe_cut(text: str, at: int) -> int:
    """``at`` or a little before it, so that no letter is parted from its marks and no line end is halved."""
    for back in range(65):
        i = at - back
        if i <= 0:
            return at
        joined = unicodedata.combining(text[i]) or text[i] in "‍︎️" or text[i - 1] == "‍" or text[i - 1 : i + 1] == "\r\n"
        if not joined:
            return i
    return at


def units(text: str, start: int, end: int, room: int, hard: int, level: int = 0) -> Iterator[tuple[int, int]]:
    """Spans of at most ``room`` characters covering ``start..end`` in order, cut at the strongest boundaries possible.

    Where there is none, spans of ``hard`` characters leave room for an overlap.
    """
    if end - start <= room:
        yield start, end
        return
    if level == len(SEPARATORS):
        while end - start > hard:
            cut = safe_cut(text, start + hard)
            cut = cut if cut > start else start + hard
            yield start, cut
            start = cut
        if end > start:
            yield start, end
        return
    at = start
    for m in SEPARATORS[level].finditer(text, start, end):
        if m.end() > at and m.end() < end:
            yield from units(text, at, m.end(), room, hard, level + 1)
            at = m.end()
    yield from units(text, at, end, room, hard, level + 1)


def word_starts(text: str) -> list[int]:
    return [m.start() for m in re.finditer(r"(?<=\s)\S", text)]


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """``(lead, start, end)`` of each piece: it is ``text[start - lead : end]``, of at most ``limit`` characters."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    n = len(text)
    if n <= limit:
        return [(0, 0, n)]
    starts, out = word_starts(text), []
    begin, lead, stop = 0, 0, 0
    for a, b in units(text, 0, n, limit, limit - overlap):
        if b - begin + lead > limit:
            out.append((lead, begin, stop))
            # a unit that all but fills a piece leaves less room for the tail before it
            begin, floor = a, max(a - min(overlap, limit - (b - a)), begin)
            k = bisect.bisect_left(starts, floor)
            first = starts[k] if k < len(starts) and starts[k] < a else floor
            lead = a - first
        stop = b
    out.append((lead, begin, stop))
    return out


PIECE = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("piece_no", "lead", "start", "end", "n_chars")] + [T.StructField("piece", T.StringType())]
)


def split_oversized(df: DataFrame, text: str, limit: int = LIMIT, overlap: int = OVERLAP, key: str | None = None) -> DataFrame:
    """One row per piece of every row's ``text``: the other columns, then ``piece_no lead start end n_chars piece``.

    Texts within the limit become their one piece inside the JVM; only oversized ones visit Python, as Arrow batches.
    With ``key``, repeated rows of a key count once; they are dropped behind the size filter, so a reader of one kind of
    piece shuffles that kind's texts only.
    """
    clash = {f.name for f in PIECE} & (set(df.columns) - {text})
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    rest = [c for c in df.columns if c != text]
    size = F.length(text)
    once = (lambda part: part.dropDuplicates([key])) if key else (lambda part: part)
    short = once(df.where(size <= limit)).select(
        *rest,
        *(F.lit(0).alias(n) for n in ("piece_no", "lead", "start")),
        size.alias("end"),
        size.alias("n_chars"),
        F.col(text).alias("piece"),
    )

    @F.pandas_udf(T.ArrayType(PIECE))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: [
                {"piece_no": i, "lead": lead, "start": a, "end": b, "n_chars": b - a + lead, "piece": t[a - lead : b]}
                for i, (lead, a, b) in enumerate(pieces(t, limit, overlap))
            ]
        )

    long = once(df.where(size > limit)).select(*rest, F.explode(cut(F.col(text))).alias("p")).select(*rest, "p.*")
    return short.unionByName(long)


def split_sections(sections: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, key: str = "section_id") -> DataFrame:
    """The pieces of every section, each with its section's ``heading``; a section delivered twice is split once."""
    return split_oversized(sections.select(key, "heading", "body"), "body", limit, overlap, key)
