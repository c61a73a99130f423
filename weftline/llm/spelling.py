"""Token-level tools for names typed by people: folding, edit distance, symmetric-delete neighbourhoods, abbreviations."""

from __future__ import annotations

import re
import unicodedata
from itertools import combinations

from weftline.llm.visual_form import letter_map

# Letters that keep no accent to strip.
LETTERS = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "þ": "th", "æ": "ae", "Æ": "Ae", "œ": "oe", "ß": "ss", "ı": "i"}
_TABLE = str.maketrans(letter_map() | LETTERS)
_CAMEL = re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ][a-zà-ÿ])")


def plain(text: str) -> str:
    """``text`` with look-alikes, accents and invisible characters removed; case kept."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).translate(_TABLE))
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").translate(_TABLE)


def uncamel(text: str) -> str:
    """``text`` with a blank between words joined as in ``CamelCase``."""
    return _CAMEL.sub(" ", text)


def distance(a: str, b: str, most: int) -> int:
    """Edits (change, drop, add, swap of neighbours) from ``a`` to ``b``, or ``most + 1`` when there are more.

    Only cells within ``most`` of the diagonal are filled, so the cost grows with the length, not its square.
    """
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    start, end = 0, 0
    short = min(len(a), len(b))
    while start < short and a[start] == b[start]:
        start += 1
    while end < short - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return max(len(a), len(b))
    far, width = most + 1, 2 * most + 3  # cell k of row i stands for column i + k - most - 1
    older, old = [far] * width, [j if 0 <= (j := k - most - 1) <= len(b) else far for k in range(width)]
    for i, x in enumerate(a, 1):
        row = [far] * width
        for k in range(1, width - 1):
            j = i + k - most - 1
            if not 0 <= j <= len(b):
                continue
            if j == 0:
                row[k] = i
                continue
            y = b[j - 1]
            d = min(old[k + 1] + 1, row[k - 1] + 1, old[k] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[k] + 1)
            row[k] = d
        if min(row) > most:
            return far
        older, old = old, row
    return min(old[len(b) - len(a) + most + 1], far)


def allowed(n: int) -> int:
    """Edits allowed in a token of ``n`` letters."""
    return 0 if n < 4 else 1 if n < 7 else 2


#: Letters up to which neighbours are found by dropping letters; longer tokens share one of five unchanged parts.
DROPPED = 40


def deletes(token: str, depth: int) -> set[str]:
    """``token`` and everything left of it after dropping up to ``depth`` letters."""
    out = {token}
    for d in range(1, min(depth, len(token) - 1) + 1):
        out |= {"".join(token[i] for i in keep) for keep in combinations(range(len(token)), len(token) - d)}
    return out


def near_keys(token: str, depth: int) -> set[str]:
    """Keys of which two tokens within ``depth`` (at most two) edits of each other share at least one, at any length.

    Up to ``DROPPED`` letters, what is left after dropping letters. Two edits touch at most four of five parts of a longer
    token, so a part of its index stands unchanged, moved by up to two places, in the other one.
    """
    n = len(token)
    out = deletes(token, depth) if n <= DROPPED + 2 else set()
    if n > DROPPED - 2 and depth:
        for size in range(n - 2, n + 3):
            for i in range(5):
                a, b = size * i // 5, size * (i + 1) // 5
                out |= {f"{size}/{i}/{token[at : at + b - a]}" for at in range(max(0, a - 2), min(n - (b - a), a + 2) + 1)}
    return out


def abbreviates(short: str, full: str) -> float:
    """How well ``short`` reads as an abbreviation of ``full``: 0 for not at all, a beginning better than a skeleton."""
    if not 2 <= len(short) < len(full) or short[0] != full[0]:
        return 0.0
    if full.startswith(short):
        return 0.8
    rest = iter(full)
    if all(c in rest for c in short):
        return 0.7 if len(short) <= (len(full) + 1) * 2 / 3 else 0.0
    return 0.0


def assign(weights: list[list[float]]) -> list[int]:
    """The column of each row in the one-to-one assignment of the greatest sum; there are at least as many columns as rows.

    The Hungarian method with potentials: rows squared times columns.
    """
    n, m = len(weights), len(weights[0])
    u, v, row_of, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while row_of[j]:
            used[j] = True
            delta, to = float("inf"), 0
            for k in range(1, m + 1):
                if not used[k]:
                    cost = -weights[row_of[j] - 1][k - 1] - u[row_of[j]] - v[k]
                    if cost < least[k]:
                        least[k], way[k] = cost, j
                    if least[k] < delta:
                        delta, to = least[k], k
            for k in range(m + 1):
                if used[k]:
                    u[row_of[k]] += delta
                    v[k] -= delta
                else:
                    least[k] -= delta
            j = to
        while j:
            row_of[j], j = row_of[way[j]], way[j]
    out = [0] * n
    for k in range(1, m + 1):
        if row_of[k]:
            out[row_of[k] - 1] = k - 1
    return out


def sounded(token: str) -> str:
    """A light phonetic key: spellings that sound alike share it."""
    for a, b in (("ph", "f"), ("ck", "k"), ("ks", "x"), ("th", "t"), ("qu", "kv"), ("c", "k"), ("w", "v"), ("z", "s"), ("y", "i"), ("d", "t")):
        token = token.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", token)
