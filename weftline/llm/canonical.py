"""Mapping freely typed values to a canonical list (problem 3).

Token-level repair: each distinct token is joined to the list's vocabulary - by symmetric-delete keys (edit distance), by a
phonetic key, or as an abbreviation; complete entries are then ranked by soft TF-IDF over the repaired tokens, aligned by
optimal assignment. A value means an entry only if every token of the value is explained by it; tokens of the entry may be
left out (``Central Bureau``) while that stays unambiguous. Joined words and initials are tried as well.

Everything is a join on hashed keys: distinct values are read once, distinct tokens repaired once, and a value meets the
entries of its rarest token only. Document frequencies are counted once over the whole list. Nothing of the list or the
values is collected or broadcast by this module, so answers do not depend on the size of either.

Defined results
    * every row of the input comes out once per key; null, empty and placeholder values are ``unmatched``.
    * equal scores: the entry of the row's guessed type wins; if that does not decide, the value is ``unmatched``.
    * repeated rows of a key count once (the least of them); an empty list leaves all values unmatched; values and words of
      any length are read whole. Entries without an id are no entries; one without a word is never found.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.spelling import abbreviates, allowed, assign, distance, near_keys, plain, sounded, uncamel
from weftline.plans.runtime import parallel, written

UNMATCHED = "unmatched"
#: Letters up to which a token may be a skeleton of a word (``mgr``); longer ones abbreviate by their beginning only.
SKELETON = 12
#: How far below the best a score counts as equal to it.
MARGIN = 0.03
# Words around a name that are no part of it (kept where the list itself uses them).
BEFORE = {"the", "our", "old", "new", "probably", "maybe", "perhaps", "likely", "a", "an"}
AFTER = (r"i think", r"see notes?", r"tbc", r"main one", r"team", r"v\d+", r"the", r"maybe", r"again")
JOINING = {"for", "of", "and", "the", "in", "at"}
_AFTER = re.compile(r"[\s,;(\[–—-]*\b(?:" + "|".join(AFTER) + r")\b[\s)\].?!]*$")


def entry_tokens(name: str | None) -> list[str]:
    return re.findall(r"[^\W_]+", plain(name or "").casefold())


def typed_tokens(value: str, own: frozenset[str] | set[str] = frozenset()) -> list[str]:
    """The tokens of a typed value without the words around it; words in ``own`` stand in the list and are kept."""
    text = uncamel(plain(value)).casefold()
    text = re.sub(r"(?<=[a-z])'(?=s\b)", "", text)
    while (shorter := _AFTER.sub("", text)) != text and re.search(r"[^\W_]", shorter):
        text = shorter
    tokens = re.findall(r"[^\W_]+", text)
    while tokens and tokens[0] in BEFORE and tokens[0] not in own and not all(len(t) == 1 for t in tokens):
        tokens = tokens[1:]
    return [t for i, t in enumerate(tokens) if not (0 < i < len(tokens) - 1 and t in JOINING and t not in own)]


def likeness(token: str, word: str, known: bool) -> float:
    """How well ``token`` may stand for the list's ``word``: 0 for not at all. ``known``: the token is itself in the list."""
    if token == word:
        return 1.0
    out = 0.0
    if len(token) >= 4:
        most = min(allowed(len(token)), allowed(len(word)))
        e = distance(token, word, most)
        if 0 < e <= most:
            out = 1 - 0.08 * e - e / (4 * len(word))
        if sounded(token) == sounded(word):
            out = max(out, 0.86)
    if len(token) >= 2 and (not known or word.startswith(token)):
        out = max(out, abbreviates(token, word))
    return out


def soft(like: list[list[float]], weights: list[float]) -> float:
    """Soft TF-IDF of a value's tokens (rows of likenesses to the entry's words); 0 unless each has its own word."""
    total = sum(w * w for w in weights)
    # an allowed pair outweighs any sum of weights; nearer places win among equals
    worth = [[(1 + s * w * w / total + 1e-6 / (1 + abs(i - j))) * (s > 0) for j, (s, w) in enumerate(zip(row, weights, strict=True))] for i, row in enumerate(like)]
    at = assign(worth)
    if any(not like[i][j] for i, j in enumerate(at)):
        return 0.0
    score = sum(like[i][j] * weights[j] ** 2 for i, j in enumerate(at)) / total
    return score * 0.9 + 0.1 * sum(like[i][j] for i, j in enumerate(at)) / len(at) + (0.02 if at == sorted(at) else 0)


def _mapped(df: DataFrame, schema: str, rows: Callable[..., list[tuple]]) -> DataFrame:
    """``df`` through a function of a row's cells that gives any number of rows."""
    names = [part.split()[0] for part in re.sub(r"<[^>]*>", "", schema).split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for cells in zip(*(pdf[c] for c in pdf.columns), strict=True) for r in rows(*cells)], columns=names)

    return df.mapInPandas(run, schema)


def _keyed(df: DataFrame, name: str, keys: Callable[[str], set[str]]) -> DataFrame:
    """``(name, key)`` of distinct texts, the keys as 64-bit hashes."""
    return _mapped(df.select(name), f"{name} string, key string", lambda t: [(t, k) for k in keys(t)]).select(name, F.xxhash64("key").alias("key"))


def _word_keys(word: str) -> set[str]:
    short = {"a" + word[:n] for n in range(2, len(word))} if len(word) <= 60 else {"a" + word[:n] for n in range(2, 60)}
    return {"d" + k for k in near_keys(word, allowed(len(word)))} | {"s" + sounded(word), "f" + word[0]} | short


def _token_keys(token: str) -> set[str]:
    near = {"d" + k for k in near_keys(token, allowed(len(token)))} | {"s" + sounded(token)} if len(token) >= 4 else {"d" + token}
    # an abbreviation begins like its word: a beginning meets it by itself, a skeleton by the first letter
    return near | ({"a" + token[:59]} | ({"f" + token[0]} if len(token) <= SKELETON else set()) if len(token) >= 2 else set())


def repaired(typed: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(token, word, s)``: every word of ``vocabulary (word)`` that a token of ``typed (token)`` may stand for."""

    @F.pandas_udf("double")
    def alike(tokens: pd.Series, words: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([likeness(t, w, k) for t, w, k in zip(tokens, words, known, strict=True)], dtype="float64")

    known = vocabulary.select(F.col("word").alias("token"), F.lit(True).alias("known"))
    met = _keyed(typed, "token", _token_keys).join(_keyed(vocabulary, "word", _word_keys), "key").select("token", "word").distinct()
    met = met.join(known, "token", "left").withColumn("s", alike("token", "word", F.coalesce("known", F.lit(False))))
    return met.where("s > 0").select("token", "word", "s")


def map_to_canonical(
    values: DataFrame,
    entries: DataFrame,
    key: str = "loose_id",
    value: str = "descriptor",
    guess: str = "type_guess",
    entry_id: str = "id",
    entry_type: str = "type",
    entry_name: str = "name",
    out: str = "suggestion_id",
) -> DataFrame:
    """``(key, out)``: each row's entry of the list, or ``unmatched``."""
    listed = entries.select(F.col(entry_id).cast("string").alias("i"), F.col(entry_type).cast("string").alias("t"), F.col(entry_name).cast("string").alias("n")).where("i IS NOT NULL").distinct()
    listed = listed.withColumn("e", F.md5(F.to_json(F.struct("i", "t", "n"))))
    tokens = _mapped(listed.select("e", "n"), "e string, words array<string>", lambda e, n: [(e, w)] if (w := entry_tokens(n)) else [])
    tokens = written(tokens.join(listed.select("e", "i", "t"), "e"), "entries")
    size = tokens.count()
    posted = tokens.select("e", F.explode(F.array_distinct("words")).alias("word"))
    vocabulary = written(posted.groupBy("word").agg(F.count(F.lit(1)).alias("df")).withColumn("w", F.log(1 + F.lit(size) / F.col("df"))), "words")
    own = frozenset(r["word"] for r in vocabulary.where(F.col("word").isin(*sorted(BEFORE | JOINING))).collect())
    placed = tokens.select("e", F.posexplode("words").alias("at", "word")).join(vocabulary, "word")
    entry = placed.groupBy("e").agg(F.sort_array(F.collect_list(F.struct("at", "word", "w"))).alias("theirs"))

    rows = values.select(F.col(key).alias("k"), F.struct(F.col(value).cast("string").alias("v"), F.col(guess).cast("string").alias("g")).alias("r")).groupBy("k").agg(F.min("r").alias("r"))
    rows = rows.select("k", F.sha2("r.v", 256).alias("h"), "r.v", "r.g")

    def read(h: str, v: str) -> list[tuple]:
        ts = typed_tokens(v, own)
        return [(h, ts, "".join(ts))] if any(c.isalpha() for t in ts for c in t) else []

    distinct = rows.where("v IS NOT NULL").groupBy("h").agg(F.first("v").alias("v"))
    asked = written(_mapped(parallel(distinct).select("h", "v"), "h string, tokens array<string>, letters string", read), "values")

    # initials, and words written as one
    whole = tokens.select("e", F.array_join("words", "").alias("whole"), F.when(F.size("words") >= 3, F.array_join(F.transform("words", lambda w: F.substring(w, 1, 1)), "")).alias("initials"))
    single = F.forall("tokens", lambda t: F.length(t) == 1) | (F.size("tokens") == 1)
    short = asked.where(single).select("h", F.col("letters").alias("initials")).join(whole, "initials").select("h", "e", F.lit(0.7).alias("s"))

    @F.pandas_udf("double")
    def as_one(a: pd.Series, b: pd.Series) -> pd.Series:
        edits = [distance(x, y, 2) for x, y in zip(a, b, strict=True)]
        return pd.Series([0.97 - 0.06 * e if e <= (2 if len(x) >= 9 else 1) else 0.0 for e, x in zip(edits, a, strict=True)], dtype="float64")

    one = lambda df, name: _keyed(df.select(name).distinct(), name, lambda t: near_keys(t, 1))
    pairs = one(asked.where("length(letters) >= 6"), "letters").join(one(whole, "whole"), "key").select("letters", "whole").distinct()
    pairs = pairs.withColumn("s", as_one("letters", "whole")).where("s > 0")
    joined = asked.join(pairs, "letters").join(whole, "whole").select("h", "e", "s")
    direct = written(short.unionByName(joined), "direct")

    # repaired tokens
    word_by = asked.select("h", "letters", F.size("tokens").alias("n"), F.posexplode("tokens").alias("at", "token"))
    typed = word_by.select("token").where("length(token) > 1").distinct()
    fixed = written(repaired(typed, vocabulary).join(vocabulary, "word"), "repairs")
    by_token = fixed.groupBy("token").agg(F.sum("df").alias("many"), F.map_from_entries(F.collect_list(F.struct("word", "s"))).alias("repairs"))
    read_as = word_by.join(by_token, "token", "left").where("repairs IS NOT NULL OR length(token) = 1")
    per_value = read_as.groupBy("h", "n", "letters").agg(
        F.collect_list(F.struct("at", "token", "repairs")).alias("mine"),
        F.min(F.when(F.col("many").isNotNull(), F.struct("many", "at", "token"))).alias("rarest"),
    )
    # a few letters alone are initials where an entry has them, never a shortened name
    found = direct.select("h").distinct().withColumn("found", F.lit(True))
    alone = (F.col("n") == 1) & (F.length("letters") <= 3) & F.col("found").isNotNull()
    # maps cannot be sorted by, so the places are
    per_value = per_value.withColumn("mine", F.array_sort("mine", lambda a, b: a["at"] - b["at"]))
    per_value = per_value.where((F.size("mine") == F.col("n")) & F.col("rarest").isNotNull()).join(found, "h", "left").where(~alone)
    met = per_value.select("h", F.col("rarest.token").alias("token")).join(fixed.select("token", "word"), "token").join(posted, "word").select("h", "e").distinct()

    def ranked(h: str, e: str, like: np.ndarray, weights: np.ndarray) -> list[tuple]:
        s = soft(like.reshape(-1, len(weights)).tolist(), weights.tolist())
        return [(h, e, s)] if s else []

    fits = met.join(entry, "e").join(per_value.select("h", "mine"), "h").where((F.size("mine") <= F.size("theirs")) & (2 * F.size("mine") >= F.size("theirs")))
    # a token of one letter has no repairs of its own: it fits whatever begins with it
    letter = lambda m, t: F.when((m["token"] == F.substring(t["word"], 1, 1)) & (F.length(t["word"]) > 1), 0.6)
    row = lambda m: F.transform("theirs", lambda t: F.coalesce(F.try_element_at(m["repairs"], t["word"]), letter(m, t), F.lit(0.0)))
    fits = fits.select("h", "e", F.transform("mine", row).alias("like"), F.col("theirs.w").alias("weights")).where(F.forall("like", lambda r: F.array_max(r) > 0))
    scored = _mapped(fits.select("h", "e", F.flatten("like").alias("like"), "weights"), "h string, e string, s double", ranked)
    options = written(direct.unionByName(scored).join(tokens.select("e", "i", "t"), "e").groupBy("h", "i", "t").agg(F.max("s").alias("s")), "options")

    # close ones are counted by type: one is the answer, several are told apart by the guess
    best = options.groupBy("h").agg(F.max("s").alias("best"))
    close = options.join(best, "h").where(F.col("s") >= F.col("best") - MARGIN)
    kinds = close.groupBy("h", "t").agg(F.count(F.lit(1)).alias("c"), F.min("i").alias("i"))
    every = kinds.groupBy("h").agg(F.sum("c").alias("c"), F.min("i").alias("i"))
    chosen = rows.select("k", "h", "g").join(every, "h", "left").join(kinds.select("h", F.col("t").alias("g"), F.col("c").alias("cg"), F.col("i").alias("ig")), ["h", "g"], "left")
    answer = F.when(F.col("c") == 1, F.col("i")).when((F.col("c") > 1) & (F.col("cg") == 1), F.col("ig")).otherwise(F.lit(UNMATCHED))
    return chosen.select(F.col("k").alias(key), answer.alias(out))
