"""Column expressions for retrieval: tokens, term frequency, snippets, cosine similarity."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.ids import _col, words

SPLIT = r"[^\p{IsAlphabetic}\p{N}]+"


def tokens(c: Column | str) -> Column:
    """Distinct lower-case alphanumeric tokens in order of appearance. Split first, then lower-cased."""
    return F.array_distinct(F.transform(F.filter(F.split(_col(c), SPLIT), lambda t: t != ""), lambda t: F.lower(t)))


def query_tokens(text: str) -> list[str]:
    """``tokens`` of a query, on the driver."""
    out = dict.fromkeys(t.lower() for t in re.findall(r"[^\W_]+", text))
    return list(out)


def folded(c: Column | str) -> Column:
    """Lower case without accents, as the full-text index compares tokens."""
    return F.lower(F.regexp_replace(_fold(_col(c)), r"\p{M}+", ""))


def fold_table() -> tuple[str, str]:
    """Accented Latin letters and what is left of them without accents, derived by rule."""
    source, target = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1:
            source.append(chr(code))
            target.append(base[0])
    return "".join(source), "".join(target)


def _fold(c: Column) -> Column:
    return F.translate(c, *fold_table())


def fold_token(token: str) -> str:
    """``folded`` of one token, on the driver."""
    return "".join(c for c in unicodedata.normalize("NFD", token.lower()) if not unicodedata.combining(c))


def index_tokens(*columns: Column | str) -> Column:
    """The distinct folded tokens of several texts: what a full-text match looks tokens up in."""
    text = F.concat_ws(" ", *(_col(c) for c in columns))
    return F.array_distinct(F.filter(F.split(folded(text), SPLIT), lambda t: t != ""))


def term_frequency(body: Column | str, query: list[str]) -> Column:
    """How often the query's tokens stand in ``body`` as substrings, not overlapping, case aside."""
    lower = F.lower(_col(body))
    total = F.lit(0)
    for t in query:
        total = total + F.floor((F.length(lower) - F.length(F.replace(lower, F.lit(t), F.lit("")))) / len(t)).cast("int")
    return total


def contains_all(text: Column | str, query: list[str]) -> Column:
    """Whether ``text`` (lower case) has every token of the query as a substring."""
    out = F.lit(True)
    for t in query:
        out = out & _col(text).contains(t)
    return out


def snippet(body: Column | str, query: list[str]) -> Column:
    """Twelve words around the first word that holds a query token, or the first twelve words."""
    w = words(body)
    hit = F.lit(False)
    has = lambda x: hit if not query else F.exists(F.array(*(F.lit(t) for t in query)), lambda t: F.contains(F.lower(x), t))
    at = F.array_position(F.transform(w, has), True)
    start = F.greatest(at - 4, F.lit(1))
    return F.array_join(F.when(at > 0, F.slice(w, start.cast("int"), (at + 8 - start).cast("int"))).otherwise(F.slice(w, 1, 12)), " ")


def with_cosine(df: DataFrame, vector: str, asked: list[float], out: str = "similarity") -> DataFrame:
    """``df`` with the cosine of its column ``vector`` to one vector in place of it, as one matrix product an Arrow batch.

    0 where lengths differ, a vector is null, empty or zero, or has a null or an element that is no number.
    """
    question = np.asarray(asked, np.float64)
    rest = [c for c in df.columns if c != vector]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, similarity = batch.column(len(rest)), np.zeros(batch.num_rows)
            fits = pc.equal(pc.list_value_length(vectors), len(question)).fill_null(False)
            x = np.asarray(vectors.filter(fits).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, len(question))
            with np.errstate(all="ignore"):
                s = x @ question / (np.linalg.norm(x, axis=1) * np.linalg.norm(question))
            similarity[np.asarray(fits.to_numpy(zero_copy_only=False), bool)] = np.where(np.isfinite(s), s, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(similarity)], names=[*rest, out])

    return df.select(*rest, vector).mapInArrow(run, schema) if len(question) else df.select(*rest, F.lit(0.0).alias(out))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two vectors; 0 where lengths differ, or a vector is empty or zero."""
    a, b = _col(a), _col(b)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    norm = F.sqrt(square(a)) * F.sqrt(square(b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) < 1) | (norm == 0), F.lit(0.0)).otherwise(dot / norm)
