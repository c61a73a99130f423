"""One consistent form for text that looks the same (problem 8).

Every Arrow batch is handed, some megabytes of text at a time, to an in-process DuckDB that evaluates one SQL expression:
invisible characters are removed with a regular expression, compatibility forms and look-alike letters
are mapped with ``translate``/``replace``, blanks are unified and ``nfc_normalize`` composes the accents.

Defined results
    * null text: null form; a text that shows nothing (empty, only blanks or invisible characters): form ``''``.
      Neither takes part in pairs.
    * very long texts are processed whole, on their own; rows are independent, so ties and repeated rows change nothing.
    * empty tables give empty results; other columns pass through ``visual_form`` untouched.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts drawn like a Latin letter, one pair of strings per script.
CYRILLIC = ("аеорсухіјѕһԁԛԝАВЕЅІЈКМНОРСТУХԌԛӏ", "aeopcyxijshdqwABESIJKMHOPCTYXGql")
GREEK = ("ονρϲιυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳ", "ovpciukABEZHIKMNOPTYXCj")
ARMENIAN = ("օսհցոՕՍՏ", "ouhgnOUS")
CHEROKEE = ("ᎪᏴᏟᎬᏀᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ", "ABCEGHJKLMPSTVWZ")
# Further forms a reader cannot tell apart from the plain one.
PLAIN = ("‐‑⁃−ɡɑıꞏ․ｰ￠￡￥￦", "----gaı·.ー¢£¥₩")
# Ligatures written as several letters.
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))
# Blanks of any width, as a character class; line breaks are a class of their own.
BLANKS = r"[\t\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
BREAKS = r"\r\n|[\r\x{000B}\x{000C}\x{0085}\x{2028}\x{2029}]"
# Characters without a picture of their own.
INVISIBLE = (
    r"[\x{0000}-\x{0008}\x{000E}-\x{001F}\x{007F}-\x{0084}\x{0086}-\x{009F}\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}"
    r"\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}"
    r"\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E0FFF}]"
)
# Combining marks that have precomposed letters in the scripts above.
MARKS = "".join(map(chr, (*range(0x300, 0x315), 0x31B, *range(0x323, 0x329), 0x32D, 0x32E, 0x330, 0x331, 0x342, 0x345)))


def letter_map() -> dict[str, str]:
    """Single-character mapping: look-alikes with every composed accent, and width forms, derived by rule."""
    table = dict(zip(PLAIN[0], PLAIN[1], strict=True))
    for theirs, latin in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE):
        for a, b in zip(theirs, latin, strict=True):
            table[a] = b
            for mark in MARKS:
                composed, target = unicodedata.normalize("NFC", a + mark), unicodedata.normalize("NFC", b + mark)
                if len(composed) == 1 and len(target) == 1:
                    table[composed] = target
    for code in [*range(0xFF01, 0xFF5F), *range(0xFF61, 0xFF9E), *range(0xFFA1, 0xFFDD)]:
        wide = unicodedata.normalize("NFKC", chr(code))
        if len(wide) == 1:
            table[chr(code)] = table.get(wide, wide)
    for code in range(0x2160, 0x2180):  # Roman numerals of one letter
        letter = unicodedata.normalize("NFKC", chr(code))
        if len(letter) == 1:
            table[chr(code)] = letter
    table["ﾞ"], table["ﾟ"] = "゙", "゚"
    return table


def several_letters() -> tuple[tuple[str, str], ...]:
    """Characters that look like several: ligatures, and Roman numerals by rule."""
    numerals = ((chr(code), unicodedata.normalize("NFKC", chr(code))) for code in range(0x2160, 0x2180))
    return LIGATURES + tuple((a, b) for a, b in numerals if len(b) > 1)


def read_confusables(path: str) -> dict[str, str]:
    """Single characters and what they look like, from a public table of lines ``code ; code ... ; class # note``."""
    out = {}
    with open(path, encoding="utf-8-sig") as lines:
        for line in lines:
            cells = line.split("#")[0].split(";")
            if len(cells) >= 2 and cells[0].strip() and cells[1].strip():
                source, target = ("".join(chr(int(c, 16)) for c in cell.split()) for cell in cells[:2])
                if len(source) == len(target) == 1 and source != target:
                    out[source] = target
    return out


def form_sql(column: str, confusables: str | None = None) -> str:
    """The embedded DuckDB expression that brings ``column`` to its one form; ``confusables`` names a further table."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = (read_confusables(confusables) if confusables else {}) | letter_map()
    table = {a: table.get(b, b) for a, b in table.items()}
    source, target = quote("".join(table)), quote("".join(table.values()))
    expr = f"nfc_normalize(regexp_replace({column}, {quote(INVISIBLE)}, '', 'g'))"
    expr = f"nfc_normalize(translate({expr}, {source}, {target}))"
    # a mark that only now stands on its own letter may have composed into a look-alike again
    expr = f"translate({expr}, {source}, {target})"
    for a, b in several_letters():
        expr = f"replace({expr}, {quote(a)}, {quote(b)})"
    expr = f"regexp_replace({expr}, {quote(BREAKS)}, chr(10), 'g')"
    return f"regexp_replace({expr}, {quote(BLANKS)}, ' ', 'g')"


def _duck():
    import duckdb

    # nothing spills beside the process: a slice of texts fits, or the limit says so
    con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
    con.execute("SET preserve_insertion_order=true")
    return con


#: Bytes of text that are normalised at a time; a longer text is a slice of its own.
SLICE_BYTES = 8_000_000


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about ``SLICE_BYTES`` of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    part = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    start = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    for a, b in zip(start, [*start[1:], len(part)], strict=True):
        yield batch.slice(int(a), int(b - a))


def visual_form(df: DataFrame, text: str = "text", out: str = "form", confusables: str | None = None) -> DataFrame:
    """``df`` with the unified form of ``text`` in a new string column ``out`` (all other columns unchanged)."""
    if out in df.columns:
        raise ValueError(f"column {out} exists already")
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    sql = f"SELECT {form_sql('t', confusables)} AS f FROM batch_in"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        for batch in (part for whole in batches for part in slices(whole, whole.schema.get_field_index(text))):
            batch_in = pa.table({"t": batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())})  # noqa: F841
            con.register("batch_in", batch_in)
            form = con.sql(sql).to_arrow_table().column(0).combine_chunks().cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, form], names=[*batch.schema.names, out])
            con.unregister("batch_in")

    return df.mapInArrow(run, schema)


def form_keys(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, form_key, text_key)``: 128-bit hashes of the unified form and of the exact text.

    Only the hashes leave the Arrow partition, so what is shuffled later does not depend on text length.
    Rows whose text is null or shows nothing are left out.
    """
    schema = T.StructType([docs.schema[key], T.StructField("form_key", T.StringType()), T.StructField("text_key", T.StringType())])
    sql = f"SELECT k, md5(f) AS form_key, md5(t) AS text_key FROM (SELECT k, t, {form_sql('t')} AS f FROM batch_in) WHERE trim(f, ' ' || chr(10)) <> ''"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        for batch in (part for whole in batches for part in slices(whole, 1)):
            batch_in = pa.table({"k": batch.column(0), "t": batch.column(1).cast(pa.large_string())})  # noqa: F841
            con.register("batch_in", batch_in)
            found = con.sql(sql).to_arrow_table().combine_chunks()
            arrays = [found.column(0).combine_chunks(), *(found.column(i).combine_chunks().cast(pa.string()) for i in (1, 2))]
            yield pa.RecordBatch.from_arrays([a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays], names=[key, "form_key", "text_key"])
            con.unregister("batch_in")

    return docs.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, schema)


def lookalike_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every pair of rows whose texts look the same but are not the same character sequence.

    Forms with a single spelling (exact copies only, however many) are dropped by a map-side combined aggregate before
    any join. Pairs are first made between distinct spellings of a form and only then given their rows.
    Result: ``<key>_a``, ``<key>_b`` with the smaller key first, each pair once; repeated rows of a key count once.
    """
    from weftline.plans.runtime import broadcast_if_small, cut

    # the hashes are read several times; a checkpoint keeps the texts from being normalised again
    keys = cut(form_keys(docs, key, text))
    mixed = keys.groupBy("form_key").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi")).where("lo <> hi").select("form_key")
    rows = keys.join(mixed, "form_key", "left_semi").distinct()
    spell = rows.select("form_key", "text_key").distinct()
    a, b = spell.select("form_key", F.col("text_key").alias("ta")), spell.select("form_key", F.col("text_key").alias("tb"))
    pairs = a.join(b, "form_key").where("ta < tb")
    left = rows.select(F.col(key).alias("ka"), "form_key", F.col("text_key").alias("ta"))
    right = rows.select(F.col(key).alias("kb"), "form_key", F.col("text_key").alias("tb"))
    # few spellings pair at all: where they are that few, the rows of a hot text stay in place
    found = broadcast_if_small(pairs).join(left, ["form_key", "ta"]).join(right, ["form_key", "tb"])
    return found.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b")).distinct()
