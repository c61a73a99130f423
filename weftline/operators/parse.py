"""Markdown files into nodes, edges, loose ends and sections.

One Arrow pass a file reads what is sequential by nature - the YAML block, fences, headings and links of its lines; ids,
references, vocabulary and scopes are column expressions on top, so Catalyst prunes and pushes through them. Nothing is
shuffled: every derived table is an explode of the parsed rows.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.config import Config
from weftline.functions import ids

#: Frontmatter keys that are never references.
NON_EDGE_KEYS = ("id", "type", "superseded_by", "name", "aliases")
INLINE = "inline"
#: Frontmatter keys that make the id; a node's shown fields are the others.
ADDRESS = ("id", "type")

_REF = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("line", T.IntegerType())])
_LINK = T.StructType([T.StructField("inner", T.StringType()), T.StructField("line", T.IntegerType())])
_SECTION = T.StructType([T.StructField("heading", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("body", T.StringType())])
#: What the Arrow pass gives for a file.
PARSED = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("node_type", "slug", "frontmatter", "display_name")]
    + [T.StructField("strings", T.MapType(T.StringType(), T.StringType())), T.StructField("aliases", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.ArrayType(t)) for n, t in (("refs", _REF), ("links", _LINK), ("sections", _SECTION))]
)


def yaml_loader():
    """A YAML loader with the core schema: dates, times and ``yes`` stay strings."""
    import yaml

    class Core(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        yaml_implicit_resolvers: dict = {}

    tag = "tag:yaml.org,2002:"
    for name, pattern, first in (
        ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
        ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
        ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", list("-+0123456789")),
        ("float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", list("-+.0123456789")),
    ):
        Core.add_implicit_resolver(tag + name, re.compile(pattern), first)
    Core.add_constructor(tag + "int", lambda loader, node: int(loader.construct_scalar(node), 0) if "o" in node.value or "x" in node.value else int(node.value))
    return Core


def lines_of(text: str) -> list[str]:
    """Lines as terminated by LF or CR LF; no empty line after a final line end."""
    parts = text.split("\n")
    if parts and parts[-1] == "":
        parts.pop()
    return [p[:-1] if p.endswith("\r") else p for p in parts]


def is_fence(line: str) -> bool:
    return line.lstrip().startswith(("```", "~~~"))


def split_document(text: str) -> tuple[list[str], list[str], int] | None:
    """``(frontmatter lines, prose lines, line the prose starts at)``; None where the file has no closed frontmatter."""
    lines = lines_of(text)
    if not lines or lines[0].strip() != "---":
        return None
    for i in range(1, len(lines)):
        if lines[i].strip() == "---":
            return lines[1:i], lines[i + 1 :], i + 2
    return None


def scan_links(lines: list[str], first: int) -> list[dict]:
    """The inner texts of ``[[ ]]`` outside fences, with absolute lines; an opening without an end on its line is text."""
    out, fenced = [], False
    for n, line in enumerate(lines, first):
        if is_fence(line):
            fenced = not fenced
        elif not fenced and "[[" in line:
            out += [{"inner": m, "line": n} for m in re.findall(r"\[\[(.*?)\]\]", line)]
    return out


def scan_sections(lines: list[str], first: int) -> list[dict]:
    """Sections opened by ``## ``; the text before the first has no heading. Fences are not looked at here."""
    out: list[dict] = []
    for n, line in enumerate(lines, first):
        if line.startswith("## "):
            out.append({"heading": line[3:].strip(), "line": n, "body": []})
            continue
        if not out:
            out.append({"heading": "", "line": n, "body": []})
        out[-1]["body"].append(line)
    return [s | {"body": "\n".join(s["body"]).strip()} for s in out]


def sole_title(lines: list[str]) -> str | None:
    """The only level-1 heading outside fences; None where there is none or more than one."""
    found, fenced = [], False
    for line in lines:
        if is_fence(line):
            fenced = not fenced
        elif not fenced and (title := line.lstrip()).startswith("# ") and title[2:].strip():
            found.append(title[2:].strip())
    return found[0] if len(found) == 1 else None


def _plain(value):
    """A YAML value as JSON has it."""
    if isinstance(value, dict):
        return {k if isinstance(k, str) else json.dumps(_plain(k)): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_plain(v) for v in value]
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    return value


def parse_file(path: str, text: str | None, loader) -> dict | None:
    """Everything a node file holds, or None for a file that is no node."""
    import yaml

    parts = split_document(text or "")
    if parts is None:
        return None
    head, prose, first = parts
    try:
        fm = yaml.load("\n".join(head), Loader=loader)  # noqa: S506 - a safe loader
    except (yaml.YAMLError, ValueError, RecursionError):
        return None
    if not isinstance(fm, dict) or not all(isinstance(k, str) for k in fm):
        return None
    node_type, slug = (v.strip() if isinstance(v := fm.get(k), str) else "" for k in ("type", "id"))
    if not node_type or not slug:
        return None
    line_of: dict[str, int] = {}
    for n, line in enumerate(head, 2):
        key, colon, _ = line.partition(":")
        if colon and line[:1].strip() and key.strip():
            line_of.setdefault(key.strip(), n)
    refs = []
    for key in sorted(fm):
        if key not in NON_EDGE_KEYS:
            value = fm[key]
            refs += [{"key": key, "value": v, "line": line_of.get(key, 0)} for v in (value if isinstance(value, list) else [value]) if isinstance(v, str)]
    name = fm.get("name")
    stem = path.rsplit("/", 1)[-1]
    stem = stem.rsplit(".", 1)[0] if "." in stem[1:] else stem
    display = (name.strip() if isinstance(name, str) else "") or sole_title(prose) or stem
    aliases = fm.get("aliases")
    return {
        "node_type": node_type,
        "slug": slug,
        "frontmatter": json.dumps(_plain(fm) | {"name": display}, ensure_ascii=False, sort_keys=True),
        "strings": {k: v for k, v in fm.items() if isinstance(v, str)},
        "display_name": display,
        "aliases": [a for a in aliases if isinstance(a, str)] if isinstance(aliases, list) else [],
        "refs": refs,
        "links": scan_links(prose, first),
        "sections": scan_sections(prose, first),
    }


@F.pandas_udf(PARSED)
def _parse(paths: pd.Series, texts: pd.Series) -> pd.DataFrame:
    loader = yaml_loader()
    rows = [parse_file(p, t, loader) or {} for p, t in zip(paths, texts, strict=True)]
    return pd.DataFrame([[r.get(n) for n in PARSED.names] for r in rows], columns=PARSED.names, dtype="object")


def parse_documents(files: DataFrame, config: Config) -> DataFrame:
    """``files (path, content)`` as one wide row a node: address, frontmatter, and arrays of references and sections.

    Files that are no node give no row. Nodes of scoped types take the string of their scope field as scope, raw.
    """
    p = F.col("p")
    rows = files.select("path", _parse("path", "content").alias("p")).where(p["slug"].isNotNull())
    scoped = F.lit(False) if not config.scoped_types else p["node_type"].isin(*config.scoped_types)
    scope = F.when(scoped, F.get(F.array(p["strings"][config.scope_field]), 0))
    return rows.select(
        "path",
        ids.format_id(scope, p["node_type"], p["slug"]).alias("id"),
        scope.alias("scope"),
        p["node_type"].alias("type"),
        p["slug"].alias("slug"),
        p["frontmatter"].alias("frontmatter"),
        p["display_name"].alias("name"),
        p["aliases"].alias("aliases"),
        F.when(ids.id_type(p["strings"]["superseded_by"]).isNotNull(), p["strings"]["superseded_by"]).alias("superseded_by"),
        p["refs"].alias("refs"),
        p["links"].alias("links"),
        p["sections"].alias("sections"),
    )


def references(parsed: DataFrame) -> DataFrame:
    """Every reference of every node with where it stands: frontmatter ones first, by key, then inline ones in order."""
    key = F.transform("refs", lambda r: F.struct(r["key"].alias("ref_type"), F.lit("frontmatter").alias("origin"), ids.reference_value(r["value"]).alias("inner"), r["line"].alias("line")))
    link = F.transform("links", lambda r: F.struct(F.lit(INLINE).alias("ref_type"), F.lit(INLINE).alias("origin"), r["inner"].alias("inner"), r["line"].alias("line")))
    rows = parsed.select("id", "scope", "path", F.posexplode(F.concat(key, link)).alias("seq", "r"))
    rows = rows.select("id", "scope", "path", "seq", "r.*")
    return rows.withColumn("ref", ids.parse_reference("inner")).where("ref IS NOT NULL")


def edges(refs: DataFrame, config: Config) -> DataFrame:
    """Resolved references. Frontmatter ones only where the target's type is in the vocabulary; inline ones always.

    A target of a scoped type without a scope takes the scope of the node it stands in.
    """
    known = F.col("ref.type").isin(*config.id_prefixes) if config.id_prefixes else F.lit(False)
    rows = refs.where((F.col("ref.kind") == "resolved") & ((F.col("origin") == INLINE) | known))
    relative = F.col("ref.type").isin(*config.scoped_types) & F.col("ref.scope").isNull() & F.col("scope").isNotNull() if config.scoped_types else F.lit(False)
    to_id = F.when(relative, ids.format_id("scope", "ref.type", "ref.slug")).otherwise(ids.format_id("ref.scope", "ref.type", "ref.slug"))
    return rows.select(F.col("id").alias("from_id"), to_id.alias("to_id"), "ref_type", "origin", F.col("path").alias("source_file"), "line", "seq")


def unresolved(refs: DataFrame) -> DataFrame:
    """Loose ends: references that name a thing without its id."""
    rows = refs.where(F.col("ref.kind") == "unresolved")
    return rows.select(F.col("id").alias("record_id"), F.col("ref.type_guess").alias("type_guess"), F.col("ref.descriptor").alias("descriptor"), F.col("path").alias("source_file"), "line", "seq")


def sections(parsed: DataFrame) -> DataFrame:
    """One row a section: ``node_id heading line body``; the heading of a preamble is ``''``."""
    return parsed.select(F.col("id").alias("node_id"), F.col("path").alias("source_file"), F.explode("sections").alias("s")).select("node_id", "s.heading", "s.line", "s.body", "source_file")


def shown_fields(frontmatter: Column | str = "frontmatter") -> Column:
    """The frontmatter fields a reader is shown, as a map of texts (lists and objects as JSON); null for broken JSON."""
    fields = F.from_json(frontmatter, "map<string,string>")
    return F.map_filter(fields, lambda k, _: ~k.isin(*ADDRESS))


NODE = ("id", "type", "path", "frontmatter", "name", "aliases", "superseded_by")


def first_nodes(versions: DataFrame) -> DataFrame:
    """One row an id: the version whose file comes first, combined before the shuffle."""
    rest = [c for c in NODE if c not in ("id", "path", "frontmatter", "name")]
    first = F.min(F.struct("path", "frontmatter", "name", *rest)).alias("v")
    return versions.groupBy("id").agg(first).select(*(F.col(c) if c == "id" else F.col(f"v.{c}") for c in NODE))
