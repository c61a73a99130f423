"""Integrity checks of a reference graph, one DataFrame a check and one report over all of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import ids
from weftline.operators.parse import INLINE, NON_EDGE_KEYS

FIELDS = ("kind", "severity", "id", "to", "field", "value", "path", "paths", "line")
VIOLATIONS = ("duplicate_id", "dangling_ref")
KINDS = (*VIOLATIONS, "orphan", "drift", "frontmatter_wikilink", "unknown_type")


def duplicate_ids(node_files: DataFrame) -> DataFrame:
    """Ids that several files claim: ``id n paths``, paths sorted."""
    rows = node_files.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("path")).alias("paths"))
    return rows.where("n > 1")


def dangling_refs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is no node. An anti join on keys: a null can never empty the result as ``NOT IN`` would."""
    return edges.join(nodes.select(F.col("id").alias("to_id")), "to_id", "left_anti").select("from_id", "to_id", "source_file", "line")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes no edge starts from or leads to, dangling and self edges included: ``id path``."""
    touched = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    return nodes.join(touched, "id", "left_anti").select("id", "path")


def drift(edges: DataFrame) -> DataFrame:
    """Inline references whose target the node's frontmatter does not name: ``id to path line``, once a pair.

    One aggregate over the pairs decides, with no self join: a pair drifts when it has only inline edges.
    """
    inline = F.col("origin") == INLINE if "origin" in edges.columns else F.col("ref_type") == INLINE
    pairs = edges.groupBy("from_id", "to_id").agg(
        F.min(inline).alias("only"), F.min(F.when(inline, F.col("source_file"))).alias("path"), F.min(F.when(inline, F.col("line"))).alias("line")
    )
    return pairs.where("only").select(F.col("from_id").alias("id"), F.col("to_id").alias("to"), "path", "line")


def _fields(nodes: DataFrame) -> DataFrame:
    """``id path field value shape``: the top-level frontmatter fields as variants with their schemas."""
    rows = nodes.select("id", "path", F.try_parse_json("frontmatter").alias("fm")).where(F.schema_of_variant("fm").startswith("OBJECT"))
    fields = nodes.sparkSession.tvf.variant_explode(F.col("fm").outer())
    return rows.lateralJoin(fields).select("id", "path", F.col("key").alias("field"), "value", F.schema_of_variant("value").alias("shape"))


def _items(value: str = "value") -> Column:
    """The items of a list field; null for other fields."""
    return F.when(F.col("shape").startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))


def _string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _bracketed(v: Column) -> Column:
    return (F.schema_of_variant(v) == "STRING") & (_string(v).contains("[[") | _string(v).contains("]]"))


def frontmatter_wikilinks(nodes: DataFrame) -> DataFrame:
    """Fields written with link brackets: text that holds ``[[`` or ``]]``, or a list with a nested list, object or such text."""
    nested = lambda v: F.schema_of_variant(v).rlike("^(?:ARRAY|OBJECT)") | _bracketed(v)
    trapped = _bracketed(F.col("value")) | F.coalesce(F.exists(_items(), nested), F.lit(False))
    return _fields(nodes).where(trapped).select("id", "field", "path")


def unknown_types(nodes: DataFrame, vocabulary: Iterable[str]) -> DataFrame:
    """Reference-shaped field values whose type is not in the vocabulary: ``id field value path``."""
    rows = _fields(nodes).where(~F.col("field").isin(*NON_EDGE_KEYS))
    one = F.when(F.col("shape") == "STRING", F.array(_string(F.col("value"))))
    many = F.transform(F.filter(_items(), lambda v: F.schema_of_variant(v) == "STRING"), _string)
    rows = rows.select("id", "field", "path", F.explode(F.coalesce(one, many)).alias("value"))
    kind = ids.referenced_type("value")
    return rows.where(kind.isNotNull() & ~kind.isin(*vocabulary)).select("id", "field", "value", "path")


def ordered(found: DataFrame) -> DataFrame:
    """Findings by check, those of edges then by place, all by id and field."""
    kind = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    placed = F.col("kind").isin("dangling_ref", "drift")
    return found.orderBy(kind, F.when(placed, F.coalesce("path", F.lit(""))), F.when(placed, F.coalesce("line", F.lit(0))), "id", F.coalesce("field", F.lit("")), "to", "value")


def check(nodes: DataFrame, node_files: DataFrame, edges: DataFrame, vocabulary: Iterable[str]) -> DataFrame:
    """All findings in one shape: ``kind severity id to field value path paths line``."""

    def shaped(df: DataFrame, kind: str, **given: str) -> DataFrame:
        types = {"paths": "array<string>", "line": "int"}
        cells = [F.lit(kind).alias("kind"), F.lit("violation" if kind in VIOLATIONS else "warning").alias("severity")]
        return df.select(*cells, *((F.col(given[n]) if n in given else F.lit(None)).cast(types.get(n, "string")).alias(n) for n in FIELDS[2:]))

    parts = [
        shaped(duplicate_ids(node_files), "duplicate_id", id="id", paths="paths"),
        shaped(dangling_refs(edges, nodes), "dangling_ref", id="from_id", to="to_id", path="source_file", line="line"),
        shaped(orphans(nodes, edges), "orphan", id="id", path="path"),
        shaped(drift(edges), "drift", id="id", to="to", path="path", line="line"),
        shaped(frontmatter_wikilinks(nodes), "frontmatter_wikilink", id="id", field="field", path="path"),
        shaped(unknown_types(nodes, vocabulary), "unknown_type", id="id", field="field", value="value", path="path"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
