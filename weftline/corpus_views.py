"""The test corpus as a clean graph: one row a node, edge, loose end and section; the same views as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.orphans import WHITE
from weftline.plans.runtime import read_table

BLANK = "' ' || " + " || ".join(f"chr({ord(c)})" for c in WHITE if c != " ")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Live nodes, the earliest row an id: ``id type path frontmatter name aliases superseded_by``."""
    rows = read_table(spark, sf, "nodes").where("deleted_at IS NULL AND id IS NOT NULL")
    first = Window.partitionBy("id").orderBy("indexed_at", "path", "frontmatter")
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1")
    return rows.select("id", "type", "path", "frontmatter", F.when(F.col("name") != "", F.col("name")).alias("name"), "aliases", "superseded_by")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges, each once, ends trimmed: ``edge_id from_id to_id ref_type origin source_file line seq``."""
    rows = read_table(spark, sf, "edges").withColumn("to_id", F.trim("to_id", F.lit(WHITE))).withColumn("from_id", F.trim("from_id", F.lit(WHITE)))
    rows = rows.where("to_id <> '' AND from_id <> ''")
    return rows.select("edge_id", "from_id", "to_id", "ref_type", "origin", "source_file", "line", "seq").distinct()


def loose(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "unresolved").select("loose_id", "record_id", "type_guess", "descriptor", "source_file", "line").distinct()


def sections(spark: SparkSession, sf: str) -> DataFrame:
    """One section a node and line: ``node_id line heading body``."""
    first = Window.partitionBy("node_id", "line").orderBy("section_id")
    rows = read_table(spark, sf, "sections").where("node_id IS NOT NULL").withColumn("n", F.row_number().over(first)).where("n = 1")
    return rows.select("node_id", "line", F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce("body", F.lit("")).alias("body"))


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Usable section vectors: ``datum_id node_id section_line content_hash vector``."""
    v = F.col("embedding")
    usable = (F.size(v) == 64) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = read_table(spark, sf, "embedding_datum").where(v.isNotNull() & usable).dropDuplicates(["datum_id"])
    return rows.select("datum_id", "node_id", "section_line", "content_hash", v.alias("vector"))


SQL = f"""WITH RECURSIVE g_nodes AS (SELECT id, type, path, frontmatter, nullif(name, '') AS name, aliases, superseded_by FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at, path, frontmatter) AS rn
  FROM nodes WHERE deleted_at IS NULL AND id IS NOT NULL) WHERE rn = 1),
g_edges AS (SELECT DISTINCT edge_id, trim(from_id, {BLANK}) AS from_id, trim(to_id, {BLANK}) AS to_id, ref_type, origin, source_file, line, seq FROM edges
  WHERE trim(to_id, {BLANK}) <> '' AND trim(from_id, {BLANK}) <> ''),
g_loose AS (SELECT DISTINCT loose_id, record_id, type_guess, descriptor, source_file, line FROM unresolved),
g_sections AS (SELECT node_id, line, coalesce(heading, '') AS heading, coalesce(body, '') AS body FROM (SELECT *, row_number() OVER (PARTITION BY node_id, line ORDER BY section_id) AS rn
  FROM sections WHERE node_id IS NOT NULL) WHERE rn = 1),
g_vectors AS (SELECT DISTINCT datum_id, node_id, section_line, content_hash, embedding AS vector FROM embedding_datum WHERE len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)
"""
