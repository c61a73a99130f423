"""Queries of the core by name, each with equivalent SQL where SQL can express it. All run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import corpus_views as views
from weftline.config import Config
from weftline.functions import ids, text
from weftline.functions.embedding import LocalEmbedder, content_hash, embed_missing
from weftline.operators import check, graph, orphans, parse, render
from weftline.operators import search as retrieval
from weftline.plans.build import derive, merge
from weftline.plans.runtime import read_table
from weftline.sources.files import filter_paths

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, graph_views: bool = True) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL over the clean views (or the raw tables)."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (views.SQL if graph_views else "") + sql
        return f

    return register


# Constants the queries ask for; they stand in the corpus at every size.
TARGET, SCOPE = "project:tidewater-refit", "project:tidewater-refit"
VOCABULARY = ("person", "department", "method", "system", "record", "project")
#: A vocabulary that leaves types of the tables unknown.
FEW = ("person", "project")
WORDS = "copper ledger"
TOKENS = ["copper", "ledger"]
CONFIG = Config(include=("**/*.md",), id_prefixes=VOCABULARY, scoped_types=("record",), scope_field="project")

# --- graph reads ----------------------------------------------------------------------------------------------------------


@query(f"SELECT n.id, n.type, n.path, e.ref_type, e.line FROM g_edges e JOIN g_nodes n ON n.id = e.from_id WHERE e.to_id = '{TARGET}'")
def backlinks(spark: SparkSession, sf: str) -> DataFrame:
    return graph.backlinks(views.nodes(spark, sf), views.edges(spark, sf), TARGET)


@query(f"SELECT n.id, n.type, n.path, e.ref_type, e.line FROM g_edges e JOIN g_nodes n ON n.id = e.from_id WHERE e.to_id = '{TARGET}' AND n.type = 'person'")
def backlinks_type(spark: SparkSession, sf: str) -> DataFrame:
    return graph.backlinks(views.nodes(spark, sf), views.edges(spark, sf), TARGET, type="person")


@query(f"SELECT n.id, n.type, n.path, e.ref_type, e.line FROM g_edges e JOIN g_nodes n ON n.id = e.from_id WHERE e.to_id = '{TARGET}' ORDER BY n.id, e.line, e.ref_type NULLS FIRST LIMIT 10")
def backlinks_limit(spark: SparkSession, sf: str) -> DataFrame:
    return graph.backlinks(views.nodes(spark, sf), views.edges(spark, sf), TARGET, limit=10)


@query("SELECT e.to_id AS id, count(*) AS n FROM g_edges e JOIN g_nodes n ON n.id = e.from_id GROUP BY 1")
def backlink_counts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.backlink_counts(views.nodes(spark, sf), views.edges(spark, sf))


@query("SELECT to_id, ref_type, line FROM g_edges WHERE from_id = (SELECT min(from_id) FROM g_edges WHERE from_id LIKE 'decision:%')")
def outbound(spark: SparkSession, sf: str) -> DataFrame:
    edges = views.edges(spark, sf)
    first = edges.where(F.col("from_id").startswith("decision:")).agg(F.min("from_id")).first()[0]
    return graph.outbound(edges, first or "")


_START = "starts AS (SELECT id FROM g_nodes)"
_HOPS = f""", {_START}, walk(start, id, d) AS (SELECT id, id, 0 FROM starts
  UNION SELECT w.start, e.to_id, w.d + 1 FROM walk w JOIN g_edges e ON e.from_id = w.id JOIN g_nodes n ON n.id = e.to_id WHERE w.d < {{depth}}),
reached AS (SELECT start, id, min(d) AS distance FROM walk GROUP BY start, id HAVING min(d) > 0)
SELECT r.start, r.id, n.type, n.path, r.distance{{more}} FROM reached r JOIN g_nodes n USING (id)"""


def _refs(spark: SparkSession, sf: str, depth: int) -> DataFrame:
    nodes = views.nodes(spark, sf)
    return graph.traverse(nodes, views.edges(spark, sf), nodes.select("id"), depth)


@query(
    f""", {_START}, ranked AS (SELECT s.id AS start, e.*, row_number() OVER (PARTITION BY s.id, e.to_id ORDER BY e.line NULLS FIRST, e.seq NULLS FIRST, e.ref_type NULLS FIRST) AS rn
  FROM starts s JOIN g_edges e ON e.from_id = s.id WHERE e.to_id <> s.id)
SELECT start, n.id, n.type, n.path, ref_type, line, 1 AS distance FROM ranked JOIN g_nodes n ON n.id = to_id WHERE rn = 1"""
)
def refs_depth1(spark: SparkSession, sf: str) -> DataFrame:
    return _refs(spark, sf, 1)


@query(_HOPS.format(depth=2, more=""))
def refs_depth2(spark: SparkSession, sf: str) -> DataFrame:
    return _refs(spark, sf, 2).drop("ref_type", "line")


@query(_HOPS.format(depth=3, more="") + " WHERE n.type = 'system'")
def refs_type_filter(spark: SparkSession, sf: str) -> DataFrame:
    return graph.reach(views.nodes(spark, sf), views.edges(spark, sf), "system", 3)


_CHAIN = """, chain(requested, cur, path, state, hops) AS (SELECT id, id, []::VARCHAR[], 'on', 0 FROM asked
  UNION ALL SELECT requested, CASE WHEN nx.id IS NULL OR nx.next IS NULL OR list_contains(path, cur) THEN cur ELSE nx.next END, list_append(path, cur),
    CASE WHEN nx.id IS NULL THEN 'missing' WHEN nx.next IS NULL OR list_contains(path, cur) THEN 'end' ELSE 'on' END, hops + 1
  FROM chain LEFT JOIN (SELECT id, nullif(superseded_by, '') AS next FROM g_nodes) nx ON nx.id = cur WHERE state = 'on')
SELECT requested, CASE WHEN state = 'end' THEN cur END AS resolved, CASE WHEN state = 'missing' THEN cur END AS missing FROM chain WHERE state <> 'on'"""


@query(", asked AS (SELECT DISTINCT id FROM (SELECT id FROM g_nodes UNION ALL SELECT to_id FROM g_edges))" + _CHAIN)
def resolve_all(spark: SparkSession, sf: str) -> DataFrame:
    nodes = views.nodes(spark, sf)
    return graph.resolve_all(nodes, nodes.select("id").union(views.edges(spark, sf).select("to_id")))


@query(
    ", asked AS (SELECT id FROM g_nodes WHERE superseded_by <> '')"
    + _CHAIN.replace("SELECT requested, CASE WHEN state = 'end'", ", ends AS (SELECT requested, CASE WHEN state = 'end'")
    + ") SELECT e.resolved, e.requested, e.missing, n.type, n.path FROM ends e JOIN g_nodes n ON n.id = e.resolved"
)
def resolve_redirects(spark: SparkSession, sf: str) -> DataFrame:
    nodes = views.nodes(spark, sf)
    ends = graph.resolve_all(nodes, nodes.where("superseded_by <> ''").select("id"))
    return ends.where("resolved IS NOT NULL").join(nodes.select(F.col("id").alias("resolved"), "type", "path"), "resolved")


@query("SELECT record_id AS record, source_file AS path, type_guess, descriptor, line FROM g_loose")
def unresolved(spark: SparkSession, sf: str) -> DataFrame:
    return graph.unresolved(views.loose(spark, sf))


@query("SELECT record_id AS record, source_file AS path, type_guess, descriptor, line FROM g_loose WHERE type_guess = 'person'")
def unresolved_type(spark: SparkSession, sf: str) -> DataFrame:
    return graph.unresolved(views.loose(spark, sf), type="person")


@query(f"SELECT record_id AS record, source_file AS path, type_guess, descriptor, line FROM g_loose WHERE record_id IN (SELECT from_id FROM g_edges WHERE ref_type = 'scope' AND to_id = '{SCOPE}')")
def unresolved_scope(spark: SparkSession, sf: str) -> DataFrame:
    return graph.unresolved(views.loose(spark, sf), views.edges(spark, sf), scope=SCOPE)


@query("SELECT (SELECT count(*) FROM g_nodes) AS nodes, (SELECT count(*) FROM g_edges) AS edges, (SELECT count(*) FROM g_vectors) AS sections")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.status_counts(views.nodes(spark, sf), views.edges(spark, sf), views.embeddings(spark, sf))


@query("SELECT type, count(*) AS n FROM g_nodes GROUP BY type")
def status_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return graph.count_by_type(views.nodes(spark, sf))


@query(
    """, parsed AS (SELECT id, frontmatter::JSON AS fm FROM g_nodes WHERE json_valid(frontmatter) AND json_type(frontmatter) = 'OBJECT'), fields AS (SELECT id, unnest(json_keys(fm)) AS field, fm FROM parsed)
SELECT id, field, replace(fm ->> ('$."' || field || '"'), '", "', '","') AS "value" FROM fields WHERE field NOT IN ('id', 'type')"""
)
def frontmatter_view(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.nodes(spark, sf).select("id", F.explode(parse.shown_fields()).alias("field", "value"))
    return rows.withColumn("value", F.replace("value", F.lit('", "'), F.lit('","')))


# --- checks ---------------------------------------------------------------------------------------------------------------


@query("SELECT id, count(*) AS n, list(path ORDER BY path) AS paths FROM (SELECT DISTINCT id, path FROM node_files) GROUP BY id HAVING count(*) > 1", graph_views=False)
def check_duplicate_id(spark: SparkSession, sf: str) -> DataFrame:
    return check.duplicate_ids(read_table(spark, sf, "node_files").select("id", "path").distinct())


@query("SELECT from_id, to_id, source_file, line FROM g_edges e WHERE NOT EXISTS (SELECT 1 FROM g_nodes n WHERE n.id = e.to_id)")
def check_dangling(spark: SparkSession, sf: str) -> DataFrame:
    return check.dangling_refs(views.edges(spark, sf), views.nodes(spark, sf))


@query("SELECT id, path FROM g_nodes n WHERE NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.from_id = n.id AND origin = 'frontmatter') AND NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.to_id = n.id AND origin = 'frontmatter')")
def check_orphan(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes that stand apart in the graph that frontmatter declares (the tables' inline links touch every node)."""
    return check.orphans(views.nodes(spark, sf), views.edges(spark, sf).where("origin = 'frontmatter'"))


@query(
    """SELECT e.from_id AS id, e.to_id AS "to", min(e.source_file) AS path, min(e.line) AS line FROM g_edges e WHERE e.origin = 'inline'
  AND NOT EXISTS (SELECT 1 FROM g_edges f WHERE f.from_id = e.from_id AND f.to_id = e.to_id AND f.origin <> 'inline') GROUP BY 1, 2"""
)
def check_drift(spark: SparkSession, sf: str) -> DataFrame:
    return check.drift(views.edges(spark, sf))


_FIELDS = """, parsed AS (SELECT id, path, frontmatter::JSON AS fm FROM g_nodes WHERE json_valid(frontmatter) AND json_type(frontmatter) = 'OBJECT'),
fields AS (SELECT id, path, unnest(json_keys(fm)) AS field, fm FROM parsed),
vals AS (SELECT id, path, field, json_extract(fm, '$."' || field || '"') AS v FROM fields),
strings AS (SELECT id, path, field, v ->> '$' AS s FROM vals WHERE json_type(v) = 'VARCHAR'
  UNION ALL SELECT id, path, field, x ->> '$' FROM (SELECT id, path, field, unnest(json_extract(v, '$[*]')) AS x FROM vals WHERE json_type(v) = 'ARRAY') WHERE json_type(x) = 'VARCHAR')
"""


_TRAPPED = """SELECT DISTINCT id, field, path FROM (SELECT id, field, path FROM strings WHERE contains(s, '[[') OR contains(s, ']]')
  UNION ALL SELECT id, field, path FROM (SELECT id, field, path, unnest(json_extract(v, '$[*]')) AS x FROM vals WHERE json_type(v) = 'ARRAY') WHERE json_type(x) IN ('ARRAY', 'OBJECT'))"""


@query(
    """SELECT node_id || '#' || line AS id, field, node_id AS path FROM (SELECT node_id, line, 'heading' AS field, heading AS s FROM g_sections UNION ALL SELECT node_id, line, 'lines', body FROM g_sections)
  WHERE contains(s, '[[') OR contains(s, ']]') UNION ALL SELECT node_id || '#' || line, 'nested', node_id FROM g_sections"""
)
def check_fm_wikilink(spark: SparkSession, sf: str) -> DataFrame:
    """The bracket check over objects made of every section: a text, a list of lines and a nested list."""
    made = F.to_json(F.struct("heading", F.split("body", "\n").alias("lines"), F.array(F.array("line")).alias("nested")))
    rows = views.sections(spark, sf).select(F.concat("node_id", F.lit("#"), "line").alias("id"), F.col("node_id").alias("path"), made.alias("frontmatter"))
    return check.frontmatter_wikilinks(rows)


@query(
    _FIELDS
    + f"""SELECT id, field, s AS "value", path FROM strings WHERE field NOT IN ('id', 'type', 'superseded_by', 'name', 'aliases')
  AND regexp_full_match(s, '[A-Za-z0-9_\\-]+:\\S+') AND split_part(s, ':', 1) NOT IN {FEW}"""
)
def check_unknown_type(spark: SparkSession, sf: str) -> DataFrame:
    return check.unknown_types(views.nodes(spark, sf), FEW)


_REPORT = """, found(kind, severity) AS (SELECT 'duplicate_id', 'violation' FROM (SELECT id FROM (SELECT DISTINCT id, path FROM node_files) GROUP BY id HAVING count(*) > 1)
  UNION ALL SELECT 'dangling_ref', 'violation' FROM g_edges e WHERE e.to_id NOT IN (SELECT id FROM g_nodes)
  UNION ALL SELECT 'orphan', 'warning' FROM g_nodes n WHERE id NOT IN (SELECT from_id FROM g_edges) AND id NOT IN (SELECT to_id FROM g_edges)
  UNION ALL SELECT 'drift', 'warning' FROM (SELECT 1 FROM g_edges GROUP BY from_id, to_id HAVING bool_and(origin = 'inline'))
  UNION ALL SELECT 'frontmatter_wikilink', 'warning' FROM ({trapped})
  UNION ALL SELECT 'unknown_type', 'warning' FROM ({unknown}))
SELECT kind, severity, count(*) AS n FROM found GROUP BY kind, severity"""


@query(_FIELDS.rstrip() + _REPORT.replace("{trapped}", _TRAPPED).replace("{unknown}", ORACLES["check_unknown_type"].rpartition(_FIELDS)[2]))
def check_report(spark: SparkSession, sf: str) -> DataFrame:
    files = read_table(spark, sf, "node_files").select("id", "path").distinct()
    found = check.check(views.nodes(spark, sf), files, views.edges(spark, sf), FEW)
    return found.groupBy("kind", "severity").agg(F.count("*").alias("n"))


# --- ids, paths and references --------------------------------------------------------------------------------------------


@query(
    """SELECT id, CASE WHEN regexp_matches(id, '^.+/[^/]*$') THEN regexp_extract(id, '^(.+)/[^/]*$', 1) END AS scope, regexp_extract(id, '^(?:.+/)?([^:/]+):.+$', 1) AS type,
  regexp_extract(id, '^(?:.+/)?[^:/]+:(.+)$', 1) AS slug, regexp_extract(id, '^(?:.+/)?([^/]*)$', 1) AS local FROM g_nodes"""
)
def parse_id(spark: SparkSession, sf: str) -> DataFrame:
    p = ids.parse_id("id")
    return views.nodes(spark, sf).select("id", p["scope"].alias("scope"), p["type"].alias("type"), p["slug"].alias("slug"), ids.local_id("id").alias("local"))


@query(
    """, raw AS (SELECT loose_id, type_guess, trim(descriptor) AS d FROM g_loose WHERE descriptor IS NOT NULL)
SELECT loose_id, 'unresolved' AS kind, nullif(trim(coalesce(type_guess, '')), '') AS type_guess, regexp_replace(d, '^\\s+|\\s+$', '', 'g') AS descriptor FROM raw WHERE regexp_replace(d, '^\\s+|\\s+$', '', 'g') <> ''"""
)
def parse_reference(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.loose(spark, sf).where("descriptor IS NOT NULL")
    inner = F.concat(F.lit(" ?"), F.coalesce("type_guess", F.lit("")), F.lit(" : "), "descriptor")
    r = ids.parse_reference(inner)
    return rows.select("loose_id", r["kind"].alias("kind"), r["type_guess"].alias("type_guess"), r["descriptor"].alias("descriptor")).where("kind IS NOT NULL")


@query("SELECT DISTINCT path FROM documents WHERE path LIKE '%.md' AND path NOT LIKE 'archive/%' AND path NOT LIKE '%/archive/%' AND path NOT LIKE '%README%'", graph_views=False)
def glob_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filter_paths(read_table(spark, sf, "documents").select("path"), Config(include=("**/*.md",), exclude=("**/archive/**", "**README*"))).distinct()


@query(
    """, pairs AS (SELECT DISTINCT e.source_file AS a, n.path AS b FROM g_edges e JOIN g_nodes n ON n.id = e.to_id WHERE e.source_file IS NOT NULL),
parts AS (SELECT a, b, string_split(a, '/') AS x, string_split(b, '/') AS y FROM pairs),
n AS (SELECT *, least(len(x), len(y)) - 1 AS most FROM parts),
c AS (SELECT *, coalesce(list_min(list_filter(range(most), lambda i: x[i + 1] <> y[i + 1])), most) AS common FROM n)
SELECT a AS source, b AS target, CASE WHEN len(x) - 1 = common THEN './' ELSE repeat('../', len(x) - 1 - common) END || array_to_string(y[common + 1:], '/') AS href FROM c"""
)
def relative_path(spark: SparkSession, sf: str) -> DataFrame:
    n = views.nodes(spark, sf).select(F.col("id").alias("to_id"), F.col("path").alias("target"))
    pairs = views.edges(spark, sf).where("source_file IS NOT NULL").join(n, "to_id").select(F.col("source_file").alias("source"), "target").distinct()
    return pairs.select("source", "target", ids.relative_path("source", "target").alias("href"))


# --- parsing Markdown -----------------------------------------------------------------------------------------------------

_LINES = r""", texts AS (SELECT doc_id, string_split(CASE WHEN text LIKE '%' || chr(10) THEN text[:-2] ELSE text END, chr(10)) AS ls FROM documents WHERE text <> ''),
ls AS (SELECT doc_id, i AS n, regexp_replace(ls[i], '\r$', '') AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM texts)),
fenced AS (SELECT *, starts_with(ltrim(line, {blank}), '```') OR starts_with(ltrim(line, {blank}), '~~~') AS is_fence FROM ls),
open AS (SELECT *, sum(is_fence::INT) OVER (PARTITION BY doc_id ORDER BY n) % 2 AS inside FROM fenced)
""".replace("{blank}", views.BLANK)


def _scan(spark: SparkSession, sf: str, function: Callable, schema: str) -> DataFrame:
    @F.pandas_udf(f"array<struct<{schema}>>")
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: function(parse.lines_of(t), 1))

    rows = read_table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.explode(scan("text")).alias("r"))
    return rows.select("doc_id", "r.*")


@query(_LINES + r"SELECT doc_id, n AS line, unnest(regexp_extract_all(line, '\[\[(.*?)\]\]', 1)) AS inner FROM open WHERE NOT is_fence AND inside = 0".replace("AS inner", 'AS "inner"'))
def parse_wikilinks(spark: SparkSession, sf: str) -> DataFrame:
    return _scan(spark, sf, parse.scan_links, "inner:string,line:bigint")


@query(
    _LINES
    + f""", grouped AS (SELECT doc_id, n, line, starts_with(line, '## ') AS is_head, sum(starts_with(line, '## ')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM ls)
SELECT doc_id, min(n) AS line, coalesce(max(CASE WHEN is_head THEN trim(line[4:], {views.BLANK}) END), '') AS heading,
  trim(coalesce(string_agg(CASE WHEN NOT is_head THEN line END, chr(10) ORDER BY n), ''), {views.BLANK}) AS body FROM grouped GROUP BY doc_id, g"""
)
def parse_sections(spark: SparkSession, sf: str) -> DataFrame:
    return _scan(spark, sf, parse.scan_sections, "heading:string,line:bigint,body:string")


@query(
    _LINES
    + f""", titles AS (SELECT doc_id, trim(ltrim(line, {views.BLANK})[3:], {views.BLANK}) AS title FROM open WHERE NOT is_fence AND inside = 0 AND starts_with(ltrim(line, {views.BLANK}), '# '))
SELECT doc_id, min(title) AS title FROM titles WHERE title <> '' GROUP BY doc_id HAVING count(*) = 1"""
)
def sole_title(spark: SparkSession, sf: str) -> DataFrame:
    return _scan(spark, sf, lambda lines, first: [{"title": t}] if (t := parse.sole_title(lines)) else [], "title:string")


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select(F.coalesce("path", F.concat(F.lit("doc/"), "doc_id")).alias("path"), F.col("text").alias("content"))
    return parse.parse_documents(docs.where("content IS NOT NULL"), CONFIG)


_NODES = _LINES + rf""", marks AS (SELECT doc_id, bool_or(n = 1 AND trim(line, {views.BLANK}) = '---') AS opened, min(CASE WHEN n > 1 AND trim(line, {views.BLANK}) = '---' THEN n END) AS closed FROM ls GROUP BY doc_id HAVING opened AND closed IS NOT NULL),
heads AS (SELECT doc_id, n, regexp_matches(line, '^[A-Za-z_]+: +\S') AS ok, regexp_extract(line, '^([A-Za-z_]+): +', 1) AS k, regexp_extract(line, '^[A-Za-z_]+: +(.*?)[ \t]*$', 1) AS v FROM ls JOIN marks USING (doc_id) WHERE n > 1 AND n < closed),
items AS (SELECT doc_id, n, k, v, CASE WHEN starts_with(v, '[') THEN list_transform(string_split(v[2:-2], ','), lambda x: trim(x)) END AS vs FROM heads),
titles AS (SELECT doc_id, trim(ltrim(line, {views.BLANK})[3:], {views.BLANK}) AS title FROM open JOIN marks USING (doc_id) WHERE n > closed AND NOT is_fence AND inside = 0 AND starts_with(ltrim(line, {views.BLANK}), '# ')),
sole AS (SELECT doc_id, min(title) AS title FROM titles WHERE title <> '' GROUP BY doc_id HAVING count(*) = 1),
addressed AS (SELECT doc_id, max(v) FILTER (k = 'type') AS type, max(v) FILTER (k = 'id') AS slug, max(v) FILTER (k = 'project') AS project FROM items GROUP BY doc_id HAVING type <> '' AND slug <> '' AND doc_id NOT IN (SELECT doc_id FROM heads WHERE NOT ok)),
parsed AS (SELECT a.doc_id, d.path, CASE WHEN type = 'record' THEN a.project END AS scope, type, CASE WHEN type = 'record' AND a.project IS NOT NULL THEN a.project || '/' ELSE '' END || type || ':' || slug AS id,
  coalesce(title, regexp_extract(d.path, '([^/]*?)(?:\.[^./]*)?$', 1)) AS name FROM addressed a JOIN documents d USING (doc_id) LEFT JOIN sole USING (doc_id)),
fm AS (SELECT doc_id, '{{' || string_agg(to_json(k) || ': ' || CASE WHEN vs IS NULL THEN to_json(v) ELSE '[' || array_to_string(list_transform(vs, lambda x: to_json(x)), ', ') || ']' END, ', ' ORDER BY k) || '}}' AS frontmatter
  FROM (SELECT doc_id, k, v, vs FROM items UNION ALL SELECT doc_id, 'name', name, NULL FROM parsed) GROUP BY doc_id)
"""
_REFERENCES = rf""", stated AS (SELECT doc_id, 0 AS later, k AS ref_type, 'frontmatter' AS origin, n AS line, i, coalesce(vs, [v])[i] AS inner_text FROM (SELECT *, unnest(range(1, len(coalesce(vs, [v])) + 1)) AS i FROM items WHERE k NOT IN ('id', 'type', 'superseded_by', 'name', 'aliases'))
  UNION ALL SELECT doc_id, 1, 'inline', 'inline', n, i, xs[i] FROM (SELECT doc_id, n, xs, unnest(range(1, len(xs) + 1)) AS i FROM (SELECT doc_id, n, regexp_extract_all(line, '\[\[(.*?)\]\]', 1) AS xs FROM open JOIN marks USING (doc_id) WHERE n > closed AND NOT is_fence AND inside = 0))),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY later, CASE WHEN later = 0 THEN ref_type END, line, i) - 1 AS seq, trim(inner_text, {views.BLANK}) AS t FROM stated),
kinds AS (SELECT *, starts_with(t, '?') AS loose, trim(regexp_extract(t, '(?s)^\?([^:]*):(.*)$', 1), {views.BLANK}) AS guess, trim(regexp_extract(t, '(?s)^\?([^:]*):(.*)$', 2), {views.BLANK}) AS descriptor,
  trim(split_part(t, '|', 1), {views.BLANK}) AS target, CASE WHEN contains(t, '|') THEN trim(regexp_extract(t, '(?s)^[^|]*\|(.*)$', 1), {views.BLANK}) END AS display FROM placed),
refs AS (SELECT k.*, regexp_extract(target, '(?s)^(?:(.+)/)?(/?[^/:]+):([^/]+)$', 1) AS to_scope, regexp_extract(target, '(?s)^(?:(.+)/)?(/?[^/:]+):([^/]+)$', 2) AS to_type, regexp_extract(target, '(?s)^(?:(.+)/)?(/?[^/:]+):([^/]+)$', 3) AS to_slug, p.id, p.path, p.scope
  FROM kinds k JOIN parsed p USING (doc_id)),
links AS (SELECT *, CASE WHEN to_type = 'record' AND to_scope = '' AND scope IS NOT NULL THEN scope || '/' || target ELSE target END AS to_id FROM refs WHERE NOT loose AND to_slug <> '')
"""


@query(_NODES + "SELECT id, type, path, frontmatter, name, []::VARCHAR[] AS aliases, NULL::VARCHAR AS superseded_by FROM parsed JOIN fm USING (doc_id)")
def parse_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return derive(_parsed(spark, sf), CONFIG)["node_versions"]


@query(_NODES + _REFERENCES + f"SELECT id AS from_id, to_id, ref_type, origin, path AS source_file, line::INT AS line, seq::INT AS seq FROM links WHERE origin = 'inline' OR to_type IN {VOCABULARY}")
def parse_edges(spark: SparkSession, sf: str) -> DataFrame:
    return derive(_parsed(spark, sf), CONFIG)["edges"]


@query(_NODES + _REFERENCES + "SELECT id AS record_id, nullif(guess, '') AS type_guess, descriptor, path AS source_file, line::INT AS line, seq::INT AS seq FROM refs WHERE loose AND descriptor <> ''")
def parse_unresolved(spark: SparkSession, sf: str) -> DataFrame:
    return derive(_parsed(spark, sf), CONFIG)["unresolved"]


_HREF = """parts AS (SELECT a, b, string_split(a, '/') AS x, string_split(b, '/') AS y FROM pairs),
n AS (SELECT *, least(len(x), len(y)) - 1 AS most FROM parts),
c AS (SELECT *, coalesce(list_min(list_filter(range(most), lambda i: x[i + 1] <> y[i + 1])), most) AS common FROM n),
hrefs AS (SELECT a, b, CASE WHEN len(x) - 1 = common THEN './' ELSE repeat('../', len(x) - 1 - common) END || array_to_string(y[common + 1:], '/') AS href FROM c)"""


@query(
    _NODES
    + _REFERENCES
    + r""", first AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY id ORDER BY path, frontmatter, name) AS rn FROM parsed p JOIN fm USING (doc_id)) WHERE rn = 1),
pairs AS (SELECT DISTINCT l.path AS a, f.path AS b FROM links l JOIN first f ON f.id = l.to_id WHERE later = 1), """
    + _HREF
    + r""", texts AS (SELECT doc_id, line AS n, i, descriptor AS put FROM refs WHERE later = 1 AND loose AND descriptor <> ''
  UNION ALL SELECT l.doc_id, l.line, i, '[' || coalesce(display, f.name) || '](' || href || ')' FROM links l JOIN first f ON f.id = l.to_id JOIN hrefs ON a = l.path AND b = f.path WHERE later = 1),
cells AS (SELECT o.doc_id, n, unnest(range(1, len(ps) + 1)) AS i, ps, xs FROM (SELECT doc_id, n, regexp_split_to_array(line, '\[\[.*?\]\]') AS ps, regexp_extract_all(line, '\[\[(.*?)\]\]', 1) AS xs
  FROM open JOIN marks USING (doc_id) WHERE n > closed AND NOT is_fence AND inside = 0 AND regexp_matches(line, '\[\[.*?\]\]')) o),
changed AS (SELECT c.doc_id, c.n, string_agg(ps[c.i] || CASE WHEN c.i <= len(xs) THEN coalesce(put, '[[' || xs[c.i] || ']]') ELSE '' END, '' ORDER BY c.i) AS line FROM cells c LEFT JOIN texts t ON t.doc_id = c.doc_id AND t.n = c.n AND t.i = c.i GROUP BY 1, 2)
SELECT f.id, f.path, string_agg(coalesce(c.line, l.line), chr(10) ORDER BY l.n) || chr(10) AS markdown FROM first f JOIN ls l USING (doc_id) LEFT JOIN changed c ON c.doc_id = l.doc_id AND c.n = l.n GROUP BY f.id, f.path""".replace(", texts AS", ", put_texts AS").replace("JOIN texts t", "JOIN put_texts t")
)
def render_documents(spark: SparkSession, sf: str) -> DataFrame:
    parsed = _parsed(spark, sf)
    docs = read_table(spark, sf, "documents").where("text IS NOT NULL AND path IS NOT NULL").groupBy("path").agg(F.min("text").alias("content"))
    nodes = parse.first_nodes(parsed.select(*parse.NODE))
    return render.render(nodes, docs, nodes.select("id"), CONFIG)


# --- retrieval ------------------------------------------------------------------------------------------------------------

_WORD = r"'[^\p{L}\p{N}\x{0901}-\x{0903}\x{093E}-\x{094C}\x{0E31}\x{0E34}-\x{0E3A}\x{0345}]+'"
_TF = "((length(lower(body)) - length(replace(lower(body), 'copper', ''))) // 6 + (length(lower(body)) - length(replace(lower(body), 'ledger', ''))) // 6)"
_SNIPPET = r"""CASE WHEN hit IS NULL THEN array_to_string(w[1:12], ' ') ELSE array_to_string(w[greatest(hit - 4, 1):hit + 7], ' ') END"""
_PASSES = rf""", toks AS (SELECT node_id, line, heading, body, {_TF} AS tf, list_filter(regexp_split_to_array(body, '[\s\x{{0085}}\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+'), lambda x: x <> '') AS w,
  list_has_any(list_transform(regexp_split_to_array(lower(strip_accents(heading || ' ' || body)), {_WORD}), lambda x: x), ['copper', 'ledger']) AS cand FROM g_sections),
snip AS (SELECT node_id, line, heading, tf, cand, w, list_position(list_transform(w, lambda x: contains(lower(x), 'copper') OR contains(lower(x), 'ledger')), true) AS h0 FROM toks),
sn AS (SELECT node_id, line, heading, tf, cand, {_SNIPPET} AS snippet FROM (SELECT *, nullif(h0, 0) AS hit FROM snip)),
fts AS (SELECT node_id AS id, tf::DOUBLE AS score, heading, line, snippet FROM sn WHERE cand AND tf > 0),
named AS (SELECT id FROM g_nodes WHERE len(list_filter(list_concat([name], coalesce(aliases, [])), lambda x: contains(lower(x), 'copper') AND contains(lower(x), 'ledger'))) > 0),
scores AS (SELECT id, sum(score) AS score FROM (SELECT id, score FROM fts UNION ALL SELECT id, 5.0::DOUBLE FROM named) GROUP BY id)
"""


@query(_PASSES + "SELECT id, score, heading, line, snippet FROM fts")
def fts_search(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.fts_pass(views.sections(spark, sf), TOKENS).drop("priority")


@query(_PASSES + "SELECT id FROM named")
def alias_search(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.alias_pass(views.nodes(spark, sf), views.sections(spark, sf), TOKENS).select("id")


_TOP = "SELECT row_number() OVER (ORDER BY s.score DESC, s.id) AS rank, {id} AS id, n.type, n.path, round(s.score, 4) AS score FROM scores s JOIN g_nodes n USING (id) {where} ORDER BY s.score DESC, s.id LIMIT 10"


def _search(spark: SparkSession, sf: str, **options) -> DataFrame:
    found = retrieval.search(views.nodes(spark, sf), views.sections(spark, sf), WORDS, edges=views.edges(spark, sf), **options)
    return found.select("rank", "id", "type", "path", F.round("score", 4).alias("score"))


@query(_PASSES + _TOP.format(id="s.id", where=""))
def search(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf)


@query(_PASSES + _TOP.format(id="s.id", where="WHERE n.type = 'record'"))
def search_type(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, type="record")


@query(_PASSES + _TOP.format(id="regexp_extract(s.id, '^(?:.+/)?([^/]*)$', 1)", where=f"WHERE s.id IN (SELECT from_id FROM g_edges WHERE ref_type = 'scope' AND to_id = '{SCOPE}')"))
def search_scope(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, scope=SCOPE)


_VECTOR = "q AS (SELECT min_by(vector, datum_id) AS v FROM g_vectors)"
_HYBRID = f""", {_VECTOR}, near AS (SELECT node_id, section_line AS line, list_cosine_similarity(vector::DOUBLE[], (SELECT v FROM q)::DOUBLE[]) AS s FROM g_vectors WHERE len(list_filter(vector, lambda x: x <> 0)) > 0),
first AS (SELECT node_id, min(struct_pack(line := line, heading := heading, body := body)) AS f FROM g_sections GROUP BY node_id),
hits AS (SELECT id, score, 1 AS priority, line, heading, snippet FROM fts
  UNION ALL SELECT named.id, 5.0, 2, sn.line, sn.heading, sn.snippet FROM named LEFT JOIN first ON first.node_id = named.id LEFT JOIN sn ON sn.node_id = named.id AND sn.line = f.line
  UNION ALL SELECT sn.node_id, s, 3, sn.line, sn.heading, sn.snippet FROM near JOIN sn ON sn.node_id = near.node_id AND sn.line = near.line WHERE s >= 0.9),
top AS (SELECT row_number() OVER (ORDER BY sum(score) DESC, h.id) AS rank, h.id, n.type, n.path, sum(score) AS score, min(priority) AS least FROM hits h JOIN g_nodes n ON n.id = h.id GROUP BY h.id, n.type, n.path ORDER BY sum(score) DESC, h.id LIMIT 10),
kept AS (SELECT h.* FROM hits h JOIN top USING (id) WHERE h.line IS NOT NULL AND (priority <> 2 OR least <> 1)),
shown AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line, priority, heading, snippet) AS pos FROM kept k WHERE NOT EXISTS (SELECT 1 FROM kept o WHERE o.id = k.id AND o.line = k.line AND o.priority < k.priority))
SELECT top.rank, top.id, top.type, top.path, round(top.score, 4) AS score, pos - 1 AS pos, shown.heading, shown.line, shown.snippet FROM top LEFT JOIN shown ON shown.id = top.id AND pos <= 3"""


@query(_PASSES + _HYBRID)
def search_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked hybrid search with a row an anchor."""
    rows = hybrid(spark, sf).select("rank", "id", "type", "path", F.round("score", 4).alias("score"), F.posexplode_outer("anchors").alias("pos", "a"))
    return rows.select("rank", "id", "type", "path", "score", "pos", "a.heading", "a.line", "a.snippet")


@query(_PASSES + _HYBRID.replace("SELECT top.rank", "SELECT DISTINCT top.rank").replace(", pos - 1 AS pos, shown.heading, shown.line, shown.snippet FROM top", ", (SELECT count(*) FROM shown s WHERE s.id = top.id AND s.pos <= 3) AS anchors FROM top"))
def search_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked hybrid search with the number of anchors."""
    return hybrid(spark, sf).select("rank", "id", "type", "path", F.round("score", 4).alias("score"), F.size("anchors").cast("long").alias("anchors"))


def hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """All three passes with anchors; the query's vector is that of the lowest usable section."""
    vectors = views.embeddings(spark, sf)
    asked = vectors.agg(F.min_by("vector", "datum_id")).first()[0]
    return retrieval.search(views.nodes(spark, sf), views.sections(spark, sf), WORDS, vectors, asked, threshold=0.9)


_SUGGEST = r""", toks AS (SELECT DISTINCT node_id AS id FROM g_sections WHERE list_has_any(regexp_split_to_array(lower(strip_accents(heading || ' ' || body)), {word}), ['audit', 'kiln'])),
names AS (SELECT id, type, name, path, list_transform(list_filter(list_concat([name], coalesce(aliases, [])), lambda x: x IS NOT NULL), lambda x: lower(x)) AS c FROM g_nodes),
scored AS (SELECT id, type, coalesce(name, '') AS name, path, coalesce(list_max(list_transform(c, lambda x: CASE WHEN x = 'audit kiln' THEN 3.0 WHEN contains(x, 'audit') AND contains(x, 'kiln') THEN 2.0 ELSE 0.0 END)), 0.0)
  + CASE WHEN id IN (SELECT id FROM toks) THEN 0.5 ELSE 0.0 END AS score FROM names)
SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, id, type, name, path, score::DOUBLE AS score FROM scored WHERE score > 0 {where} ORDER BY score DESC, id LIMIT 5""".replace("{word}", _WORD)


@query(_SUGGEST.replace("{where}", ""))
def suggest(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.suggest(views.nodes(spark, sf), views.sections(spark, sf), "Audit  kiln".replace("  ", " "))


@query(_SUGGEST.replace("{where}", "AND type = 'record'"))
def suggest_type(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.suggest(views.nodes(spark, sf), views.sections(spark, sf), "audit kiln", type="record")


@query(rf"SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), {_WORD}), lambda x: x <> '')).list_sort() AS tokens FROM documents WHERE text IS NOT NULL", graph_views=False)
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.sort_array(text.tokens("text")).alias("tokens"))


@query("SELECT doc_id, ((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 + (length(lower(text)) - length(replace(lower(text), 'each', ''))) // 4)::BIGINT AS tf FROM documents WHERE text IS NOT NULL", graph_views=False)
def term_frequency(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", text.term_frequency("text", ["the", "each"]).cast("bigint").alias("tf"))


_FOLDED = "lower(regexp_replace(translate(heading || ' ' || body, '{}', '{}'), '\\p{{M}}+', '', 'g'))".format(*text.fold_table())


@query(f", t AS (SELECT node_id, line, list_distinct(list_filter(regexp_split_to_array({_FOLDED}, {_WORD}), lambda x: x <> '')) AS ts FROM g_sections) SELECT unnest(ts) AS token, node_id, line FROM t")
def section_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The inverted index over all sections."""
    return retrieval.section_tokens(views.sections(spark, sf))


@query(f", {_VECTOR} SELECT datum_id, node_id, round(list_cosine_similarity(vector::DOUBLE[], (SELECT v FROM q)::DOUBLE[]), 6) AS similarity FROM g_vectors WHERE len(list_filter(vector, lambda x: x <> 0)) > 0 AND list_cosine_similarity(vector::DOUBLE[], (SELECT v FROM q)::DOUBLE[]) >= 0.4")
def vector_search(spark: SparkSession, sf: str) -> DataFrame:
    vectors = views.embeddings(spark, sf)
    near = text.with_cosine(vectors.select("datum_id", "node_id", "vector"), "vector", vectors.agg(F.min_by("vector", "datum_id")).first()[0])
    return near.where("similarity >= 0.4").withColumn("similarity", F.round("similarity", 6))


# --- index maintenance ----------------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL", graph_views=False)
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", content_hash("text").alias("content_hash"))


@query("SELECT DISTINCT sha256(body) AS content_hash FROM g_sections WHERE sha256(body) NOT IN (SELECT content_hash FROM g_vectors WHERE content_hash IS NOT NULL)")
def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    """The sections that the table of usable vectors has none for, embedded."""
    return embed_missing(views.sections(spark, sf), views.embeddings(spark, sf), LocalEmbedder(16)).select("content_hash")


@query("SELECT source_file, line, descriptor FROM unresolved WHERE source_file IS NOT NULL AND source_file NOT IN (SELECT path FROM node_files WHERE path LIKE '%records/%') UNION ALL SELECT source_file, line, 'again' FROM unresolved WHERE source_file LIKE '%records/%' AND source_file IN (SELECT path FROM node_files)", graph_views=False)
def incremental_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Loose ends after all record files changed: their old rows go, fresh ones come."""
    old = read_table(spark, sf, "unresolved").where("source_file IS NOT NULL").select("source_file", "line", "descriptor")
    changed = read_table(spark, sf, "node_files").where("path LIKE '%records/%'").select("path").distinct()
    fresh = old.join(changed, old["source_file"] == changed["path"], "left_semi").withColumn("descriptor", F.lit("again"))
    return merge(old, fresh, changed, "source_file")


@query()
def embed_local(spark: SparkSession, sf: str) -> DataFrame:
    """Feature-hash vectors of all distinct sections."""
    return embed_missing(views.sections(spark, sf), None, LocalEmbedder(64))


@query("SELECT id, type, path, frontmatter, name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY path NULLS FIRST, frontmatter NULLS FIRST, name NULLS FIRST) AS rn FROM nodes WHERE id IS NOT NULL) WHERE rn = 1", graph_views=False)
def first_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return parse.first_nodes(read_table(spark, sf, "nodes").where("id IS NOT NULL")).select("id", "type", "path", "frontmatter", "name")


# --- references to records that do not exist ------------------------------------------------------------------------------

#: The corpus' foreign keys into nodes.id: referring table, its id, its reference.
REFERENCES = (("edges", "edge_id", "to_id"), ("unresolved", "loose_id", "record_id"), ("sections", "section_id", "node_id"), ("embedding_datum", "datum_id", "node_id"))


def corpus_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """All orphans of the corpus. A node hangs on the node that supersedes it and on its containers: the scope in its id and
    the targets of its ``scope`` and ``project`` fields."""
    nodes = read_table(spark, sf, "nodes")
    refs = [orphans.references(read_table(spark, sf, t), t, key, ref) for t, key, ref in REFERENCES]
    child, scope = F.col("id").alias("child"), F.regexp_extract("id", "^(.+)/[^/]*$", 1).alias("parent")
    over = F.trim("superseded_by", F.lit(orphans.WHITE)).alias("parent")
    live = nodes.where("deleted_at IS NULL")
    within = read_table(spark, sf, "edges").where("origin = 'frontmatter' AND ref_type IN ('scope', 'project')")
    held = within.select(F.trim("from_id", F.lit(orphans.WHITE)).alias("child"), F.trim("to_id", F.lit(orphans.WHITE)).alias("parent"))
    return orphans.find_orphans(refs, nodes, live.select(child, over).unionByName(live.select(child, scope)).unionByName(held))


_BLANK = views.BLANK
_REFS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, {key} AS row_id, trim({ref}, {_BLANK}) AS ref, indexed_at AS seen_at FROM {t}" for t, key, ref in REFERENCES)
_P5 = f"""WITH RECURSIVE refs AS (SELECT DISTINCT * FROM ({_REFS}) WHERE ref <> ''),
states AS (SELECT id AS ref, bool_or(deleted_at IS NULL) AS alive, min(indexed_at) AS first_at FROM nodes GROUP BY id),
links AS (SELECT DISTINCT l.* FROM (SELECT id AS child, trim(superseded_by, {_BLANK}) AS parent FROM nodes WHERE deleted_at IS NULL
  UNION ALL SELECT id, regexp_extract(id, '^(.+)/[^/]*$', 1) FROM nodes WHERE deleted_at IS NULL
  UNION ALL SELECT trim(from_id, {_BLANK}), trim(to_id, {_BLANK}) FROM edges WHERE origin = 'frontmatter' AND ref_type IN ('scope', 'project')) l
  JOIN states c ON c.ref = child AND c.alive WHERE parent <> '' AND child <> parent),
below(ref, depth) USING KEY (ref) AS (SELECT child, 1 FROM links WHERE NOT EXISTS (SELECT 1 FROM states s WHERE s.ref = parent AND s.alive)
  UNION SELECT child, min(depth) + 1 FROM below JOIN links ON parent = ref WHERE NOT EXISTS (SELECT 1 FROM recurring.below b WHERE b.ref = child) GROUP BY child),
depths AS (SELECT ref, min(depth) AS depth FROM below GROUP BY ref),
judged AS (SELECT table_name, row_id, strftime(seen_at, '%Y-%m') AS period, CASE WHEN alive IS NULL THEN 'missing' WHEN NOT alive THEN 'deleted' WHEN first_at > seen_at THEN 'late' END AS kind,
  depths.depth AS depth FROM refs LEFT JOIN states USING (ref) LEFT JOIN depths USING (ref)),
found AS (SELECT DISTINCT table_name, row_id, period, coalesce(kind, 'inherited') AS kind, CASE WHEN kind IS NULL THEN 'inherited' ELSE 'direct' END AS origin,
  CASE WHEN kind IS NULL THEN depth ELSE 0 END AS depth FROM judged WHERE kind IS NOT NULL OR depth IS NOT NULL)
"""


@query(_P5 + "SELECT table_name, row_id, period, kind FROM found WHERE origin = 'direct'", graph_views=False)
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_orphans(spark, sf).where("origin = 'direct'").select("table_name", "row_id", "period", "kind")


@query(_P5 + "SELECT * FROM found", graph_views=False)
def p5_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_orphans(spark, sf)


@query(_P5 + "SELECT table_name, period, kind, origin, count(*) AS n FROM found GROUP BY ALL", graph_views=False)
def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_report(corpus_orphans(spark, sf))


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked hybrid search with anchors."""
    return hybrid(spark, sf)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
