"""Ranked retrieval: full text, names and aliases, vectors; and suggestions for a descriptor.

The three passes are projections of pruned scans that meet in one aggregate by node; only nodes with a score reach it.
The filters on type and scope are per node, so they run before ranking without changing it; top-k is a bounded heap. Anchors
and their snippets are made in a second look at the sections of the winners alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.functions.ids import local_id
from weftline.plans.runtime import cut

# The weights of the three passes and of suggestions, and the anchors a hit shows.
ALIAS_WEIGHT, FTS_WEIGHT, VECTOR_WEIGHT, VECTOR_THRESHOLD, MAX_ANCHORS = 5.0, 1.0, 1.0, 0.9, 3
SUGGEST_EXACT, SUGGEST_TOKENS, SUGGEST_FTS = 3.0, 2.0, 0.5
#: Winners up to which their ids are broadcast.
FEW = 10_000
ANCHOR = "struct<heading:string,line:int,snippet:string>"


def section_tokens(sections: DataFrame) -> DataFrame:
    """The inverted index: ``token node_id line`` for every distinct folded token of a section's heading and body."""
    rows = sections.select("node_id", "line", text.index_tokens("heading", "body").alias("t"))
    return rows.select(F.explode("t").alias("token"), "node_id", "line")


def matching(sections: DataFrame, query: list[str], index: DataFrame | None = None) -> DataFrame:
    """Sections that have any query token as a whole token of heading or body, through the inverted index where there is one."""
    asked = [text.fold_token(t) for t in query]
    if index is None:
        return sections.where(F.arrays_overlap(text.index_tokens("heading", "body"), F.array(*(F.lit(t) for t in asked))))
    places = index.where(F.col("token").isin(*asked)).select("node_id", "line").distinct()
    return sections.join(places, ["node_id", "line"], "left_semi")


def candidates(name: Column | str = "name", aliases: Column | str = "aliases") -> Column:
    """A node's name and aliases in lower case."""
    every = F.concat(F.array(F.col(name)), F.coalesce(F.col(aliases), F.array().cast("array<string>")))
    return F.transform(F.filter(every, lambda x: x.isNotNull()), lambda x: F.lower(x))


def fts_pass(sections: DataFrame, query: list[str], index: DataFrame | None = None) -> DataFrame:
    """Full-text hits a section: substring occurrences of all query tokens in the body of matching sections."""
    # the count of substrings is far cheaper than the tokens of a section, so it comes first
    rows = matching(sections.withColumn("tf", text.term_frequency("body", query)).where("tf > 0"), query, index)
    return rows.select(F.col("node_id").alias("id"), (F.col("tf") * FTS_WEIGHT).cast("double").alias("score"), F.lit(1).alias("priority"), "heading", "line", text.snippet("body", query).alias("snippet"))


def alias_pass(nodes: DataFrame, sections: DataFrame, query: list[str]) -> DataFrame:
    """Nodes of which one name or alias holds every token, anchored at their first section."""
    hits = nodes.where(F.exists(candidates(), lambda c: text.contains_all(c, query))).select("id")
    first = sections.join(hits, F.col("node_id") == F.col("id"), "left_semi").groupBy("node_id").agg(F.min(F.struct("line", "heading", "body")).alias("s"))
    rows = hits.join(first, F.col("id") == F.col("node_id"), "left")
    return rows.select("id", F.lit(ALIAS_WEIGHT).alias("score"), F.lit(2).alias("priority"), "s.heading", "s.line", text.snippet("s.body", query).alias("snippet"))


def vector_pass(embeddings: DataFrame, sections: DataFrame, vector: list[float], query: list[str], threshold: float = VECTOR_THRESHOLD) -> DataFrame:
    """Sections whose vector is at least ``threshold`` similar to the query's."""
    near = text.with_cosine(embeddings.select("node_id", F.col("section_line").alias("line"), "vector"), "vector", vector).where(F.col("similarity") >= threshold)
    rows = near.join(sections, ["node_id", "line"])
    return rows.select(F.col("node_id").alias("id"), (F.col("similarity") * VECTOR_WEIGHT).alias("score"), F.lit(3).alias("priority"), "heading", "line", text.snippet("body", query).alias("snippet"))


def search(
    nodes: DataFrame,
    sections: DataFrame,
    query: str,
    embeddings: DataFrame | None = None,
    vector: list[float] | None = None,
    edges: DataFrame | None = None,
    index: DataFrame | None = None,
    type: str | None = None,
    scope: str | None = None,
    scope_field: str = "scope",
    limit: int | None = 10,
    threshold: float = VECTOR_THRESHOLD,
) -> DataFrame:
    """Nodes for a query: ``rank id type path score anchors``, best first, ties by id; ids are local under a scope.

    A query without tokens finds nothing. An alias hit's anchor shows only where full text gave the node none.
    """
    asked = text.query_tokens(query)
    nodes = nodes if type is None else nodes.where(F.col("type") == type)
    if scope is not None:
        from weftline.operators.graph import scope_members

        nodes = nodes.join(scope_members(edges, scope, scope_field), "id", "left_semi")
    if not asked:
        asked, nodes = ["\0"], nodes.where("false")

    def passes(nodes: DataFrame, sections: DataFrame, vectors: DataFrame | None) -> DataFrame:
        hits = fts_pass(sections, asked, index).unionByName(alias_pass(nodes, sections, asked))
        return hits if vectors is None or not vector else hits.unionByName(vector_pass(vectors, sections, vector, asked, threshold))

    best = passes(nodes, sections, embeddings).groupBy("id").agg(F.sum("score").alias("score")).where("score > 0").join(nodes.select("id", "type", "path"), "id")
    if limit is not None:
        best = cut(best.orderBy(F.desc("score"), "id").limit(limit))
        few = best.select("id") if limit > FEW else F.broadcast(best.select("id"))
        of = lambda df: df.join(few.select(F.col("id").alias("node_id")), "node_id", "left_semi")
        nodes, sections, embeddings = nodes.join(few, "id", "left_semi"), of(sections), None if embeddings is None else of(embeddings)
    hits = passes(nodes, sections, embeddings)
    anchor = F.when(F.col("line").isNotNull(), F.struct("line", "priority", "heading", "snippet"))
    per_node = hits.groupBy("id").agg(F.sort_array(F.collect_list(anchor)).alias("a"), F.min("priority").alias("least"))
    kept = F.filter("a", lambda x: (x["priority"] != 2) | (F.col("least") != 1))
    first = F.filter(kept, lambda x: ~F.exists(kept, lambda y: (y["line"] == x["line"]) & (y["priority"] < x["priority"])))
    anchors = F.transform(F.slice(first, 1, MAX_ANCHORS), lambda x: F.struct(x["heading"].alias("heading"), x["line"].alias("line"), x["snippet"].alias("snippet")))
    rows = best.join(per_node, "id").select("id", "type", "path", "score", anchors.alias("anchors"))
    return _ranked(rows, limit, local=scope is not None)


def _ranked(rows: DataFrame, limit: int | None, local: bool = False) -> DataFrame:
    rows = rows.orderBy(F.desc("score"), "id")
    rows = rows if limit is None else rows.limit(limit)
    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))) if limit is not None else rows
    return ranked.withColumn("id", local_id("id")) if local else ranked


def suggest(nodes: DataFrame, sections: DataFrame, descriptor: str, type: str | None = None, limit: int = 5, index: DataFrame | None = None) -> DataFrame:
    """Nodes a descriptor may mean: ``rank id type name path score``. Names first, a match in prose as a bonus; no vectors."""
    needle, asked = descriptor.strip().lower(), text.query_tokens(descriptor)
    nodes = nodes if type is None else nodes.where(F.col("type") == type)
    nodes = nodes.where("false") if not needle else nodes
    by_tokens = (lambda c: text.contains_all(c, asked)) if asked else (lambda c: F.lit(False))
    best = F.array_max(F.transform(candidates(), lambda c: F.when(c == needle, SUGGEST_EXACT).when(by_tokens(c), SUGGEST_TOKENS).otherwise(0.0)))
    scored = nodes.select("id", "type", "name", "path", F.coalesce(best, F.lit(0.0)).alias("by_name"))
    if asked:
        prose = matching(sections, asked, index).select(F.col("node_id").alias("id")).distinct().withColumn("bonus", F.lit(SUGGEST_FTS))
        scored = scored.join(prose, "id", "left")
    else:
        scored = scored.withColumn("bonus", F.lit(0.0))
    score = F.col("by_name") + F.coalesce("bonus", F.lit(0.0))
    rows = scored.select("id", "type", F.coalesce("name", F.lit("")).alias("name"), "path", score.alias("score")).where("score > 0")
    return _ranked(rows, limit)
