"""Building the index: in full, from what changed, from the working tree, or vectors only."""

from __future__ import annotations

import time
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.config import Config
from weftline.functions.embedding import Embedder, content_hash, embed_missing, embed_texts, embedder_of
from weftline.operators import parse
from weftline.operators.search import section_tokens
from weftline.plans import store as index
from weftline.sources import files as source

COMMITTED, WORKING = "committed", "working-tree"


@dataclass(frozen=True)
class IndexSummary:
    nodes: int
    edges: int
    sections_embedded: int
    elapsed_ms: int
    commit: str | None


def derive(parsed: DataFrame, config: Config) -> dict[str, DataFrame]:
    """The tables that come from parsed nodes file by file; each keeps the file it came from."""
    refs = parse.references(parsed)
    return {
        "node_versions": parsed.select(*parse.NODE),
        "edges": parse.edges(refs, config),
        "unresolved": parse.unresolved(refs),
        "sections": parse.sections(parsed),
    }


FILE_OF = {"node_versions": "path", "edges": "source_file", "unresolved": "source_file", "sections": "source_file", "documents": "path"}


def merge(old: DataFrame, fresh: DataFrame, changed: DataFrame, file: str) -> DataFrame:
    """``old`` without the rows of changed files, and the fresh rows: equal to a full rebuild, whatever the edits."""
    return old.join(changed.select(F.col("path").alias(file)), file, "left_anti").select(*old.columns).unionByName(fresh)


def write_snapshot(writer: index.Writer, tables: dict[str, DataFrame], cache: DataFrame | None, embedder: Embedder) -> None:
    """Write the per-file tables and what follows from them: first versions, files by id, tokens, vectors."""
    kept = writer.write_all(tables)
    versions, sections = kept["node_versions"], kept["sections"]
    writer.write_all({"nodes": parse.first_nodes(versions), "node_files": versions.select("id", "path"), "edges_out": kept["edges"], "section_tokens": section_tokens(sections)})
    fresh = embed_missing(sections, cache, embedder)
    vectors = writer.write("embed_cache", fresh if cache is None else cache.unionByName(fresh))
    keyed = sections.select("node_id", F.col("line").alias("section_line"), content_hash().alias("content_hash"))
    writer.write("embeddings", keyed.join(vectors, "content_hash").select("node_id", "section_line", "content_hash", "vector"))


def _summary(store: index.Store, began: float, embedded: int | None = None) -> IndexSummary:
    n = store.embeddings.count() if embedded is None else embedded
    return IndexSummary(store.nodes.count(), store.edges.count(), n, int((time.monotonic() - began) * 1000), store.meta.get("last_indexed_commit"))


def build_index(
    spark: SparkSession,
    root: str | Path,
    config: Config | None = None,
    embedder: Embedder | None = None,
    full: bool = False,
    working_tree: bool = False,
    re_embed: bool = False,
) -> IndexSummary:
    """Bring the index of the corpus at ``root`` up to date.

    ``re_embed`` renews vectors only; ``working_tree`` reads the files on disk; ``full`` rebuilds from the last commit.
    Otherwise the files that changed since the indexed commit are read again - if the index holds a commit of this schema
    version, else everything. Without git, or before the first commit, the files on disk are read.
    """
    from weftline.config import MARKER

    began, root = time.monotonic(), Path(root)
    config = config or Config.load(root / MARKER / "config.toml")
    embedder = embedder or embedder_of(config, root)
    if re_embed:
        return reembed(spark, root, embedder)
    commit = source.head(root) if source.is_git_root(root) else None
    from_commit = commit is not None and not working_tree
    prior = None
    if from_commit and not full and index.exists(root):
        prior = index.open_store(spark, root, any_version=True)
        m = prior.meta
        if m.get("schema_version") != index.SCHEMA_VERSION or not m.get("last_indexed_commit") or m.get("index_source") != COMMITTED:
            prior = None
    if prior is not None:
        since = prior.meta["last_indexed_commit"]
        to_index, to_delete = source.changed_files(root, since, config)
        documents = source.committed(spark, root, to_index)
        changed = spark.createDataFrame([(p,) for p in [*to_index, *to_delete]], "path string")
    else:
        documents = source.committed(spark, root, source.files_at_head(root, config)) if from_commit else source.working_tree(spark, root, config)
    # parsed once; every table is an explode of these rows
    parsed = parse.parse_documents(documents, config).persist()
    try:
        tables = derive(parsed, config) | {"documents": documents}
        if prior is not None:
            tables = {name: merge(prior.table(name), df, changed, FILE_OF[name]) for name, df in tables.items()}
        meta = {"schema_version": index.SCHEMA_VERSION, "index_source": WORKING if working_tree else COMMITTED, "last_indexed_commit": None if working_tree else commit}
        with index.Writer(root) as writer:
            write_snapshot(writer, tables, prior.embed_cache if prior is not None else None, embedder)
            writer.commit(meta)
    finally:
        parsed.unpersist()
    return _summary(index.open_store(spark, root), began)


def reembed(spark: SparkSession, root: str | Path, embedder: Embedder) -> IndexSummary:
    """Renew every vector and the cache; nodes, edges and the recorded commit stay."""
    began = time.monotonic()
    old = index.open_store(spark, root)
    with index.Writer(root) as writer:
        writer.write_all({name: old.table(name) for name in index.TABLES if name not in ("embeddings", "embed_cache")})
        keyed = old.sections.select("node_id", F.col("line").alias("section_line"), content_hash().alias("content_hash"))
        vectors = writer.write("embed_cache", embed_texts(old.sections.select(content_hash().alias("content_hash"), "body"), embedder))
        writer.write("embeddings", keyed.join(vectors, "content_hash").select("node_id", "section_line", "content_hash", "vector"))
        writer.commit(old.meta)
    return _summary(index.open_store(spark, root), began)
