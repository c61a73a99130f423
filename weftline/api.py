"""The commands over a corpus: each gives the JSON value that every surface shows."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftline import config as conf
from weftline.errors import IdNotFound, UsageError
from weftline.functions.embedding import Embedder, embedder_of
from weftline.operators import check as checks
from weftline.operators import graph, parse
from weftline.operators import render as rendering
from weftline.operators import search as retrieval
from weftline.plans import build as building
from weftline.plans import store as index
from weftline.sources import files as source

# Keys and defaults of a configuration file, as ``Config`` has them.
DEFAULT_CONFIG = """# The corpus' configuration; everything else beside it is derived.
include = ["knowledge/**/*.md", "projects/**/*.md"]
exclude = ["**/node_modules/**", "**/drafts/**", "**/archive/**"]
id_prefixes = ["person", "department", "method", "system", "event", "record", "project"]
vocabulary_strict = false

[embeddings]
provider = "local"
dimensions = 384
"""


def init(path: str | Path = ".") -> dict:
    """Mark ``path`` as a corpus; refuses where one is."""
    root = Path(path)
    target = root / conf.MARKER / "config.toml"
    if target.exists():
        raise UsageError(f"already a corpus: {target} exists")
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(DEFAULT_CONFIG, encoding="utf-8")
    (target.parent / ".gitignore").write_text("*\n!.gitignore\n!config.toml\n", encoding="utf-8")
    return {"root": str(root), "config_path": str(target)}


def parse_id(id: str) -> tuple[str | None, str, str]:
    """``(scope, type, slug)`` of an id; a usage error for a malformed one."""
    prefix, slash, last = id.rpartition("/")
    scope, local = (prefix, last) if slash and prefix else (None, id)
    node_type, colon, slug = local.partition(":")
    problem = "id is missing a ':' type prefix" if not colon else "id has an empty type prefix" if not node_type else "id has an empty slug" if not slug else ""
    if problem:
        raise UsageError(f"bad id '{id}': {problem}")
    return scope, node_type, slug


class Corpus:
    """A corpus and its index. Reads open the current snapshot each time, so they see the latest build."""

    def __init__(self, spark: SparkSession, root: str | Path | None = None, config_path: str | None = None, embedder: Embedder | None = None) -> None:
        self.spark = spark
        self.root = conf.discover(str(root) if root else None)
        self.config = conf.Config.load(config_path or self.root / conf.MARKER / "config.toml")
        self._embedder = embedder

    @property
    def embedder(self) -> Embedder:
        if self._embedder is None:
            self._embedder = embedder_of(self.config, self.root)
        return self._embedder

    def store(self) -> index.Store:
        return index.open_store(self.spark, self.root)

    def resolve(self, id: str) -> dict:
        parse_id(id)
        nodes = self.store().nodes
        found = graph.resolve(nodes, id).collect()
        if not found:
            missing = graph.resolve_all(nodes, self.spark.createDataFrame([(id,)], "id string")).collect()
            raise IdNotFound(missing[0]["missing"] if missing else id)
        r = found[0]
        fm = {k: v for k, v in json.loads(r["frontmatter"]).items() if k not in parse.ADDRESS}
        out = {"id": r["id"], "type": r["type"], "path": r["path"], "frontmatter": fm}
        return out | ({"requested_id": r["requested_id"]} if r["requested_id"] else {}) | {"superseded_by": r["superseded_by"]}

    def render(self, id: str) -> dict:
        parse_id(id)
        store, path = self.store(), self.resolve(id)["path"]
        asked, file = self.spark.createDataFrame([(id,)], "id string"), self.root / path
        # the file as it is now; the indexed text where there is none any more
        text = self.spark.createDataFrame([(path, file.read_bytes().decode("utf-8", "replace"))], source.DOCUMENT) if file.is_file() else store.documents
        return rendering.render(store.nodes, text, asked, self.config).first().asDict()

    def backlinks(self, id: str, type: str | None = None, limit: int | None = None) -> dict:
        parse_id(id)
        store = self.store()
        rows = [r.asDict() for r in graph.backlinks(store.nodes, store.edges, id, type, limit).collect()]
        return {"id": id, "backlinks": rows, "count": len(rows)}

    def refs(self, id: str, depth: int = 1, type: str | None = None) -> dict:
        parse_id(id)
        store = self.store()
        rows = [r.asDict() for r in graph.refs(store.nodes, store.edges_out, id, depth, type).collect()]
        return {"id": id, "depth": depth, "refs": rows, "count": len(rows)}

    def search(self, query: str, type: str | None = None, scope: str | None = None, limit: int = 10, threshold: float = retrieval.VECTOR_THRESHOLD) -> dict:
        if scope is not None:
            parse_id(scope)
        store = self.store()
        vector = self.embedder.embed([query])[0] if query.strip() else None
        hits = retrieval.search(store.nodes, store.sections, query, store.embeddings, vector, store.edges, store.section_tokens, type, scope, self.config.scope_field, limit, threshold)
        rows = [r.asDict(recursive=True) for r in hits.orderBy("rank").drop("rank").collect()]
        return {"query": query, "results": rows, "count": len(rows)}

    def suggest(self, descriptor: str, type: str | None = None, limit: int = 5) -> dict:
        store = self.store()
        hits = retrieval.suggest(store.nodes, store.sections, descriptor, type, limit, store.section_tokens)
        rows = [r.asDict() for r in hits.orderBy("rank").drop("rank").collect()]
        return {"descriptor": descriptor, "suggestions": rows, "count": len(rows)}

    def unresolved(self, type: str | None = None, scope: str | None = None) -> dict:
        if scope is not None:
            parse_id(scope)
        store = self.store()
        rows = [r.asDict() for r in graph.unresolved(store.unresolved, store.edges, type, scope, self.config.scope_field).collect()]
        return {"unresolved": rows, "count": len(rows)}

    def index(self, full: bool = False, working_tree: bool = False, re_embed: bool = False) -> dict:
        return dict(vars(building.build_index(self.spark, self.root, self.config, self.embedder, full, working_tree, re_embed)))

    def check(self, strict: bool = False, working_tree: bool = False) -> tuple[dict, bool]:
        """``(report, failed)``; with ``working_tree`` the files on disk are indexed first."""
        if working_tree:
            self.index(working_tree=True)
        store = self.store()
        report: dict = {"ok": True, "violations": [], "warnings": []}
        found = checks.ordered(checks.check(store.nodes, store.node_files, store.edges, self.config.id_prefixes))
        for r in found.toLocalIterator():
            shown = {k: v for k, v in r.asDict().items() if v is not None and k != "severity"}
            if r["kind"] == "dangling_ref":
                shown["from"] = shown.pop("id")
            report["violations" if r["severity"] == "violation" else "warnings"].append(shown)
        report["ok"] = not report["violations"]
        return report, bool(report["violations"] or (strict and report["warnings"]))

    def status(self) -> dict:
        """What is indexed; nulls and zeros where nothing is."""
        out = {"repo": str(self.root), "index_path": f"{conf.MARKER}/index", "schema_version": None, "source": None, "last_indexed_commit": None, "commits_behind_head": 0}
        if not index.exists(self.root):
            return out | {"nodes": {"total": 0, "by_type": {}}, "edges": 0, "embeddings": {"sections": 0, "cached": 0}}
        store = index.open_store(self.spark, self.root, any_version=True)
        counts = graph.status_counts(store.nodes, store.edges, store.embeddings).first()
        commit = store.meta.get("last_indexed_commit")
        out |= {"schema_version": store.meta.get("schema_version"), "source": store.meta.get("index_source"), "last_indexed_commit": commit}
        out["commits_behind_head"] = source.commits_ahead(self.root, commit) if commit else 0
        by_type = {r["type"]: r["n"] for r in graph.count_by_type(store.nodes).collect()}
        return out | {"nodes": {"total": counts["nodes"], "by_type": by_type}, "edges": counts["edges"], "embeddings": {"sections": counts["sections"], "cached": store.embed_cache.agg(F.count("*")).first()[0]}}
