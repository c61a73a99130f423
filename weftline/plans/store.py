"""The index on disk: one folder a snapshot with a parquet table each, and a pointer to the current one.

A build writes a new snapshot and then moves the pointer, so readers see the old index or the new one, never a mixture.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from weftline.config import MARKER
from weftline.errors import IndexCorrupt, IndexNotBuilt

SCHEMA_VERSION = 1
#: Tables of a snapshot, each with the columns its files are sorted by (min/max statistics then skip row groups).
TABLES = {
    "documents": ("path",),
    "node_versions": ("id", "path"),
    "nodes": ("id",),
    "node_files": ("id",),
    "edges": ("to_id",),
    "edges_out": ("from_id",),
    "unresolved": ("source_file",),
    "sections": ("node_id",),
    "section_tokens": ("token",),
    "embeddings": ("node_id",),
    "embed_cache": ("content_hash",),
}


def index_dir(root: str | Path) -> Path:
    return Path(root) / MARKER / "index"


@dataclass
class Store:
    """A snapshot opened for reading."""

    spark: SparkSession
    folder: Path
    meta: dict = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(str(self.folder / name))

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


def exists(root: str | Path) -> bool:
    return (index_dir(root) / "CURRENT").exists()


def open_store(spark: SparkSession, root: str | Path, any_version: bool = False) -> Store:
    """The current snapshot; errors where there is none, it is broken, or another version wrote it."""
    base = index_dir(root)
    if not exists(root):
        raise IndexNotBuilt(str(base))
    try:
        folder = base / (base / "CURRENT").read_text(encoding="utf-8").strip()
        meta = json.loads((folder / "meta.json").read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise IndexCorrupt(str(e)) from e
    if not any_version and meta.get("schema_version") != SCHEMA_VERSION:
        raise IndexCorrupt(f"schema version {meta.get('schema_version')}, expected {SCHEMA_VERSION}")
    if not any_version and any(not (folder / t).exists() for t in TABLES):
        raise IndexCorrupt("a table is missing")
    return Store(spark, folder, meta)


class Writer:
    """A snapshot in the making. Its folder is dropped unless it is committed."""

    def __init__(self, root: str | Path) -> None:
        self.base = index_dir(root)
        self.folder = self.base / f"snapshot-{uuid.uuid4().hex}"
        self.folder.mkdir(parents=True)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Write a table in sorted ranges, one a file, and give it back as read from there."""
        path = str(self.folder / name)
        # by ranges of the sort columns: a point read opens the one file whose range holds its key
        df.repartitionByRange(*TABLES[name]).sortWithinPartitions(*TABLES[name]).write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def write_all(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Write independent tables side by side."""
        with ThreadPoolExecutor(4) as pool:
            return dict(zip(tables, pool.map(lambda t: self.write(*t), tables.items()), strict=True))

    def commit(self, meta: dict) -> None:
        old = (self.base / "CURRENT").read_text(encoding="utf-8").strip() if (self.base / "CURRENT").exists() else None
        (self.folder / "meta.json").write_text(json.dumps(meta), encoding="utf-8")
        pointer = self.base / f"CURRENT.{uuid.uuid4().hex}"
        pointer.write_text(self.folder.name, encoding="utf-8")
        os.replace(pointer, self.base / "CURRENT")
        if old and old != self.folder.name:
            self.retire(old)

    def retire(self, last: str) -> None:
        """Drop snapshots but the current, the one before and what is still being written, so that open readers can end."""
        for folder in self.base.glob("snapshot-*"):
            if folder.name not in (self.folder.name, last) and (folder / "meta.json").exists():
                shutil.rmtree(folder, ignore_errors=True)

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            shutil.rmtree(self.folder, ignore_errors=True)


def write_meta(store: Store) -> None:
    """Upsert the snapshot's key-value table."""
    temporary = store.folder / f"meta.{uuid.uuid4().hex}"
    temporary.write_text(json.dumps(store.meta), encoding="utf-8")
    os.replace(temporary, store.folder / "meta.json")
