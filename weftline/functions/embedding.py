"""Embedders: batch of texts in, batch of equally many vectors out. One object a Python worker, one call an Arrow batch."""

from __future__ import annotations

import json
import os
import re
import subprocess
import urllib.request
from collections.abc import Iterator
from pathlib import Path
from typing import Protocol
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.config import MARKER, Config
from weftline.errors import ConfigError, WeftlineError


class Embedder(Protocol):
    """What a provider implements; objects must be picklable, as they travel to the workers."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def dimensions(self) -> int: ...


class LocalEmbedder:
    """Feature hashing: every token, repeats included, adds one to its bucket; length one, or zero for no tokens."""

    def __init__(self, dimensions: int = 384) -> None:
        self.size = max(1, dimensions)

    def dimensions(self) -> int:
        return self.size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            buckets = [crc32(w.lower().encode()) % self.size for w in re.findall(r"[^\W_]+", t)]
            v = np.bincount(buckets, minlength=self.size).astype(np.float64) if buckets else np.zeros(self.size)
            norm = np.linalg.norm(v)
            out.append((v / norm if norm else v).astype(np.float32).tolist())
        return out


class CommandEmbedder:
    """A shell command that reads a JSON array of texts and prints a JSON array of vectors."""

    def __init__(self, command: str, dimensions: int = 384) -> None:
        self.command, self.size = command, dimensions

    def dimensions(self) -> int:
        return self.size

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not self.command.strip():
            raise ConfigError("embeddings.command is empty")
        if not texts:
            return []
        try:
            ran = subprocess.run(["sh", "-c", self.command], input=json.dumps(texts), capture_output=True, text=True)
        except OSError as e:
            raise WeftlineError(f"embed command could not start: {e}") from e
        if ran.returncode:
            raise WeftlineError(f"embed command failed with status {ran.returncode}: {ran.stderr.strip()}")
        try:
            vectors = [[float(x) for x in v] for v in json.loads(ran.stdout)]
        except (ValueError, TypeError) as e:
            raise WeftlineError(f"embed command printed no JSON array of vectors: {e}") from e
        if len(vectors) != len(texts):
            raise WeftlineError(f"embed command gave {len(vectors)} vectors for {len(texts)} texts")
        return vectors


class OpenAiEmbedder:
    """An HTTP embeddings service; empty texts are not sent and get zero vectors."""

    def __init__(self, key: str, model: str, dimensions: int, base: str = "https://api.openai.com/v1") -> None:
        self.key, self.model, self.size, self.base = key, model, dimensions, base.rstrip("/")

    def dimensions(self) -> int:
        return self.size

    def request(self, texts: list[str]) -> dict:
        body = {"model": self.model, "input": texts}
        return body | {"dimensions": self.size} if self.model.startswith("text-embedding-3") else body

    def embed(self, texts: list[str]) -> list[list[float]]:
        sent = [t for t in texts if t.strip()]
        vectors: list[list[float]] = []
        if sent:
            headers = {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"}
            ask = urllib.request.Request(f"{self.base}/embeddings", json.dumps(self.request(sent)).encode(), headers)
            with urllib.request.urlopen(ask, timeout=120) as answer:
                vectors = parse_response(answer.read().decode(), len(sent))
        return fill_empty(texts, vectors, self.size)


def parse_response(text: str, expected: int) -> list[list[float]]:
    """The vectors of a service's answer in the order of its ``index`` fields."""
    data = sorted(json.loads(text)["data"], key=lambda d: d["index"])
    if len(data) != expected:
        raise WeftlineError(f"embeddings service gave {len(data)} vectors for {expected} texts")
    return [d["embedding"] for d in data]


def fill_empty(texts: list[str], vectors: list[list[float]], dimensions: int) -> list[list[float]]:
    """``vectors`` of the non-blank texts, with zero vectors put in for blank ones."""
    rest = iter(vectors)
    return [next(rest) if t.strip() else [0.0] * dimensions for t in texts]


def parse_env(text: str) -> dict[str, str]:
    """``KEY=VALUE`` lines of an environment file; comments, ``export`` and quotes are understood."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#") or "=" not in line:
            continue
        key, _, value = line.removeprefix("export ").partition("=")
        value = value.strip()
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        out[key.strip()] = value
    return out


def secret(name: str, root: str | Path) -> str | None:
    """A secret from the environment if set there and not empty, else from ``.env`` in the marker folder, which is ignored by git."""
    if os.environ.get(name):
        return os.environ[name]
    env = Path(root) / MARKER / ".env"
    return (parse_env(env.read_text(encoding="utf-8")).get(name) or None) if env.exists() else None


def embedder_of(config: Config, root: str | Path = ".") -> Embedder:
    """The embedder a configuration names."""
    e = config.embeddings
    if e.provider == "command":
        return CommandEmbedder(e.command, e.dimensions)
    if e.provider == "openai":
        key = secret("OPENAI_API_KEY", root)
        if not key:
            raise ConfigError("provider openai needs OPENAI_API_KEY")
        return OpenAiEmbedder(key, e.embedding_model, e.dimensions, secret("OPENAI_BASE_URL", root) or "https://api.openai.com/v1")
    return LocalEmbedder(e.dimensions)


def content_hash(c: str = "body"):
    return F.sha2(F.col(c), 256)


def embed_texts(texts: DataFrame, embedder: Embedder, batch: int = 128) -> DataFrame:
    """``(content_hash, vector)`` of the distinct ``(content_hash, body)`` rows, ``batch`` texts a call."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                vectors = embedder.embed(part["body"].tolist())
                if len(vectors) != len(part):
                    raise WeftlineError(f"embedder gave {len(vectors)} vectors for {len(part)} texts")
                yield pd.DataFrame({"content_hash": part["content_hash"].to_numpy(), "vector": vectors})

    return texts.select("content_hash", "body").dropDuplicates(["content_hash"]).mapInPandas(run, "content_hash string, vector array<float>")


def embed_missing(sections: DataFrame, cache: DataFrame | None, embedder: Embedder) -> DataFrame:
    """The cache entries ``sections`` lack: each distinct text that misses the cache is embedded once."""
    wanted = sections.select(content_hash().alias("content_hash"), "body")
    if cache is not None:
        wanted = wanted.join(cache.select("content_hash"), "content_hash", "left_anti")
    return embed_texts(wanted, embedder)
