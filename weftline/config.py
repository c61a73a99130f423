"""Corpus configuration and discovery of the corpus root."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from weftline.errors import ConfigError, NoRepo

MARKER = ".weftline"
ROOT_VARIABLE = "WEFTLINE_REPO"


@dataclass(frozen=True)
class EmbeddingConfig:
    """Which embedder turns sections into vectors: ``local``, ``command`` or ``openai``."""

    provider: str = "local"
    command: str = ""
    embedding_model: str = "text-embedding-3-small"
    dimensions: int = 384


@dataclass(frozen=True)
class Config:
    """What a corpus contains and how its references are read. All keys are optional; unknown keys are ignored."""

    include: tuple[str, ...] = ("knowledge/**/*.md", "projects/**/*.md")
    exclude: tuple[str, ...] = ("**/node_modules/**", "**/drafts/**", "**/archive/**")
    id_prefixes: tuple[str, ...] = ("person", "department", "method", "system", "event", "record", "project")
    vocabulary_strict: bool = False
    scoped_types: tuple[str, ...] = ()
    scope_field: str = "scope"
    embeddings: EmbeddingConfig = field(default_factory=EmbeddingConfig)

    @classmethod
    def load(cls, path: str | Path) -> Config:
        """The configuration in the TOML file ``path``; the defaults if there is none."""
        path = Path(path)
        if not path.exists():
            return cls()
        try:
            given = tomllib.loads(path.read_text(encoding="utf-8"))
            return cls.of(given)
        except (tomllib.TOMLDecodeError, UnicodeDecodeError, TypeError, ValueError) as e:
            raise ConfigError(f"{path}: {e}") from e

    @classmethod
    def of(cls, given: dict) -> Config:
        known = {}
        for f in fields(cls):
            if f.name not in given:
                continue
            value = given[f.name]
            if f.name == "embeddings":
                names = {e.name for e in fields(EmbeddingConfig)}
                value = EmbeddingConfig(**{k: v for k, v in value.items() if k in names})
                if value.provider not in ("local", "command", "openai"):
                    raise ValueError(f"unknown embedding provider {value.provider!r}")
            elif isinstance(f.default, tuple):
                if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
                    raise ValueError(f"{f.name} must be a list of strings")
                value = tuple(value)
            elif type(value) is not type(f.default):
                raise ValueError(f"{f.name} must be a {type(f.default).__name__}")
            known[f.name] = value
        return cls(**known)


def discover(explicit: str | None = None, start: str | None = None) -> Path:
    """The corpus root: the explicit path, else the environment's, else the nearest ancestor that has the marker."""
    for given in (explicit, os.environ.get(ROOT_VARIABLE)):
        if given:
            if not (Path(given) / MARKER).is_dir():
                raise NoRepo()
            return Path(given).resolve()
    here = Path(start or ".").resolve()
    for folder in (here, *here.parents):
        if (folder / MARKER).is_dir():
            return folder
    raise NoRepo()
