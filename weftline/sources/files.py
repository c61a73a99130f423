"""Where a corpus is read from: the working tree, or the tree and history of a git repository.

Files are listed once on the driver - names only, hidden ones too, which Spark's own file index would leave out - and read
on the executors: working files by their paths, committed ones from one archive stream a partition.
"""

from __future__ import annotations

import io
import os
import re
import subprocess
import tarfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.config import MARKER, Config
from weftline.errors import ConfigError, WeftlineError

DOCUMENT = "path string, content string"


def glob_regex(glob: str) -> str:
    """A glob as a regular expression: ``*`` and ``?`` may cross ``/``, ``**/`` stands for any folders or none."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.+", i + 3
        elif c == "*":
            while glob.startswith("*", i):
                i += 1
            out += ".*"
        elif c == "?":
            out, i = out + ".", i + 1
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ConfigError(f"bad glob {glob!r}: unclosed character class")
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif c == "{":
            end = glob.find("}", i)
            if end < 0:
                raise ConfigError(f"bad glob {glob!r}: unclosed alternates")
            out, i = out + "(?:" + "|".join(glob_regex(g) for g in glob[i + 1 : end].split(",")) + ")", end + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def scope_patterns(config: Config) -> tuple[str, str]:
    """Regular expressions of what a corpus includes and excludes."""
    union = lambda globs: "^(?:" + "|".join(glob_regex(g) for g in globs) + ")$" if globs else r"[^\s\S]"
    return union(config.include), union(config.exclude)


def in_scope(config: Config, path: str) -> bool:
    include, exclude = scope_patterns(config)
    return bool(re.match(include, path, re.S)) and not re.match(exclude, path, re.S)


def filter_paths(files: DataFrame, config: Config) -> DataFrame:
    """Files whose ``path`` matches some include glob and no exclude glob."""
    include, exclude = scope_patterns(config)
    return files.where(F.col("path").rlike("(?s)" + include) & ~F.col("path").rlike("(?s)" + exclude))


def relative_to(root: str | Path):
    """The root-relative POSIX path of the file a row was read from, as a column."""
    base = re.escape(str(Path(root).resolve()).rstrip("/") + "/")
    return F.regexp_replace(F.regexp_replace(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), "^file:/*", "/"), "^" + base, "")


def files_on_disk(root: str | Path, config: Config) -> list[str]:
    """Root-relative paths of the corpus files on disk; derived and version-control folders are never entered."""
    base, found = str(Path(root).resolve()), []
    for folder, below, names in os.walk(base):
        below[:] = [d for d in below if d not in (".git", MARKER)]
        inside = os.path.relpath(folder, base).replace(os.sep, "/")
        found += [n if inside == "." else f"{inside}/{n}" for n in names]
    include, exclude = (re.compile(p, re.S) for p in scope_patterns(config))
    return sorted(p for p in found if include.match(p) and not exclude.match(p))


def working_tree(spark: SparkSession, root: str | Path, config: Config, per_task: int = 500) -> DataFrame:
    """``(path, content)`` of the corpus files on disk, decoded leniently; the folder must be visible to all executors."""
    paths, base = files_on_disk(root, config), str(Path(root).resolve())
    if not paths:
        return spark.createDataFrame([], DOCUMENT)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf["path"]:
                yield pd.DataFrame({"path": [p], "content": [Path(base, p).read_bytes().decode("utf-8", "replace")]})

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths) // per_task + 1))
    return listed.mapInPandas(run, DOCUMENT)


def _git(root: str | Path, *args: str, check: bool = True) -> str | None:
    ran = subprocess.run(["git", "-C", str(root), "-c", "core.quotepath=off", *args], capture_output=True)
    if ran.returncode:
        if check:
            raise WeftlineError(f"git {args[0]} failed: {ran.stderr.decode(errors='replace').strip()}")
        return None
    return ran.stdout.decode("utf-8", "replace")


def is_git_root(root: str | Path) -> bool:
    return (Path(root) / ".git").exists()


def head(root: str | Path) -> str | None:
    """The commit of HEAD; None before the first commit."""
    out = _git(root, "rev-parse", "--verify", "-q", "HEAD", check=False)
    return out.strip() if out else None


def commits_ahead(root: str | Path, commit: str) -> int:
    """Commits between ``commit`` and HEAD; 0 where git cannot tell."""
    out = _git(root, "rev-list", "--count", f"{commit}..HEAD", check=False)
    return int(out.strip()) if out and out.strip().isdigit() else 0


def files_at_head(root: str | Path, config: Config) -> list[str]:
    names = [n for n in _git(root, "ls-tree", "-r", "-z", "--name-only", "HEAD").split("\0") if n]
    return sorted(n for n in names if in_scope(config, n))


def changed_files(root: str | Path, since: str, config: Config) -> tuple[list[str], list[str]]:
    """``(to index, to delete)`` of the corpus files that differ between ``since`` and HEAD; renames name both paths."""
    names = [n for n in _git(root, "diff", "--name-only", "--no-renames", "-z", since, "HEAD").split("\0") if n]
    present = set(files_at_head(root, config))
    names = [n for n in names if in_scope(config, n)]
    return [n for n in names if n in present], [n for n in names if n not in present]


def show_at_head(root: str | Path, path: str) -> str | None:
    return _git(root, "show", f"HEAD:{path}", check=False)


def committed(spark: SparkSession, root: str | Path, paths: list[str], at: str = "HEAD", per_task: int = 500) -> DataFrame:
    """``(path, content)`` of files as committed; each task reads its paths from one archive stream, decoded leniently."""
    if not paths:
        return spark.createDataFrame([], DOCUMENT)
    folder = str(Path(root).resolve())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names = pdf["path"].tolist()
            for i in range(0, len(names), 200):
                ran = subprocess.run(["git", "-C", folder, "archive", "--format=tar", at, "--", *(f":(literal){n}" for n in names[i : i + 200])], capture_output=True, check=True)
                found = []
                with tarfile.open(fileobj=io.BytesIO(ran.stdout)) as tar:
                    for member in tar:
                        if member.isfile():
                            found.append((member.name, tar.extractfile(member).read().decode("utf-8", "replace")))
                yield pd.DataFrame(found, columns=["path", "content"])

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths) // per_task + 1))
    return listed.mapInPandas(run, DOCUMENT)

