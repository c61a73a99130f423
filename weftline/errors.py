"""Errors with the exit codes and kinds that commands report."""

from __future__ import annotations


class WeftlineError(Exception):
    """Anything a command reports; ``code`` is its exit code, ``kind`` its stable machine-readable name."""

    code, kind = 1, "generic"

    def to_json(self) -> dict:
        return {"error": {"code": self.code, "kind": self.kind, "message": str(self)}}


class ConfigError(WeftlineError):
    def __str__(self) -> str:
        return f"config error: {self.args[0]}"


class UsageError(WeftlineError):
    code, kind = 2, "usage"

    def __str__(self) -> str:
        return f"usage error: {self.args[0]}"


class IndexCorrupt(WeftlineError):
    code, kind = 3, "index_corrupt"

    def __str__(self) -> str:
        return f"index is corrupt and cannot be opened ({self.args[0]}); rebuild it in full"


class NoRepo(WeftlineError):
    code, kind = 4, "no_repo"

    def __str__(self) -> str:
        return "no corpus found: no marker directory here or in any parent"


class IndexNotBuilt(WeftlineError):
    code, kind = 4, "index_not_built"

    def __str__(self) -> str:
        return f"index not built yet at {self.args[0]}"


class IdNotFound(WeftlineError):
    code, kind = 5, "id_not_found"

    def __str__(self) -> str:
        return f"no node with id '{self.args[0]}'"


class CheckViolations(WeftlineError):
    code, kind = 6, "check_violations"

    def __str__(self) -> str:
        return f"check found {self.args[0]} violation(s)"
