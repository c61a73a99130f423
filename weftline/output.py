"""Human-readable text of command results: stable and deterministic, coloured only on request."""

from __future__ import annotations

import json
import os
import sys

_STYLE = {"bold": "1", "dim": "2", "red": "31", "green": "32", "yellow": "33", "cyan": "36"}


def use_color(no_color: bool = False) -> bool:
    return not no_color and not os.environ.get("NO_COLOR") and sys.stdout.isatty()


class Painter:
    """Text with or without ANSI styles."""

    def __init__(self, color: bool = False) -> None:
        self.color = color

    def __call__(self, text: str, style: str) -> str:
        return f"\x1b[{_STYLE[style]}m{text}\x1b[0m" if self.color else text


def inline(value) -> str:
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return ", ".join(inline(v) for v in value)
    return json.dumps(value, ensure_ascii=False)


def plural(n: int, one: str, many: str | None = None) -> str:
    return f"{n} {one if n == 1 else many or one + 's'}"


def aligned(pairs: list[tuple[str, str]], paint: Painter) -> list[str]:
    width = max((len(k) + 1 for k, _ in pairs), default=0)
    return [f"  {paint((k + ':').ljust(width), 'dim')} {v}" for k, v in pairs]


#: What is said where a command found nothing.
EMPTY = {
    "backlinks": "backlinks to {id}", "refs": "refs from {id} within {depth}", "search": "match for \"{query}\"",
    "suggest": "suggestion for \"{descriptor}\"", "unresolved": "loose ends",
}


def human(command: str, value: dict, paint: Painter | None = None) -> str:
    """The text a person reads for the result of ``command``."""
    p = paint or Painter()
    where = lambda r: p(f"{r['path']}:{r['line']}" if r.get("line") is not None else str(r.get("path", "")), "dim")
    out: list[str] = []
    if command in EMPTY and not value["count"]:
        return p("no " + EMPTY[command].format(**value), "dim") + "\n"
    if command == "render":
        return value["markdown"]
    if command == "resolve":
        out.append(p(value["id"], "bold"))
        pairs = [("type", value["type"]), ("path", value["path"])]
        if value.get("requested_id"):
            pairs.append(("requested", value["requested_id"]))
        if value["superseded_by"]:
            pairs.append(("superseded by", value["superseded_by"]))
        out += aligned(pairs + [(k, inline(v)) for k, v in value["frontmatter"].items()], p)
    elif command == "backlinks":
        out.append(f"{plural(value['count'], 'backlink')} to {p(value['id'], 'bold')}")
        out += [f"  {p(r['id'], 'cyan')}  {r['ref_type']}  {where(r)}" for r in value["backlinks"]]
    elif command == "refs":
        out.append(f"{plural(value['count'], 'ref')} from {p(value['id'], 'bold')} (depth {value['depth']})")
        out += [f"  {r['distance']}  {p(r['id'], 'cyan')}  {r['ref_type']}  {where(r)}" for r in value["refs"]]
    elif command == "search":
        out.append(f"{plural(value['count'], 'result')} for \"{value['query']}\"")
        for r in value["results"]:
            out.append(f"  {p(r['id'], 'cyan')}  {r['score']:.2f}  {p(r['path'], 'dim')}")
            out += [f"      {a['line']}: {a['heading'] or '(preamble)'} - {a['snippet']}" for a in r["anchors"]]
    elif command == "suggest":
        out.append(f"{plural(value['count'], 'suggestion')} for \"{value['descriptor']}\"")
        out += [f"  {p(r['id'], 'cyan')}  {r['name']}  {r['score']:.1f}  {p(r['path'], 'dim')}" for r in value["suggestions"]]
    elif command == "unresolved":
        out.append(plural(value["count"], "unresolved reference"))
        out += [f"  {p('?' + (r['type_guess'] or ''), 'yellow')}: {r['descriptor']}  {p(r['record'], 'cyan')}  {where(r)}" for r in value["unresolved"]]
    elif command == "index":
        out.append(f"indexed {plural(value['nodes'], 'node')}, {plural(value['edges'], 'edge')}, {plural(value['sections_embedded'], 'section')} in {value['elapsed_ms']} ms")
        out.append(f"  at {value['commit'] or 'the working tree'}")
    elif command == "check":
        out.append(p("ok", "green") if value["ok"] else p(plural(len(value["violations"]), "violation"), "red"))
        for name, style in (("violations", "red"), ("warnings", "yellow")):
            for r in value[name]:
                detail = " ".join(f"{k}={inline(v)}" for k, v in r.items() if k not in ("kind", "path", "line"))
                out.append(f"  {p(r['kind'], style)}  {detail}  {where(r)}".rstrip())
    elif command == "status":
        built = value["schema_version"] is not None
        out.append(p(value["repo"], "bold"))
        n = value["nodes"]
        pairs = [("index", value["index_path"] if built else "not built yet"), ("source", value["source"] or "-"), ("commit", value["last_indexed_commit"] or "-"), ("behind head", str(value["commits_behind_head"]))]
        pairs += [("nodes", f"{n['total']} ({', '.join(f'{k} {v}' for k, v in n['by_type'].items())})" if n["by_type"] else str(n["total"])), ("edges", str(value["edges"])), ("sections", str(value["embeddings"]["sections"]))]
        out += aligned(pairs, p)
    elif command == "init":
        out.append(f"marked {value['root']} as a corpus: {value['config_path']}")
    else:
        return json.dumps(value, ensure_ascii=False, indent=2)
    return "\n".join(out) + "\n"
