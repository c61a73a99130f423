"""Command line: ``python -m weftline.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import sys

from weftline import api, server
from weftline.errors import CheckViolations, UsageError, WeftlineError
from weftline.output import Painter, human, use_color


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise UsageError(message)


def parser() -> argparse.ArgumentParser:
    top = _Parser(prog="weftline", description="Reference graphs over text corpora on Spark.")
    top.add_argument("--repo", help="corpus root")
    top.add_argument("--config", help="configuration file")
    for flag in ("--json", "--quiet", "--verbose", "--no-color"):
        top.add_argument(flag, action="store_true")
    sub = top.add_subparsers(dest="command", required=True, parser_class=_Parser)

    def add(name: str, *arguments: tuple) -> None:
        command = sub.add_parser(name)
        for names, options in arguments:
            command.add_argument(*names, **options)

    id_, type_ = (("id",), {}), (("--type",), {"dest": "type"})
    scope, limit = (("--scope",), {}), lambda n: (("--limit",), {"type": int, "default": n})
    add("resolve", id_)
    add("render", id_)
    add("backlinks", id_, type_, limit(None))
    add("refs", id_, type_, (("--depth",), {"type": int, "default": 1}))
    add("search", (("query",), {}), type_, scope, limit(10))
    add("suggest", (("descriptor",), {}), type_, limit(5))
    add("unresolved", type_, scope)
    flags = lambda *names: [((f"--{n}",), {"action": "store_true"}) for n in names]
    add("index", *flags("full", "working-tree", "re-embed"))
    add("check", *flags("strict", "working-tree"))
    add("status")
    add("init", (("path",), {"nargs": "?", "default": "."}))
    add("mcp")
    return top


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("weftline").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def main(argv: list[str] | None = None, spark=None) -> int:
    """Run a command; the exit code says how it went."""
    argv = sys.argv[1:] if argv is None else argv
    as_json = "--json" in argv
    try:
        args = vars(parser().parse_args(argv))
        command = args.pop("command")
        repo, config, no_color = args.pop("repo"), args.pop("config"), args.pop("no_color")
        for name in ("json", "quiet", "verbose"):
            args.pop(name)
        failure = None
        if command == "init":
            value = api.init(args["path"])
        else:
            corpus = api.Corpus(spark or session(), repo, config)
            if command == "mcp":
                server.serve(corpus)
                return 0
            value = getattr(corpus, command)(**args)
            if command == "check":
                value, failed = value
                failure = CheckViolations(len(value["violations"])) if failed else None
        sys.stdout.write(json.dumps(value, ensure_ascii=False) + "\n" if as_json else human(command, value, Painter(use_color(no_color))))
        return failure.code if failure else 0
    except WeftlineError as e:
        if as_json:
            sys.stdout.write(json.dumps(e.to_json(), ensure_ascii=False) + "\n")
        else:
            sys.stderr.write(f"error: {e}\n")
        return e.code


if __name__ == "__main__":
    sys.exit(main())
