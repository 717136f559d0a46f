"""Command line: ``python -m weft <command>``."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from weft import __version__
from weft.operators import graph
from weft.plans import build, protocol, report, tools, vault
from weft.sources.git import GitError


def session() -> SparkSession:
    spark = SparkSession.builder.appName("weft").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _root(a: argparse.Namespace) -> Path:
    root = Path(a.repo).resolve()
    if not root.is_dir():
        raise SystemExit(f"weft: {root} is not a directory")
    return root


def _name(root: Path, path: str) -> str:
    p = Path(path)
    inside = (p.is_absolute() or p.exists()) and p.resolve().is_relative_to(root)
    return (p.resolve().relative_to(root) if inside else p).as_posix()


def _graph(a: argparse.Namespace, rebuild: bool = False):
    return build.load_or_build(session(), _root(a), rebuild)


def _show(x) -> None:
    print(json.dumps(x, indent=2, ensure_ascii=False, default=str))


def cmd_build(a) -> None:
    g = _graph(a, rebuild=True)
    edges = {r["layer"]: r["count"] for r in g.edges.groupBy("layer").count().collect()}
    print(f"{g.files().count()} files, {g.meta['commits']} commits; edges: {', '.join(f'{n} {c}' for n, c in sorted(edges.items()))}")
    print(f"communities: {g.communities.select('community').distinct().count()}; graph kept in {build.cache_path(_root(a))}")


def cmd_related(a) -> None:
    g, seeds = _graph(a), [_name(_root(a), f) for f in a.files]
    known = {r[0] for r in g.nodes.where(g.nodes["id"].isin(seeds)).select("id").collect()}
    if missing := [s for s in seeds if s not in known]:
        raise SystemExit(f"weft: not files of the project: {', '.join(missing)}")
    rows = graph.related_files(g, seeds, a.limit, code_only=a.code_only).orderBy("rank").collect()
    if a.json:
        return _show([{"path": r["path"], "score": r["score"], "reasons": r["reasons"]} for r in rows])
    for r in rows:
        print(f"{r['score']:8.4f}  {r['path']}\n          {'; '.join(r['reasons'])}")


def cmd_explain(a) -> None:
    _show(graph.explain_file(_graph(a), _name(_root(a), a.file)))


def cmd_hidden(a) -> None:
    rows = graph.hidden_dependencies(_graph(a), a.min_commits, a.limit).orderBy("rank").collect()
    if not rows:
        print(f"no hidden dependencies (pairs that changed together in {a.min_commits} commits or more)")
    for r in rows:
        hops = "no import path" if r["structural_distance"] is None else f"{r['structural_distance']} hops"
        print(f"{r['commits']:4d} commits  confidence {r['confidence']:.2f}  {hops:15s} {r['category']:15s} {r['a']}  <->  {r['b']}")


def cmd_report(a) -> None:
    text = report.render(_graph(a))
    if a.out:
        Path(a.out).write_text(text, encoding="utf-8")
    print(f"report written to {a.out}" if a.out else text)


def cmd_vault(a) -> None:
    root = _root(a)
    print(f"vault written to {vault.export(_graph(a), Path(a.out) if a.out else root.parent / f'{root.name}-weft-vault', a.lang)}")


def cmd_serve(a) -> None:
    """The tools over the Model Context Protocol, on standard input and output."""
    for said in protocol.serve(tools.tools(tools.GraphStore(session(), _root(a))), sys.stdin):
        print(said, flush=True)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weft", description="Multilayer graph of a project's files.")
    p.add_argument("--version", action="version", version=f"weft {__version__}")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, f, about: str, *options: tuple) -> None:
        s = sub.add_parser(name, help=about)
        s.add_argument("--repo", default=".", help="project folder")
        s.set_defaults(f=f)
        for names, more in options:
            s.add_argument(*names, **more)

    add("build", cmd_build, "build the graph anew")
    add("related", cmd_related, "files related to the given ones", (["files"], {"nargs": "+"}), (["-k", "--limit"], {"type": int, "default": 10}), (["--code-only"], {"action": "store_true"}), (["--json"], {"action": "store_true"}))
    add("explain", cmd_explain, "a file's links in every layer", (["file"], {}))
    add("hidden", cmd_hidden, "couplings that imports do not show", (["--limit"], {"type": int, "default": 20}), (["--min-commits"], {"type": int, "default": 3}))
    add("report", cmd_report, "Markdown report", (["--out"], {}))
    add("obsidian", cmd_vault, "vault of linked notes", (["--out"], {}), (["--lang"], {"choices": ("en", "sr"), "default": "en"}))
    add("serve", cmd_serve, "answer tool requests on standard input")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        a.f(a)
    except (GitError, FileExistsError, KeyError, ValueError) as e:
        print(f"weft: {e}", file=sys.stderr)
        return 1
    return 0
