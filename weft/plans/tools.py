"""The eight tools that an assistant can call on one project, as a table of functions; ``protocol`` serves them."""

from __future__ import annotations

import difflib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from weft.model import FileGraph
from weft.operators import graph, walk
from weft.plans import build, report, vault


class RequestError(ValueError):
    """A request that can't be answered; its message is for the caller."""


class GraphStore:
    """One project's graph and the walk over it, made anew when the project changes."""

    def __init__(self, spark: SparkSession, root: Path):
        self.spark, self.root = spark, root.resolve()
        self._graph: FileGraph | None = None
        self._ranker: walk.Ranker | None = None

    def get(self, rebuild: bool = False) -> FileGraph:
        if rebuild or self._graph is None or not build.is_current(self._graph, self.root):
            self._graph, self._ranker = build.load_or_build(self.spark, self.root, rebuild), None
        return self._graph

    def ranker(self) -> walk.Ranker:
        """The graph's transition table, made once for each graph."""
        g = self.get()
        if self._ranker is None:
            self._ranker = walk.Ranker(g.edges, g.nodes, g.meta.get("weights") or walk.default_weights(g.edges))
        return self._ranker

    def normalize(self, path: str) -> str:
        """A file's path in the project, from an absolute or relative name; close names are suggested for unknown ones."""
        p = Path(path)
        if p.is_absolute():
            if not p.resolve().is_relative_to(self.root):
                raise RequestError(f"{path!r} is outside the project {self.root}")
            name = p.resolve().relative_to(self.root).as_posix()
        else:
            name = p.as_posix().removeprefix("./")
        g = self.get()
        if not g.nodes.where(g.nodes["id"] == name).limit(1).count():
            files = [r[0] for r in g.files().select("id").orderBy("id").toLocalIterator()]
            close = difflib.get_close_matches(name, files, n=3, cutoff=0.5)
            raise RequestError(f"{path!r} is not a file of the project." + (f" Did you mean: {', '.join(close)}?" if close else ""))
        return name


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def tools(store: GraphStore) -> dict[str, Callable]:
    """Functions by name."""

    def related_files(paths: list[str], limit: int = 10, code_only: bool = False) -> list[dict]:
        """Files that are most related to the given ones over all layers, each with its reasons."""
        seeds = [store.normalize(p) for p in paths]
        return _rows(graph.related_files(store.get(), seeds, limit, code_only=code_only, ranker=store.ranker()).orderBy("rank").drop("rank"))

    def explain_file(path: str) -> dict:
        """A file's links in every layer, its community and its number of changes."""
        return graph.explain_file(store.get(), store.normalize(path))

    def hidden_dependencies(limit: int = 15, min_commits: int = 3) -> list[dict]:
        """Pairs of files that change together though no short way of imports joins them."""
        return _rows(graph.hidden_dependencies(store.get(), min_commits, limit).orderBy("rank").drop("rank"))

    def communities() -> list[dict]:
        """Groups of closely linked files, with their main directory and members."""
        g = store.get()
        return _rows(graph.community_summary(g.communities, g.nodes, g.edges).orderBy("community"))

    def connection_path(source: str, target: str) -> list[dict]:
        """The strongest chain of links from one file to another, with each hop's layer."""
        a, b = store.normalize(source), store.normalize(target)
        try:
            return graph.connection_path(store.get(), a, b)
        except ValueError as e:
            raise RequestError(str(e)) from e

    def project_report() -> str:
        """A Markdown overview of layers, communities, central files and hidden dependencies."""
        return report.render(store.get())

    def rebuild_graph() -> dict:
        """Build the graph anew from the working tree and its history."""
        g = store.get(rebuild=True)
        return {"files": g.files().count(), "revision": g.meta.get("revision", ""), "edges": {r["layer"]: r["count"] for r in g.edges.groupBy("layer").count().collect()}}

    def export_obsidian(target_directory: str, language: str = "en") -> str:
        """Write the graph as a vault of linked notes, coloured by community."""
        if language not in vault.HEADINGS:
            raise RequestError(f"language must be one of: {', '.join(vault.HEADINGS)}")
        try:
            return f"Vault written to {vault.export(store.get(), Path(target_directory).expanduser(), language)}."
        except FileExistsError as e:
            raise RequestError(str(e)) from e

    named = (related_files, explain_file, hidden_dependencies, communities, connection_path, project_report, rebuild_graph, export_obsidian)
    return {f.__name__: f for f in named}
