"""A Markdown report of a graph, from five small results."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import functions as F

from weft.model import LAYERS, FileGraph
from weft.operators import graph


def code(path: str) -> str:
    return f"`{path}`"


def _table(head: list[str], right: int, rows: list[list]) -> list[str]:
    ruler = "|".join(["---"] * (len(head) - right) + ["---:"] * right)
    return [f"| {' | '.join(head)} |", f"|{ruler}|", *(f"| {' | '.join(map(str, r))} |" for r in rows)]


def render(g: FileGraph, link: Callable[[str], str] = code) -> str:
    """Report text; ``link`` formats a file."""
    langs = g.files().groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    edges = {r["layer"]: r["count"] for r in g.edges.groupBy("layer").count().collect()}
    built = dt.datetime.fromtimestamp(g.meta.get("built_at", 0)).strftime("%Y-%m-%d %H:%M")
    overlap = graph.layer_overlap(g.edges, g.files(), "structure", "evolution").first()[0]
    weights = g.meta.get("weights", {})
    out = [
        "# weft report", "", f"Project {code(g.meta.get('root', ''))} at revision {code(g.meta.get('revision', '')[:10] or 'working tree')}, built {built}.", "",
        f"{sum(r['count'] for r in langs)} files ({', '.join(str(r['count']) + ' ' + r['lang'] for r in langs[:5])}), {g.meta.get('commits', 0)} commits analysed.", "",
        "## Layers", "", *_table(["Layer", "Edges", "Weight in walk"], 2, [[n, edges.get(n, 0), f"{weights.get(n, 0):.2f}"] for n in LAYERS]), "",
        f"Overlap of imports and co-changes (Jaccard): {overlap:.3f}. Where it is low, history shows couplings that imports do not.", "", "## Communities", "",
    ]
    for c in graph.community_summary(g.communities, g.nodes, g.edges).orderBy("community").collect():
        out.append(f"- **{c['community']}** — {c['size']} files, mostly in {code(c['main_directory'])}: {', '.join(map(link, c['top_members'][:4]))}")
    central = graph.central_files(g.nodes, g.edges).collect()
    out += ["", "## Central files (most imported)", "", *_table(["File", "Importers", "Commits"], 2, [[link(r["id"]), r["importers"], r["changes"]] for r in central])]
    hidden = graph.hidden_dependencies(g).orderBy("rank").collect()
    rows = [[link(h["a"]), link(h["b"]), h["category"].replace("_", " "), h["commits"], f"{h['confidence']:.2f}", "none" if h["structural_distance"] is None else h["structural_distance"]] for h in hidden]
    out += ["", "## Hidden dependencies", "", "Pairs that changed in the same commits and that no short chain of imports links.", ""]
    return "\n".join([*out, *_table(["File A", "File B", "Kind", "Commits", "Confidence", "Import hops"], 3, rows or [["—"] * 6])]) + "\n"
