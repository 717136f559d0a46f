"""Building, keeping and reading the graph of a project or of a past revision."""

from __future__ import annotations

import json
import shutil
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import paths
from weft.model import EDGE_SCHEMA, FORMAT, LAYERS, NODE_SCHEMA, FileGraph, edge_parts, merge_edges
from weft.operators import cochange, communities, docs, hierarchy, structure, walk
from weft.sources import files as F_
from weft.sources import git
from weft.staging import stage


def graph_tables(sources: DataFrame, commits: DataFrame | None, reference: int, most: int = cochange.MOST_FILES, half_life: float | None = cochange.HALF_LIFE_DAYS) -> tuple[DataFrame, DataFrame]:
    """Nodes and merged edges of all layers from ``sources`` (path, lang, is_test, text, lines) and ``commits`` (sha, ts, file)."""
    spark = sources.sparkSession
    listed = sources.select("path", "lang", "is_test", "lines")
    parts = []
    tree = hierarchy.containment(listed)
    parts.append(tree.select(F.lit("hierarchy").alias("layer"), F.col("child").alias("u"), F.col("parent").alias("v"), F.lit(1.0).alias("weight"), F.lit("contains").alias("kind"), F.lit(0).cast("long").alias("seq")))
    tests = hierarchy.test_pairs(listed)
    parts.append(tests.select(F.lit("hierarchy").alias("layer"), F.col("test").alias("u"), F.col("module").alias("v"), F.lit(1.0).alias("weight"), F.lit("tests").alias("kind"), F.lit(1).cast("long").alias("seq")))
    python = structure.python_imports(sources.where("lang = 'python'"), listed.where("lang = 'python'").select("path"))
    script = structure.javascript_imports(sources.where("lang in ('javascript', 'typescript')"), listed.select("path"))
    parts.append(structure.structure_parts(python, script))
    refs = docs.references(sources.where(F.col("lang").isin(*paths.DOC_LANGUAGES)), listed)
    parts.append(docs.docs_parts(refs))
    counts = spark.createDataFrame([], "file string, changes bigint")
    if commits is not None:
        known = listed.select(F.col("path").alias("file"))
        pairs = cochange.cochange_pairs(commits, reference, most, half_life, known)
        parts.append(pairs.select(F.lit("evolution").alias("layer"), F.col("a").alias("u"), F.col("b").alias("v"), "weight", F.lit("co-change").alias("kind"), F.lit(0).cast("long").alias("seq"), "count", "last_change"))
        counts = cochange.change_counts(commits.join(known, "file", "left_semi"))
    every = edge_parts(parts[0])
    for p in parts[1:]:
        every = every.unionByName(edge_parts(p))
    nodes = listed.join(counts.withColumnRenamed("file", "path"), "path", "left").select(
        F.col("path").alias("id"), F.lit("file").alias("kind"), "lang", "is_test", "lines", F.coalesce("changes", F.lit(0)).cast("long").alias("changes")
    )
    empty = [F.lit("").alias("lang"), F.lit(False).alias("is_test"), F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("changes")]
    dirs = tree.select(F.col("parent").alias("id")).union(spark.createDataFrame([("dir:.",)], "id string")).distinct()
    return nodes.unionByName(dirs.select("id", F.lit("dir").alias("kind"), *empty)), merge_edges(every)


def build_graph(
    spark: SparkSession, root: Path, revision: str | None = None, *, history_root: Path | None = None, most: int = cochange.MOST_FILES,
    half_life: float | None = cochange.HALF_LIFE_DAYS, follow_renames: bool = True, with_communities: bool = True,
) -> FileGraph:
    """The graph of the files under ``root``, with the history of ``history_root`` up to ``revision`` (HEAD)."""
    root = root.resolve()
    repo = (history_root or root).resolve()
    listed = stage(F_.scan(spark, root), "files")
    sources = stage(F_.read_texts(root, listed.select("path", "lang", "is_test")), "sources")
    meta = {"root": str(root), "revision": "", "built_at": int(time.time()), "fingerprint": F_.fingerprint(listed), "commits": 0, "max_commit_files": most, "half_life_days": half_life}
    commits, reference = None, 0
    if git.is_git_repo(repo) and git.has_commits(repo):
        meta["revision"] = git.resolve_rev(repo, revision or "HEAD")
        reference = git.commit_time(repo, meta["revision"])
        # Git names paths from the top of the repository; the graph from its root, which may be below.
        prefix = git.run_git(root, "rev-parse", "--show-prefix").strip() if repo == root else ""
        alive = listed.select(F.concat(F.lit(prefix), "path").alias("path"))
        commits = git.history_until(spark, repo, meta["revision"], alive, follow_renames)
        commits = stage(commits.withColumn("file", F.substring("file", len(prefix) + 1, 1 << 30)), "commits")
        meta["commits"] = commits.select("sha").distinct().count()
    nodes, edges = graph_tables(sources, commits, reference, most, half_life)
    none = spark.createDataFrame([], "file string, community int")
    g = FileGraph(nodes, edges, none, meta).staged()
    meta["weights"] = walk.default_weights(g.edges)
    if with_communities and listed.limit(1).count():
        g.communities = stage(communities.detect(g.edges, g.nodes, meta["weights"]), "communities")
    return g


def build_graph_at(spark: SparkSession, repo: Path, revision: str, **options) -> FileGraph:
    """The graph of a past revision, as it would have been built then."""
    with tempfile.TemporaryDirectory(prefix="weft-") as folder:
        git.export_revision(repo, revision, Path(folder))
        g = build_graph(spark, Path(folder), revision, history_root=repo, **options)
    g.meta["root"] = str(repo.resolve())
    return g


def cache_path(root: Path) -> Path:
    return root / F_.CACHE_DIR / "graph"


def save(g: FileGraph, path: Path) -> None:
    """Parquet tables, edges partitioned by layer, and what the graph was built from; replaces an earlier graph."""
    fresh = path.with_name(path.name + ".new")
    shutil.rmtree(fresh, ignore_errors=True)
    fresh.mkdir(parents=True)
    g.nodes.write.parquet(f"file://{fresh}/nodes")
    g.edges.write.partitionBy("layer").parquet(f"file://{fresh}/edges")
    g.communities.write.parquet(f"file://{fresh}/communities")
    (fresh / "meta.json").write_text(json.dumps({"format": FORMAT} | g.meta, ensure_ascii=False, indent=1), encoding="utf-8")
    shutil.rmtree(path, ignore_errors=True)
    fresh.rename(path)


def load(spark: SparkSession, path: Path) -> FileGraph:
    meta = json.loads((path / "meta.json").read_text(encoding="utf-8"))
    if meta.pop("format", None) != FORMAT:
        raise ValueError("the graph was kept in another format")
    cols = ("layer", "a", "b", "weight", "kinds", "detail")
    edges = spark.read.schema(EDGE_SCHEMA).parquet(f"file://{path}/edges").select(*cols)
    return FileGraph(spark.read.schema(NODE_SCHEMA).parquet(f"file://{path}/nodes"), edges, spark.read.schema("file string, community int").parquet(f"file://{path}/communities"), meta)


def to_json(g: FileGraph) -> str:
    """The whole graph as one JSON document."""
    rows = lambda df: [json.loads(x) for x in df.toJSON().toLocalIterator()]
    by_layer: dict[str, list] = {n: [] for n in LAYERS}
    for e in rows(g.edges.orderBy("layer", "a", "b")):
        by_layer[e.pop("layer")].append(e)
    members = {r["file"]: r["community"] for r in g.communities.orderBy("file").toLocalIterator()}
    return json.dumps({"format": FORMAT, **g.meta, "nodes": rows(g.nodes.orderBy("id")), "layers": by_layer, "communities": members}, ensure_ascii=False, indent=1)


def from_json(spark: SparkSession, text: str) -> FileGraph:
    data = json.loads(text)
    if data.pop("format", None) != FORMAT:
        raise ValueError("the graph was written in another format")
    nodes, layers, members = data.pop("nodes"), data.pop("layers"), data.pop("communities")
    lines = lambda rows: spark.createDataFrame([(json.dumps(r),) for r in rows], "j string")
    table = lambda rows, schema: lines(rows).select(F.from_json("j", schema).alias("r")).select("r.*")
    edges = table([e | {"layer": n} for n, es in layers.items() for e in es], EDGE_SCHEMA)
    return FileGraph(table(nodes, NODE_SCHEMA), edges, spark.createDataFrame(list(members.items()), "file string, community int"), data)


def is_current(g: FileGraph, root: Path) -> bool:
    """Whether the graph has the project's revision and its files as they are."""
    revision = git.resolve_rev(root) if git.is_git_repo(root) and git.has_commits(root) else ""
    return g.meta.get("revision") == revision and g.meta.get("fingerprint") == F_.fingerprint(F_.scan(g.spark, root.resolve()))


def load_or_build(spark: SparkSession, root: Path, rebuild: bool = False) -> FileGraph:
    """The kept graph if it is current, else a new one, which is kept."""
    path = cache_path(root)
    if not rebuild and (path / "meta.json").exists():
        try:
            g = load(spark, path)
            if is_current(g, root):
                return g
        except (ValueError, KeyError, TypeError):
            pass  # unreadable or of another format
    g = build_graph(spark, root)
    save(g, path)
    return load(spark, path)
