"""Questions to a multilayer graph: hubs, hidden dependencies, distances, paths, summaries."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.functions import paths, words
from weft.model import FileGraph, both_ways
from weft.operators import walk
from weft.staging import stage

HUB_SHARE = 0.10
HUB_MIN_COMMITS = 50


def hub_files(nodes: DataFrame, commits: int, share: float = HUB_SHARE) -> DataFrame:
    """(id): files touched by more than ``share`` of all commits; none with few commits."""
    enough = F.lit(commits >= HUB_MIN_COMMITS)
    return nodes.where(enough & (F.col("kind") == "file") & (F.col("changes") > share * commits)).select("id")


def _reach(start: np.ndarray, to: np.ndarray, source: int, hops: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes at most ``hops`` steps from a source, and their steps; ``to[start[x]:start[x + 1]]`` are x's neighbours."""
    depth = np.full(len(start) - 1, -1, np.int64)
    depth[source], front = 0, np.array([source])
    for k in range(1, hops + 1):
        many = start[front + 1] - start[front]
        near = to[np.repeat(start[front] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        front = np.unique(near[depth[near] < 0])
        if not len(front):
            break
        depth[front] = k
    found = np.nonzero(depth >= 0)[0]
    return found, depth[found]


def within(edges: DataFrame, sources: DataFrame, hops: int, method: str = "auto") -> DataFrame:
    """(src, node, d): nodes at most ``hops`` undirected steps from each source (node), the source itself at 0.

    Up to SMALL_EDGES edges, which are counted first, tasks walk from their sources over a broadcast copy (``kernel``);
    beyond, each round joins the newest nodes with the edges and leaves out those that were seen (``loop``).
    """
    step = stage(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct(), "steps")
    sources = sources.select("node").distinct()
    if method == "kernel" or method == "auto" and step.count() <= walk.SMALL_EDGES:
        e = step.toPandas()
        ids, x = np.unique(e["x"].to_numpy(), return_inverse=True)
        y = np.searchsorted(ids, e["y"].to_numpy())
        order = np.argsort(x, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=len(ids)))]).astype(np.int64)
        sent = edges.sparkSession.sparkContext.broadcast((ids, start, y[order]))
        kind = step.schema["x"].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, first, to = sent.value
            place = {n: k for k, n in enumerate(names.tolist())}
            for batch in batches:
                for source in batch["node"].tolist():
                    if source in place:
                        found, d = _reach(first, to, place[source], hops)
                        yield pd.DataFrame({"src": source, "node": names[found], "d": d.astype(np.int32)})
                    else:
                        yield pd.DataFrame({"src": [source], "node": [source], "d": np.array([0], np.int32)})

        return sources.repartition(edges.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, f"src {kind}, node {kind}, d int")
    seen = front = stage(sources.select(F.col("node").alias("src"), "node").withColumn("d", F.lit(0)), "seen")
    for k in range(1, hops + 1):
        new = front.join(step, front["node"] == step["x"]).select("src", F.col("y").alias("node")).distinct().join(seen.select("src", "node"), ["src", "node"], "left_anti")
        front = stage(new.withColumn("d", F.lit(k)), "front")
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
        seen = stage(seen, "seen") if k % 8 == 0 else seen
    return seen


def distances(edges: DataFrame, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """``pairs`` (a, b) with distance: undirected steps from a to b, null if there is no way. Walks from each a until nothing is new."""
    seen = within(edges, pairs.select(F.col("a").alias("node")), most if most is not None else 1 << 20)
    found = seen.select(F.col("src").alias("a"), F.col("node").alias("b"), F.col("d").alias("distance"))
    return pairs.join(found, ["a", "b"], "left")


def near_pairs(edges: DataFrame, pairs: DataFrame, hops: int) -> DataFrame:
    """The pairs (a, b) that are at most ``hops`` steps apart."""
    if hops < 1:
        return pairs.where("a = b")
    if hops <= 2:
        e = both_ways(edges.withColumn("layer", F.lit("x"))).select("src", "dst").distinct()
        two = e.alias("p").join(e.alias("q"), F.col("p.dst") == F.col("q.src")).select(F.col("p.src").alias("a"), F.col("q.dst").alias("b"))
        reach = e.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        reach = reach.union(two) if hops == 2 else reach
        return pairs.join(reach, ["a", "b"], "left_semi")
    return distances(edges, pairs, hops).where("distance is not null").select("a", "b")


def hidden_pairs(nodes: DataFrame, edges: DataFrame, commits: int, min_commits: int = 3, limit: int | None = 20, min_distance: int = 3, exact: bool = True) -> DataFrame:
    """Pairs that change together but are far apart in the code: (rank, a, b, commits, weight, confidence, structural_distance, category)."""
    docs = nodes.where((F.col("kind") == "file") & F.col("lang").isin(*paths.DOC_LANGUAGES)).select("id")
    out = hub_files(nodes, commits).union(docs)
    pairs = edges.where("layer = 'evolution'").select("a", "b", "weight", F.coalesce("detail.count", F.lit(0)).alias("commits")).where(F.col("commits") >= min_commits)
    for end in ("a", "b"):
        pairs = pairs.join(out.withColumnRenamed("id", end), end, "left_anti")
    tests = edges.where("layer = 'hierarchy' and array_contains(kinds, 'tests')").select("a", "b")
    pairs = stage(pairs.join(tests, ["a", "b"], "left_anti"), "pairs")
    structure = edges.where("layer = 'structure'").select("a", "b")
    pairs = pairs.join(near_pairs(structure, pairs.select("a", "b"), min_distance - 1), ["a", "b"], "left_anti")
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("id").alias(end), F.col("lang").alias(f"lang_{end}"), F.col("is_test").alias(f"test_{end}"), F.greatest("changes", F.lit(1)).alias(f"n_{end}")), end)
    pairs = pairs.withColumn("confidence", F.greatest(F.col("commits") / F.col("n_a"), F.col("commits") / F.col("n_b")))
    kind = paths.classify_pair(F.col("a"), F.col("lang_a"), F.col("test_a"), F.col("b"), F.col("lang_b"), F.col("test_b"))
    pairs = pairs.withColumn("category", kind)
    last = F.array_position(F.array(*map(F.lit, paths.CATEGORIES)), F.col("category")) > paths.CATEGORIES.index("config_config")
    order = [last.asc(), (F.col("commits") * F.col("confidence")).desc(), F.col("a"), F.col("b")]
    top = pairs.orderBy(*order)
    top = top.limit(limit) if limit is not None else top
    top = stage(top.withColumn("last", last), "top")
    if exact:
        far = distances(structure, top.select("a", "b"))
        top = top.join(far.withColumnRenamed("distance", "structural_distance"), ["a", "b"])
    else:
        top = top.withColumn("structural_distance", F.lit(None).cast("int"))
    by = W.orderBy("last", (F.col("commits") * F.col("confidence")).desc(), "a", "b")
    if limit is None:
        return top.select("a", "b", "commits", "weight", "confidence", "structural_distance", "category")
    return top.select(F.row_number().over(by).alias("rank"), "a", "b", "commits", "weight", "confidence", "structural_distance", "category")


def hidden_dependencies(g: FileGraph, min_commits: int = 3, limit: int = 20, min_distance: int = 3) -> DataFrame:
    return hidden_pairs(g.nodes, g.edges, g.meta.get("commits", 0), min_commits, limit, min_distance)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, importers, changes) of files: neighbours in the structure layer, in either direction, and commits."""
    n = both_ways(edges.where("layer = 'structure'")).groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("importers"))
    return nodes.where("kind = 'file'").select("id", "changes").join(n, "id", "left").select("id", F.coalesce("importers", F.lit(0)).alias("importers"), F.coalesce("changes", F.lit(0)).alias("changes"))


def central_files(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    return degrees(nodes, edges).orderBy(F.desc("importers"), F.desc("changes"), "id").limit(limit)


def strongest_neighbors(edges: DataFrame, nodes: DataFrame, per_layer: int = 8) -> DataFrame:
    """(src, layer, n, path, weight, kinds, commits): the heaviest links of each node by layer; directories go after the cut."""
    e = both_ways(edges, "weight", "kinds", "detail").join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
    ranked = e.withColumn("n", F.row_number().over(W.partitionBy("src", "layer").orderBy(F.desc("weight"), "dst"))).where(F.col("n") <= per_layer)
    return ranked.where(~F.col("dst").cast("string").startswith("dir:")).select("src", "layer", "n", F.col("dst").alias("path"), F.round("weight", 4).alias("weight"), "kinds", F.col("detail.count").alias("commits"))


def explain_file(g: FileGraph, path: str, per_layer: int = 8) -> dict:
    """A node, its community and its strongest links in every layer; KeyError for an unknown path."""
    from weft.model import LAYERS

    node = g.nodes.where(F.col("id") == path).first()
    if node is None:
        raise KeyError(path)
    community = g.communities.where(F.col("file") == path).first()
    layers: dict[str, list[dict]] = {n: [] for n in LAYERS}
    for r in strongest_neighbors(g.edges, g.nodes.where(F.col("id") == path), per_layer).orderBy("layer", "n").collect():
        layers[r["layer"]].append({"path": r["path"], "weight": r["weight"], "kinds": r["kinds"]} | ({"commits": r["commits"]} if r["commits"] is not None else {}))
    return {"path": path, "language": node["lang"], "is_test": node["is_test"], "lines": node["lines"], "commits": node["changes"], "community": community["community"] if community else None, "layers": layers}


def cheapest_links(edges: DataFrame) -> DataFrame:
    """(a, b, cost, layer): the layer that links two nodes best; cost is the layer's mean weight over the edge's, ties to the earlier layer."""
    from weft.model import LAYERS

    mean = edges.groupBy("layer").agg(F.avg("weight").alias("mean"))
    cost = edges.join(mean, "layer").select("a", "b", "layer", (F.col("mean") / F.col("weight")).alias("cost"), F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer")).alias("n"))
    return cost.groupBy("a", "b").agg(F.min(F.struct("cost", "n", "layer")).alias("m")).select("a", "b", "m.cost", "m.layer")


def shortest_costs(links: DataFrame, source) -> DataFrame:
    """(node, cost, hops, via, layer): cheapest ways from ``source``, by rounds in which every node that got cheaper tells its neighbours."""
    step = stage(links.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("cost").alias("c"), "layer").union(links.select("b", "a", "cost", "layer")), "links")
    kind = step.schema["x"].dataType.simpleString()
    state = step.sparkSession.range(1).select(F.lit(source).cast(kind).alias("node"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit(None).cast(kind).alias("via"), F.lit(None).cast("string").alias("layer"))
    state = changed = stage(state, "costs")
    while True:
        told = changed.join(step, changed["node"] == step["x"]).select(F.col("y").alias("node"), (F.col("cost") + F.col("c")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.col("x").alias("via"), step["layer"])
        told = told.groupBy("node").agg(F.min(F.struct("cost", "hops", "via", "layer")).alias("m")).select("node", "m.*")
        old = state.select("node", F.col("cost").alias("old"))
        changed = stage(told.join(old, "node", "left").where("old is null or cost < old - 1e-12").drop("old"), "costs")
        if not changed.limit(1).count():
            return state
        state = stage(state.join(changed.select("node"), "node", "left_anti").unionByName(changed), "costs")


def _cheapest_way(start: list[int], to: list[int], cost: list[float], a: int, b: int) -> list[int] | None:
    """Places along the cheapest way from a to b, ties to fewer hops, then to the smaller place before (Dijkstra 1959)."""
    best, done, heap = {a: (0.0, 0, -1)}, set(), [(0.0, 0, a)]
    while heap:
        x = heapq.heappop(heap)[2]
        if x in done:
            continue
        done.add(x)
        if x == b:
            break
        c, hops, _ = best[x]
        for k in range(start[x], start[x + 1]):
            y, new = to[k], (round(c + cost[k], 12), hops + 1, x)
            if y not in done and (y not in best or new < best[y]):
                best[y] = new
                heapq.heappush(heap, (*new[:2], y))
    if b not in done:
        return None
    way = [b]
    while way[-1] != a:
        way.append(best[way[-1]][2])
    return way[::-1]


def connection_path(g: FileGraph, a: str, b: str, method: str = "auto") -> list[dict]:
    """The strongest chain of links from a to b, with the layer of each hop; ValueError if there is none.

    Up to SMALL_EDGES links, which are counted first, the driver walks over a copy (``kernel``), so the number of jobs
    does not grow with the hops; beyond, costs come by rounds (``loop``).
    """
    links = stage(cheapest_links(g.edges), "links")
    for end in (a, b):
        if not links.where((F.col("a") == end) | (F.col("b") == end)).limit(1).count():
            raise ValueError(f"{end!r} has no links in any layer")
    if a == b:
        return []
    none = ValueError(f"no chain of links connects {a!r} and {b!r}")
    if method == "kernel" or method == "auto" and links.count() <= walk.SMALL_EDGES:
        e = links.toArrow()
        ends, cost, layer = [e[c].to_numpy() for c in "ab"], e["cost"].to_numpy(), e["layer"].to_numpy()
        ids, flat = np.unique(np.concatenate(ends), return_inverse=True)
        x, y = flat, np.concatenate([flat[len(cost) :], flat[: len(cost)]])
        order = np.argsort(x, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=len(ids)))]).tolist()
        to, row = y[order].tolist(), order % len(cost)
        way = _cheapest_way(start, to, cost[row].tolist(), *np.searchsorted(ids, [a, b]).tolist())
        if way is None:
            raise none
        names = ids[way].tolist()
        used = [layer[row[start[p] + to[start[p] : start[p + 1]].index(q)]] for p, q in zip(way, way[1:])]
        return [{"from": p, "to": q, "layer": n} for p, q, n in zip(names, names[1:], used)]
    ways = shortest_costs(links, a)
    out, at = [], b
    while at != a:  # one row for each hop
        row = ways.where(F.col("node") == at).first()
        if row is None:
            raise none
        out.append({"from": row["via"], "to": at, "layer": row["layer"]})
        at = row["via"]
    return out[::-1]


def community_summary(communities: DataFrame, nodes: DataFrame, edges: DataFrame, members: int = 6) -> DataFrame:
    """(community, size, main_directory, top_members): the commonest directory, and members by neighbours plus commits; ties by name."""
    rows = communities.join(degrees(nodes, edges).withColumnRenamed("id", "file"), "file")
    size = communities.groupBy("community").agg(F.count("*").alias("size"))
    dirs = communities.groupBy("community", paths.parent(F.col("file")).alias("dir")).agg(F.count("*").alias("n"))
    main = dirs.groupBy("community").agg(F.min_by("dir", F.struct(-F.col("n"), "dir")).alias("main_directory"))
    rank = F.row_number().over(W.partitionBy("community").orderBy(F.desc(F.col("importers") + F.col("changes")), "file"))
    top = rows.withColumn("n", rank).where(F.col("n") <= members)
    top = top.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "file"))), lambda s: s["file"]).alias("top_members"))
    return size.join(main, "community").join(top, "community")


def layer_overlap(edges: DataFrame, files: DataFrame, a: str, b: str) -> DataFrame:
    """(jaccard) of the file pairs that two layers link; 0 if neither links any."""
    f = files.select("id")
    e = edges.where(F.col("layer").isin(a, b)).join(f.withColumnRenamed("id", "a"), "a", "left_semi").join(f.withColumnRenamed("id", "b"), "b", "left_semi")
    by = e.groupBy("a", "b").agg(F.count_distinct("layer").alias("n"))
    both, every = F.count_if(F.col("n") == 2), F.count("*")
    return by.agg(F.when(every > 0, both / every).otherwise(0.0).alias("jaccard"))


def related_files(g: FileGraph, seeds: list[str], k: int = 10, weights: dict[str, float] | None = None, code_only: bool = False, method: str = "auto", ranker: walk.Ranker | None = None) -> DataFrame:
    """(rank, path, score, reasons): files most related to the seeds over all layers; unknown seeds don't count.

    ``ranker`` takes the place of the weights where one is at hand.
    """
    spark = g.spark
    asked = spark.createDataFrame([(0, s) for s in seeds], "qid int, seed string")
    ranker = ranker or walk.Ranker(g.edges, g.nodes, weights or g.meta.get("weights") or walk.default_weights(g.edges))
    scores = ranker.scores(asked, method)
    files = g.files().where(F.col("lang").isin(*paths.CODE_LANGUAGES)) if code_only else g.files()
    top = stage(walk.top_k(scores, asked, files, k).select("rank", F.col("node").alias("path"), F.round("score", 4).alias("score")), "top")
    named = spark.createDataFrame([(n, s) for n, s in enumerate(seeds)], "n int, seed string")
    e = both_ways(g.edges, "kinds", "detail").join(named.withColumnRenamed("seed", "src"), "src").join(top.select(F.col("path").alias("dst")), "dst")
    of = lambda layer, c: F.first(F.when(F.col("layer") == layer, c), ignorenulls=True)
    links = e.groupBy("n", "dst").agg(
        of("structure", F.col("detail.imports")).alias("imports"), of("evolution", F.coalesce("detail.count", F.lit(0))).alias("count"),
        of("hierarchy", F.array_contains("kinds", "tests")).alias("tests"), of("docs", F.col("kinds")).alias("docs"),
    )
    known = g.files().select(F.col("id").alias("seed")).join(named, "seed")
    near = F.col("seed").isNotNull() & (paths.parent(F.col("seed")) == paths.parent(F.col("path")))
    rows = top.join(F.broadcast(known), F.lit(True))  # k rows by the seeds that were named
    rows = rows.join(links, (rows["n"] == links["n"]) & (rows["path"] == links["dst"]), "left").select("rank", "path", "score", rows["n"], words.link_reasons(F.col("imports"), F.col("count"), F.col("tests"), F.col("docs"), near).alias("r"))
    said = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "r"))), lambda s: s["r"]))
    out = rows.groupBy("rank", "path", "score").agg(said.alias("reasons"))
    return out.withColumn("reasons", F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("indirect (through neighbours)"))))
