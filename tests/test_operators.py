"""Golden cases and invariants of the graph operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import paths
from weft.model import EDGE_SCHEMA, FileGraph, edge_parts, merge_edges
from weft.operators import cochange, communities, docs, evaluate, graph, history, modules, rules, structure, walk
from weft.operators.components import connected_components
from weft.sources.git import parse_log
from weft.staging import stage
from weft.streaming import cochange as stream


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- rules: the worked example of the published method ----------------------


@pytest.fixture(scope="module")
def tx(spark):
    rows = [(s, 0, f) for s, fs in (("1", "abc"), ("2", "ad"), ("3", "cd")) for f in fs]
    return cochange.transactions(table(spark, rows, "sha string, ts bigint, file string"))


def ruled(spark, f, tx, files):
    q = table(spark, [(0, x) for x in files], "qid int, file string")
    return {r["file"]: (r["support"], round(r["confidence"], 3)) for r in f(tx, q).collect()}


def test_rules(spark, tx):
    assert ruled(spark, rules.whole_query_rules, tx, "a") == {"b": (1, 0.5), "c": (1, 0.5), "d": (1, 0.5)}
    assert ruled(spark, rules.whole_query_rules, tx, "bd") == {}
    assert ruled(spark, rules.largest_overlap_rules, tx, "bd") == {"a": (1, 1.0), "c": (1, 1.0)}
    assert ruled(spark, rules.largest_overlap_rules, tx, "ac") == {"b": (1, 1.0)}
    assert ruled(spark, rules.largest_overlap_rules, tx, "e") == {}
    q = table(spark, [(0, "a"), (0, "d"), (1, "b"), (1, "d"), (2, "e")], "qid int, file string")
    assert {r["qid"]: r["seen"] for r in rules.is_seen(tx, q).collect()} == {0: True, 1: False, 2: False}


def test_whole_queries_meet_transactions_at_one_file(spark):
    """Pairs of query and transaction are made at a query's first file alone, and rows of queries are dealt out once."""
    rows = [(str(s), 0, f"f{k}") for s in range(40) for k in (0, 1, 2 + s % 3)] + [("x", 0, "f0"), ("x", 0, "f9")] + [(f"y{s}", 0, f) for s in range(50) for f in ("f1", f"g{s}")]
    tx = stage(cochange.transactions(table(spark, rows, "sha string, ts bigint, file string")), "tx")
    q = table(spark, [(0, "f1"), (0, "f0"), (1, "f9"), (1, "f2"), (1, "f0"), (2, None), (3, "f3")], "qid int, file string")
    hit = rules.containing(tx, q)
    assert {(r["qid"], r["sha"]) for r in hit.collect()} == {(0, str(s)) for s in range(40)} | {(3, str(s)) for s in range(1, 40, 3)}
    plan = hit._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    got = {(r["qid"], r["file"]): (r["support"], round(r["confidence"], 3)) for r in rules.largest_overlap_rules(tx, q).collect()}
    # Query 1 is nowhere whole: f0 and f2 in 14 commits, f0 and f9 in one, each an antecedent of its own.
    assert got == {(0, "f2"): (14, 0.35), (0, "f3"): (13, 0.325), (0, "f4"): (13, 0.325), (1, "f1"): (14, 1.0), (3, "f0"): (13, 1.0), (3, "f1"): (13, 1.0)}


def test_large_commits_are_no_transactions(spark):
    rows = [("x", 0, f"f{k}") for k in range(40)] + [("y", 0, "f1"), ("y", 0, "f2"), ("z", 0, "f1")]
    ch = table(spark, rows, "sha string, ts bigint, file string")
    assert [r["sha"] for r in cochange.transactions(ch).collect()] == ["y"]
    assert {r["file"]: r["changes"] for r in cochange.change_counts(ch).collect()}["f1"] == 3


# --- connection paths --------------------------------------------------------


def linked(spark, rows):
    e = edge_parts(table(spark, rows, "layer string, u long, v long, weight double, kind string"))
    return FileGraph(table(spark, [], "id long"), merge_edges(e), table(spark, [], "file long, community int"))


def test_connection_path_takes_few_jobs(spark):
    g = linked(spark, [("structure", k, k + 1, 1.0, "import") for k in range(60)])
    spark.sparkContext.setJobGroup("connection", "connection")
    way = graph.connection_path(g, 60, 0)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("connection")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [(x["from"], x["to"], x["layer"]) for x in way] == [(k + 1, k, "structure") for k in range(59, -1, -1)]
    assert len(jobs) < 30


def test_connection_path_kernel_equals_rounds(spark):
    rng = random.Random(4)
    rows = [(rng.choice(("structure", "evolution")), u, v, rng.uniform(0.5, 3), "x") for u in range(30) for v in range(u + 1, 30) if rng.random() < 0.12]
    rows += [("docs", 90, 91, 1.0, "x")]
    g = linked(spark, rows)
    for a, b in ((0, 29), (17, 3)):
        assert graph.connection_path(g, a, b, "kernel") == graph.connection_path(g, a, b, "loop") != []
    for method in ("kernel", "loop"):
        with pytest.raises(ValueError, match="no chain"):
            graph.connection_path(g, 0, 91, method)


# --- history: the fold, one change after the other ---------------------------


def fold_back(commits, alive, follow):
    alias, out = {}, set()
    for sha, changes in commits:
        for st, p, old in changes:
            t = alias[p] if p in alias else (p if p in alive else None)
            if t and st != "D":
                out.add((sha, t))
            if st == "R" and old:
                alias[old], alias[p] = (t if follow else None), None
            elif st in "ACD":
                alias[p] = None
    return out


def fold_forth(commits, alive):
    now, out = {p: p for p in alive}, set()
    for sha, changes in commits:
        for st, p, old in changes:
            if st == "R" and old:
                now[p] = now.pop(old, None)
            elif st in "AC":
                now[p] = None
            if t := now.get(p):
                out.add((sha, t))
            if st == "D":
                now.pop(p, None)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_renames_equal_the_fold(spark, seed):
    rng = random.Random(seed)
    rows, alive, back, back_off, forth = [], [], set(), set(), set()
    for h in range(60):
        names = [f"{h}/{c}" for c in "abcd"]
        commits = []
        for c in range(rng.randint(1, 9)):
            changes = []
            for _ in range(rng.randint(1, 4)):
                st = rng.choice("MMARRDCT")
                p, old = rng.sample(names, 2)
                changes.append((st, p, old if st in "RC" else None))
            commits.append((f"{h}-{c}", changes))
        live = set(rng.sample(names, rng.randint(0, 4)))
        alive += [(p,) for p in live]
        rows += [(sha, 0, k + 1000 * h, n, st, p, old) for k, (sha, chs) in enumerate(commits) for n, (st, p, old) in enumerate(chs)]
        back |= fold_back(commits, live, True)
        back_off |= fold_back(commits, live, False)
        forth |= fold_forth(commits, live)
    ch = table(spark, rows, "sha string, ts bigint, seq bigint, pos bigint, status string, path string, old_path string")
    al = table(spark, alive, "path string")
    got = lambda df: {(r["sha"], r["file"]) for r in df.collect()}
    assert got(history.normalize_backward(ch, al)) == back
    assert got(history.normalize_backward(ch, al, follow_renames=False)) == back_off
    assert got(history.normalize_forward(ch, al)) == forth


def test_log_parsing(spark):
    text = "abc\x1f100\n\nM\ta.py\nR087\told.py\tnew.py\nC100\tx.py\ty.py\nA\tz.py\nbroken\n"
    rows = parse_log(table(spark, [(0, text)], "seq bigint, record string")).orderBy("pos").collect()
    assert [(r["status"], r["path"], r["old_path"]) for r in rows] == [("M", "a.py", None), ("R", "new.py", "old.py"), ("C", "y.py", "x.py"), ("A", "z.py", None)]
    assert {r["ts"] for r in rows} == {100}


# --- paths, modules, imports, documents --------------------------------------


def test_paths(spark):
    df = table(spark, [("a/b.PY",), ("test/x_test.go",), ("conftest.py",), ("app.spec.ts",), ("test_core.py",)], "p string")
    p = F.col("p")
    got = [tuple(r) for r in df.select(paths.language_of(p), paths.is_test_path(p), paths.tested_stem(p), paths.parent(p)).collect()]
    assert got == [("python", False, None, "a"), ("go", True, "x", "test"), ("python", False, None, "."), ("typescript", True, "app", "."), ("python", True, "core", ".")]
    two = table(spark, [("a/b/c", "a/b/d"), ("a", "a"), ("a/b", "a"), ("x", "y")], "a string, b string")
    assert [r[0] for r in two.select(paths.shared_prefix(F.col("a"), F.col("b"))).collect()] == [2, 1, 1, 0]


PY = ["pkg/__init__.py", "pkg/a.py", "pkg/b.py", "tools/run.py", "tools/helper.py", "__init__.py"]


def test_modules(spark):
    files = table(spark, [(p,) for p in PY], "path string")
    m = modules.module_names(files)
    assert {r["path"]: r["module"] for r in m.collect()}["pkg/a.py"] == "pkg.a"
    asked = [("helper", "tools/run.py"), ("a", None), ("pkg.a.x", None), ("pkg.none", None), ("zzz", "pkg/a.py"), ("helper", "pkg/a.py")]
    got = {(r["name"], r["importer"]): r["target"] for r in modules.resolve(table(spark, asked, "name string, importer string"), m, modules.package_dirs(files)).collect()}
    assert got == {("helper", "tools/run.py"): "tools/helper.py", ("a", None): "pkg/a.py", ("pkg.a.x", None): "pkg/a.py", ("pkg.none", None): "pkg/__init__.py", ("zzz", "pkg/a.py"): None, ("helper", "pkg/a.py"): "tools/helper.py"}


def test_imports(spark):
    files = table(spark, [(p,) for p in PY], "path string")
    src = table(spark, [("pkg/a.py", "import os\nfrom pkg import b\nfrom .b import thing\nfrom . import b as c\n"), ("pkg/b.py", "def broken(:\n"), ("tools/run.py", "import helper\nimport helper.x\n")], "path string, text string")
    got = {(r["importer"], r["target"]): r["symbols"] for r in structure.python_imports(src, files).collect()}
    assert got == {("pkg/a.py", "pkg/b.py"): ["b", "thing"], ("tools/run.py", "tools/helper.py"): ["helper", "helper.x"]}
    web = table(spark, [(p,) for p in ("src/app.js", "src/util.ts", "src/lib/index.js", "shared/x.jsx")], "path string")
    js = table(spark, [("src/app.js", "import a from './util';\nimport {b} from './lib'\nconst c = require('../shared/x'); import d from 'react'; import './util'")], "path string, text string")
    assert [r["target"] for r in structure.javascript_imports(js, web).orderBy("ord").collect()] == ["src/util.ts", "src/lib/index.js", "shared/x.jsx", "src/util.ts"]


def test_document_references(spark):
    listed = [("docs/a.rst", "rst"), ("docs/guide.md", "markdown"), ("src/pkg/__init__.py", "python"), ("src/pkg/core.py", "python")]
    files = table(spark, listed, "path string, lang string")
    text = "See :class:`~pkg.core.Name` and [x](https://e.org/a), [g](guide.md#top).\n\n.. automodule:: pkg.core\n.. literalinclude:: ../src/pkg/core.py\n:doc:`guide` ``src/pkg/core.py`` `nothing.here` [root](/src/pkg/core.py?x)\n"
    got = [(r["kind"], r["target"]) for r in docs.references(table(spark, [("docs/a.rst", text)], "path string, text string"), files).orderBy("ord").collect()]
    core = "src/pkg/core.py"
    assert got == [("link", "docs/guide.md"), ("link", core), ("role", core), ("role", "docs/guide.md"), ("directive", core), ("directive", core), ("mention", "docs/guide.md"), ("mention", core)]


# --- edges, walks, components, communities -----------------------------------


def test_edge_merge(spark):
    parts = table(
        spark,
        [("docs", "b", "a", 1.0, "link", 2, 1, 5, ["x"]), ("docs", "a", "b", 0.5, "mention", 1, 2, 3, ["y", "x"])],
        "layer string, u string, v string, weight double, kind string, seq bigint, count bigint, last_change bigint, imports array<string>",
    )
    e = merge_edges(edge_parts(parts)).first()
    assert (e["a"], e["b"], e["weight"], e["kinds"]) == ("a", "b", 1.5, ["mention", "link"])
    assert (e["detail"]["count"], e["detail"]["last_change"], e["detail"]["imports"]) == (3, 5, ["y", "x"])
    loop = edge_parts(table(spark, [("docs", "a", "a", 1.0, "x", 1)], "layer string, u string, v string, weight double, kind string, seq bigint"))
    with pytest.raises(Exception, match="self-loop"):
        merge_edges(loop).collect()


@pytest.fixture(scope="module")
def ring(spark):
    rng = random.Random(4)
    rows = [("evolution", f"n{a:02}", f"n{b:02}", rng.random(), ["x"], None) for a in range(20) for b in range(a + 1, 20) if rng.random() < 0.2]
    rows += [("structure", f"n{a:02}", f"n{a + 1:02}", 1.0, ["x"], None) for a in range(0, 18, 2)]
    return table(spark, rows, EDGE_SCHEMA), table(spark, [(f"n{k:02}",) for k in range(21)], "id string")


def test_walk(spark, ring):
    edges, nodes = ring
    steps = walk.transition(edges, {"evolution": 0.7, "structure": 0.3})
    assert all(abs(r[1] - 1) < 1e-9 for r in steps.groupBy("src").agg(F.sum("p")).collect())
    seeds = table(spark, [(0, "n00"), (1, "n05"), (2, "n00"), (2, "n05"), (3, "n20"), (4, "none")], "qid int, seed string")
    shares = walk.seed_shares(seeds, nodes)
    score = {m: {(r["qid"], r["node"]): r["score"] for r in walk.pagerank(steps, shares, nodes, method=m).collect()} for m in ("kernel", "loop")}
    for q in range(4):
        assert abs(sum(v for (k, _), v in score["kernel"].items() if k == q) - 1) < 1e-6
    assert set(q for q, _ in score["kernel"]) == {0, 1, 2, 3}
    for key, v in score["kernel"].items():
        assert abs(score["loop"].get(key, 0) - v) < 1e-7
    for n in range(20):  # linear in the restart
        name = f"n{n:02}"
        k = score["kernel"]
        assert abs(k.get((2, name), 0) - (k.get((0, name), 0) + k.get((1, name), 0)) / 2) < 1e-6


def test_walk_by_blocks_equals_kernel(spark, ring, monkeypatch):
    """Many blocks, several batches of queries, rows of few and of many steps, and a limit on nodes that sends it to the loop."""
    edges, nodes = ring
    steps = walk.transition(edges, {"evolution": 0.7, "structure": 0.3})
    seeds = table(spark, [(0, "n00"), (1, "n05"), (2, "n00"), (2, "n05"), (3, "n20"), (4, "none")], "qid int, seed string")
    shares = walk.seed_shares(seeds, nodes)
    want = {(r["qid"], r["node"]): r["score"] for r in walk.pagerank(steps, shares, nodes, method="kernel").collect()}
    monkeypatch.setattr(walk, "BLOCK", 7, raising=False)
    for most in (4_000_000, 50):
        monkeypatch.setattr(walk, "SCORES", most, raising=False)
        got = walk.pagerank(steps, shares, nodes, method="blocks")
        rows = got.collect()
        assert len(rows) == len(want) and {(r["qid"], r["node"]): pytest.approx(r["score"], abs=1e-7) for r in rows} == want
        assert got.schema["qid"].dataType == shares.schema["qid"].dataType
    monkeypatch.setattr(walk, "SCORES", 3)
    assert walk.pagerank_blocks(steps, 99, shares) is None
    rng = np.random.default_rng(1)
    first, r = np.array([0, 200, 200, 290]), rng.random((30, 4))
    src, p = rng.integers(0, 30, 290), rng.random(290)
    dense = np.stack([(r[src[i:j]] * p[i:j, None]).sum(axis=0) for i, j in zip(first, first[1:])])
    assert np.allclose(walk._times(src, p, first, r), dense)
    assert np.allclose(walk._times(src[:20], p[:20], np.array([0, 3, 3, 20]), r)[[0, 2]], [(r[src[:3]] * p[:3, None]).sum(axis=0), (r[src[3:20]] * p[3:20, None]).sum(axis=0)])


def test_distances(spark, ring):
    from weft.operators import graph

    edges, nodes = ring
    e = edges.where("layer = 'structure' or weight < 0.4")
    sources = nodes.select(F.col("id").alias("node")).where("id in ('n00', 'n07', 'n20')")
    for hops in (0, 1, 2, 30):
        got = {m: sorted(map(tuple, graph.within(e, sources, hops, m).collect())) for m in ("kernel", "loop")}
        assert got["kernel"] == got["loop"] and ("n20", "n20", 0) in got["kernel"]
    near = {}
    for r in e.collect():
        near.setdefault(r["a"], set()).add(r["b"])
        near.setdefault(r["b"], set()).add(r["a"])
    depth, front = {"n00": 0}, ["n00"]
    while front:
        front = [y for x in front for y in sorted(near.get(x, ())) if y not in depth and not depth.update({y: depth[x] + 1})]
    assert {(n, d) for s, n, d in got["loop"] if s == "n00"} == set(depth.items())


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5000 + k) for k in range(50)]
    group = {}

    def root(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        group[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in connected_components(table(spark, pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for p in pairs for x in p if root(x) != x}
    assert connected_components(table(spark, [], "a long, b long")).count() == 0


def test_communities(spark):
    rng = np.random.default_rng(0)
    a, b = np.triu_indices(60, 1)
    p = np.where(a // 20 == b // 20, 0.6, 0.02)
    keep = rng.random(len(a)) < p
    a, b = a[keep], b[keep]
    w = np.ones(len(a))
    label = communities.Leiden(1.0, w.sum(), 1).run(60, a, b, w)
    planted = np.arange(60) // 20
    assert communities.modularity(a, b, w, label) >= communities.modularity(a, b, w, planted) - 1e-9
    rows = [("structure", f"d{x // 20}/f{x:02}", f"d{y // 20}/f{y:02}", 1.0, ["x"], None) for x, y in zip(a.tolist(), b.tolist())]
    nodes = table(spark, [(f"d{k // 20}/f{k:02}", "file") for k in range(60)] + [("z/alone", "file")], "id string, kind string")
    got = communities.detect(table(spark, rows, EDGE_SCHEMA), nodes, {"hierarchy": 0.5, "structure": 0.5}).collect()
    sizes = [sum(r["community"] == c for r in got) for c in range(1 + max(r["community"] for r in got))]
    assert sum(sizes) == 61 and sizes == sorted(sizes, reverse=True) and sizes[0] == 20


@pytest.mark.parametrize("scale", [1.0, 1e-9])
def test_groups_stand_for_their_pairs(scale):
    """A group does what links between all of its nodes do, and labels do not depend on the scale of weights."""
    rng = np.random.default_rng(3)
    group = np.repeat([0, 1, 2, -1], [40, 25, 12, 20])
    each = scale / np.array([39, 24, 11])
    a, b = np.triu_indices(97, 1)
    a, b = np.stack([a, b])[:, rng.random(len(a)) < 0.02]
    w = scale * rng.uniform(0.1, 0.6, len(a))
    x, y = np.triu_indices(97, 1)
    same = (group[x] == group[y]) & (group[x] >= 0)
    x, y = x[same], y[same]
    aa, bb, ww = np.concatenate([a, x]), np.concatenate([b, y]), np.concatenate([w, each[group[x]]])
    short = communities.Leiden(1.0, ww.sum(), 1).run(97, a, b, w, group, each)
    long = communities.Leiden(1.0, ww.sum(), 1).run(97, aa, bb, ww)
    of = [communities.modularity(aa, bb, ww, n) for n in (short, long)]
    assert of[0] == pytest.approx(of[1], abs=0.02) and of[0] > 0.3 and 3 <= short.max() < 40


@pytest.fixture(scope="module")
def folders(spark):
    """Files of directories of 1 to 23 files, with links in a directory, between two, and of the hierarchy itself."""
    rng = random.Random(7)
    files = [f"d{d}/f{k:02}" for d, n in enumerate((23, 9, 8, 1, 2)) for k in range(n)]
    some = {tuple(sorted(rng.sample(files, 2))) for _ in range(40)}
    rows = [(rng.choice(("structure", "hierarchy", "docs")), a, b, rng.uniform(0.5, 2), ["x"], None) for a, b in sorted(some)]
    return files, rows, table(spark, rows, EDGE_SCHEMA), table(spark, [(x, "file") for x in files] + [("dir:d0", "dir")], "id string, kind string")


def projected(files, rows, weights):
    layer = {}
    for n, a, b, w, *_ in rows:
        layer.setdefault(n, {})[a, b] = w
    for a in files:
        for b in files:
            if a < b and a.split("/")[0] == b.split("/")[0]:
                k = sum(x.split("/")[0] == a.split("/")[0] for x in files)
                layer["hierarchy"][a, b] = layer["hierarchy"].get((a, b), 0) + 1 / (k - 1)
    out = {}
    for n, pairs in layer.items():
        for p, w in pairs.items():
            if weights.get(n):
                out[p] = out.get(p, 0) + weights[n] * w / sum(pairs.values())
    return out


def test_file_projection_by_blocks(spark, folders, monkeypatch):
    """Blocks of a directory give every pair once, and pairs are neither dealt out nor summed once they are made."""
    files, rows, edges, nodes = folders
    monkeypatch.setattr(communities, "BLOCK", 4, raising=False)
    for weights in ({"hierarchy": 0.7, "structure": 0.3}, {"structure": 1.0, "hierarchy": 0.0}, {"evolution": 1.0}):
        pairs = communities.file_projection(edges, nodes, weights)
        got = [(r["a"], r["b"], r["weight"]) for r in pairs.collect()]
        want = projected(files, rows, weights)
        assert len(got) == len(want) and {(a, b): pytest.approx(w) for a, b, w in got} == want
    assert pairs._jdf.queryExecution().analyzed().toString().startswith("Union")


def test_detect_makes_no_pairs_of_a_directory(spark, folders, monkeypatch):
    files, rows, edges, nodes = folders
    monkeypatch.delattr(communities, "pairs_of", raising=False)
    monkeypatch.setattr(communities, "file_projection", None)
    weights = {"hierarchy": 0.7, "structure": 0.3}
    label = {r["file"]: r["community"] for r in communities.detect(edges, nodes, weights).collect()}
    assert sorted(label) == sorted(files)
    pairs = projected(files, rows, weights)
    a, b = (np.array([files.index(p[k]) for p in pairs]) for k in (0, 1))
    w = np.array(list(pairs.values()))
    by_pairs = communities.Leiden(1.0, w.sum(), 42).run(len(files), a, b, w)
    mine = communities.modularity(a, b, w, np.array([label[f] for f in files]))
    assert mine == pytest.approx(communities.modularity(a, b, w, by_pairs), abs=0.02) and mine > 0.3


# --- evaluation ---------------------------------------------------------------


def test_grid_and_metrics(spark):
    grid = evaluate.simplex_grid(spark).collect()
    assert len(grid) == 286 and all(abs(sum(r[k] for k in ("hierarchy", "structure", "evolution", "docs")) - 1) < 1e-9 for r in grid)
    q = table(spark, [(0, "a"), (1, "b")], "qid int, seed string")
    truth = table(spark, [(0, "b"), (1, "a"), (1, "c")], "qid int, node string")
    score = table(spark, [(0, "b", 1.0), (1, "a", 1.0), (1, "c", 0.5)], "qid int, node string, score double")
    ids = evaluate.tie_breaks(table(spark, [(x,) for x in "abcd"], "id string"))
    got = {r["qid"]: (r["rr"], r["r1"], r["r5"]) for r in evaluate.metrics(evaluate.positions(score, q, ids, truth), truth).collect()}
    assert got == {0: (1.0, 1.0, 1.0), 1: (1.0, 0.5, 1.0)}


def test_weight_tuning(spark, ring):
    edges, nodes = ring
    q = table(spark, [(k, f"n{k:02}") for k in range(5)], "qid int, seed string")
    truth = table(spark, [(k, f"n{k + 1:02}") for k in range(5)], "qid int, node string")
    grid = evaluate.simplex_grid(spark, 1)
    truth = truth.union(table(spark, [(0, "n07"), (1, "nobody"), (2, "n02"), (9, "n03")], "qid int, node string"))
    ties = evaluate.tie_breaks(nodes)
    best, results = evaluate.tune_weights(edges, nodes, q, truth, ties, grid, method="each")
    assert len(results) == 4 and max(v for _, v in results) == dict((tuple(w.items()), v) for w, v in results)[tuple(best.items())]
    for metric in ("mrr", "recall_5"):
        same, once = evaluate.tune_weights(edges, nodes, q, truth, ties, grid, metric, batch=2)
        assert [w for w, _ in once] == [w for w, _ in results] and (metric != "mrr" or same == best)
        if metric == "mrr":
            assert all(abs(x - y) < 1e-9 for (_, x), (_, y) in zip(once, results, strict=True))


@pytest.mark.parametrize("unique", [True, False])
def test_places_among_all_candidates(spark, unique):
    rng = random.Random(6)
    ids = [f"n{k:02}" for k in range(40)]
    tie = {x: rng.choice([0.0, 1e-3, 2e-3, rng.random()]) for x in ids}
    seeds = {(q, rng.choice([*ids, "far"])) for q in range(12) for _ in range(2)}
    scores = {(q, x): rng.choice([0.0, 1e-3, 0.5, rng.random(), -0.2]) for q in range(12) for x in [*ids, "off"] if rng.random() < 0.3}
    truth = {(q, rng.choice([*ids, "gone"])) for q in range(13) for _ in range(5)}
    want = {}
    for q, x in truth:
        total = {y: scores.get((q, y), 0.0) + tie[y] for y in ids if (q, y) not in seeds}
        if q < 12 and x in total:
            want[q, x] = 1 + sum(total[y] > total[x] or (unique and total[y] == total[x] and y < x) for y in total)
    got = evaluate.positions(
        table(spark, [(*k, v) for k, v in scores.items()], "qid int, node string, score double"), table(spark, list(seeds) * 2, "qid int, seed string"),
        table(spark, list(tie.items()), "id string, tie double"), table(spark, list(truth), "qid int, node string"), unique,
    )
    assert {(r["qid"], r["node"]): r["pos"] for r in got.collect()} == want


def test_ties_are_one_stream(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "BLOCK", 8)
    ids = [f"n{k:03}" for k in range(50)]
    got = {r["id"]: r["tie"] for r in evaluate.tie_breaks(table(spark, [(x,) for x in [*ids, *ids[:9]]], "id string").repartition(3), 5).collect()}
    assert got == dict(zip(ids, (np.random.default_rng(5).random(50) * 1e-12).tolist(), strict=True))
    assert evaluate.tie_breaks(table(spark, [], "id string")).count() == 0


def test_methods_on_sets(spark, tx, ring):
    edges, nodes = ring
    q = table(spark, [(0, "b"), (0, "d")], "qid int, seed string")
    truth = table(spark, [(0, "a")], "qid int, node string")
    ids = evaluate.tie_breaks(table(spark, [(x,) for x in "abcde"], "id string"))
    by = lambda scores: evaluate.evaluate_scores(scores, q, truth, ids, unique=False).first()
    assert by(evaluate.rule_scores(tx, q))["recall_5"] == 1.0 and by(evaluate.rule_scores(tx, q))["mrr"] >= 0.5
    assert 0 < by(evaluate.rule_scores(tx, q, "rose"))["mrr"] == by(None)["mrr"]  # no rule: only ties decide
    two = table(spark, [(0, "n00"), (0, "n05")], "qid int, seed string")
    scores = evaluate.walk_scores(edges, nodes, two, {"evolution": 1.0})
    assert abs(scores.agg(F.sum("score")).first()[0] - 1) < 1e-6


def test_set_queries_and_interval(spark):
    rows = [("ab" * 20, 0, f) for f in "abc"] + [("cd" * 20, 0, f) for f in "xy"]
    ch = table(spark, rows, "sha string, ts bigint, file string")
    got = {r["qid"]: r for r in evaluate.set_queries(ch).collect()}
    assert len(got) == 3
    want = np.random.default_rng([int("ab" * 6, 16), 2]).choice(["a", "b", "c"], size=2, replace=False).tolist()
    assert got["ab" * 20 + ":2"]["seeds"] == sorted(want) and len(got["ab" * 20 + ":2"]["truth"]) == 1
    v = table(spark, [(float(k % 2),) for k in range(100)], "v double")
    lo, hi = evaluate.bootstrap_interval(v, "v").first()
    assert 0.35 < lo < 0.5 < hi < 0.65
    draws = np.random.default_rng(1).integers(0, 100, (4000, 100))
    want = np.quantile((draws % 2).mean(axis=1), [0.025, 0.975])
    assert abs(lo - want[0]) <= 0.02 and abs(hi - want[1]) <= 0.02


# --- streaming ------------------------------------------------------------------


def test_stream_equals_batch(spark, tmp_path):
    epoch, day = 1_000_000_000, 86_400
    rng = random.Random(2)
    rows = [(f"s{k}", epoch + rng.randrange(900) * day, rng.sample("abcdefg", rng.randint(1, 4))) for k in range(80)]
    for n in range(4):
        table(spark, rows[n::4], "sha string, ts bigint, files array<string>").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    feed = spark.readStream.schema("sha string, ts bigint, files array<string>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sums = stream.pair_sums(feed, epoch)
    q = sums.writeStream.outputMode("complete").format("memory").queryName("pair_sums").start()
    try:
        q.processAllAvailable()
        at = epoch + 1000 * day
        got = {(r["a"], r["b"]): (round(r["weight"], 9), r["count"], r["last_change"]) for r in stream.weights_at(spark.table("pair_sums"), at, epoch).collect()}
    finally:
        q.stop()
    flat = table(spark, [(s, t, f) for s, t, fs in rows for f in fs], "sha string, ts bigint, file string")
    want = {(r["a"], r["b"]): (round(r["weight"], 9), r["count"], r["last_change"]) for r in cochange.cochange_pairs(flat, at).collect()}
    assert got == want
