"""Registered queries over projects that the fixture tables make up, each with SQL for the same rows.

Nations are the files of a package for each region, with their own scripts and notes; orders are
commits of a log. The SQL side works out what the files' texts must lead to, not how they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.functions import words
from weft.model import FileGraph, edge_parts, first_nodes, merge_edges
from weft.operators import cochange, docs, evaluate, graph, rules, structure, walk
from weft.plans.queries import CHAIN, CHANGES, SETS, SUPPLIERS, _split, chain, changes, edge_like, query, read, supplier_edges
from weft.sources import git

_NATIONS = (
    "nt AS (SELECT n_nationkey AS k, n_regionkey AS r, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS nx, (n_regionkey + 1) % 5 AS r2, "
    "(SELECT min(m.n_nationkey) FROM nation m WHERE m.n_regionkey = (nation.n_regionkey + 1) % 5) AS f FROM nation)"
)


def _nations(spark, d) -> DataFrame:
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    n = n.withColumn("nx", F.lead("k").over(W.partitionBy("r").orderBy("k"))).withColumn("r2", (F.col("r") + 1) % 5)
    return n.join(n.groupBy(F.col("r").alias("r2")).agg(F.min("k").alias("f")), "r2")


def _said(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _next() -> Column:
    return F.coalesce(F.col("nx").cast("string"), F.lit("gone"))


# --- commit log ---------------------------------------------------------------


@query(
    "WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS sha, CAST(epoch(o_orderdate) AS BIGINT) AS ts, CAST(o_orderkey AS BIGINT) AS seq, o_custkey AS c FROM orders) "
    "SELECT sha, ts, seq, 0 AS pos, 'M' AS status, 'src/' || c || '.py' AS path, NULL AS old_path FROM o UNION ALL SELECT sha, ts, seq, 1, 'R', 'src/new ' || c || '.py', 'src/é' || c || '.py' FROM o "
    "UNION ALL SELECT sha, ts, seq, 4, 'D', 'gone', NULL FROM o UNION ALL SELECT sha, ts, seq, 5, 'C', 'y', 'x' FROM o WHERE c % 2 = 0"
)
def log_parse(spark, d):
    c = F.col("o_custkey").cast("string")
    lines = ["M\tsrc/", c, ".py\nR087\tsrc/é", c, ".py\tsrc/new ", c, ".py\nX\nA\ttwo\tpaths\nD\tgone\n", F.when(F.col("o_custkey") % 2 == 0, "C100\tx\ty\n").otherwise("\n")]
    ts = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string")
    return git.parse_log(read(spark, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("seq"), _said(F.col("o_orderkey").cast("string"), "\x1f", ts, "\n\n", *lines).alias("record")))


# --- imports ------------------------------------------------------------------

_PY = (
    "py AS (SELECT 'src/pkg/r' || r || '/n' || k || '.py' AS importer, 'src/pkg/r' || r || CASE WHEN nx IS NULL THEN '/__init__.py' ELSE '/n' || nx || '.py' END AS target, 'n' || coalesce(CAST(nx AS VARCHAR), 'gone') AS symbols FROM nt "
    "UNION ALL SELECT 'src/pkg/r' || r || '/n' || k || '.py', 'src/pkg/r' || r2 || '/n' || f || '.py', 'n' || f FROM nt UNION ALL SELECT 'src/pkg/r' || r || '/n' || k || '.py', 'src/pkg/r' || r2 || '/__init__.py', 'missing' FROM nt)"
)
_JS_FILE = "'web/r' || r || '/n' || {0} || CASE WHEN {0} % 2 = 0 THEN '.ts' ELSE '.js' END"
_JS = (
    f"js AS (SELECT {_JS_FILE.format('k')} AS importer, 0 AS ord, {_JS_FILE.format('nx')} AS target FROM nt WHERE nx IS NOT NULL UNION ALL SELECT {_JS_FILE.format('k')}, 1, 'web/lib/index.js' FROM nt "
    f"UNION ALL SELECT {_JS_FILE.format('k')}, 3, {_JS_FILE.format('nx')} FROM nt WHERE nx % 2 = 1)"
)


def _python(spark, d) -> tuple[DataFrame, DataFrame]:
    """Sources (path, text) and all files (path)."""
    n = _nations(spark, d)
    text = _said("import os\nfrom . import n", _next(), "\nfrom pkg.r", F.col("r2").cast("string"), " import n", F.col("f").cast("string"), " as other, missing\nfrom ..r", F.col("r").cast("string"), " import n", F.col("k").cast("string"), "\n")
    own = n.select(_said("src/pkg/r", F.col("r").cast("string"), "/n", F.col("k").cast("string"), ".py").alias("path"), text.alias("text"))
    init = n.select(_said("src/pkg/r", F.col("r").cast("string"), "/__init__.py").alias("path")).distinct().union(spark.createDataFrame([("src/pkg/__init__.py",), ("tools/broken.py",)], "path string"))
    sources = own.unionByName(init.withColumn("text", F.lit("def broken(:\n")))
    return sources, sources.select("path")


def _javascript(spark, d) -> tuple[DataFrame, DataFrame]:
    n = _nations(spark, d)
    path = _said("web/r", F.col("r").cast("string"), "/n", F.col("k").cast("string"), F.when(F.col("k") % 2 == 0, ".ts").otherwise(".js"))
    text = _said("import a from './n", _next(), "'\nexport * from \"../lib\"\nconst b = require('./nowhere')\nimport('./n", _next(), ".js')\nimport 'react'\n")
    sources = n.select(path.alias("path"), text.alias("text")).union(spark.createDataFrame([("web/lib/index.js", "")], "path string, text string"))
    return sources, sources.select("path")


@query(f"WITH {_NATIONS}, {_PY} SELECT importer, target, symbols FROM py")
def python_imports(spark, d):
    return structure.python_imports(*_python(spark, d)).select("importer", "target", F.array_join("symbols", ",").alias("symbols"))


@query(f"WITH {_NATIONS}, {_JS} SELECT importer, ord, target FROM js")
def javascript_imports(spark, d):
    return structure.javascript_imports(*_javascript(spark, d))


@query(
    f"WITH {_NATIONS}, {_PY}, {_JS}, al AS (SELECT importer, target FROM py UNION ALL SELECT importer, target FROM js) "
    "SELECT least(importer, target) AS a, greatest(importer, target) AS b, CAST(count(*) AS DOUBLE) AS weight, CAST(count(DISTINCT importer) AS BIGINT) AS directions FROM al GROUP BY 1, 2"
)
def structure_layer(spark, d):
    parts = structure.structure_parts(structure.python_imports(*_python(spark, d)), structure.javascript_imports(*_javascript(spark, d)))
    return merge_edges(edge_parts(parts)).select("a", "b", "weight", F.size("detail.imports").cast("long").alias("directions"))


# --- documents ----------------------------------------------------------------

_DOC = "'docs/n' || k || '.md'"


@query(
    f"WITH {_NATIONS} SELECT {_DOC} AS doc, 0 AS ord, 'link' AS kind, 'docs/n' || nx || '.md' AS target FROM nt WHERE nx IS NOT NULL UNION ALL SELECT {_DOC}, 2, 'link', 'docs/n0.md' FROM nt WHERE k <> 0 "
    f"UNION ALL SELECT {_DOC}, 3, 'role', 'src/pkg/r' || r || '/__init__.py' FROM nt UNION ALL SELECT {_DOC}, 4, 'directive', 'src/pkg/r' || r || '/n' || k || '.py' FROM nt "
    f"UNION ALL SELECT {_DOC}, 5, 'mention', 'src/pkg/r' || r || '/__init__.py' FROM nt UNION ALL SELECT {_DOC}, 6, 'mention', 'src/pkg/__init__.py' FROM nt"
)
def doc_references(spark, d):
    n = _nations(spark, d)
    k, r = F.col("k").cast("string"), F.col("r").cast("string")
    text = _said("See [next](n", _next(), ".md?x=1#frag) or [site](https://a.b/c) or [top](/docs/n0).\n:mod:`pkg.r", r, "` and ``src/pkg/__init__.py``\n\n.. automodule:: pkg.r", r, ".n", k, "\n")
    notes = n.select(_said("docs/n", k, ".md").alias("path"), text.alias("text"))
    files = _python(spark, d)[1].withColumn("lang", F.lit("python")).unionByName(notes.select("path", F.lit("markdown").alias("lang")))
    return docs.references(notes, files)


_NORMAL = "list_reduce(list_prepend('', string_split({0}, '/')), lambda acc, x: CASE WHEN x = '..' THEN regexp_replace(acc, '/?[^/]*$', '') WHEN x IN ('.', '') THEN acc WHEN acc = '' THEN x ELSE acc || '/' || x END)"


@query(
    "WITH rf AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS target FROM pages), u AS (SELECT page_id, target FROM rf UNION SELECT page_id, regexp_replace(url, '^https?://[^/]*', '../..') FROM pages UNION SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') FROM pages), "
    "t AS (SELECT 'site/' || page_id % 5 || '/index.md' AS doc, 'site/' || page_id % 5 AS here, target, split_part(split_part(target, '#', 1), '?', 1) AS t FROM u), x AS (SELECT doc, target, t, regexp_replace(t, '^/+', '') AS top, here || '/' || t AS near FROM t) "
    f"SELECT DISTINCT doc, target, CASE WHEN t = '' OR contains(t, '://') OR starts_with(t, 'mailto:') THEN NULL WHEN starts_with(t, '/') THEN {_NORMAL.format('top')} ELSE {_NORMAL.format('near')} END AS path FROM x"
)
def doc_target_paths(spark, d):
    p = read(spark, d, "pages")
    bare = lambda to: F.regexp_replace("url", "^https?://[^/]*", to)
    each = F.array_union(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1), F.array(bare("../.."), bare("")))
    rows = p.select(_said("site/", (F.col("page_id") % 5).cast("string"), "/index.md").alias("doc"), F.explode(each).alias("target")).distinct()
    return rows.select("doc", "target", docs.target_path(F.col("target"), F.col("doc")).alias("path"))


# --- nodes and words ------------------------------------------------------------


@query("SELECT CAST(l_partkey AS VARCHAR) AS id, arg_min(l_linestatus, l_orderkey * 10 + l_linenumber) AS lang, arg_min(l_suppkey, l_orderkey * 10 + l_linenumber) AS lines FROM lineitem GROUP BY l_partkey")
def node_first_wins(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("id"), F.col("l_linestatus").alias("lang"), F.col("l_suppkey").alias("lines"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return first_nodes(rows, "seq").select("id", "lang", "lines")


@query(
    "WITH s AS (SELECT s_suppkey AS k FROM supplier), x AS (SELECT k, list_filter([CASE WHEN k % 2 = 0 THEN 'a -> ' || k END, CASE WHEN k % 3 = 0 THEN 'changed together in ' || k || ' commits' END, CASE WHEN k % 5 = 0 THEN 'test named after the module' END, "
    "CASE WHEN k % 7 = 0 THEN 'documentation reference (link, mention)' END], lambda y: y IS NOT NULL) AS l FROM s) SELECT k, array_to_string(CASE WHEN len(l) = 0 AND k % 11 <> 0 THEN ['same directory'] ELSE l END, '; ') AS reasons FROM x"
)
def link_reasons(spark, d):
    k = F.col("s_suppkey")
    near = F.when(k % 11 != 0, True)  # unknown counts as not near
    said = words.link_reasons(F.when(k % 2 == 0, F.array(_said("a -> ", k.cast("string")))), F.when(k % 3 == 0, k), k % 5 == 0, F.when(k % 7 == 0, F.array(F.lit("link"), F.lit("mention"))), near)
    return read(spark, d, "supplier").select(k.alias("k"), F.array_join(said, "; ").alias("reasons"))


@query("SELECT p_partkey AS k, '[[' || p_type || '/' || p_name || '|' || p_name || ']]' AS wiki, '`' || p_type || '/' || p_name || '`' AS code, CASE WHEN p_partkey % 4 = 0 THEN 'weft/c-none' ELSE 'weft/c0' || p_partkey % 4 END AS tag FROM part")
def note_words(spark, d):
    path, k = _said(F.col("p_type"), "/", F.col("p_name")), F.col("p_partkey")
    return read(spark, d, "part").select(k.alias("k"), words.wiki(path).alias("wiki"), words.code(path).alias("code"), words.community_tag(F.when(k % 4 != 0, k % 4)).alias("tag"))


# --- rankings -------------------------------------------------------------------


@query(
    f"WITH {CHANGES.format('l_suppkey')}, {SETS.format(30)}, ps AS (SELECT x.file AS qid, y.file AS file, count(*) AS support FROM tx x JOIN tx y ON x.sha = y.sha AND x.file <> y.file GROUP BY 1, 2), nq AS (SELECT file AS qid, count(*) AS n FROM tx GROUP BY file) "
    "SELECT qid, file, support, row_number() OVER (PARTITION BY qid ORDER BY support DESC, support / n DESC, file) AS place FROM ps JOIN nq USING (qid)"
)
def rule_order(spark, d):
    tx = cochange.transactions(changes(spark, d, "l_suppkey"))
    asked = read(spark, d, "supplier").select(F.col("s_suppkey").alias("qid"), F.col("s_suppkey").alias("file"))
    found = rules.whole_query_rules(tx, asked)
    by = W.partitionBy("qid").orderBy(F.desc(rules.rule_value(F.col("support"), F.col("confidence"))), "file")
    return found.select("qid", "file", "support", F.row_number().over(by).alias("place"))


@query(
    f"WITH {CHANGES.format('l_suppkey')}, {SETS.format(30)}, cut AS (SELECT ts AS t FROM (SELECT CAST(epoch(o_orderdate) AS BIGINT) AS ts FROM orders) ORDER BY ts LIMIT 1 OFFSET (SELECT CAST(floor(0.5 * count(*)) AS BIGINT) FROM orders)), "
    "new AS (SELECT tx.* FROM tx, cut WHERE tx.ts > t), tr AS (SELECT DISTINCT x.file AS seed, y.file AS node FROM new x JOIN new y ON x.sha = y.sha AND x.file <> y.file), "
    "ps AS (SELECT s.seed, u.s_suppkey AS node, row_number() OVER (PARTITION BY s.seed ORDER BY u.s_suppkey) AS pos FROM (SELECT DISTINCT seed FROM tr) s JOIN supplier u ON u.s_suppkey <> s.seed), "
    "me AS (SELECT seed, 1.0 / min(pos) AS rr, count(*) FILTER (pos <= 1) / count(*) AS r1, count(*) FILTER (pos <= 5) / count(*) AS r5, count(*) FILTER (pos <= 10) / count(*) AS r10 FROM tr JOIN ps USING (seed, node) GROUP BY seed) "
    "SELECT round(avg(rr), 6) AS mrr, round(avg(r1), 6) AS recall_1, round(avg(r5), 6) AS recall_5, round(avg(r10), 6) AS recall_10 FROM me"
)
def baseline_without_scores(spark, d):
    """No scores at all: only ties decide, and with equal ties the order of ids."""
    _, new, files = _split(spark, d)
    truth = cochange.seed_queries(new).select(F.col("seed").alias("qid"), F.col("truth").alias("node"), "seed").distinct()
    out = evaluate.evaluate_scores(None, truth.select("qid", "seed").distinct(), truth.select("qid", "node"), files)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(
    f"{SUPPLIERS}, h AS (SELECT count(*) > 0 AS y FROM pr) SELECT 'edges' AS of, layer, CAST(CASE WHEN y THEN w ELSE s END AS DOUBLE) AS weight FROM h, (VALUES ('hierarchy', 0.3, 0.7), ('structure', 0.0, 0.3), ('evolution', 0.7, 0.0), ('docs', 0.0, 0.0)) AS v(layer, w, s) "
    "UNION ALL SELECT 'structure alone', layer, CAST(s AS DOUBLE) FROM (VALUES ('hierarchy', 0.7), ('structure', 0.3), ('evolution', 0.0), ('docs', 0.0)) AS v(layer, s)"
)
def default_weights(spark, d):
    e = supplier_edges(spark, d)
    rows = [(of, k, float(w)) for of, edges in (("edges", e), ("structure alone", e.where("layer = 'structure'"))) for k, w in walk.default_weights(edges).items()]
    return spark.createDataFrame(rows, "of string, layer string, weight double")


@query(
    f"WITH {CHAIN}, n AS (SELECT s_nationkey AS k FROM supplier GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT row_number() OVER (ORDER BY a) AS hop, a AS \"from\", b AS \"to\", 'structure' AS layer "
    "FROM chain JOIN supplier ON s_suppkey = a WHERE s_nationkey = (SELECT k FROM n)"
)
def connection_path(spark, d):
    """Along the chain of the nation with the most suppliers, from its first to its last: there is one way only."""
    s = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("a"), F.max("s_suppkey").alias("b"))
    ends = s.orderBy(F.desc("n"), "s_nationkey").first()
    links = chain(spark, d).select(F.lit("structure").alias("layer"), F.col("a").alias("u"), F.col("b").alias("v"), F.lit(1.0).alias("weight"), F.lit("import").alias("kind"))
    g = FileGraph(read(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), merge_edges(edge_like(links)), spark.createDataFrame([], "file long, community int"))
    found = graph.connection_path(g, ends["a"], ends["b"]) if ends["n"] > 1 else []  # a lone supplier has no links
    rows = [(k, x["from"], x["to"], x["layer"]) for k, x in enumerate(found, 1)]
    return spark.createDataFrame(rows, "hop long, from long, to long, layer string")

