"""Registered queries over the fixture tables, each with SQL for the same rows where SQL can say it.

Orders are commits and their parts or suppliers the files; a chain of suppliers within
each nation is the structure layer. All queries run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.functions import paths, words
from weft.model import FileGraph, edge_parts, merge_edges
from weft.operators import cochange, communities, docs, evaluate, graph, hierarchy, history, modules, rules, walk
from weft.staging import stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], columns: str) -> str:
    def one(x) -> str:
        return "NULL" if x is None else ("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x))

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({columns})"


# --- fixtures ---------------------------------------------------------------

CHANGES = "ch AS (SELECT DISTINCT l_orderkey AS sha, CAST(epoch(o_orderdate) AS BIGINT) AS ts, {0} AS file FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
SETS = "tx AS (SELECT sha, ts, file, count(*) OVER (PARTITION BY sha) AS n FROM ch QUALIFY n BETWEEN 2 AND {0})"
LAST = "(SELECT CAST(epoch(max(o_orderdate)) AS BIGINT) FROM orders)"
PAIRS = (
    "pr AS (SELECT x.file AS a, y.file AS b, sum(pow(0.5, greatest({0} - x.ts, 0) / (365.0 * 86400)) / (x.n - 1)) AS weight, count(*) AS cnt, max(x.ts) AS last_change "
    "FROM tx x JOIN tx y ON x.sha = y.sha AND x.file < y.file GROUP BY x.file, y.file)"
).format(LAST)
CHAIN = "chain AS (SELECT * FROM (SELECT s_suppkey AS a, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS b FROM supplier) WHERE b IS NOT NULL)"
LANG = "CASE s_suppkey % 7 WHEN 0 THEN 'markdown' WHEN 1 THEN 'config' WHEN 2 THEN 'javascript' WHEN 3 THEN 'style' ELSE 'python' END"
NODES = f"nd AS (SELECT s_suppkey AS id, {LANG} AS lang, s_suppkey % 5 = 0 AS is_test, coalesce(c.changes, 0) AS changes FROM supplier LEFT JOIN (SELECT file, count(*) AS changes FROM ch GROUP BY file) c ON s_suppkey = c.file)"
SUPPLIERS = f"WITH {CHANGES.format('l_suppkey')}, {SETS.format(30)}, {PAIRS}, {CHAIN}, {NODES}"


def changes(spark: SparkSession, d: str, file: str = "l_partkey") -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"))
    rows = read(spark, d, "lineitem").select("l_orderkey", file).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("l_orderkey").alias("sha"), "ts", F.col(file).alias("file")).distinct()


def reference_time(spark: SparkSession, d: str) -> int:
    return read(spark, d, "orders").agg(F.unix_timestamp(F.max("o_orderdate").cast("timestamp"))).first()[0]


def pairs(spark: SparkSession, d: str, file: str = "l_partkey", most: int = 30) -> DataFrame:
    return cochange.cochange_pairs(changes(spark, d, file), reference_time(spark, d), most)


def chain(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("s_nationkey").orderBy("s_suppkey")
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), F.lead("s_suppkey").over(w).alias("b")).where("b is not null")


def supplier_nodes(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    lang = F.when(key % 7 == 0, "markdown").when(key % 7 == 1, "config").when(key % 7 == 2, "javascript").when(key % 7 == 3, "style").otherwise("python")
    n = cochange.change_counts(changes(spark, d, "l_suppkey"))
    s = read(spark, d, "supplier").select(key.alias("id"), F.lit("file").alias("kind"), lang.alias("lang"), (key % 5 == 0).alias("is_test"), F.lit(0).cast("long").alias("lines"))
    return s.join(n, s["id"] == n["file"], "left").select("id", "kind", "lang", "is_test", "lines", F.coalesce("changes", F.lit(0)).alias("changes"))


def supplier_edges(spark: SparkSession, d: str) -> DataFrame:
    """Co-change and chain layers, as merged edges."""
    co = pairs(spark, d, "l_suppkey").select(F.lit("evolution").alias("layer"), F.col("a").alias("u"), F.col("b").alias("v"), "weight", F.lit("co-change").alias("kind"), "count", "last_change")
    st = chain(spark, d).select(F.lit("structure").alias("layer"), F.col("a").alias("u"), F.col("b").alias("v"), F.lit(1.0).alias("weight"), F.lit("import").alias("kind"))
    return stage(merge_edges(edge_like(co).unionByName(edge_like(st))), "edges")


def edge_like(df: DataFrame) -> DataFrame:
    wanted = {"seq": "bigint", "count": "bigint", "last_change": "bigint", "imports": "array<string>", "symbols": "array<string>", "mentions": "bigint"}
    return df.select("layer", "u", "v", "weight", "kind", *(F.col(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in wanted.items()))


def supplier_graph(spark: SparkSession, d: str) -> FileGraph:
    commits = changes(spark, d, "l_suppkey").select("sha").distinct().count()
    none = spark.createDataFrame([], "file long, community int")
    return FileGraph(stage(supplier_nodes(spark, d), "nodes"), supplier_edges(spark, d), none, {"commits": commits, "weights": {"evolution": 0.7, "structure": 0.3}})


# --- co-change --------------------------------------------------------------

_PAIR_OUT = "SELECT a, b, round(weight, 6) AS weight, cnt AS count, last_change FROM pr"


def _pair_out(p: DataFrame) -> DataFrame:
    return p.select("a", "b", F.round("weight", 6).alias("weight"), "count", "last_change")


@query(f"WITH {CHANGES.format('l_partkey')}, {SETS.format(30)}, {PAIRS} {_PAIR_OUT}")
def cochange_pairs(spark, d):
    return _pair_out(pairs(spark, d))


@query(f"WITH {CHANGES.format('l_partkey')}, {SETS.format(5)}, {PAIRS} {_PAIR_OUT}")
def cochange_pairs_capped(spark, d):
    return _pair_out(pairs(spark, d, most=5))


@query(f"WITH {CHANGES.format('l_suppkey')}, {SETS.format(30)}, {PAIRS} SELECT a, b, round(weight, 6) AS weight FROM pr")
def decayed_edge_weights(spark, d):
    return pairs(spark, d, "l_suppkey").select("a", "b", F.round("weight", 6).alias("weight"))


@query(f"WITH {CHANGES.format('l_partkey')} SELECT file, count(*) AS changes FROM ch GROUP BY file")
def file_change_counts(spark, d):
    return cochange.change_counts(changes(spark, d))


@query(f"WITH {CHANGES.format('l_partkey')}, {SETS.format(30)} SELECT sha, string_agg(file, ',' ORDER BY file) AS files FROM tx GROUP BY sha")
def transactions(spark, d):
    return cochange.transactions(changes(spark, d)).select("sha", F.array_join("files", ",").alias("files"))


@query(f"WITH {CHANGES.format('l_partkey')}, {SETS.format(30)} SELECT x.sha, x.file AS seed, y.file AS truth FROM tx x JOIN tx y ON x.sha = y.sha AND x.file <> y.file")
def make_queries(spark, d):
    return cochange.seed_queries(changes(spark, d))


@query("SELECT age, hl, round(CASE WHEN hl = 0 THEN 1 ELSE pow(0.5, greatest(age, 0) / (hl * 86400.0)) END, 9) AS decay FROM (SELECT CAST(epoch(l_shipdate) AS BIGINT) - 915148800 AS age, unnest([0, 30, 365]) AS hl FROM lineitem)")
def decay(spark, d):
    age = (F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) - 915148800).alias("age")
    rows = read(spark, d, "lineitem").select(age, F.explode(F.array(F.lit(0), F.lit(30), F.lit(365))).alias("hl"))
    by = F.when(F.col("hl") == 0, cochange.decay(F.col("age"), None)).when(F.col("hl") == 30, cochange.decay(F.col("age"), 30)).otherwise(cochange.decay(F.col("age"), 365))
    return rows.select("age", "hl", F.round(by, 9).alias("decay"))


# --- association rules ------------------------------------------------------

_ASK = (
    f"WITH {CHANGES.format('l_partkey')}, {SETS.format(30)}, "
    "q AS (SELECT sha AS qid, file FROM (SELECT sha, file, row_number() OVER (PARTITION BY sha ORDER BY file) AS k FROM tx WHERE n >= 3) WHERE k <= 2), "
    "ov AS (SELECT qid, t.sha, count(*) AS n FROM q JOIN tx t ON t.file = q.file GROUP BY qid, t.sha)"
)


def _first_two(tx: DataFrame) -> DataFrame:
    """A query for each commit of three files or more: its first two."""
    return tx.where(F.size("files") >= 3).select(F.col("sha").alias("qid"), F.explode(F.slice("files", 1, 2)).alias("file"))


def _rules(df: DataFrame) -> DataFrame:
    return df.select("qid", "file", "support", F.round("confidence", 6).alias("confidence"), F.round(rules.rule_value(F.col("support"), F.col("confidence")), 6).alias("value"))


@query(
    f"{_ASK}, hit AS (SELECT qid, sha FROM ov WHERE n = 2), tot AS (SELECT qid, count(*) AS total FROM hit GROUP BY qid), "
    "r AS (SELECT h.qid, t.file, count(*) AS support FROM hit h JOIN tx t ON t.sha = h.sha WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.qid = h.qid AND q.file = t.file) GROUP BY h.qid, t.file) "
    "SELECT qid, file, support, round(support / total, 6) AS confidence, round(support + 0.5 * (support / total), 6) AS value FROM r JOIN tot USING (qid)"
)
def rose_rules(spark, d):
    tx = stage(cochange.transactions(changes(spark, d)), "tx")
    return _rules(rules.whole_query_rules(tx, _first_two(tx)))


@query(
    f"{_ASK}, best AS (SELECT qid, max(n) AS n FROM ov GROUP BY qid), kept AS (SELECT ov.qid, ov.sha FROM ov JOIN best USING (qid, n)), "
    "ante AS (SELECT k.qid, k.sha, string_agg(t.file, ',' ORDER BY t.file) AS ante FROM kept k JOIN tx t ON t.sha = k.sha JOIN q ON q.qid = k.qid AND q.file = t.file GROUP BY k.qid, k.sha), "
    "tot AS (SELECT qid, ante, count(*) AS total FROM ante GROUP BY qid, ante), "
    "r AS (SELECT a.qid, a.ante, t.file, count(*) AS support FROM ante a JOIN tx t ON t.sha = a.sha WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.qid = a.qid AND q.file = t.file) GROUP BY a.qid, a.ante, t.file), "
    "s AS (SELECT qid, file, support, support / total AS confidence, row_number() OVER (PARTITION BY qid, file ORDER BY support DESC, support / total DESC) AS k FROM r JOIN tot USING (qid, ante)) "
    "SELECT qid, file, support, round(confidence, 6) AS confidence, round(support + 0.5 * confidence, 6) AS value FROM s WHERE k = 1"
)
def tarmaq_rules(spark, d):
    tx = stage(cochange.transactions(changes(spark, d)), "tx")
    return _rules(rules.largest_overlap_rules(tx, _first_two(tx)))


@query(
    f"WITH {CHANGES.format('l_partkey')}, {SETS.format(30)}, q AS (SELECT o_custkey AS qid, unnest([min(l_partkey), max(l_partkey)]) AS file FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey), "
    "d AS (SELECT DISTINCT qid, file FROM q), need AS (SELECT qid, count(*) AS k FROM d GROUP BY qid), hit AS (SELECT d.qid, tx.sha, count(*) AS k FROM d JOIN tx USING (file) GROUP BY d.qid, tx.sha) "
    "SELECT qid, EXISTS (SELECT 1 FROM hit WHERE hit.qid = need.qid AND hit.k = need.k) AS seen FROM need"
)
def is_seen(spark, d):
    tx = stage(cochange.transactions(changes(spark, d)), "tx")
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    ends = read(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("qid")).agg(F.array(F.min("l_partkey"), F.max("l_partkey")).alias("f"))
    return rules.is_seen(tx, ends.select("qid", F.explode("f").alias("file")))


# --- paths and words --------------------------------------------------------

_PATHS = [
    "a/b.PY", "Makefile", "image.png", "src/x.tsx", "docs/LICENSE", "a.b.md", ".env", "x/.py", "pkg/__init__.py", "tests/test_core.py", "src/app.spec.ts", "a/tests/b/c.go", "test/x.js", "Tests/x.py",
    "a/core_test.py", "a/b_test.go", "TEST_a.py", "conftest.py", "spec/a.rb", "a/my.test.js", "noext", "a.tar.gz", "lib/mod.Rs", "tests.py", "a/testing/x.c", "x/test_.py", "setup.cfg", "v.json", "q.j2",
]
def _path_rows(spark, d) -> DataFrame:
    """Every path below each nation's directory."""
    dirs = read(spark, d, "nation").select(F.when(F.col("n_nationkey") == 0, "").otherwise(F.concat("n_name", F.lit("/"))).alias("dir"))
    return dirs.select(F.explode(F.transform(F.array(*map(F.lit, _PATHS)), lambda p: F.concat("dir", p))).alias("path"))


_PATH_ROWS = f"p AS (SELECT CASE WHEN n_nationkey = 0 THEN '' ELSE n_name || '/' END || v.path AS path, v.path AS tail FROM nation, {sql_values([(p,) for p in _PATHS], 'path')})"
_NAME = "regexp_extract(path, '[^/]*$')"
_SUFFIX = f"regexp_extract({_NAME}, '^.+?(\\.[^.]+)$', 1)"
_STEM = f"left({_NAME}, length({_NAME}) - length({_SUFFIX}))"
_case = lambda col, d: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.items()) + " END"
_LANG = f"coalesce({_case(f'lower({_SUFFIX})', paths.LANGUAGES)}, {_case(_NAME, paths.WHOLE_NAMES)})"
_TEST = (
    "(len(list_filter(string_split(path, '/')[:-2], lambda x: x IN (" + ", ".join(f"'{t}'" for t in paths.TEST_DIRS) + f"))) > 0 OR lower({_NAME}) LIKE 'test\\_%' ESCAPE '\\' OR "
    + " OR ".join(f"ends_with(lower({_NAME}), '{e}')" for e in paths.TEST_ENDS) + ")"
)


@query(f"WITH {_PATH_ROWS} SELECT path, {_LANG} AS lang FROM p")
def language_of(spark, d):
    return _path_rows(spark, d).select("path", paths.language_of(F.col("path")).alias("lang"))


@query(f"WITH {_PATH_ROWS} SELECT path, {_TEST} AS is_test FROM p")
def is_test_path(spark, d):
    return _path_rows(spark, d).select("path", paths.is_test_path(F.col("path")).alias("is_test"))


_BARE = f"regexp_extract({_STEM}, '^(?:test_)?(.+?)(?:_test|\\.test|\\.spec)?$', 1)"


@query(f"WITH {_PATH_ROWS}, b AS (SELECT path, {_STEM} AS s, CASE WHEN {_BARE} = '' THEN {_STEM} ELSE {_BARE} END AS bare FROM p) SELECT path, CASE WHEN bare <> s OR s LIKE 'test%' THEN bare END AS stem FROM b")
def tested_stem(spark, d):
    return _path_rows(spark, d).select("path", paths.tested_stem(F.col("path")).alias("stem"))


@query(f"WITH {_PATH_ROWS} SELECT path, regexp_matches(path, '(^|/)\\.github(/|$)') OR {_NAME} IN (" + ", ".join(f"'{c}'" for c in paths.CI_NAMES) + f") AS ci, CASE WHEN path LIKE '%/%' THEN 'dir:' || regexp_extract(path, '^(.*)/', 1) ELSE 'dir:.' END AS dir FROM p")
def ci_and_directory(spark, d):
    p = F.col("path")
    return _path_rows(spark, d).select("path", paths.is_ci(p).alias("ci"), paths.dir_id(paths.parent(p)).alias("dir"))


_ODD = [(p,) for p in ("a/./b", "a/../b", "../a", "a/b/../../..", "./x/./y.py", "a//b", "x/../../y/z", "..", ".", "a/b/c/../d")]


@query(
    f"WITH v AS (SELECT n_name || '/' || v.path AS path FROM nation, {sql_values(_ODD, 'path')}), "
    "r AS (SELECT path, list_reduce(list_prepend('', string_split(path, '/')), lambda acc, x: CASE WHEN x = '..' THEN regexp_replace(acc, '/?[^/]*$', '') WHEN x IN ('.', '') THEN acc WHEN acc = '' THEN x ELSE acc || '/' || x END) AS normal FROM v) SELECT path, normal FROM r"
)
def path_normalize(spark, d):
    tails = F.array(*(F.lit(p) for (p,) in _ODD))
    rows = read(spark, d, "nation").select(F.explode(F.transform(tails, lambda t: F.concat("n_name", F.lit("/"), t))).alias("path"))
    return rows.select("path", paths.normalized(F.col("path")).alias("normal"))


def _sr(one, few, many):
    return f"CASE WHEN n % 10 = 1 AND n % 100 <> 11 THEN '{one}' WHEN n % 10 BETWEEN 2 AND 4 AND n % 100 NOT BETWEEN 12 AND 14 THEN '{few}' ELSE '{many}' END"


@query(
    "WITH c AS (SELECT DISTINCT p_partkey AS n FROM part) SELECT n, n || ' ' || CASE WHEN n = 1 THEN 'commit' ELSE 'commits' END AS en_commits, "
    f"n || ' ' || {_sr(*words.UNITS['sr']['commits'])} AS sr_commits, n || ' ' || {_sr(*words.UNITS['sr']['lines'])} AS sr_lines, 'weft/c' || lpad(CAST(n AS VARCHAR), CAST(greatest(2, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS tag FROM c"
)
def count_word(spark, d):
    n = F.col("p_partkey")
    rows = read(spark, d, "part").select(n).distinct()
    return rows.select(n.alias("n"), words.count_word(n, "commits", "en").alias("en_commits"), words.count_word(n, "commits", "sr").alias("sr_commits"), words.count_word(n, "lines", "sr").alias("sr_lines"), words.community_tag(n).alias("tag"))


_CLASSES = "CASE WHEN ca AND cb THEN 'ci' WHEN fa AND fb THEN 'config_config' WHEN fa OR fb THEN CASE WHEN ka OR kb THEN 'config_code' ELSE 'other' END WHEN ka AND kb THEN CASE WHEN ta AND tb THEN 'test_test' WHEN ta OR tb THEN 'test_code' WHEN la = lb THEN 'code_code' ELSE 'cross_language' END WHEN ca OR cb THEN 'ci' ELSE 'other' END"
_CODE = "(" + ", ".join(f"'{x}'" for x in (*paths.CODE_LANGUAGES, "template", "style")) + ")"
_CI_PATHS = [*_PATHS, "tox.ini", ".github/w.yml", "noxfile.py", "README.rst", "a/style.css"]


@query(
    f"WITH p AS (SELECT path FROM {sql_values([(p,) for p in _CI_PATHS], 'path')}), k AS (SELECT path, {_LANG} AS l, {_TEST} AS t, "
    f"regexp_matches(path, '(^|/)\\.github(/|$)') OR {_NAME} IN (" + ", ".join(f"'{c}'" for c in paths.CI_NAMES) + ") AS c FROM p), "
    f"x AS (SELECT a.path AS a, b.path AS b, a.l AS la, b.l AS lb, a.t AS ta, b.t AS tb, a.c AS ca, b.c AS cb, coalesce(a.l IN ('config', 'build'), false) AS fa, coalesce(b.l IN ('config', 'build'), false) AS fb, coalesce(a.l IN {_CODE}, false) AS ka, coalesce(b.l IN {_CODE}, false) AS kb FROM k a, k b WHERE a.path < b.path) "
    f"SELECT a, b, {_CLASSES} AS category FROM x"
)
def classify_pair(spark, d):
    k = values(spark, [(p,) for p in _CI_PATHS], "path string").select("path", paths.language_of(F.col("path")).alias("l"), paths.is_test_path(F.col("path")).alias("t"))
    a, b = (k.select(*(F.col(c).alias(f"{c}{s}") for c in k.columns)) for s in "ab")
    rows = a.join(b, F.col("patha") < F.col("pathb"))  # pairs of a literal list
    return rows.select(F.col("patha").alias("a"), F.col("pathb").alias("b"), paths.classify_pair(F.col("patha"), F.col("la"), F.col("ta"), F.col("pathb"), F.col("lb"), F.col("tb")).alias("category"))


# --- hierarchy --------------------------------------------------------------

_PART_PATH = "p_type || '/' || p_brand || '/' || p_partkey"


@query(
    f"WITH f AS (SELECT p_type AS t, p_type || '/' || p_brand AS b, {_PART_PATH} AS path FROM part) "
    "SELECT path AS child, 'dir:' || b AS parent FROM f UNION SELECT 'dir:' || b, 'dir:' || t FROM f UNION SELECT 'dir:' || t, 'dir:.' FROM f"
)
def containment_edges(spark, d):
    return hierarchy.containment(read(spark, d, "part").select(F.concat_ws("/", "p_type", "p_brand", "p_partkey").alias("path")))


_MODULE_FILES = "f AS (SELECT DISTINCT p_type || '/' || p_brand || '/' || CASE WHEN p_size % 5 = 0 THEN 'test_' WHEN p_size % 7 = 0 THEN '_' ELSE '' END || 'm' || (p_partkey // 4) AS stem, CASE p_size % 2 WHEN 0 THEN 'python' ELSE 'go' END AS lang, p_size % 5 = 0 AS is_test, p_type, p_brand, p_partkey // 4 AS k FROM part)"


@query(
    f"WITH {_MODULE_FILES}, x AS (SELECT a.stem || '.' || a.lang AS test, b.stem || '.' || b.lang AS module, CASE WHEN a.p_type <> b.p_type THEN 0 WHEN a.p_brand <> b.p_brand THEN 1 ELSE 2 END AS near FROM f a JOIN f b ON a.k = b.k AND a.lang = b.lang AND a.is_test AND NOT b.is_test), "
    "r AS (SELECT test, module, row_number() OVER (PARTITION BY test ORDER BY near DESC, module) AS n FROM x) SELECT test, module FROM r WHERE n = 1"
)
def test_module_pairing(spark, d):
    lead = F.when(F.col("p_size") % 5 == 0, "test_").when(F.col("p_size") % 7 == 0, "_").otherwise("")
    lang = F.when(F.col("p_size") % 2 == 0, "python").otherwise("go")
    path = F.concat_ws("/", "p_type", "p_brand", F.concat(lead, F.lit("m"), F.floor(F.col("p_partkey") / 4), F.lit("."), lang))
    return hierarchy.test_pairs(read(spark, d, "part").select(path.alias("path"), lang.alias("lang"), (F.col("p_size") % 5 == 0).alias("is_test")).distinct())


# --- walks ------------------------------------------------------------------

_STEP = (
    f"{SUPPLIERS}, e AS (SELECT 'evolution' AS layer, 0.7 AS lw, a, b, weight FROM pr UNION ALL SELECT 'structure', 0.3, a, b, 1.0 FROM chain), "
    "dir AS (SELECT layer, lw, a AS src, b AS dst, weight FROM e UNION ALL SELECT layer, lw, b, a, weight FROM e), deg AS (SELECT src, layer, lw, sum(weight) AS g FROM dir GROUP BY src, layer, lw), "
    "nrm AS (SELECT src, sum(lw) AS nrm FROM deg GROUP BY src), st AS (SELECT dir.src, dst, sum(weight * dir.lw / nrm / g) AS p FROM dir JOIN deg USING (src, layer) JOIN nrm USING (src) GROUP BY dir.src, dst), "
    "seed AS (SELECT s_nationkey AS qid, min(s_suppkey) AS node FROM supplier GROUP BY s_nationkey)"
)
_ROUNDS = 4


def _rank_sql() -> str:
    out = "r0 AS (SELECT qid, node, CAST(1 AS DOUBLE) AS score FROM seed)"
    for k in range(_ROUNDS):
        lost = f"(SELECT coalesce(sum(z.score), 0) FROM r{k} z WHERE z.qid = seed.qid AND z.node NOT IN (SELECT src FROM st))"
        out += (
            f", r{k + 1} AS (SELECT qid, node, sum(v) AS score FROM (SELECT r.qid, st.dst AS node, 0.85 * r.score * st.p AS v FROM r{k} r JOIN st ON st.src = r.node "
            f"UNION ALL SELECT qid, node, 0.15 + 0.85 * {lost} FROM seed) GROUP BY qid, node)"
        )
    return out


_RANKS = f"{_STEP}, {_rank_sql()}"


def _steps(spark, d) -> DataFrame:
    return walk.transition(supplier_edges(spark, d), {"evolution": 0.7, "structure": 0.3})


def _seeds(spark, d) -> DataFrame:
    return read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("qid")).agg(F.min("s_suppkey").alias("seed"))


@query(f"{_STEP} SELECT src, dst, round(p, 6) AS p FROM st")
def layer_transition(spark, d):
    return _steps(spark, d).select("src", "dst", F.round("p", 6).alias("p"))


def _fixed(spark, d, method: str) -> DataFrame:
    nodes = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return walk.pagerank(_steps(spark, d), walk.seed_shares(_seeds(spark, d), nodes), nodes, tolerance=None, rounds=_ROUNDS, method=method)


@query(f"{_RANKS} SELECT qid, node, round(score, 6) AS score FROM r{_ROUNDS} WHERE score > 0")
def ppr_fixed_iters(spark, d):
    return _fixed(spark, d, "auto").select("qid", "node", F.round("score", 6).alias("score"))


@query(f"{_RANKS} SELECT qid, node, round(score, 6) AS score FROM r{_ROUNDS} WHERE score > 0")
def ppr_fixed_iters_loop(spark, d):
    return _fixed(spark, d, "loop").select("qid", "node", F.round("score", 6).alias("score"))


@query(f"{_RANKS}, k AS (SELECT qid, node, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node) AS rank FROM r{_ROUNDS} WHERE score > 0 AND (qid, node) NOT IN (SELECT (qid, node) FROM seed)) SELECT qid, CAST(rank AS INTEGER) AS rank, node FROM k WHERE rank <= 10")
def ppr_topk(spark, d):
    files = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return walk.top_k(_fixed(spark, d, "auto"), _seeds(spark, d), files, 10).select("qid", "rank", "node")


@query()
def ppr_converged(spark, d):
    nodes = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return walk.pagerank(_steps(spark, d), walk.seed_shares(_seeds(spark, d), nodes), nodes).select("qid", "node", F.round("score", 6).alias("score"))


# --- graph questions --------------------------------------------------------

_COMMITS = "(SELECT count(DISTINCT sha) FROM ch)"


@query(f"{SUPPLIERS} SELECT id FROM nd WHERE changes > 1.02 * {_COMMITS} * (SELECT avg(changes) FROM nd) / {_COMMITS} ")
def hub_files(spark, d):
    nodes = stage(supplier_nodes(spark, d), "nodes")
    commits = changes(spark, d, "l_suppkey").select("sha").distinct().count()
    share = 1.02 * nodes.agg(F.avg("changes")).first()[0] / commits
    return graph.hub_files(nodes, commits, share)


_NEAR2 = "e1 AS (SELECT a AS x, b AS y FROM chain UNION SELECT b, a FROM chain), nr AS (SELECT x AS a, y AS b FROM e1 UNION SELECT p.x, q.y FROM e1 p JOIN e1 q ON p.y = q.x UNION SELECT s_suppkey, s_suppkey FROM supplier)"
_CAT = _CLASSES.replace("ca AND cb", "false").replace("ca OR cb", "false")


@query(
    f"{SUPPLIERS}, {_NEAR2}, rn AS (SELECT s_suppkey AS id, s_nationkey AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier), x AS (SELECT pr.a, pr.b, cnt, weight, greatest(cnt / greatest(m.changes, 1), cnt / greatest(o.changes, 1)) AS conf, m.lang AS la, o.lang AS lb, m.is_test AS ta, o.is_test AS tb, "
    f"coalesce(m.lang IN ('config', 'build'), false) AS fa, coalesce(o.lang IN ('config', 'build'), false) AS fb, m.lang IN {_CODE} AS ka, o.lang IN {_CODE} AS kb FROM pr JOIN nd m ON m.id = pr.a JOIN nd o ON o.id = pr.b "
    "WHERE cnt >= 3 AND m.lang <> 'markdown' AND o.lang <> 'markdown' AND (pr.a, pr.b) NOT IN (SELECT (a, b) FROM nr) "
    f"AND m.changes <= 0.1 * {_COMMITS} AND o.changes <= 0.1 * {_COMMITS}), y AS (SELECT *, {_CAT} AS category FROM x) "
    "SELECT y.a, y.b, cnt AS commits, round(weight, 6) AS weight, round(conf, 6) AS confidence, category, CASE WHEN p.n = q.n THEN CAST(abs(p.k - q.k) AS INTEGER) END AS structural_distance "
    "FROM y JOIN rn p ON p.id = y.a JOIN rn q ON q.id = y.b ORDER BY CASE WHEN category IN ('config_config', 'ci', 'other') THEN 1 ELSE 0 END, -cnt * conf, y.a, y.b LIMIT 20"
)
def hidden_dependencies(spark, d):
    out = graph.hidden_dependencies(supplier_graph(spark, d))
    return out.select("a", "b", "commits", F.round("weight", 6).alias("weight"), F.round("confidence", 6).alias("confidence"), "category", "structural_distance")


@query(f"{SUPPLIERS}, {_NEAR2} SELECT pr.a, pr.b FROM pr WHERE (pr.a, pr.b) IN (SELECT (a, b) FROM nr)")
def two_hop_near(spark, d):
    p = pairs(spark, d, "l_suppkey").select("a", "b")
    return graph.near_pairs(chain(spark, d), p, 2)


@query(
    "WITH rn AS (SELECT s_suppkey AS id, s_nationkey AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier) "
    "SELECT p.id AS a, q.id AS b, CASE WHEN p.n = q.n THEN CAST(q.k - p.k AS INTEGER) END AS distance FROM rn p, rn q WHERE p.k = 1"
)
def bfs_distance(spark, d):
    s = read(spark, d, "supplier")
    first = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("a")).select("a")
    every = s.select(F.col("s_suppkey").alias("b"))
    return graph.distances(chain(spark, d), stage(first.join(every, F.lit(True)), "pairs"))  # one source for each nation


@query(f"{SUPPLIERS}, {_NEAR2}, g AS (SELECT x AS id, count(DISTINCT y) AS importers FROM e1 GROUP BY x) SELECT nd.id, coalesce(importers, 0) AS importers, changes FROM nd LEFT JOIN g USING (id) ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10")
def central_files(spark, d):
    g = supplier_graph(spark, d)
    return graph.central_files(g.nodes, g.edges)


@query(
    f"{SUPPLIERS}, e AS (SELECT 'evolution' AS layer, a, b, weight, cnt FROM pr UNION ALL SELECT 'structure', a, b, 1.0, NULL FROM chain), w AS (SELECT layer, a AS src, b AS path, weight, cnt FROM e UNION ALL SELECT layer, b, a, weight, cnt FROM e), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY src, layer ORDER BY weight DESC, path) AS n FROM w) SELECT src, layer, CAST(n AS INTEGER) AS n, path, round(weight, 4) AS weight, cnt AS commits FROM k WHERE n <= 8"
)
def explain_file(spark, d):
    g = supplier_graph(spark, d)
    return graph.strongest_neighbors(g.edges, g.nodes).select("src", "layer", "n", "path", "weight", "commits")


_COST = (
    f"{SUPPLIERS}, e AS (SELECT 3 AS k, 'evolution' AS layer, a, b, weight FROM pr UNION ALL SELECT 2, 'structure', a, b, CAST(1 AS DOUBLE) FROM chain), mn AS (SELECT layer, avg(weight) AS m FROM e GROUP BY layer), "
    "c0 AS (SELECT a, b, m / weight AS cost, layer, row_number() OVER (PARTITION BY a, b ORDER BY m / weight, k) AS n FROM e JOIN mn USING (layer)), lk AS (SELECT a, b, cost, layer FROM c0 WHERE n = 1)"
)


@query(f"{_COST} SELECT a, b, round(cost, 6) AS cost, layer FROM lk")
def min_cost_edges(spark, d):
    return graph.cheapest_links(supplier_edges(spark, d)).select("a", "b", F.round("cost", 6).alias("cost"), "layer")


_RELAX = ", ".join(
    ["w AS (SELECT a AS x, b AS y, cost FROM lk UNION ALL SELECT b, a, cost FROM lk)", "s0 AS (SELECT min(s_suppkey) AS node, CAST(0 AS DOUBLE) AS cost FROM supplier)"]
    + [f"s{k + 1} AS (SELECT node, min(cost) AS cost FROM (SELECT node, cost FROM s{k} UNION ALL SELECT w.y, s{k}.cost + w.cost FROM s{k} JOIN w ON w.x = s{k}.node) GROUP BY node)" for k in range(12)]
)


@query(f"{_COST}, {_RELAX} SELECT node, round(cost, 6) AS cost FROM s12")
def shortest_path_cost(spark, d):
    first = read(spark, d, "supplier").agg(F.min("s_suppkey")).first()[0]
    return graph.shortest_costs(graph.cheapest_links(supplier_edges(spark, d)), first).select("node", F.round("cost", 6).alias("cost"))


@query(f"{SUPPLIERS} SELECT round((SELECT count(*) FROM pr JOIN chain USING (a, b)) / (SELECT count(*) FROM (SELECT a, b FROM pr UNION SELECT a, b FROM chain)), 6) AS jaccard")
def layer_jaccard(spark, d):
    g = supplier_graph(spark, d)
    return graph.layer_overlap(g.edges, g.files(), "structure", "evolution").select(F.round("jaccard", 6).alias("jaccard"))


_CUSTOMER = "SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) || '/' || (c_custkey % 40) AS dir FROM customer"


@query(
    f"WITH f AS ({_CUSTOMER}), g AS (SELECT dir, count(*) AS k FROM f GROUP BY dir HAVING count(*) > 1), h AS (SELECT x.dir || '/' || x.id AS a, y.dir || '/' || y.id AS b, 1.0 / (k - 1) AS w FROM f x JOIN f y ON x.dir = y.dir AND x.dir || '/' || x.id < y.dir || '/' || y.id JOIN g ON g.dir = x.dir), "
    "s AS (SELECT least(p, q) AS a, greatest(p, q) AS b FROM (SELECT dir || '/' || id AS p, lead(dir || '/' || id) OVER (PARTITION BY dir ORDER BY id) AS q FROM f) WHERE q IS NOT NULL), "
    "u AS (SELECT 0.7 * w / (SELECT sum(w) FROM h) AS w, a, b FROM h UNION ALL SELECT 0.3 / (SELECT count(*) FROM s), a, b FROM s) SELECT a, b, round(sum(w) * 1000, 6) AS weight FROM u GROUP BY a, b"
)
def file_projection(spark, d):
    nodes, edges = _customer_graph(spark, d)
    return communities.file_projection(edges, nodes, {"hierarchy": 0.7, "structure": 0.3}).select("a", "b", F.round(F.col("weight") * 1000, 6).alias("weight"))


def _customer_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """Customers as files of 40 directories in each nation, chained within a directory."""
    c = read(spark, d, "customer").select("c_custkey", F.concat_ws("/", "c_nationkey", F.col("c_custkey") % 40).alias("dir"))
    c = c.select("c_custkey", "dir", F.concat_ws("/", "dir", "c_custkey").alias("id"))
    nxt = c.select("id", F.lead("id").over(W.partitionBy("dir").orderBy("c_custkey")).alias("q")).where("q is not null")
    edges = nxt.select(F.lit("structure").alias("layer"), F.least("id", "q").alias("a"), F.greatest("id", "q").alias("b"), F.lit(1.0).alias("weight"))
    return c.select("id", F.lit("file").alias("kind"), F.lit("python").alias("lang"), F.lit(False).alias("is_test"), F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("changes")), edges


@query()
def detect_communities(spark, d):
    nodes, edges = _customer_graph(spark, d)
    return communities.detect(edges, nodes, {"hierarchy": 0.7, "structure": 0.3})


@query(
    f"{SUPPLIERS}, {_NEAR2}, g AS (SELECT x AS id, count(DISTINCT y) AS k FROM e1 GROUP BY x), m AS (SELECT s_nationkey AS community, s_suppkey AS id, coalesce(k, 0) + changes AS w FROM supplier JOIN nd ON nd.id = s_suppkey LEFT JOIN g ON g.id = s_suppkey), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY w DESC, 'n' || community || '/' || lpad(CAST(id AS VARCHAR), 12, '0')) AS n FROM m) "
    "SELECT community, (SELECT count(*) FROM m x WHERE x.community = t.community) AS size, 'n' || community AS main_directory, string_agg('n' || community || '/' || lpad(CAST(id AS VARCHAR), 12, '0'), ',' ORDER BY n) AS top_members FROM t WHERE n <= 6 GROUP BY community"
)
def community_summary(spark, d):
    g = supplier_graph(spark, d)
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("n"), "s_nationkey", F.lit("/"), F.lpad(F.col("s_suppkey").cast("string"), 12, "0")).alias("name"), "s_nationkey")
    nodes = g.nodes.join(s, F.col("id") == F.col("k")).select(F.col("name").alias("id"), "kind", "lang", "is_test", "lines", "changes")
    x, y = s.select(F.col("k").alias("a"), F.col("name").alias("na")), s.select(F.col("k").alias("b"), F.col("name").alias("nb"))
    edges = g.edges.join(x, "a").join(y, "b").select("layer", F.col("na").alias("a"), F.col("nb").alias("b"), "weight")
    out = graph.community_summary(s.select(F.col("name").alias("file"), F.col("s_nationkey").alias("community")), nodes, edges)
    return out.select("community", "size", "main_directory", F.array_join("top_members", ",").alias("top_members"))


# --- history ----------------------------------------------------------------

# Each customer's orders are a history: every order renames, touches, adds or deletes one of the customer's files.
_LOG = (
    "lg AS (SELECT o_custkey AS cust, o_orderkey AS sha, CAST(epoch(o_orderdate) AS BIGINT) AS ts, CASE o_orderkey % 6 WHEN 0 THEN 'R' WHEN 1 THEN 'A' WHEN 2 THEN 'D' ELSE 'M' END AS st, "
    "o_custkey || '/' || (o_orderkey % 4) AS path, o_custkey || '/' || ((o_orderkey + 1) % 4) AS old, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey {0}) AS k FROM orders), "
    "al AS (SELECT c_custkey || '/' || x AS path FROM customer, (VALUES (0), (1), (2)) v(x))"
)
# The fold, one change after the other, over each customer's four names.
_FOLD = (
    "WITH RECURSIVE {log}, f AS (SELECT c_custkey AS cust, CAST(0 AS BIGINT) AS k, MAP {{'0': c_custkey || '/0', '1': c_custkey || '/1', '2': c_custkey || '/2', '3': CAST(NULL AS VARCHAR)}} AS m, CAST(NULL AS VARCHAR) AS hit, CAST(NULL AS BIGINT) AS sha, CAST(NULL AS BIGINT) AS ts FROM customer "
    "UNION ALL SELECT f.cust, lg.k, {step} AS m, {hit} AS hit, lg.sha, lg.ts FROM f JOIN lg ON lg.cust = f.cust AND lg.k = f.k + 1) SELECT sha, ts, hit AS file FROM f WHERE hit IS NOT NULL"
)
_P, _Q = "split_part(lg.path, '/', 2)", "split_part(lg.old, '/', 2)"
_set = lambda m, key, v: f"map_from_entries(list_transform(map_entries({m}), lambda e: {{'k': e.key, 'v': CASE WHEN e.key = {key} THEN {v} ELSE e.value END}}))"
_BACK = _FOLD.format(
    log=_LOG.format("DESC"),
    step=f"CASE WHEN lg.st = 'R' THEN {_set(_set('f.m', _Q, f'f.m[{_P}]'), _P, 'NULL')} WHEN lg.st IN ('A', 'D') THEN {_set('f.m', _P, 'NULL')} ELSE f.m END",
    hit=f"CASE WHEN lg.st <> 'D' THEN f.m[{_P}] END",
)
_FORTH = _FOLD.format(
    log=_LOG.format("ASC"),
    step=f"CASE WHEN lg.st = 'R' THEN {_set(_set('f.m', _P, f'f.m[{_Q}]'), _Q, 'NULL')} WHEN lg.st IN ('A', 'D') THEN {_set('f.m', _P, 'NULL')} ELSE f.m END",
    hit=f"CASE WHEN lg.st = 'R' THEN f.m[{_Q}] WHEN lg.st = 'A' THEN NULL ELSE f.m[{_P}] END",
)


def _log(spark, d, newest_first: bool) -> tuple[DataFrame, DataFrame]:
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    name = lambda c: F.concat_ws("/", "o_custkey", c % 4)
    status = F.when(k % 6 == 0, "R").when(k % 6 == 1, "A").when(k % 6 == 2, "D").otherwise("M")
    seq = (F.lit(0) - k if newest_first else k) + F.lit(1 << 30)
    log = o.select(k.alias("sha"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"), seq.alias("seq"), F.lit(0).alias("pos"), status.alias("status"), name(k).alias("path"), F.when(k % 6 == 0, name(k + 1)).alias("old_path"))
    alive = read(spark, d, "customer").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda x: F.concat_ws("/", "c_custkey", x))).alias("path"))
    return log, alive


@query(_BACK)
def rename_backward(spark, d):
    return history.normalize_backward(*_log(spark, d, True))


@query(_FORTH)
def rename_forward(spark, d):
    return history.normalize_forward(*_log(spark, d, False))


# --- modules and documents --------------------------------------------------

_PY = ["src/pkg/__init__.py", "src/pkg/core.py", "src/pkg/sub/__init__.py", "src/pkg/sub/deep.py", "src/pkg/ns/x.py", "tools/run.py", "tools/helper.py", "tests/test_core.py", "other/pkg2/__init__.py", "other/pkg2/core.py", "other/pkg2/only.py", "lone/__init__.py", "setup.py"]
_ASKED = ["pkg", "pkg.core", "pkg.core.Name", "core", "deep", "sub.deep", "pkg.ns.x", "x", "helper", "run.main", "only", "pkg2.only.f", "lone", "nothing", "pkg.nothing.at.all", "setup"]
# Names as literals: the SQL side of module_resolve checks resolution, that of module_names the names.
_MODULES = [("src/pkg/__init__.py", "pkg"), ("src/pkg/core.py", "pkg.core"), ("src/pkg/sub/__init__.py", "pkg.sub"), ("src/pkg/sub/deep.py", "pkg.sub.deep"), ("src/pkg/ns/x.py", "pkg.ns.x"), ("tools/run.py", "run"), ("tools/helper.py", "helper"), ("tests/test_core.py", "test_core"), ("other/pkg2/__init__.py", "pkg2"), ("other/pkg2/core.py", "pkg2.core"), ("other/pkg2/only.py", "pkg2.only"), ("lone/__init__.py", "lone"), ("setup.py", "setup")]


_PARTS = "string_split(path, '/')"


@query(
    f"WITH p AS (SELECT n_name || '/' || v.path AS path FROM nation, {sql_values([(x,) for x in _PY], 'path')}), init AS (SELECT regexp_replace(path, '/__init__[.]py$', '') AS u FROM p WHERE regexp_matches(path, '/__init__[.]py$')), "
    f"d AS (SELECT path, i, array_to_string({_PARTS}[1:i], '/') AS dir FROM p, range(1, 12) r(i) WHERE i < len({_PARTS})), k AS (SELECT path, min(i) AS top FROM d JOIN init ON dir = u OR starts_with(dir, u || '/') GROUP BY path) "
    f"SELECT p.path, array_to_string(list_concat(CASE WHEN top IS NULL THEN [] ELSE string_split(p.path, '/')[top:len(string_split(p.path, '/')) - 1] END, "
    "CASE WHEN ends_with(p.path, '/__init__.py') THEN [] ELSE [regexp_extract(p.path, '([^/]*)[.]py$', 1)] END), '.') AS module FROM p LEFT JOIN k ON k.path = p.path"
)
def module_names(spark, d):
    files = read(spark, d, "nation").select(F.explode(F.transform(F.array(*map(F.lit, _PY)), lambda p: F.concat("n_name", F.lit("/"), p))).alias("path"))
    return modules.module_names(files)


@query(
    f"WITH m AS (SELECT path, module FROM {sql_values(_MODULES, 'path, module')}), q AS (SELECT n_name || '.' || v.name AS full_name, v.name FROM nation, {sql_values([(x,) for x in _ASKED], 'name')} UNION ALL SELECT name, name FROM {sql_values([(x,) for x in _ASKED], 'name')}), "
    "pf AS (SELECT full_name, n, array_to_string(string_split(full_name, '.')[1:n], '.') AS prefix FROM q, range(1, 12) r(n) WHERE n <= len(string_split(full_name, '.'))), "
    "ix AS (SELECT module AS prefix, min(path) AS target, 1 AS exact FROM m GROUP BY module UNION ALL SELECT sfx, min(path), 0 FROM (SELECT path, array_to_string(string_split(module, '.')[k:], '.') AS sfx FROM m, range(1, 8) r(k) WHERE k <= len(string_split(module, '.'))) GROUP BY sfx HAVING count(DISTINCT path) = 1), "
    "b AS (SELECT full_name, target, row_number() OVER (PARTITION BY full_name ORDER BY n DESC, exact DESC) AS k FROM pf JOIN ix USING (prefix)) SELECT q.full_name AS name, b.target FROM q LEFT JOIN b ON b.full_name = q.full_name AND k = 1"
)
def module_resolve(spark, d):
    asked = F.array(*map(F.lit, _ASKED))
    named = read(spark, d, "nation").select(F.explode(F.transform(asked, lambda a: F.concat("n_name", F.lit("."), a))).alias("name"))
    names = named.union(values(spark, [(a,) for a in _ASKED], "name string")).withColumn("importer", F.lit(None).cast("string"))
    return modules.resolve(names, modules.module_names(values(spark, [(p,) for p in _PY], "path string"))).select("name", "target")


@query(
    "SELECT 'docs' AS layer, CAST(least(l_suppkey, l_suppkey + 1 + l_partkey % 3) AS VARCHAR) AS a, CAST(greatest(l_suppkey, l_suppkey + 1 + l_partkey % 3) AS VARCHAR) AS b, round(sum(l_quantity), 4) AS weight, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS kinds, sum(l_linenumber) AS count, max(l_orderkey) AS last_change FROM lineitem GROUP BY 1, 2, 3"
)
def edge_merge(spark, d):
    k, m = F.col("l_suppkey"), F.col("l_suppkey") + 1 + F.col("l_partkey") % 3
    turned = F.col("l_linenumber") % 2 == 0
    parts = read(spark, d, "lineitem").select(
        F.lit("docs").alias("layer"), F.when(turned, k).otherwise(m).cast("string").alias("u"), F.when(turned, m).otherwise(k).cast("string").alias("v"), F.col("l_quantity").alias("weight"), F.col("l_returnflag").alias("kind"),
        F.col("l_linenumber").cast("long").alias("count"), F.col("l_orderkey").alias("last_change"),
    )
    out = merge_edges(edge_parts(parts))
    low = F.col("a").cast("long") < F.col("b").cast("long")
    return out.select(
        "layer", F.when(low, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("b"), F.round("weight", 4).alias("weight"), F.array_join(F.array_sort("kinds"), ",").alias("kinds"), "detail.count", "detail.last_change"
    )


_REFS = "rf AS (SELECT page_id AS doc, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS target FROM pages)"


@query(f"WITH {_REFS} SELECT 'page ' || doc AS a, target AS b, round(CASE WHEN target LIKE 'http%' THEN 1.0 ELSE 0.5 END, 4) AS weight, count(*) AS mentions FROM rf GROUP BY doc, target")
def docs_layer(spark, d):
    p = read(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("ord", "target"))
    refs = p.select(F.concat(F.lit("page "), "page_id").alias("doc"), F.col("ord").cast("long").alias("ord"), "target", F.when(F.col("target").startswith("http"), "link").otherwise("mention").alias("kind"))
    e = docs.docs_parts(refs)
    return e.select(F.col("u").alias("a"), F.col("v").alias("b"), F.round("weight", 4).alias("weight"), "mentions")


# --- evaluation -------------------------------------------------------------

_HALF = "(SELECT ts FROM (SELECT CAST(epoch(o_orderdate) AS BIGINT) AS ts FROM orders) ORDER BY ts LIMIT 1 OFFSET (SELECT CAST(floor(0.5 * count(*)) AS BIGINT) FROM orders))"
_SPLIT = (
    f"WITH {CHANGES.format('l_suppkey')}, {SETS.format(30)}, cut AS (SELECT {_HALF} AS t), old AS (SELECT tx.* FROM tx, cut WHERE tx.ts <= t), new AS (SELECT tx.* FROM tx, cut WHERE tx.ts > t), "
    "sc AS (SELECT x.file AS seed, y.file AS node, count(*) AS score FROM old x JOIN old y ON x.sha = y.sha AND x.file <> y.file GROUP BY 1, 2), sd AS (SELECT DISTINCT file AS seed FROM new), "
    "full_al AS (SELECT sd.seed, s.s_suppkey AS node, coalesce(sc.score, 0) AS score FROM sd CROSS JOIN supplier s LEFT JOIN sc ON sc.seed = sd.seed AND sc.node = s.s_suppkey WHERE s.s_suppkey <> sd.seed), "
    "ps AS (SELECT seed, node, {0} AS pos FROM full_al), tr AS (SELECT x.sha, x.file AS seed, y.file AS node FROM new x JOIN new y ON x.sha = y.sha AND x.file <> y.file), "
    "me AS (SELECT sha, seed, 1.0 / min(pos) AS rr, count(*) FILTER (pos <= 1) / count(*) AS r1, count(*) FILTER (pos <= 5) / count(*) AS r5, count(*) FILTER (pos <= 10) / count(*) AS r10 FROM tr JOIN ps USING (seed, node) GROUP BY sha, seed)"
)
_BY_PLACE, _BY_RANK = "row_number() OVER (PARTITION BY seed ORDER BY score DESC, node)", "rank() OVER (PARTITION BY seed ORDER BY score DESC)"


def _split(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    ch = stage(changes(spark, d, "l_suppkey"), "changes")
    o = read(spark, d, "orders").select(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"))
    half = evaluate.time_quantiles(o, [0.5]).first()["ts"]
    return ch.where(F.col("ts") <= half), ch.where(F.col("ts") > half), read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(0.0).alias("tie"))


def _measured(spark, d, unique: bool) -> DataFrame:
    """Metrics of each query (a commit's file against the rest), ranked by past co-changes; a seed is ranked once."""
    old, new, files = _split(spark, d)
    truth = cochange.seed_queries(new)
    seeds = truth.select(F.col("seed").alias("qid"), "seed").distinct()
    scores = evaluate.cochange_scores(cochange.cochange_pairs(old, 0, half_life_days=None), seeds)
    asked = truth.select(F.col("seed").alias("qid"), F.col("truth").alias("node")).distinct()
    places = stage(evaluate.positions(scores, seeds, files, asked, unique), "places")
    t = truth.select(F.struct("sha", "seed").alias("q"), F.col("seed").alias("qid"), F.col("truth").alias("node"))
    return evaluate.metrics(t.join(places, ["qid", "node"]).select(F.col("q").alias("qid"), "node", "pos"), t.select(F.col("q").alias("qid"), "node"))


@query(_SPLIT.format(_BY_PLACE) + " SELECT round(avg(rr), 6) AS mrr, round(avg(r1), 6) AS recall_1, round(avg(r5), 6) AS recall_5, round(avg(r10), 6) AS recall_10 FROM me")
def rose_mrr(spark, d):
    s = evaluate.summary(_measured(spark, d, True))
    return s.select(*(F.round(c, 6).alias(c) for c in s.columns))


def _metric_rows(m: DataFrame) -> DataFrame:
    return m.select("qid.sha", "qid.seed", *(F.round(c, 6).alias(c) for c in ("rr", "r1", "r5", "r10")))


_METRIC = " SELECT sha, seed, round(rr, 6) AS rr, round(r1, 6) AS r1, round(r5, 6) AS r5, round(r10, 6) AS r10 FROM me"


@query(_SPLIT.format(_BY_PLACE) + _METRIC)
def rank_metrics_position(spark, d):
    return _metric_rows(_measured(spark, d, True))


@query(_SPLIT.format(_BY_RANK) + _METRIC)
def rank_metrics_competition(spark, d):
    return _metric_rows(_measured(spark, d, False))


_FRACTIONS = [0.0, 0.25, 0.5, 0.9, 1.0]


@query(
    "WITH t AS (SELECT CAST(epoch(o_orderdate) AS BIGINT) AS ts, row_number() OVER (ORDER BY o_orderdate) - 1 AS k FROM orders), "
    f"f AS (SELECT fraction, least(CAST(floor(fraction * (SELECT count(*) FROM t)) AS BIGINT), (SELECT count(*) FROM t) - 1) AS k FROM {sql_values([(f,) for f in _FRACTIONS], 'fraction')}) SELECT CAST(fraction AS DOUBLE) AS fraction, ts FROM f JOIN t USING (k)"
)
def time_quantiles(spark, d):
    o = read(spark, d, "orders").select(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"))
    return evaluate.time_quantiles(o, _FRACTIONS)


@query(
    "WITH c AS (SELECT c_custkey AS seq, c_nationkey * 1000 + CAST(c_custkey AS BIGINT) AS ts, c_name AS sha FROM customer), t AS (SELECT *, max(ts) OVER (ORDER BY seq) AS top FROM c), m AS (SELECT DISTINCT CAST(p_retailprice AS BIGINT) AS moment FROM part), "
    "h AS (SELECT moment, arg_max(sha, seq) AS sha FROM m JOIN t ON top <= moment GROUP BY moment) SELECT m.moment, coalesce(h.sha, (SELECT arg_min(sha, seq) FROM c)) AS sha FROM m LEFT JOIN h USING (moment)"
)
def revision_at(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_name").alias("sha"), (F.col("c_nationkey") * 1000 + F.col("c_custkey")).alias("ts"))
    moments = read(spark, d, "part").select(F.round("p_retailprice").cast("long").alias("moment")).distinct()
    return evaluate.revision_at(c, moments)


@query(
    "SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS n, round(a / 10, 6) AS hierarchy, round(b / 10, 6) AS structure, round(c / 10, 6) AS evolution, round((10 - a - b - c) / 10, 6) AS docs FROM range(11) x(a), range(11) y(b), range(11) z(c) WHERE a + b + c <= 10"
)
def simplex_grid(spark, d):
    g = evaluate.simplex_grid(spark)
    return g.select(F.col("n").cast("long").alias("n"), *(F.round(c, 6).alias(c) for c in ("hierarchy", "structure", "evolution", "docs")))


@query()
def set_queries(spark, d):
    ch = changes(spark, d).withColumn("sha", F.lpad(F.hex("sha"), 40, "0"))
    out = evaluate.set_queries(ch)
    return out.select("qid", "m", F.array_join("seeds", ",").alias("seeds"), F.array_join("truth", ",").alias("truth"))


@query()
def bootstrap_ci(spark, d):
    return evaluate.bootstrap_interval(_measured(spark, d, True), "rr")
