"""URL filters: rules by host and path, and boosted trees for URLs that no rule fits.

The trees (Spark's own gradient boosting, in the JVM) see lexical features only:
lengths, depth, digit ratio, entropy, parameters, and statistics of the host's suffix.
They learn from labelled URLs, by default those that a rule judges, at most TRAIN_ROWS
of them, drawn by a hash. Statistics of suffixes cover all URLs, and all that ``learn``
allows to be labels. URLs fall into FOLDS by a hash, and the share of blocked ones that a
labelled URL is described by leaves out its own fold, so the trees cannot read their
answer from it.

Suffix statistics are broadcast up to SUFFIX_ROWS suffixes. Beyond, those that more than
one in SUFFIX_ROWS URLs have are, and the others, none of which is long, are exchanged.

Defined results: a null URL or one without ``://`` has an empty host and path; no rule
fits it, and the trees judge it as they do any other. Without labelled URLs of both
verdicts, those that no rule fits are allowed. Every row gives one row; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.staging import discard, stage

TRAIN_ROWS = 20_000
SUFFIX_ROWS = 20_000
TREES, DEPTH = 20, 3
FOLDS = 8

#: Verdict, host and path of each rule.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
FEATURES = (
    "f_url", "f_host", "f_path", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params", "f_query", "f_fragment", "f_dashes",
    "f_secure", "f_last", "f_suffix", "f_seen", "f_blocked",
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    upper = "".join(map(chr, range(65, 91)))
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def by_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path, and its verdict; null where none does. Rules are a literal list."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def lexical(url: Column, host: Column, path: Column) -> list[Column]:
    """Features of the URL's own characters."""
    text = F.coalesce(url, F.lit(""))
    size = F.length(text)
    n = F.greatest(size, F.lit(1)).cast("double")
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: a - F.when(F.length(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    last = F.regexp_extract(path, "[^/]*$", 0)
    values = (
        size, F.length(host), F.length(path), count(path, "/[^/]"), count(host, "[^.]+"), count(text, "[0-9]") / n, entropy, count(query, "="),
        F.length(query), F.when(F.contains(text, F.lit("#")), 1).otherwise(0), count(text, "[-_~%]"), F.when(text.startswith("https://"), 1).otherwise(0), F.length(last),
    )
    return [v.cast("double").alias(name) for name, v in zip(FEATURES, values, strict=False)]


def _described(base: DataFrame, learn: Column) -> DataFrame:
    """``base`` with its label (1 block, 0 allow, null: none), and the statistics of its suffix."""
    base = base.withColumn("label", F.when(learn & (F.col("ruled") == "block"), 1.0).when(learn & (F.col("ruled") == "allow"), 0.0))
    base = base.withColumn("fold", F.pmod(F.xxhash64("u", F.lit(8)), F.lit(FOLDS)).cast("int"))
    own = [F.when(F.col("fold") == k, F.col("label")) for k in range(FOLDS)]
    known, bad = F.array(*map(F.count, own)), F.array(*(F.coalesce(F.sum(c), F.lit(0.0)) for c in own))
    stats = stage(base.groupBy(F.col("suffix").alias("s")).agg(F.count("*").alias("seen"), known.alias("known"), bad.alias("bad")), "suffixes")
    n, rows = stats.agg(F.count("*"), F.coalesce(F.sum("seen"), F.lit(0))).first()
    same = F.col("suffix") == F.col("s")
    if n <= SUFFIX_ROWS:
        rows = base.join(F.broadcast(stats), same)
    else:
        often = F.col("seen") * SUFFIX_ROWS > rows
        rows = base.join(F.broadcast(stats.where(often)), same).unionByName(
            base.join(F.broadcast(stats.where(often).select("s")), same, "left_anti").join(stats.where(~often), same)
        )

    def others(of: str) -> Column:
        whole = F.aggregate(of, F.lit(0.0), lambda a, x: a + x)
        return whole - F.when(F.col("label").isNotNull(), F.get(of, F.col("fold"))).otherwise(0)

    blocked = (others("bad") + 1) / (others("known") + 2)
    return rows.withColumns({"f_suffix": F.length("suffix").cast("double"), "f_seen": F.log1p("seen"), "f_blocked": blocked})


def judge(
    pages: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), rules: tuple[tuple[str, str, str], ...] = RULES, train_rows: int = TRAIN_ROWS, learn: Column | None = None
) -> DataFrame:
    """``keep`` columns, host, path, rule, verdict and p_block, the trees' probability of block.

    ``learn`` may hold back URLs (column ``u``) from training and from the suffixes' shares, to see how well the trees do on them.
    """
    base = pages.select(*(F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(keep)), F.col(url).alias("u"))
    host, path = parts(F.col("u"))
    base = base.withColumns({"host": host, "path": path})
    name, verdict = by_rule(F.col("host"), F.col("path"), rules)
    # The suffix is what stands behind the last dot; its statistics come from all URLs.
    base = base.withColumns({"rule": name, "ruled": verdict, "suffix": F.regexp_extract("host", "[^.]*$", 0)})
    base = stage(base.select("*", *lexical(F.col("u"), F.col("host"), F.col("path"))), "urls")
    rows = _described(base, F.lit(True) if learn is None else learn)
    sizes = rows.where("label is not null").groupBy("label").count().collect()
    result = [*(F.col(f"k{n}").alias(c) for n, c in enumerate(keep)), "host", "path", "rule"]
    if len(sizes) < 2:
        return rows.select(*result, F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("p_block"))
    lot = F.pmod(F.xxhash64("u"), F.lit(1 << 30))
    most = (1 << 30) * train_rows // sum(r["count"] for r in sizes)
    packed = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    some = packed.transform(rows.where(F.col("label").isNotNull() & (lot < most))).select("features", "label").orderBy(F.xxhash64("features")).limit(train_rows)
    some = stage(some.repartition(2, F.hash("features")), "labelled")
    if some.select("label").distinct().count() < 2:
        return rows.select(*result, F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("p_block"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=5).fit(some)
    discard(some)
    judged = model.transform(packed.transform(rows)).withColumn("p_block", vector_to_array("probability")[1])
    own = F.when(F.col("p_block") > 0.5, "block").otherwise("allow")
    return judged.select(*result, F.coalesce("ruled", own).alias("verdict"), "p_block")
