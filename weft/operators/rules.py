"""Association rules over commits: whole-query rules and largest-overlap rules.

``transactions`` is (sha, files) from :func:`weft.operators.cochange.transactions`;
``queries`` is (qid, file). Many queries are answered at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.staging import release, stage


def _overlap(transactions: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, sha, files, q, n): transactions that share files with a query, its size and their number shared."""
    q = queries.distinct().groupBy("qid").agg(F.array_sort(F.collect_list("file")).alias("q"))
    hit = transactions.select("sha", F.explode("files").alias("file")).join(queries.distinct(), "file").groupBy("qid", "sha").agg(F.count("*").alias("n"))
    return hit.join(q, "qid").join(transactions.select("sha", "files"), "sha")


def containing(transactions: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, sha, q) of transactions that contain all of a query; none for an empty query or an unseen file.

    A transaction holds a query's files after the first behind the query's first, so queries meet transactions at that
    one file, and what does not hold the rest is left out where they meet.
    """
    q = queries.groupBy("qid").agg(F.array_sort(F.collect_set("file")).alias("q"))
    asked = q.select("qid", "q", F.get("q", F.lit(0)).alias("first"))
    behind = transactions.select("sha", "files", F.posexplode("files").alias("at", "first")).select("sha", "first", F.slice("files", F.col("at") + 2, F.size("files")).alias("rest"))
    return asked.join(behind, "first").where(F.size(F.array_except(F.slice("q", 2, F.size("q")), "rest")) == 0).select("qid", "sha", "q")


def is_seen(transactions: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, seen): whether some transaction contains all of the query."""
    hit = containing(transactions, queries).select("qid").distinct().withColumn("seen", F.lit(True))
    return queries.select("qid").distinct().join(hit, "qid", "left").select("qid", F.coalesce("seen", F.lit(False)).alias("seen"))


def whole_query_rules(transactions: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, file, support, confidence): files of the transactions that contain the whole query (Zimmermann et al. 2005)."""
    hit = containing(transactions, queries).join(transactions.select("sha", "files"), "sha")
    total = hit.groupBy("qid").agg(F.count("*").alias("total"))
    found = hit.select("qid", F.explode(F.array_except("files", "q")).alias("file")).groupBy("qid", "file").agg(F.count("*").alias("support"))
    return found.join(total, "qid").select("qid", "file", "support", (F.col("support") / F.col("total")).alias("confidence"))


def largest_overlap_rules(transactions: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, file, support, confidence): the best rule of each file among antecedents of the largest overlap (Rolfsnes et al. 2016).

    No overlap is larger than the whole query, so only queries that no transaction contains are compared with every
    transaction that shares a file with them.
    """
    release(transactions.sparkSession)
    whole = stage(containing(transactions, queries), "whole")
    release(transactions.sparkSession)
    rest = queries.join(whole.select("qid").distinct(), "qid", "left_anti")
    kept = whole.join(transactions.select("sha", "files"), "sha").select("qid", F.col("q").alias("ante"), F.array_except("files", "q").alias("more"))
    if rest.limit(1).count():
        over = _overlap(transactions, rest)
        most = over.groupBy("qid").agg(F.max("n").alias("n"))
        part = over.join(most, ["qid", "n"])
        kept = kept.unionByName(part.select("qid", F.array_sort(F.array_intersect("files", "q")).alias("ante"), F.array_except("files", "q").alias("more")))
    # Dealt out by query once; sums and the choice of rules need no other exchange.
    kept = kept.repartition("qid").withColumn("total", F.count("*").over(W.partitionBy("qid", "ante")))
    rules = kept.select("qid", "ante", "total", F.explode("more").alias("file")).groupBy("qid", "ante", "file").agg(F.count("*").alias("support"), F.first("total").alias("total"))
    best = rules.groupBy("qid", "file").agg(F.max(F.struct("support", (F.col("support") / F.col("total")).alias("confidence"))).alias("r"))
    return best.select("qid", "file", "r.support", "r.confidence")


def rule_value(support: Column, confidence: Column) -> Column:
    """One number in the order of (support, confidence)."""
    return support + 0.5 * confidence
