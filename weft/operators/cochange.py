"""Co-change: commits as sets of files, decayed pair weights, change counts.

A commit's files are counted before they are gathered, so a commit that touches very
many files is never collected; pairs come out of arrays of at most ``most`` files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_FILES = 30
HALF_LIFE_DAYS = 365.0
DAY = 86_400


def decay(age: Column, half_life_days: float | None = HALF_LIFE_DAYS) -> Column:
    """One half to the power of the age in half-lives; ages below zero are zero, no half-life is no decay."""
    if not half_life_days:
        return F.lit(1.0)
    return F.pow(F.lit(0.5), F.greatest(age, F.lit(0)) / (half_life_days * DAY))


def transactions(changes: DataFrame, files: DataFrame | None = None, most: int = MOST_FILES) -> DataFrame:
    """(sha, ts, files): the sorted files of each commit that touches 2 to ``most`` of them.

    ``changes`` has sha, ts and file, repeated or not; ``files`` (file) restricts it.
    """
    if files is not None:
        changes = changes.join(files.select("file").distinct(), "file", "left_semi")
    rows = changes.select("sha", "ts", "file").distinct()
    sized = rows.groupBy("sha").agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).select("sha")
    kept = rows.join(sized, "sha")
    return kept.groupBy("sha").agg(F.min("ts").alias("ts"), F.array_sort(F.collect_list("file")).alias("files"))


def pairs_of(files: Column) -> Column:
    """All (a, b) with a before b."""
    return F.flatten(F.transform(files, lambda a, i: F.transform(F.slice(files, i + 2, F.size(files)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def cochange_pairs(changes: DataFrame, reference: Column | int, most: int = MOST_FILES, half_life_days: float | None = HALF_LIFE_DAYS, files: DataFrame | None = None) -> DataFrame:
    """(a, b, weight, count, last_change) of files that change together; a commit of n files adds decay / (n - 1) to each pair."""
    age = (reference if isinstance(reference, Column) else F.lit(reference)) - F.col("ts")
    t = transactions(changes, files, most).withColumn("w", decay(age, half_life_days) / (F.size("files") - 1))
    p = t.select("ts", "w", F.explode(pairs_of(F.col("files"))).alias("p")).select("p.a", "p.b", "ts", "w")
    return p.groupBy("a", "b").agg(F.sum("w").alias("weight"), F.count("*").alias("count"), F.max("ts").alias("last_change"))


def change_counts(changes: DataFrame) -> DataFrame:
    """(file, changes): commits that touch each file, single and very large ones included."""
    return changes.select("sha", "file").distinct().groupBy("file").agg(F.count("*").alias("changes"))


def seed_queries(changes: DataFrame, scope: DataFrame | None = None, most: int = MOST_FILES) -> DataFrame:
    """(sha, seed, truth): one query for each file of each commit of 2 to ``most`` files, the others are the truth."""
    t = transactions(changes, scope, most)
    return t.select("sha", F.explode("files").alias("seed"), "files").select("sha", "seed", F.explode("files").alias("truth")).where("seed <> truth")
