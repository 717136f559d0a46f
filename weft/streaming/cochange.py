"""Co-change pairs over a stream of commits (an extension: nothing to compare it with).

A pair's weight adds up once decay is split off: with E a fixed epoch before all
commits, 0.5^((T - t) / h) = 0.5^((T - E) / h) * 2^((t - E) / h). The stream keeps sums
relative to E, and reading them at a time T scales them. This holds for T no earlier
than the last commit. Renames would change what was added long ago, so the feed must
name files as they are now.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.cochange import DAY, HALF_LIFE_DAYS, MOST_FILES, pairs_of


def pair_sums(commits: DataFrame, epoch: int, most: int = MOST_FILES, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """Running (a, b, sum, count, last_change) of a stream or table (sha, ts, files); one row is one commit, its files distinct."""
    sized = commits.select("ts", F.array_sort(F.array_distinct("files")).alias("files")).where(F.size("files").between(2, most))
    grown = F.pow(F.lit(2.0), (F.col("ts") - epoch) / (half_life_days * DAY)) / (F.size("files") - 1)
    rows = sized.select("ts", grown.alias("w"), F.explode(pairs_of(F.col("files"))).alias("p")).select("p.a", "p.b", "ts", "w")
    return rows.groupBy("a", "b").agg(F.sum("w").alias("sum"), F.count("*").alias("count"), F.max("ts").alias("last_change"))


def weights_at(sums: DataFrame, reference: int, epoch: int, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """(a, b, weight, count, last_change) as of a time not before any commit."""
    scale = 0.5 ** ((reference - epoch) / (half_life_days * DAY))
    return sums.select("a", "b", (F.col("sum") * scale).alias("weight"), "count", "last_change")
