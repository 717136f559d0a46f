"""Numbers for rows that are equal, so that operators can tell them apart.

A third of all rows may be equal, so copies are numbered within the partitions of a
staged table first, and each partition's numbers go on from those before it: no task
holds more than its own part of the copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.staging import stage

ROW = "_weft_row"


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``key``, a non-null long, made different for each of the rows that share one.

    ``rows`` is staged and has ROW, the number that ``monotonically_increasing_id`` gave it there. The first of
    the equal rows keeps its key, so keys that are unique never change, and which of them it is makes no difference.
    """
    repeated = stage(rows.groupBy(key).count().where("count > 1").select(key), "repeated")
    if repeated.isEmpty():
        return rows
    part = F.shiftright(ROW, 33).alias("_part")
    some = rows.join(repeated, key, "left_semi").select(key, ROW, part)
    sums = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = some.groupBy(key, "_part").count().select(key, "_part", F.coalesce(F.sum("count").over(sums), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy(key, "_part").orderBy(ROW))
    copy = some.withColumn("_place", place).join(before, [key, "_part"]).select(ROW, (F.col("_before") + F.col("_place") - 1).alias("_copy"))
    own = F.when(F.col("_copy") > 0, F.xxhash64(key, "_copy")).otherwise(F.col(key))
    return rows.join(copy, ROW, "left").withColumn(key, own).drop("_copy")
