"""Renames followed through history, as an as-of lookup and pointer jumping.

Every change has a position in the order it is walked in. What a change writes about a
path is a pointer to another path at an earlier position, or nothing (the file did not
exist). A path seen at a position resolves to the last write before it: a window over
the path. Pointers lead to smaller positions, so doubling them ends after as many
rounds as the logarithm of the longest chain of renames.

``changes`` has sha, ts, seq (of the commit in walking order), pos (of the change in
it), status, path and old_path; ``alive`` has path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.staging import stage


def _resolve(refs: DataFrame, writes: DataFrame, alive: DataFrame) -> DataFrame:
    """``refs`` (rid, path, at) with target: the path's name at the reference revision, or null.

    ``writes`` has path, at and to (path, at; null: the file did not exist). A path without an earlier write is itself, if alive.
    """
    asked = refs.select("path", "at", F.struct("rid").alias("ref"), F.lit(None).cast("struct<to:struct<path:string,at:bigint>>").alias("w"))
    told = writes.select("path", "at", F.lit(None).cast(asked.schema["ref"].dataType).alias("ref"), F.struct("to").alias("w"))
    before = W.partitionBy("path").orderBy("at").rangeBetween(W.unboundedPreceding, -1)
    state = asked.unionByName(told).withColumn("last", F.last("w", ignorenulls=True).over(before)).where("ref is not null").select("ref.rid", "path", "last")
    live = alive.select("path").distinct().withColumn("live", F.lit(True))

    # Every write with a pointer is looked up once; then pointers are doubled.
    def settle(rows: DataFrame, key: str) -> DataFrame:
        own = F.when(F.col("last").isNull() & F.col("live"), F.col("path"))
        return rows.join(live, "path", "left").select(key, own.alias("target"), F.col("last.to").alias("to"))

    links = writes.where("to is not null").select("to").distinct().select(F.struct("to.path", "to.at").alias("rid"), "to.path", "to.at")
    asked2 = links.select("path", "at", F.struct("rid").alias("ref"), F.lit(None).cast("struct<to:struct<path:string,at:bigint>>").alias("w"))
    told2 = writes.select("path", "at", F.lit(None).cast(asked2.schema["ref"].dataType).alias("ref"), F.struct("to").alias("w"))
    state2 = asked2.unionByName(told2).withColumn("last", F.last("w", ignorenulls=True).over(before)).where("ref is not null").select("ref.rid", "path", "last")
    jump = stage(settle(state2, "rid"), "jumps")
    while jump.where("to is not null").limit(1).count():
        nxt = jump.select(F.col("rid").alias("to"), F.col("target").alias("t2"), F.col("to").alias("to2"), F.lit(True).alias("hit"))
        jump = stage(jump.join(nxt, "to", "left").select("rid", F.when(F.col("to").isNull(), F.col("target")).otherwise(F.col("t2")).alias("target"), F.col("to2").alias("to")), "jumps")
    end = jump.select(F.col("rid").alias("to"), F.col("target").alias("t2"))
    return settle(state, "rid").join(end, "to", "left").select("rid", F.when(F.col("to").isNull(), F.col("target")).otherwise(F.col("t2")).alias("target"))


def _numbered(changes: DataFrame) -> DataFrame:
    """Changes with ``at``, two apart: a reference is looked up between two writes."""
    return changes.withColumn("at", F.col("seq") * (1 << 24) + F.col("pos") * 4)


def _writes(rows: DataFrame, entries: Column) -> DataFrame:
    return rows.select(F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select("e.path", "e.at", "e.to")


def _entry(path: Column, at: Column, to: Column) -> Column:
    return F.struct(path.alias("path"), at.cast("bigint").alias("at"), to.cast("struct<path:string,at:bigint>").alias("to"))



def normalize_backward(changes: DataFrame, alive: DataFrame, follow_renames: bool = True) -> DataFrame:
    """(sha, ts, file): files of commits walked newest first, by their names in ``alive``; deletions are not counted."""
    c = _numbered(changes)
    none = F.lit(None)
    renamed = (F.col("status") == "R") & F.col("old_path").isNotNull()
    here = F.struct(F.col("path").alias("path"), F.col("at").alias("at"))
    writes = _writes(
        c,
        F.array(
            F.when(renamed, _entry(F.col("old_path"), F.col("at") + 1, here if follow_renames else none)),
            F.when(renamed | F.col("status").isin("A", "C", "D"), _entry(F.col("path"), F.col("at") + F.when(renamed, 2).otherwise(1), none)),
        ),
    )
    refs = c.where("status <> 'D'").select(F.struct("sha", "ts", "at").alias("rid"), "path", "at")
    return _resolve(refs, writes, alive).where("target is not null").select("rid.sha", "rid.ts", F.col("target").alias("file")).distinct()


def normalize_forward(changes: DataFrame, alive: DataFrame) -> DataFrame:
    """(sha, ts, file): files of commits walked oldest first, by their names in ``alive``; deletions are counted."""
    c = _numbered(changes)
    none = F.lit(None)
    renamed = (F.col("status") == "R") & F.col("old_path").isNotNull()
    was = F.struct(F.col("old_path").alias("path"), F.col("at").alias("at"))
    writes = _writes(
        c,
        F.array(
            F.when(renamed, _entry(F.col("old_path"), F.col("at") + 1, none)),
            F.when(renamed, _entry(F.col("path"), F.col("at") + 2, was)),
            F.when(F.col("status").isin("A", "C"), _entry(F.col("path"), F.col("at") + 1, none)),
            F.when(F.col("status") == "D", _entry(F.col("path"), F.col("at") + 3, none)),
        ),
    )
    seen = F.when(renamed, F.col("old_path")).otherwise(F.col("path"))
    refs = c.where(renamed | ~F.col("status").isin("A", "C")).select(F.struct("sha", "ts", "at").alias("rid"), seen.alias("path"), "at")
    return _resolve(refs, writes, alive).where("target is not null").select("rid.sha", "rid.ts", F.col("target").alias("file")).distinct()
