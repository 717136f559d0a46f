"""Mixing sources to target weights, with quotas split among output shards by a tree.

Every row falls by a hash into one of its source's blocks of about ROWS_EACH rows, and
an affine permutation ranks the blocks, so no source is ever sorted as a whole. A
source's target is some full passes over its blocks and a rest, which the first blocks
by rank fill: the block where the rest runs out is found by two levels of sums, and
within it rows are taken in hashed order as long as they fit. What each source gives
is thus an exact number of blocks. These quotas are split among the output shards
down a binary tree, each node by one multivariate hypergeometric draw; a shard's quota
of a source is a range of a permuted sequence of (pass, block), so shards are disjoint,
and rows are shuffled within their shard by a hash.

Only tables of one row for each source come to the driver. They are broadcast up to
BROADCAST_ROWS rows and joined by exchange beyond.

Defined results: a null text has size 0; a null source is a source, listed last; rows
that are equal in id, text and source are told apart by numbers, so each may be taken
or left by itself; sources without words have target 0; an empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.llm.copies import ROW, numbered
from weft.llm.texts import WORD
from weft.staging import discard, stage

WEIGHTS = (5.0, 2.0, 1.0)
MOST_TIMES = 3
ROWS_EACH = 500  # rows in a block, about
SHARDS = 16
BROADCAST_ROWS = 50_000
_STEPS = (1_000_003, 999_983)  # primes: one of them has no factor in common with a number of blocks
_SUPER = 256


def words(text: Column) -> Column:
    """Number of words of a whole text; none if null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """Adds source_id (from 1, by code point, null last) and target to (source, source_size, rows).

    Targets share the sum of all sizes by weight; none is above ``most_times`` its source's size, and what
    is above goes to the others by weight. With limits in order of limit over weight, the level at
    which the rest is shared is the largest of the levels that each prefix of limits leaves.
    """
    ordered = W.orderBy(F.col("source").isNull(), "source")
    level = W.orderBy(F.col("most") / F.col("weight"), "source_id")
    every = W.partitionBy()
    lifted = (
        sizes.withColumn("source_id", F.row_number().over(ordered))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_id") - 1) % len(weights) + 1))
        .withColumn("most", F.col("source_size").cast("double") * most_times)
        .withColumn("filled", F.coalesce(F.sum("most").over(level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(level.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(every) - F.col("filled")) / F.col("left"))
        .withColumn("level", F.max("level").over(every))
    )
    return lifted.withColumn("target", F.least("most", F.col("weight") * F.col("level"))).drop("weight", "most", "filled", "left", "level")


def split_quotas(quotas: np.ndarray, shards: int, seed: int = 11) -> np.ndarray:
    """Exact block counts of each source (columns) in each shard (rows), near equal in total."""
    rng = np.random.default_rng(seed)

    def split(left: np.ndarray, n: int) -> list[np.ndarray]:
        if n == 1:
            return [left]
        half = n // 2
        drawn = rng.multivariate_hypergeometric(left, int(left.sum()) * half // n, method="marginals")
        return split(drawn, half) + split(left - drawn, n - half)

    return np.array(split(quotas, shards)).reshape(shards, len(quotas))


def _permuted(index: Column, size: Column, shift: Column) -> Column:
    step = F.when(size % _STEPS[0] == 0, F.lit(_STEPS[1])).otherwise(F.lit(_STEPS[0]))
    return (index * step + shift) % size


@dataclass
class Mix:
    """What decides a row's part in the mix, by its source and key."""

    sources: DataFrame
    picks: DataFrame
    few: bool
    few_picks: bool
    shards: int

    def times(self, rows: DataFrame) -> DataFrame:
        """Adds _times, _rank and the columns of ``sources`` to rows with _source and _key."""
        small = F.broadcast if self.few else (lambda d: d)
        out = rows.join(small(self.sources), F.col("_source").eqNullSafe(F.col("source")), "left").drop("source")
        out = out.withColumn("_rank", _permuted(F.pmod("_key", "blocks"), F.col("blocks"), F.col("shift")))
        small = F.broadcast if self.few_picks else (lambda d: d)
        out = out.join(small(self.picks), (F.col("source_id") == F.col("_p_source")) & (F.col("_key") == F.col("_p_key")), "left")
        rest = (F.col("_rank") < F.col("cut")) | F.col("_p_key").isNotNull()
        return out.withColumn("_times", F.col("passes") + F.when(rest, 1).otherwise(0)).drop("_p_source", "_p_key")

    def shard(self, turn: Column) -> Column:
        """Output shard of a row's block in pass ``turn``."""
        draw = _permuted(turn * F.col("blocks") + F.col("_rank"), F.col("draws"), F.col("shift"))
        return F.size(F.filter("bounds", lambda b: b <= draw))


def key(source: Column, doc_id: Column, text: Column) -> Column:
    return F.xxhash64(source, doc_id, text)


def plan(sized: DataFrame, shards: int = SHARDS, weights: tuple[float, ...] = WEIGHTS, most_times: int = MOST_TIMES, rows_each: int = ROWS_EACH) -> Mix:
    """The mix of rows with _source, _key and size. ``sized`` is read several times: stage it."""
    spark = sized.sparkSession
    sizes = sized.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    goal = targets(sizes, weights, most_times)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("long")
    goal = (
        goal.withColumn("passes", full)
        .withColumn("rest", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0)))
        .withColumn("blocks", F.ceil(F.col("rows") / rows_each).cast("long"))
        .withColumn("shift", F.pmod(F.xxhash64("source", F.lit(5)), "blocks"))
        .drop("rows")
    )
    goal = stage(goal, "sources")
    n = goal.count()
    few = n <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda d: d)
    row = sized.join(small(goal), F.col("_source").eqNullSafe(F.col("source")))
    row = row.select("source_id", "_key", "size", "rest", _permuted(F.pmod("_key", "blocks"), F.col("blocks"), F.col("shift")).alias("rank"))
    row = row.where("rest >= 0.5")

    def cut(sums: DataFrame, by: str) -> DataFrame:
        """Where each source's rest runs out, and what is left of it there."""
        running = W.partitionBy("source_id").orderBy(by)
        sums = sums.withColumn("upto", F.sum("size").over(running))
        return sums.where("upto - size <= rest and upto > rest").select("source_id", by, (F.col("rest") - F.col("upto") + F.col("size")).alias("rest"))

    wide = F.floor(F.col("rank") / _SUPER)
    wide_cut = cut(row.withColumn("wide", wide).groupBy("source_id", "wide").agg(F.sum("size").alias("size"), F.max("rest").alias("rest")), "wide")
    wide_cut = stage(wide_cut, "cuts")
    inside = row.drop("rest").withColumn("wide", wide).join(small(wide_cut), ["source_id", "wide"])
    fine_cut = stage(cut(inside.groupBy("source_id", "rank").agg(F.sum("size").alias("size"), F.max("rest").alias("rest")), "rank"), "cuts")
    units = row.drop("rest").join(small(fine_cut), ["source_id", "rank"]).groupBy("source_id", "_key").agg(F.sum("size").alias("size"), F.max("rest").alias("rest"))
    listed = units.groupBy("source_id").agg(F.max("rest").alias("rest"), F.array_sort(F.collect_list(F.struct("_key", "size"))).alias("u"))
    # Greedy in hashed order: state is what is left and the keys taken.
    start = F.struct(F.col("rest").alias("left"), F.array().cast("array<bigint>").alias("taken"))
    taken = F.aggregate(
        "u",
        start,
        lambda s, x: F.when(
            x["size"] <= s["left"],
            F.struct((s["left"] - x["size"]).alias("left"), F.concat(s["taken"], F.array(x["_key"])).alias("taken")),
        ).otherwise(s),
        lambda s: s["taken"],
    )
    picks = stage(listed.select(F.col("source_id").alias("_p_source"), F.explode(taken).alias("_p_key")), "picks")
    few_picks = picks.count() <= 8 * BROADCAST_ROWS

    drawn = goal.join(fine_cut.select("source_id", F.col("rank").alias("cut")), "source_id", "left")
    drawn = drawn.withColumn("draws", F.col("passes") * F.col("blocks") + F.coalesce(F.col("cut") + 1, F.lit(0)))
    drawn = drawn.withColumn("cut", F.coalesce("cut", F.lit(0)))
    drawn = stage(drawn.drop("rest"), "drawn")
    quotas = drawn.select("source_id", "draws").orderBy("source_id").collect()  # one row for each source
    split = split_quotas(np.array([r["draws"] for r in quotas], np.int64), shards)
    ends = np.cumsum(split, axis=0)[:-1].T.tolist()
    bounds = spark.createDataFrame([(r["source_id"], e) for r, e in zip(quotas, ends, strict=True)], "source_id int, bounds array<bigint>")
    sources = stage(drawn.join(small(bounds), "source_id"), "mix")
    for t in (goal, wide_cut, fine_cut, drawn):
        discard(t)
    return Mix(sources, picks, few, few_picks, shards)


def sized_rows(docs: DataFrame, keep: tuple[str, ...], text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """``keep`` columns, _source, _key and size of each row, and its place, staged. Equal rows have equal keys still."""
    own = key(F.col(source), F.col(doc_id), F.col(text))
    rows = docs.select(*keep, F.col(source).alias("_source"), own.alias("_key"), words(F.col(text)).alias("size"), F.monotonically_increasing_id().alias(ROW))
    return stage(rows, "sizes")


def mix_counts(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, source_size, target, taken and the shards that draw the row, for every row."""
    rows = sized_rows(docs, ("doc_id",))
    apart = numbered(rows, "_key")
    if apart is not rows:
        rows = stage(apart, "sizes")
    mix = plan(rows, shards)
    turns = F.sequence(F.lit(0), (F.col("_times") - 1).cast("int"))
    drawn = mix.times(rows).withColumn("drawn", F.when(F.col("_times") > 0, F.transform(turns, mix.shard)).otherwise(F.array().cast("array<int>")))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("drawn")).alias("taken"), F.array_join("drawn", ",").alias("shards"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """The mix itself: each row as often as it is drawn, in its shard's partition and shuffled there.

    Whole rows are written once more only if some are equal, as a number must then tell them apart.
    """
    cols = docs.columns
    names = tuple(f"c{k}" for k in range(len(cols)))
    at = {c: names[cols.index(c)] for c in (text, source, doc_id)}
    named = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(cols, names, strict=True)))
    rows = sized_rows(named, (), at[text], at[source], at[doc_id])
    named = named.withColumn("_source", F.col(at[source])).withColumn("_key", key(*(F.col(at[c]) for c in (source, doc_id, text))))
    if numbered(rows, "_key") is not rows:
        named = numbered(stage(named.withColumn(ROW, F.monotonically_increasing_id()), "named"), "_key")
        rows = stage(named.select("_source", "_key", words(F.col(at[text])).alias("size")), "sizes")
    mix = plan(rows, shards)
    drawn = mix.times(named).where("_times > 0").withColumn("_turn", F.explode(F.sequence(F.lit(0), (F.col("_times") - 1).cast("int"))))
    drawn = drawn.withColumn("_shard", mix.shard(F.col("_turn"))).withColumn("_lot", F.xxhash64("_key", "_turn", "_shard"))
    parts = max(1, rows.count() // (20_000 * shards))
    return (
        drawn.select(*names, "_shard", "_lot")
        .repartition("_shard", F.pmod("_lot", F.lit(max(4, parts))))
        .sortWithinPartitions("_shard", "_lot")
        .select(*(F.col(n).alias(c) for n, c in zip(names, cols, strict=True)))
    )
