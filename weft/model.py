"""Tables of a multilayer file graph, and how repeated edges combine."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.staging import stage

LAYERS = ("hierarchy", "structure", "evolution", "docs")
FORMAT = 1

NODE_SCHEMA = "id string, kind string, lang string, is_test boolean, lines bigint, changes bigint"
DETAIL = "struct<count:bigint,last_change:bigint,imports:array<string>,symbols:array<string>,mentions:bigint>"
EDGE_SCHEMA = f"layer string, a string, b string, weight double, kinds array<string>, detail {DETAIL}"
#: A contribution to an edge: its ends in any order, one kind, and ``seq`` to order kinds and lists by.
PART_SCHEMA = "layer string, u string, v string, weight double, kind string, seq bigint, count bigint, last_change bigint, imports array<string>, symbols array<string>, mentions bigint"


def edge_parts(df: DataFrame) -> DataFrame:
    """``df`` with the columns of PART_SCHEMA, absent ones null."""
    wanted = [c.split(" ")[:2] for c in PART_SCHEMA.split(", ")]
    return df.select(*(F.col(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in wanted))


def merge_edges(parts: DataFrame) -> DataFrame:
    """Edges from contributions: weights, counts and mentions add up, the last change is the latest, kinds and lists
    are united in order of ``seq``. Self-loops are an error."""
    looped = F.when(F.col("u") == F.col("v"), F.raise_error(F.concat(F.lit("self-loop on "), "u"))).otherwise(F.least("u", "v"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("seq", c))), lambda s: s[c])
    united = lambda c: F.array_distinct(F.flatten(F.filter(in_order(c), lambda x: x.isNotNull())))
    merged = parts.select("*", looped.alias("a"), F.greatest("u", "v").alias("b")).groupBy("layer", "a", "b").agg(
        F.sum("weight").alias("weight"), F.array_distinct(in_order("kind")).alias("kinds"), F.sum("count").alias("count"), F.max("last_change").alias("last_change"),
        united("imports").alias("imports"), united("symbols").alias("symbols"), F.sum("mentions").alias("mentions"),
    )
    return merged.select("layer", "a", "b", "weight", "kinds", F.struct("count", "last_change", "imports", "symbols", "mentions").alias("detail"))


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    """(layer, src, dst, ``more``) in both directions."""
    return edges.select("layer", F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"), *more).select("layer", "e.src", "e.dst", *more)


def first_nodes(nodes: DataFrame, seq: str) -> DataFrame:
    """One row for each id: the first by ``seq``."""
    rest = [c for c in nodes.columns if c not in ("id", seq)]
    return nodes.groupBy("id").agg(F.min_by(F.struct(*rest), seq).alias("n")).select("id", *(f"n.{c}" for c in rest))


@dataclass
class FileGraph:
    """A project's graph: nodes, edges of all layers, communities (file, community) and what it was built from."""

    nodes: DataFrame
    edges: DataFrame
    communities: DataFrame
    meta: dict[str, Any] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def files(self) -> DataFrame:
        return self.nodes.where("kind = 'file'")

    def layer(self, name: str) -> DataFrame:
        return self.edges.where(F.col("layer") == name)

    def neighbors(self, node: str, layer: str) -> DataFrame:
        rows = self.layer(layer).where((F.col("a") == node) | (F.col("b") == node))
        return rows.withColumn("path", F.when(F.col("a") == node, F.col("b")).otherwise(F.col("a")))

    def staged(self) -> FileGraph:
        """The same graph, computed once."""
        return FileGraph(stage(self.nodes, "nodes"), stage(self.edges, "edges", ["layer"]).select("layer", "a", "b", "weight", "kinds", "detail"), stage(self.communities, "communities"), self.meta)

    def views(self, prefix: str = "") -> None:
        """Register nodes, edges and communities as temporary views for SQL."""
        for name in ("nodes", "edges", "communities"):
            getattr(self, name).createOrReplaceTempView(prefix + name)
