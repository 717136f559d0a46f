"""Connected components of an edge table of any size.

Alternates the large-star and small-star steps of Kiveris et al. (2014). Every
step is a partial aggregate and an equi-join, so a hub with very many neighbours
is summed map-side and its join can be split by AQE. Each round's edges go to a
staged table, which keeps plans short and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.staging import discard, stage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge to a smaller root.

    ``root`` is the smallest node that can be reached. Roots themselves are not
    listed. Null ends and self-loops are ignored; an empty table gives no rows.
    """
    e = stage(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
        )
        small = (
            large.join(low, "u").select(F.explode(pair).alias("p")).select("p.u", "p.v").where("u != v").distinct()
        )
        shorter = stage(small, "edges")
        discard(e)
        e = shorter
