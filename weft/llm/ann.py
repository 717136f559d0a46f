"""Approximate nearest neighbours by largest inner product.

A forest of random-projection trees is grown on the driver from a bounded sample (at
most SAMPLE distinct vectors); every vector is then indexed under one leaf of each
tree. A query walks all trees with one priority queue, nearest side of the nearest
open branch first, until the leaves it has opened hold ``share`` times as many rows as
there are vectors (a row counts once in each tree). All rows of those leaves are
ranked by their exact inner product in double precision. Vectors get one more
component, which brings them to equal length, so that the largest inner product is the
smallest distance for the trees.

Equal vectors are one entry of the index, with the TOP + 1 smallest ids, and are
expanded when results are made, so a vector that a third of all rows share is no
longer than another. Queries go to the cells that hold the leaves they have opened. A
cell that more than QUERY_BLOCK of them visit meets them in blocks: only there are its
rows sent once for each block, and cells that nobody visits are not sent at all. What
is exchanged thus follows the pairs that are ranked, not the product of both tables.

On vectors without any structure (uniform on a sphere, 64 components) 20 neighbours
need about half of all rows to be looked at for a recall of 0.9, whatever their
number; the default share gives about 0.97 there. Clustered vectors need far less.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor rows without an id, nor vectors whose length is not the
most frequent one (the larger of two as frequent); fewer candidates than asked for are
all returned; of repeated rows only the query's own row is left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.staging import stage

TOP = 20
TREES = 4
SAMPLE = 65_536
LEAF = 256  # sampled rows in a leaf
SHARE = 1.3
CELL_ROWS = 8192
QUERY_BLOCK = 16_384
_TOGETHER = 1024  # queries at a time


@dataclass
class Tree:
    """Inner nodes: plane, offset and children; a child below zero is the leaf ~child."""

    plane: np.ndarray
    offset: np.ndarray
    child: np.ndarray
    sizes: np.ndarray  # sampled rows of each leaf

    @classmethod
    def grow(cls, x: np.ndarray, rng: np.random.Generator, leaf: int = LEAF) -> Tree:
        planes, offsets, children, sizes = [], [], [], []

        def grow(rows: np.ndarray) -> int:
            if len(rows) <= leaf:
                sizes.append(len(rows))
                return ~(len(sizes) - 1)
            a, b = x[rng.choice(rows, 2, replace=False)].astype(np.float64)
            some = x[rows if len(rows) <= 512 else rng.choice(rows, 512, replace=False)].astype(np.float64)
            for _ in range(4):  # towards two means
                left = some @ a - a @ a / 2 > some @ b - b @ b / 2
                if left.all() or not left.any():
                    break
                a, b = some[left].mean(axis=0), some[~left].mean(axis=0)
            w = a - b
            w /= max(np.linalg.norm(w), 1e-12)
            side = x[rows] @ w
            cut = float(np.median(side))
            right = side > cut
            if right.all() or not right.any():
                right = np.arange(len(rows)) % 2 == 0
            k = len(planes)
            planes.append(w)
            offsets.append(cut)
            children.append([0, 0])
            children[k] = [grow(rows[~right]), grow(rows[right])]
            return k

        root = grow(np.arange(len(x)))
        if root < 0:
            planes, offsets, children = [np.zeros(x.shape[1])], [0.0], [[root, root]]
        return cls(np.array(planes, np.float32), np.array(offsets), np.array(children), np.array(sizes))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), np.int64)
        while (going := np.nonzero(at >= 0)[0]).size:
            node = at[going]
            far = np.einsum("ij,ij->i", x[going], self.plane[node]) > self.offset[node]
            at[going] = self.child[node, far.astype(np.int64)]
        return ~at


@dataclass
class Forest:
    trees: list[Tree]
    norm: float
    rows: int  # sampled

    def extended(self, x: np.ndarray) -> np.ndarray:
        last = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0.0))
        return np.hstack([x, last[:, None]])

    def probes(self, q: np.ndarray, share: float) -> list[tuple[int, int]]:
        """(tree, leaf) to look at, by one queue over all trees, until they hold ``share`` times the sampled rows."""
        x = np.append(q, 0.0)
        margins = [t.plane @ x - t.offset for t in self.trees]
        queue = [(0.0, t, 0) for t in range(len(self.trees))]
        out: dict[tuple[int, int], None] = {}  # a tree of one leaf has it on both sides
        seen = 0.0
        while queue and seen < share * self.rows:
            far, t, node = heapq.heappop(queue)
            tree, margin = self.trees[t], margins[t]
            while node >= 0:
                side = int(margin[node] > 0)
                heapq.heappush(queue, (max(far, abs(float(margin[node]))), t, int(tree.child[node, 1 - side])))
                node = int(tree.child[node, side])
            if (t, ~node) not in out:
                out[t, ~node] = None
                seen += tree.sizes[~node]
        return list(out)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim) if len(column) else np.zeros((0, dim))


def _best(who: np.ndarray, what: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` best of each ``who``, each ``what`` once, ties to the smaller."""
    order = np.lexsort((-score, what, who))
    who, what, score = who[order], what[order], score[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (what[1:] != what[:-1])
    who, what, score = who[new], what[new], score[new]
    order = np.lexsort((what, -score, who))
    who, what, score = who[order], what[order], score[order]
    first = np.searchsorted(who, who)
    few = np.arange(len(who)) - first < most
    return who[few], what[few], score[few]


def _lists(names: np.ndarray, who: np.ndarray, what: np.ndarray, score: np.ndarray) -> pa.Table:
    """A row for each name (``who`` points to them, in order), with lists."""
    ends = np.searchsorted(who, np.arange(len(names) + 1)).astype(np.int32)
    return pa.table({"qid": pa.array(names, pa.int64()), "cids": pa.ListArray.from_arrays(ends, pa.array(what, pa.int64())), "scores": pa.ListArray.from_arrays(ends, pa.array(score, pa.float64()))})


def _vectors(table: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    v = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0.0))
    dims = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = dims["d"] if dims else 1
    return v.where(F.size("v") == dim), dim


def build(index: DataFrame, dim: int, trees: int = TREES, sample: int = SAMPLE, seed: int = 17) -> Forest:
    """A forest from a sample, drawn by a hash, of ``sample`` entries at most."""
    n, norm = index.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    lot = F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(1 << 30))
    some = index.where(lot < min(1 << 30, (1 << 30) * sample // max(n, 1))).select(F.col("v").cast("array<float>").alias("v"), "cid").orderBy("cid").limit(sample)
    x = np.array([r["v"] for r in some.select("v").collect()], np.float32).reshape(-1, dim)
    forest = Forest([], float(np.sqrt(norm or 0.0)), len(x))
    x = forest.extended(x)
    rng = np.random.default_rng(seed)
    forest.trees = [Tree.grow(x, rng) for _ in range(trees)]
    return forest


def search(
    table: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", top: int = TOP, share: float = SHARE, trees: int = TREES
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``top`` nearest found for each row for which ``queries`` holds."""
    v, dim = _vectors(table, vec_id, vector)
    asked = table.where(queries).select(F.col(vec_id).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    first = v.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= top + 1)
    index = stage(first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("cid", F.col("ids")[0]), "vectors")
    own = stage(asked.join(index.select("v", "cid"), "v").select("query_id", "cid"), "queries")
    n = index.count()
    forest = build(index, dim, trees)
    sent = table.sparkSession.sparkContext.broadcast(forest)  # SAMPLE / LEAF planes for each tree
    leaves = max((len(t.sizes) for t in forest.trees), default=1)
    groups = max(1, min(leaves, -(-n // CELL_ROWS)))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = sent.value.extended(_matrix(batch.column(1), dim))
            for t, tree in enumerate(sent.value.trees):
                leaf = tree.leaves(x)
                cell = t * groups + leaf * groups // len(tree.sizes)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(leaf), *batch.columns], names=["cell", "leaf", "cid", "v"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, q in zip(batch.column(0).to_pylist(), _matrix(batch.column(1), dim), strict=True):
                cells: dict[int, list[int]] = {}
                for t, leaf in sent.value.probes(q, share):
                    cells.setdefault(t * groups + leaf * groups // len(sent.value.trees[t].sizes), []).append(leaf)
                m = len(cells)
                leaves = pa.array(list(cells.values()), pa.list_(pa.int64()))
                copies = pa.ListArray.from_arrays(np.arange(0, (m + 1) * dim, dim, dtype=np.int32), pa.array(np.tile(q, m)))
                yield pa.RecordBatch.from_arrays([pa.array(list(cells), pa.int64()), pa.array([cid] * m, pa.int64()), leaves, copies], names=["cell", "qid", "leaves", "q"])

    def rank(rows: pa.Table, asking: pa.Table) -> pa.Table:
        """A row for each query: the best of the leaves of this cell that it asked for."""
        if not rows.num_rows or not asking.num_rows:
            return _lists(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        x = _matrix(rows["v"].combine_chunks(), dim)
        leaf, cid = rows["leaf"].to_numpy(), rows["cid"].to_numpy()
        order = np.argsort(leaf, kind="stable")
        x, cid = x[order], cid[order]
        names, start = np.unique(leaf[order], return_index=True)
        at = dict(zip(names.tolist(), zip(start.tolist(), [*start[1:].tolist(), len(x)], strict=True), strict=True))
        q = _matrix(asking["q"].combine_chunks(), dim)
        wants: dict[int, list[int]] = {}
        for k, own_leaves in enumerate(asking["leaves"].to_pylist()):
            for one in own_leaves:
                wants.setdefault(one, []).append(k)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for one, who in wants.items():
            s, e = at.get(one, (0, 0))
            for k in range(0, len(who) if e > s else 0, _TOGETHER):
                some = np.array(who[k : k + _TOGETHER])
                scores = q[some] @ x[s:e].T
                keep = min(top + 1, e - s)
                least = np.partition(scores, e - s - keep, axis=1)[:, e - s - keep]
                i, j = np.nonzero(scores >= least[:, None])  # ties at the end are all kept
                found.append((some[i], cid[s + j], scores[i, j]))
        who, what, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return _lists(asking["qid"].to_numpy(), *_best(who, what, score, top + 1))

    def merge(rows: pa.Table) -> pa.Table:
        """The best of all cells for each query of a group; a vector may come from several trees."""
        who = np.repeat(rows["qid"].to_numpy(), np.diff(rows["cids"].combine_chunks().offsets.to_numpy()))
        what, score = (rows[c].combine_chunks().flatten().to_numpy() for c in ("cids", "scores"))
        names, local = np.unique(who, return_inverse=True)
        local, what, score = _best(local, what, score, top + 1)
        return pa.table({"qid": names[local], "cid": what, "score": score})

    distinct = own.select("cid").distinct().join(index, "cid").select("cid", "v")
    asking = stage(distinct.mapInArrow(ask, "cell long, qid long, leaves array<long>, q array<double>"), "asking")
    # One row for each cell that is visited, of which there is one for CELL_ROWS rows and tree.
    blocks = asking.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("long").alias("blocks"))
    asking = asking.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("qid"), "blocks")).drop("blocks")
    placed = index.select("cid", "v").mapInArrow(put, "cell long, leaf long, cid long, v array<double>")
    placed = placed.join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    ranked = placed.groupBy("cell", "block").cogroup(asking.groupBy("cell", "block")).applyInArrow(rank, "qid long, cids array<long>, scores array<double>")
    some = F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-own.count() // QUERY_BLOCK) * 8))).alias("some")
    best = ranked.withColumn("some", some).groupBy("some").applyInArrow(merge, "qid long, cid long, score double")
    best = best.join(index.select("cid", "ids"), "cid").select(F.col("qid").alias("own"), "cid", "score", "ids")
    near = own.withColumnRenamed("cid", "own").join(best, "own")
    mine = F.when(F.col("own") == F.col("cid"), F.array_position("ids", F.col("query_id"))).otherwise(F.lit(0))
    near = near.withColumn("ids", F.filter("ids", lambda x, k: k + 1 != mine)).select("query_id", "own", "score", F.explode("ids").alias("vec_id"))
    order = W.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
