"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are distinct 64-bit values, so copies of a text meet in one row before
anything is joined. The top of the trie is a table of cells (prefixes that hold at
most a fixed number of fingerprints); a cell is paired with every cell whose prefix
differs in no more bits than the error budget, and each pair is one task, which goes
on with the same traversal below: it walks pairs of nodes, adds up the bits in which
their branches differ and drops a pair once the budget is exceeded. No fingerprint
has more than 1 + 64 + 2016 others within two bits, so work stays in proportion to
the number of fingerprints, times the square of the trie's depth at most.

Defined results: a null or empty text has fingerprint zero and is linked like any
other; rows with equal doc_id stay apart; a group in which every doc_id is null has a
null component_id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.texts import LOWER, map_batches, utf8
from weft.operators.components import connected_components
from weft.staging import stage

SHINGLE = 3
BUDGET = 2
#: Fingerprints that a cell may hold: MIN_CELL, or more where cells of that size would be more than MAX_CELLS.
MIN_CELL, MAX_CELLS = 1024, 65_536
#: Bits by which prefixes that hold more grow in a round: each then gives at most 2^STEP counts.
STEP = 3
_CHUNK = 1 << 16
_FRONTIER = 1 << 18


def shingles(text: bytes | None, width: int) -> Iterator[np.ndarray]:
    """Hashes of a UTF-8 text's word shingles in order, repeats included, in arrays of bounded length; a shorter text is one shingle."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[:n]
    end = end[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, _CHUNK):
        spans = zip(start[k : k + _CHUNK].tolist(), end[k : k + _CHUNK].tolist(), strict=True)
        yield np.array([digest(joined[s:e], 42) for s, e in spans], np.uint64)


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a UTF-8 text over its word shingles, repeats included."""
    return majority(shingles(text, width))


def majority(hashes: Iterable[np.ndarray]) -> int:
    """The signed 64-bit number of the bits that are set in over half of the hashes; zero for none."""
    ones, n = np.zeros(64, np.int64), 0
    for h in hashes:
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "fp") -> DataFrame:
    """``keep`` columns and the fingerprint of each row's whole text."""
    schema = docs.select(*keep).schema.add(out, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([fingerprint(t) for t in utf8(batch.column(0))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], values], names=[*keep, out])

    return map_batches(docs.select(F.col(text).alias("_text"), *keep), run, schema)


def _cells(fps: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (unsigned, ascending) and depths of the cells, from counts by prefix.

    A round collects at most 2^STEP counts for each prefix that still holds too many, of which there are fewer
    than n / most <= MAX_CELLS at any depth. What a round reads is told by a search among those prefixes.
    """
    most = max(MIN_CELL, -(-n // MAX_CELLS))
    done: list[tuple[int, int]] = []
    wide = [(0, 0)] if n > most else []  # prefixes, with their depth, that hold too many
    if not wide and n:
        done.append((0, 0))
    while wide:
        depth = wide[0][1]
        deep = min(64, depth + STEP)
        counts = _counts(fps, [p for p, _ in wide], depth, deep)
        keys = np.array(sorted(counts), np.uint64)
        total = np.concatenate([[0], np.cumsum([counts[int(k)] for k in keys])])
        walk, wide = wide, []
        while walk:
            p, d = walk.pop()
            lo, hi = (int(np.searchsorted(keys, np.uint64(x))) if x < 1 << 64 else len(keys) for x in (p << (deep - d), (p + 1) << (deep - d)))
            if hi == lo:
                continue
            if total[hi] - total[lo] <= most or d == 64:
                done.append((p << (64 - d), d))
            elif d == deep:
                wide.append((p, d))
            else:
                walk += [(2 * p, d + 1), (2 * p + 1, d + 1)]
    done.sort()
    return np.array([x for x, _ in done], np.uint64), np.array([d for _, d in done], np.int64)


def _counts(fps: DataFrame, known: list[int], depth: int, deep: int) -> dict[int, int]:
    """Fingerprints by prefix of ``deep`` bits, under the ``known`` prefixes of ``depth`` bits only."""
    among = np.array(sorted(known), np.uint64)

    def under(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if depth:
                top = fp >> np.uint64(64 - depth)
                fp = fp[among[np.minimum(np.searchsorted(among, top), len(among) - 1)] == top]
            p, count = np.unique(fp >> np.uint64(64 - deep), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(count.astype(np.int64))], names=["p", "n"])

    rows = fps.select("fp").mapInArrow(under, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).collect()
    return {r[0] % (1 << 64): r[1] for r in rows}


def _partners(c: int, start: np.ndarray, depth: np.ndarray, budget: int) -> np.ndarray:
    """Cells whose prefix differs from cell ``c`` in ``budget`` bits at most, as far as both go."""
    common = np.minimum(depth, depth[c])
    differ = np.where(common > 0, (start ^ start[c]) >> (64 - np.maximum(common, 1)).astype(np.uint64), np.uint64(0))
    return np.nonzero(np.bitwise_count(differ) <= budget)[0]


def trie_pairs(a: np.ndarray, b: np.ndarray | None, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two sorted arrays of distinct values (``b`` None: of one with itself) within ``budget`` bits."""
    alone = b is None
    b = a if alone else b
    if not len(a) or not len(b):
        return
    one = np.array([0], np.int64)
    stack = [(0, one, one + len(a), one, one + len(b), one)]
    while stack:
        depth, la, ha, lb, hb, dist = stack.pop()
        few = (ha - la) * (hb - lb) <= 16
        if depth == 64:
            few[:] = True
        if few.any():
            x, w, y = la[few], hb[few] - lb[few], lb[few]
            many = (ha[few] - x) * w
            at = np.repeat(np.arange(len(x)), many)
            k = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            i, j = x[at] + k // w[at], y[at] + k % w[at]
            ok = np.bitwise_count(a[i] ^ b[j]) <= budget
            if alone:
                ok &= i < j
            if ok.any():
                yield i[ok], j[ok]
        la, ha, lb, hb, dist = (v[~few] for v in (la, ha, lb, hb, dist))
        if not len(la):
            continue
        bit = np.uint64(1) << np.uint64(63 - depth)
        above = ~((bit << np.uint64(1)) - np.uint64(1)) if depth else np.uint64(0)
        ma = np.clip(np.searchsorted(a, (a[la] & above) | bit), la, ha)
        mb = np.clip(np.searchsorted(b, (b[lb] & above) | bit), lb, hb)
        same = (la == lb) & (ha == hb) if alone else np.zeros(len(la), bool)
        parts = [
            (la, ma, lb, mb, dist, None), (ma, ha, mb, hb, dist, None),
            (la, ma, mb, hb, dist + 1, None), (ma, ha, lb, mb, dist + 1, ~same),
        ]
        found = []
        for p0, p1, q0, q1, d, only in parts:
            live = (p1 > p0) & (q1 > q0) & (d <= budget)
            if only is not None:
                live &= only
            found.append([v[live] for v in (p0, p1, q0, q1, d)])
        cols = [np.concatenate(v) for v in zip(*found, strict=True)]
        for k in range(0, len(cols[0]), _FRONTIER):
            stack.append((depth + 1, *(v[k : k + _FRONTIER] for v in cols)))


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the sets of each pair; the smaller index becomes the root."""
    while len(i):
        i, j = parent[i], parent[j]
        apart = i != j
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))
        parent = _roots(parent)
    return parent


def trie_links(fps: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Links (a, b) that span the near-duplicate graph of distinct fingerprints ``fp``.

    Two values within ``budget`` bits are always connected by the links returned; each
    task sends on a spanning forest of what it found rather than every pair.
    """
    start, depth = _cells(fps, fps.count())
    cells = len(start)
    near: dict[int, np.ndarray] = {}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps_here = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k in range(0, len(fps_here), 4096):
                fp = fps_here[k : k + 4096]
                cell = np.searchsorted(start, fp.view(np.uint64), "right") - 1
                for c in np.unique(cell).tolist():
                    if c not in near:
                        near[c] = _partners(c, start, depth, budget)
                to = [near[c] for c in cell.tolist()]
                many = np.fromiter(map(len, to), np.int64, len(to))
                to, cell = np.concatenate(to), np.repeat(cell, many)
                pair = np.minimum(to, cell) * cells + np.maximum(to, cell)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(to < cell), pa.array(np.repeat(fp, many))], names=["pair", "second", "fp"])

    def meet(table: pa.Table) -> pa.Table:
        pair, second = table["pair"][0].as_py(), table["second"].to_numpy()
        fp = table["fp"].to_numpy().view(np.uint64)
        a, b = np.sort(fp[~second]), np.sort(fp[second])
        alone = pair // cells == pair % cells
        both = a if alone else np.concatenate([a, b])
        parent = np.arange(len(both))
        for i, j in trie_pairs(a, None if alone else b, budget):
            parent = unite(parent, i, j if alone else j + len(a))
        linked = np.nonzero(parent != np.arange(len(both)))[0]
        return pa.table({"a": both[linked].view(np.int64), "b": both[parent[linked]].view(np.int64)})

    routed = fps.select("fp").mapInArrow(route, "pair long, second boolean, fp long")
    return routed.groupBy("pair").applyInArrow(meet, "a long, b long")


def components(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(fp, root, component_id) of every distinct fp: its component's fingerprint and smallest doc_id."""
    least = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    roots = connected_components(trie_links(least, budget))
    root = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least_of = root.groupBy("root").agg(F.min("first").alias("component_id"))
    return root.join(least_of, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints = stage(fingerprints(docs, text), "prints")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return prints.join(components(prints, budget), "fp").select("doc_id", hexed, "component_id")


def keep_one(docs: DataFrame, text: str = "text", budget: int = BUDGET) -> DataFrame:
    """One row of each near-duplicate group: the smallest doc_id, among equal ones the first stored."""
    cols = docs.columns
    row, fp = "_weft_row", "fp"
    named = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(cols)), F.col("doc_id").alias("_id"), F.col(text).alias("_text"))
    names = tuple(f"c{k}" for k in range(len(cols)))
    rows = stage(fingerprints(named, "_text", (*names, "_id")).withColumn(row, F.monotonically_increasing_id()), "rows")
    prints = rows.select(F.col("_id").alias("doc_id"), fp, row)
    group = components(prints, budget)
    best = (
        prints.join(group, fp)
        .groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", row)).alias("b"))
        .select(F.col(f"b.{row}").alias(row))
    )
    return rows.join(best, row, "left_semi").select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(cols)))
