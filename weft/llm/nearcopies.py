"""Near copies: SimHash trie join, then what its few bits cannot reach, all by exact Jaccard.

Rows with equal sets of word shingles meet first, so copies count once. The sets'
fingerprints go through the binary trie self-join of ``simhash``, and its links connect
the closest copies. Two sets of Jaccard similarity 0.8 differ in about 10 of 64 bits,
though, and a trie walked with so wide a budget prunes nothing: it compares all pairs.
So sets that are still apart become candidates where one of BANDS bands of ROWS minimum
hashes is equal; two sets of similarity s share no band with probability
(1 - s^ROWS)^BANDS, which is 5e-8 at 0.8. Wherever a candidate comes from, it counts only
if the sets themselves, made anew from both texts, have at least the similarity asked for.

A bucket's pairs are compared unless both are connected already. Buckets of a large group
would hold pairs with its square, so no rows are made of these. Their members are first
compared with a few pivots, which connects most of them. The rest is compared with the
whole group in blocks: each set is told by how it differs from a pivot of its group, which
is short for near copies, and a task counts for two blocks of such differences at once what
they have in common, from which the exact similarity follows. It returns a spanning forest
of the links it finds. No pair of a bucket is left out.

Defined results: a null or empty text has the empty set, like any other without words;
rows without a doc_id stay where no other row of their group has one; of equal rows the
first stored one stays; an empty table gives an empty result; further columns come along.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from weft.llm.simhash import majority, shingles, trie_links, unite
from weft.llm.texts import map_batches, utf8
from weft.operators.components import connected_components
from weft.staging import discard, stage

SHINGLE = 5
#: Least similarity, as a fraction that integers can check.
LEAST = (4, 5)
BANDS, ROWS = 32, 4
#: Members of a bucket outside its largest component up to which all of its open pairs are compared at once.
FEW = 16
_PIVOTS = 4
#: Hashes of differences in a block, about.
BLOCK = 1 << 20
_CELLS = 1 << 22  # pairs whose common hashes are counted at a time
_CHUNK = 1 << 12
_random = np.random.default_rng(7)
_ADD, _TIMES = (_random.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) for _ in "ab")
_TIMES |= np.uint64(1)


def shingle_set(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes, ascending, of a UTF-8 text's word shingles; a shorter text is one shingle."""
    parts = list(shingles(text, width))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit key a band; none for an empty set."""
    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for k in range(0, len(hashes), _CHUNK):
        low = np.minimum(low, ((hashes[k : k + _CHUNK, None] ^ _ADD) * _TIMES).min(axis=0))
    keys = [xxhash.xxh64_intdigest(low[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """True if two sets' Jaccard similarity is LEAST or more."""
    few, many = sorted((len(a), len(b)))
    if few * LEAST[1] < many * LEAST[0]:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LEAST[1] >= (few + many - both) * LEAST[0]


def _sets(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns, the identity of each row's set, its fingerprint and its band keys; ``_text`` comes along."""
    schema = docs.select(*keep, "_text").schema.add("set", "long").add("fp", "long").add("bands", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints, bands, known = [], [], [], {}
            for t in utf8(batch.column(len(keep))):
                if t not in known:
                    h = shingle_set(t)
                    parts = (h[k : k + _CHUNK] for k in range(0, len(h), _CHUNK))
                    known[t] = np.uint64(xxhash.xxh64_intdigest(h.tobytes())).view(np.int64).item(), majority(parts), band_keys(h)
                for out, x in zip((ids, prints, bands), known[t], strict=True):
                    out.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in (ids, prints)), pa.array(bands, pa.list_(pa.int64()))], names=schema.names)

    return map_batches(docs.select(*keep, "_text"), run, schema)


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lru_cache(8)(shingle_set)
        for batch in batches:
            x, y = utf8(batch.column(2)), utf8(batch.column(3))
            ok = pa.array([similar(of(s), of(t)) for s, t in zip(x, y, strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(ok)

    for end in "ab":
        pairs = pairs.join(texts.select(F.col("set").alias(end), F.col("_text").alias(f"t{end}")), end)
    return map_batches(pairs.select("a", "b", "ta", "tb"), run, "a long, b long")


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def trie_candidates(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints the trie join links, and of those whose fingerprints are equal."""
    least = stage(sets.groupBy("fp").agg(F.min("set").alias("least")), "prints")
    same = sets.join(least, "fp").where("set != least").select(*_pair("set", "least"))
    links = trie_links(least)
    for end in "ab":
        links = links.join(least.select(F.col("fp").alias(end), F.col("least").alias(f"s{end}")), end)
    return stage(links.select(*_pair("sa", "sb")).unionByName(same).distinct(), "pairs")


def _joined(members: DataFrame, found: DataFrame) -> DataFrame:
    return members.join(found.withColumnRenamed("node", "set"), "set", "left").select("key", "set", F.coalesce("root", "set").alias("root"))


def differences(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(p, x, size, d): for each pair the size of set x, and the hashes that only one of p and x has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lru_cache(8)(shingle_set)
        for batch in batches:
            size, d = [], []
            for s, t in zip(utf8(batch.column(2)), utf8(batch.column(3)), strict=True):
                x = shingle_set(t)
                size.append(len(x))
                d.append(np.setxor1d(of(s), x, assume_unique=True).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(size, pa.int64()), pa.array(d, pa.list_(pa.int64()))], names=["p", "x", "size", "d"])

    for end in ("p", "x"):
        pairs = pairs.join(texts.select(F.col("set").alias(end), F.col("_text").alias(f"t{end}")), end)
    return map_batches(pairs.select("p", "x", "tp", "tx"), run, "p long, x long, size long, d array<long>")


def near_in_blocks(size_a: np.ndarray, a: list[np.ndarray], size_b: np.ndarray, b: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sets of similarity LEAST or more, given sizes and differences from one and the same set."""
    n = len(b)
    many_a, many_b = np.array([len(d) for d in a]), np.array([len(d) for d in b])
    token, owner = np.concatenate(b), np.repeat(np.arange(n), many_b)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    step = max(1, _CELLS // n)
    for k in range(0, len(a), step):
        some = a[k : k + step]
        asked, who = np.concatenate(some), np.repeat(np.arange(len(some)), many_a[k : k + step])
        lo, hi = np.searchsorted(token, asked), np.searchsorted(token, asked, "right")
        common = np.zeros(len(some) * n, np.int64)
        times = hi - lo
        cuts = [0, *(np.nonzero(np.diff(np.cumsum(times) // _CELLS))[0] + 1).tolist(), len(asked)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            m = times[s:e]
            at = np.repeat(lo[s:e] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            common += np.bincount(np.repeat(who[s:e], m) * n + owner[at], minlength=len(common))
        apart = many_a[k : k + step, None] + many_b[None] - 2 * common.reshape(len(some), n)
        # (s - apart) / (s + apart) for sizes that add up to s is the similarity.
        total = size_a[k : k + step, None] + size_b[None]
        i, j = np.nonzero((total - apart) * LEAST[1] >= (total + apart) * LEAST[0])
        yield i + k, j


def _in_blocks(group: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that connect the sets of each group (p, x, open) as all near pairs with an open one would."""
    told = stage(differences(group.select("p", "x"), texts).join(group, ["p", "x"]), "told")
    room = F.ceil(F.sum(F.size("d") + 64) / BLOCK).cast("int")
    blocks = told.groupBy("p").agg(F.ceil(F.sum(F.when(F.col("open"), F.size("d") + 64)) / BLOCK).cast("int").alias("rows"), room.alias("cols"))
    told = told.join(blocks.where("rows > 0"), "p")
    mine = lambda n: F.pmod(F.xxhash64("x"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ask = told.where("open").select("p", mine("rows").alias("i"), every("cols").alias("j"), F.lit(True).alias("asks"), "x", "size", "d")
    have = told.select("p", mine("cols").alias("j"), every("rows").alias("i"), F.lit(False).alias("asks"), "x", "size", "d")

    def meet(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        x, size = table["x"].to_numpy(), table["size"].to_numpy()
        d = table["d"].combine_chunks()
        ends, flat = d.offsets.to_numpy(), d.values.to_numpy()
        parts = [flat[s:e] for s, e in zip(ends, ends[1:], strict=False)]
        a, b = np.nonzero(asks)[0], np.nonzero(~asks)[0]
        names, node = np.unique(x, return_inverse=True)
        parent = np.arange(len(names))
        if len(a) and len(b):
            for i, j in near_in_blocks(size[a], [parts[k] for k in a.tolist()], size[b], [parts[k] for k in b.tolist()]):
                parent = unite(parent, node[a[i]], node[b[j]])
        linked = np.nonzero(parent != np.arange(len(names)))[0]
        return pa.table({"a": names[parent[linked]], "b": names[linked]})

    return ask.unionByName(have).groupBy("p", "i", "j").applyInArrow(meet, "a long, b long")


def roots(members: DataFrame, texts: DataFrame, tried: DataFrame) -> DataFrame:
    """(node, root) of sets that are connected to a smaller one, from buckets (key, set), a text of each set and pairs to begin with."""
    links = stage(_confirmed(tried, texts), "links")
    found = connected_components(links)
    left = stage(_joined(members, found), "left")
    turns = [xxhash.xxh64_intdigest(b"pivot", k) >> 1 for k in range(_PIVOTS)]
    least = [F.min(F.col("set").bitwiseXOR(F.lit(c))).alias(f"p{k}") for k, c in enumerate(turns)]
    of = left.groupBy("key", "root").agg(F.count("*").alias("n"), *least).groupBy("key")
    of = of.agg((F.sum("n") - F.max("n")).alias("others"), F.max(F.struct("n", "root"))["root"].alias("most"), *(F.min(f"p{k}").alias(f"p{k}") for k in range(_PIVOTS)))
    of = stage(of.where("others > 0"), "buckets")
    few = F.col("others") <= FEW
    now = left.join(of, "key")
    apart = now.where(few & (F.col("root") != F.col("most"))).select("key", F.col("set").alias("x"), F.col("root").alias("rx"))
    pivots = F.explode(F.array(*(F.col(f"p{k}").bitwiseXOR(F.lit(c)) for k, c in enumerate(turns)))).alias("x")
    pairs = apart.join(left, "key").where("rx != root").select(*_pair("x", "set"))
    pairs = pairs.unionByName(now.where(~few).select("set", pivots).where("x != set").select(*_pair("x", "set")))
    pairs = stage(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(stage(_confirmed(pairs, texts), "links"))
    found = connected_components(links)

    again = members.join(of.where(~few).select("key"), "key", "left_semi")
    left = stage(_joined(again, found), "left")
    most = left.groupBy("key", "root").count().groupBy("key").agg(F.max(F.struct("count", "root"))["root"].alias("root"), F.count("*").alias("n"))
    # A member of the largest part is the pivot, the same one for most buckets of a group.
    pivot = left.join(most.where("n > 1").drop("n"), ["key", "root"]).groupBy("key").agg(F.min(F.struct(F.col("set").bitwiseXOR(F.lit(turns[0])), "set", "root")).alias("p"))
    group = left.join(pivot, "key").groupBy(F.col("p.set").alias("p"), F.col("set").alias("x")).agg(F.max(F.col("root") != F.col("p.root")).alias("open"))
    group = stage(group, "groups")
    if group.isEmpty():
        return found
    return connected_components(links.unionByName(stage(_in_blocks(group, texts), "links")))


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each group that near copies connect: the smallest doc_id, among equal ones the first stored."""
    cols, row = docs.columns, "_weft_row"
    names = tuple(f"c{k}" for k in range(len(cols)))
    at = names[cols.index(text)]
    named = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(cols, names, strict=True) if n != at), F.col("doc_id").alias("_id"), F.col(f"`{text}`").alias("_text"))
    rows = stage(_sets(named, tuple(n for n in (*names, "_id") if n != at)).withColumn(row, F.monotonically_increasing_id()), "rows")
    first = stage(rows.groupBy("set").agg(F.min(row).alias(row), F.min("fp").alias("fp")), "sets")
    each = rows.join(first.select(row), row, "left_semi").select("set", F.explode("bands").alias("key"))
    shared = each.groupBy("key").agg(F.min("set").alias("lo"), F.max("set").alias("hi")).where("lo != hi").select("key")
    members = stage(each.join(shared, "key"), "members")
    pairs = trie_candidates(first.select("set", "fp"))
    asked = members.select("set").unionByName(pairs.select(F.col("a").alias("set"))).unionByName(pairs.select(F.col("b").alias("set"))).distinct()
    texts = stage(rows.select(row, "set", "_text").join(asked.join(first, "set").select(row), row, "left_semi").select("set", "_text"), "texts")
    root = roots(members, texts, pairs).withColumnRenamed("node", "set")
    group = first.select("set").join(root, "set", "left").select("set", F.coalesce("root", "set").alias("root"))
    best = (
        rows.select(row, "set", F.col("_id").alias("doc_id"))
        .join(group, "set")
        .groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", row)).alias("b"))
        .select(F.col(f"b.{row}").alias(row))
    )
    return rows.join(best, row, "left_semi").select(*(F.col("_text" if n == at else n).alias(c) for c, n in zip(cols, names, strict=True)))
