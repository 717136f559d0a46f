"""Sharding by histogram sort.

Rows are ordered by (hash of the text, hash of the row), so equal texts lie together.
A splitter is a key boundary whose exact number of bytes below is to come within a
tolerance of its target. Each round counts bytes by a few more leading bits of the
key, only within the ranges that still hold an open splitter, and keeps the narrowest
range; a splitter closes at a text boundary where one is near enough, and goes on into
the second hash only where one text is larger than the tolerance. Then rows are
exchanged once, by splitter. Counts come to the driver as at most 256 rows for each
open splitter and round; rows never do. Splitters are as many as shards, less one.

Slots need no order between shards' parts: a shard is dealt by a hash into parts of
about ROWS_EACH rows, and a row's slot is its place in its part plus the rows of the
parts before, so that no task holds more than its part however many rows there are.

Defined results: null text counts as size 1; rows that are equal in text and id are
told apart by numbers, so a boundary may fall between them; null ids are a value like
any other; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.llm.copies import ROW, numbered
from weft.staging import stage

TOLERANCE = 0.002  # of a shard's bytes
ROWS_EACH = 1_000_000  # rows in a part of a shard, about
BROADCAST_PARTS = 100_000
_BITS = 8
_TOP = 1 << 63


@dataclass
class _Open:
    """A splitter that is being sought: ``fixed`` leading bits of (high, low) known, ``below`` bytes before that range."""

    target: int
    fixed: int
    prefix: int
    below: int


def _signed(unsigned: int) -> int:
    return unsigned - _TOP


def splitters(keys: DataFrame, targets: list[int], tolerance: int) -> list[tuple[int, int]]:
    """Boundaries (high, low) such that rows with (high, low) < boundary have about target bytes.

    ``keys`` has high, low (signed longs, compared in that order) and size.
    """
    wanted = [_Open(t, 0, 0, 0) for t in targets]
    found: dict[int, tuple[int, int]] = {}
    while len(found) < len(wanted):
        going = [k for k in range(len(wanted)) if k not in found]
        # Splitters at one depth are asked for together: those that went on into the second hash are deeper.
        depth = min(wanted[k].fixed for k in going)
        now = [k for k in going if wanted[k].fixed == depth]
        second = depth >= 64
        col = "low" if second else "high"
        shift = 64 - _BITS - depth % 64
        digit = F.shiftrightunsigned(F.col(col).bitwiseXOR(F.lit(-_TOP)), shift) if shift else F.col(col).bitwiseXOR(F.lit(-_TOP))
        rows = keys
        if second:
            highs = sorted({_signed(wanted[k].prefix >> (depth - 64)) for k in now})
            rows = rows.where(F.col("high").isin(highs))
        if depth % 64:
            known = sorted({wanted[k].prefix & ((1 << depth % 64) - 1) for k in now})
            rows = rows.where(F.shiftrightunsigned(F.col(col).bitwiseXOR(F.lit(-_TOP)), 64 - depth % 64).isin(known))
        by = [F.col("high").alias("h") if second else F.lit(0).alias("h"), digit.alias("d")]
        count: dict[tuple[int, int], int] = {(r["h"], r["d"] % (1 << 64)): r["n"] for r in rows.groupBy(*by).agg(F.sum("size").alias("n")).collect()}
        for k in now:
            s = wanted[k]
            base = (s.prefix & ((1 << depth % 64) - 1)) << _BITS
            h = _signed(s.prefix >> (depth - 64)) if second else 0
            below, best = s.below, None
            for digit_value in range(1 << _BITS):
                # The boundary before this digit, then the range of the digit itself.
                if best is None or abs(below - s.target) < abs(best[1] - s.target):
                    best = (digit_value, below)
                n = count.get((h, base | digit_value), 0)
                if below + n > s.target:
                    break
                below += n
            else:
                digit_value = (1 << _BITS) - 1
            at, has = best
            if abs(has - s.target) <= tolerance and (at or depth):
                found[k] = _boundary(s.prefix << _BITS | at, depth + _BITS)
            elif depth + _BITS == 128:
                found[k] = _boundary(s.prefix << _BITS | digit_value, 128)
            elif depth + _BITS == 64 and n + below - s.target <= tolerance:
                found[k] = _boundary((s.prefix << _BITS | digit_value) + 1, 64)
            else:
                wanted[k] = _Open(s.target, depth + _BITS, s.prefix << _BITS | digit_value, below)
    return [found[k] for k in range(len(wanted))]


def _boundary(prefix: int, bits: int) -> tuple[int, int]:
    whole = min(prefix << (128 - bits), (1 << 128) - 1)
    return _signed(whole >> 64), _signed(whole & ((1 << 64) - 1))


def shard(docs: DataFrame, shards: int, size: Column, high: Column, low: Column, tolerance: float = TOLERANCE, rows_each: int = ROWS_EACH) -> DataFrame:
    """All columns with shard (0 to ``shards`` - 1) and slot (gapless from 0), near equal in the sum of ``size``.

    ``high`` and ``low`` are long keys; rows of equal ``high`` stay together where the tolerance lets them.
    Column names are kept apart, so ``docs`` may have columns named shard or slot only if they are to be replaced.
    """
    cols = [c for c in docs.columns if c not in ("shard", "slot")]
    named = (F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(cols))
    rows = docs.select(*named, size.cast("long").alias("size"), high.alias("high"), low.alias("low"), F.xxhash64(high, low).alias("both"))
    rows = stage(rows.withColumn(ROW, F.monotonically_increasing_id()), "keys")
    apart = numbered(rows, "both")
    if apart is not rows:
        rows = stage(apart.withColumn("low", F.when(F.col("both") == F.xxhash64("high", "low"), F.col("low")).otherwise(F.col("both"))), "keys")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    cuts = splitters(rows, [total * (k + 1) // shards for k in range(shards - 1)], int(tolerance * total / shards)) if n else []
    # A boundary at or before the row's key puts the row one shard further.
    key = F.struct("high", "low")

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        cut = F.struct(F.lit(cuts[mid][0]), F.lit(cuts[mid][1]))
        return F.when(key < cut, search(lo, mid)).otherwise(search(mid + 1, hi))

    each = -(-n // (rows_each * shards))
    part = F.pmod(F.xxhash64("both", F.lit(7)), F.lit(max(1, each)))
    placed = rows.withColumn("shard", search(0, len(cuts))).withColumn("part", part)
    # One row for each part, of which there is one for about ROWS_EACH rows.
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    start = placed.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    small = F.broadcast if each * shards <= BROADCAST_PARTS else (lambda d: d)
    order = W.partitionBy("shard", "part").orderBy("both")
    out = placed.withColumn("place", F.row_number().over(order) - 1).join(small(start), ["shard", "part"])
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(cols)), F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("place")).cast("long").alias("slot"))
