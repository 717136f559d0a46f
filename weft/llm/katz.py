"""Language-model scoring with a Katz model of ORDER words, counted over the whole corpus.

P(w | h) = d(c(hw)) c(hw) / c(h) if hw was seen, else alpha(h) P(w | h'), where h' is h
without its first word, and so on down to P(w) = d(c(w)) c(w) / N; what that leaves goes
to one unknown word. If h itself was never seen, P(w | h) = P(w | h'). d are the
Good-Turing discounts of each length in Katz's form for counts up to FIRST, 1 above;
where they are not between 0 and 1, absolute discounting takes their place. alpha(h)
makes each row sum to one exactly, as sums over the seen successors of h are complete.
A text begins after a start symbol, which is all the history that its first word has.

The corpus is cut into blocks of about BLOCK_TOKENS tokens, and everything travels in
packed, compressed arrays by (block, partition) instead of a row for each token. Length
by length, beginning with single words:

1. each block sends its distinct n-grams, with how often they occur in training, to
   the n-gram table by a hash of the word before the last (words: by their own hash);
   where that word has a large share of all tokens, by the whole history, and a history
   with such a share is dealt over all partitions by its successors;
2. a partition adds up counts, writes its part of the table, and answers each block in
   the order asked: counts, and the sums that a history's alpha needs wherever a
   successor is unseen. Words get ids, small ones for common words;
3. the next length's blocks are made from the block's tokens and all answers so far, so
   that the probabilities of shorter n-grams are known wherever a longer one is counted.

At last each token's probability is worked out by the recursion above. Tables stay in
the shared folder: ``score_with`` scores other texts by them, with the same steps, a
table's rows taking the place of training blocks.

Words are identified by 64-bit hashes (XXH64); two of a billion distinct words share
one with a probability of 3 in 100. Tables and answers grow with the corpus and none
comes to the driver, except counts of counts and sums of the few dealt histories.

Defined results: a null or empty text is the end token alone; a null doc_id counts as
empty text in the held-out remainder; repeated rows are counted and scored as often as
they occur; with no training rows N and V are 0 and the base score is that of the
formula; further columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.texts import map_batches
from weft.staging import discard, release, stage

ORDER = 3
FIRST = 5  # counts that are discounted
BLOCK_TOKENS = 1_500_000
WORD_PART, GRAM_PART = 16 << 20, 10 << 20  # bytes of text for each partition of the tables
HOT = 4  # a history with over 1 / (HOT * partitions) of all tokens is dealt over all partitions
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pack(*arrays: np.ndarray) -> bytes:
    """Non-negative integers by byte planes, each only as wide as its largest, compressed."""
    out = [struct.pack("<i", len(arrays))]
    body = []
    for a in arrays:
        a = np.ascontiguousarray(a, "<u8")
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        out.append(struct.pack("<qi", len(a), width))
        body.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out + body))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,) = struct.unpack_from("<i", raw)
    heads = [struct.unpack_from("<qi", raw, 4 + 12 * k) for k in range(n)]
    at, out = 4 + 12 * n, []
    for size, width in heads:
        full = np.zeros((size, 8), np.uint8)
        full[:, :width] = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T
        out.append(full.view("<u8").ravel())
        at += size * width
    return out


def _floats(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a, np.float64).view(np.uint64)


def discounts(times: dict[int, int]) -> list[float]:
    """d for counts 0 (unused) to FIRST, from the numbers of types with each count (Katz 1987)."""
    n = [times.get(r, 0) for r in range(FIRST + 2)]
    out = [1.0]
    tail = (FIRST + 1) * n[FIRST + 1] / n[1] if n[1] else 0.0
    flat = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    flat = min(max(flat, 0.05), 0.95)
    for r in range(1, FIRST + 1):
        d = ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        out.append(d if 0 < d < 1 else 1 - flat / r)
    return out


@dataclass
class Unigrams:
    """Totals of the training tokens, and P(w) by count."""

    tokens: int
    types: int
    d: list[float]
    left: float  # of the unknown word

    @classmethod
    def of(cls, times: dict[int, int]) -> Unigrams:
        n, d = sum(r * k for r, k in times.items()), discounts(times)
        used = sum(k * r * (d[r] if r <= FIRST else 1.0) for r, k in times.items()) / n if n else 0.0
        # Where nothing is rare nothing is discounted: the unknown word then counts once more.
        left = max(1 - used, 1 / (n + 1)) if n else 1.0
        if n and left > 1 - used:
            d = [x * (1 - left) / used for x in d] + [(1 - left) / used]
        else:
            d = [*d, 1.0]
        return cls(n, sum(times.values()), d, left)

    def log10(self, count: np.ndarray) -> np.ndarray:
        return np.log10(self.p(count))

    def p(self, count: np.ndarray) -> np.ndarray:
        c = count.astype(np.float64)
        d = np.array(self.d)[np.minimum(count.astype(np.int64), FIRST + 1)]
        return np.where(c > 0, d * c / max(self.tokens, 1), self.left)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count.astype(np.float64) + 1) / (self.tokens + self.types + 1))


#: Kinds of rows: a block's documents, and by length: answers, counts of counts, sums of dealt histories, table rows, and what is asked.
STATE, ANSWER, TIMES, DEALT, TABLE, ASKED = 0, 100, 200, 300, 400, 500
_ROWS = [("kind", pa.int32()), ("part", pa.int64()), ("block", pa.int64()), ("data", pa.binary())]
_SQL_ROWS = "kind int, part long, block long, data binary"


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(_ROWS)})


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, lower-cased, and how many each text has."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = words.flatten()
    there = pc.greater(pc.binary_length(flat), 0)  # blanks at either end leave empty ones
    doc = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    length = np.bincount(doc[there.to_numpy(zero_copy_only=False)], minlength=len(words))
    return flat.filter(there).cast(pa.large_binary()), length


def _blocks(docs: DataFrame, text: str, doc_id: str, held: Column, parts: int) -> DataFrame:
    """Rows of a block's documents, as sequences of local word numbers, and of its words for a partition."""

    def flush(block: int, ids: list, flags: list, lengths: list, seq: list) -> Iterator[pa.RecordBatch]:
        coded = pa.concat_arrays(seq).dictionary_encode()
        known = [b"", *coded.dictionary.to_pylist()]  # first the end
        keys = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
        names, local = np.unique(keys, return_inverse=True)
        lengths = np.concatenate(lengths) + 1
        tokens = np.full(int(lengths.sum()), local[0], np.int64)
        inner = np.ones(len(tokens), bool)
        inner[np.cumsum(lengths) - 1] = False
        tokens[inner] = local[coded.indices.to_numpy() + 1]
        flags = np.concatenate(flags)
        counts = np.bincount(tokens[np.repeat(~flags, lengths)], minlength=len(names))
        common = np.argsort(-np.bincount(tokens, minlength=len(names)), kind="stable")  # small numbers for common words
        number = np.empty(len(names), np.int64)
        number[common] = np.arange(len(names))
        null = np.array([x is None for x in ids])
        own = np.array([x or 0 for x in ids], np.int64).view(np.uint64)
        rows = [(STATE, -1, block, pack(own, null, flags, lengths, number[tokens], common))]
        cuts = np.searchsorted(names, np.array([((k << 64) // parts) for k in range(1, parts)], np.uint64)) if parts > 1 else []
        for p, (n, c) in enumerate(zip(np.split(names, cuts), np.split(counts, cuts), strict=True)):
            if len(n):
                rows.append((ASKED + 1, p, block, pack(np.diff(n, prepend=np.uint64(0)), c)))
        for row in rows:
            yield _rows([row]).to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        fresh = lambda: ([], [], [], [])
        state, size = fresh(), 0
        for batch in batches:
            words, length = _split(batch.column(0))
            ids, held = batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            ends = np.concatenate([[0], np.cumsum(length)])
            tokens = ends + np.arange(len(ends))
            start = 0
            while start < len(length):  # whole documents, as many as the block still takes
                end = max(start + 1, int(np.searchsorted(tokens, tokens[start] + BLOCK_TOKENS - size, "right")) - 1)
                state[0].extend(ids[start:end])
                for have, new in zip(state[1:], (held[start:end], length[start:end], words[ends[start] : ends[end]]), strict=True):
                    have.append(new)
                size += int(tokens[end] - tokens[start])
                start = end
                if size >= BLOCK_TOKENS or start < len(length):
                    yield from flush(block, *state)
                    state, size, block = fresh(), 0, block + 1
        if size:
            yield from flush(block, *state)

    rows = docs.select(F.col(text).alias("_text"), F.col(doc_id).cast("long").alias("_id"), held.alias("_held"))
    return map_batches(rows, run, _SQL_ROWS)


def _words(parts: int) -> Callable[[pa.Table], pa.Table]:
    """The word table's partition: counts and ids, and answers to the blocks."""

    def run(table: pa.Table) -> pa.Table:
        part, kinds = table["part"][0].as_py(), table["kind"].to_pylist()
        sent = [unpack(d.as_py()) for d in table["data"]]
        keys = [np.cumsum(s[0], dtype=np.uint64) for s in sent]
        names, local = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.zeros(len(names), np.int64)
        np.add.at(count, local, np.concatenate([s[1] for s in sent]).astype(np.int64))
        number = np.empty(len(names), np.int64)
        # Ids by rank, which a table that is read again gives as before: unseen words come last.
        number[np.lexsort((names, -count))] = np.arange(len(names)) * parts + part
        rows, at = [], 0
        for kind, block, k in zip(kinds, table["block"].to_pylist(), keys, strict=True):
            own = local[at : at + len(k)]
            at += len(k)
            if kind == ASKED + 1:
                rows.append((ANSWER + 1, part, block, pack(number[own], count[own])))
        seen = count > 0
        rows.append((TIMES + 1, part, -1, pack(*np.unique(count[seen], return_counts=True))))
        rows.append((TABLE + 1, part, -1, pack(np.diff(names[seen], prepend=np.uint64(0)), count[seen])))
        return _rows(rows)

    return run


@dataclass
class Level:
    """What is known of n-grams of one length once they are counted."""

    d: list[float]
    dealt: dict[tuple[int, ...], tuple[list[int], float]]  # history: sums over its seen successors, and their mass one word shorter

    @classmethod
    def of(cls, counted: DataFrame, n: int) -> Level:
        """From a staged table of the length; counts of counts, and HOT histories for each partition at most."""
        dealt: dict[tuple[int, ...], tuple[list[int], float]] = {}
        for r in counted.where(F.col("kind") == DEALT + n).select("data").collect():
            got = unpack(bytes(r["data"]))
            for k, name in enumerate(zip(*(c.tolist() for c in got[: n - 1]), strict=True)):
                sums, mass = [int(x[k]) for x in got[n - 1 : -1]], float(got[-1].view(np.float64)[k])
                old = dealt.get(name, ([0] * len(sums), 0.0))
                dealt[name] = [a + b for a, b in zip(old[0], sums, strict=True)], old[1] + mass
        return cls(discounts(_times(counted, n)), dealt)

    def discounted(self, c: np.ndarray) -> np.ndarray:
        """d(c) c."""
        return np.array([*self.d, 1.0])[np.minimum(c, FIRST + 1)] * c


def _times(counted: DataFrame, n: int) -> dict[int, int]:
    """How many n-grams have each count; a partition has at most sqrt(2 N) different ones."""
    out: dict[int, int] = {}
    for r in counted.where(F.col("kind") == TIMES + n).select("data").collect():
        value, times = unpack(bytes(r["data"]))
        for v, t in zip(value.tolist(), times.tolist(), strict=True):
            out[v] = out.get(v, 0) + t
    return out


def _sealed(sums: list[np.ndarray]) -> np.ndarray:
    """True for histories without a rare successor: nothing is discounted there, so they give way by one count."""
    return sum(sums[:FIRST]) == 0


def _log_alpha(d: list[float], total: np.ndarray, sums: list[np.ndarray], mass: np.ndarray) -> np.ndarray:
    kept = sum(r * d[r] * sums[r - 1] for r in range(1, FIRST + 1)) + sums[FIRST]
    left = np.where(_sealed(sums), 1 / (total + 1.0), 1 - kept / np.maximum(total, 1))
    return np.log10(left) - np.log10(1 - mass)


def _differs(columns: list[np.ndarray]) -> np.ndarray:
    """True for the first row and each that is not equal to the one before."""
    return np.concatenate([[True], np.any([np.diff(c) != 0 for c in columns], axis=0)])


def _told(columns: list[np.ndarray], lower: list[np.ndarray], count: np.ndarray, hot: np.ndarray) -> bytes:
    """Sorted n-grams (history backwards, then the word), what tells the probability of one word less, and counts.

    That is the word's count for two words, written once for each word; else the shorter n-gram's count, and that of its
    history, written once for each run of n-grams that share it. So no more is written however many partitions there are.
    """
    if len(columns) == 2:
        names, first, index = np.unique(columns[1], return_index=True, return_inverse=True)
        return pack(np.diff(columns[0], prepend=0), index, count, hot, np.diff(names, prepend=0), lower[0][first])
    first = np.nonzero(_differs(columns[:-2]))[0]
    far = np.diff(columns[-2], prepend=0)  # ascending within a run
    far[first] = columns[-2][first]
    lead, *others = (c[first] for c in columns[:-2])
    return pack(far, columns[-1], lower[0], count, hot, np.diff(np.append(first, len(far))), np.diff(lead, prepend=0), *others, lower[1][first])


def _heard(n: int, data: bytes) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Columns, lower, count and hot, as told."""
    got = [x.astype(np.int64) for x in unpack(data)]
    if n == 2:
        near, index, count, hot, names, last = got
        return [np.cumsum(near), np.cumsum(names)[index]], [last[index]], count, hot > 0
    far, word, short, count, hot, size, lead, *others, last = got
    first = np.cumsum(size) - size
    total = np.cumsum(far)
    return [*(np.repeat(c, size) for c in (np.cumsum(lead), *others)), total - np.repeat(total[first] - far[first], size), word], [short, np.repeat(last, size)], count, hot > 0


class _Block:
    """A block's tokens, and what is known of the n-grams that end at each of them, length by length.

    ``id`` is each token's n-gram: 0 the start alone, then distinct ones in order, last those whose history is unseen.
    ``columns`` are the names of their words, the history's backwards, then the last.
    """

    def __init__(self, data: bytes, words: list[bytes], one: Unigrams):
        self.own, self.null, held, length, token, common = unpack(data)
        got = [unpack(d) for d in words]
        number, count = (np.concatenate([g[k] for g in got]).astype(np.int64) for k in (0, 1))
        rank = np.argsort(number)
        place = np.empty(len(number), np.int64)
        place[rank] = np.arange(1, len(number) + 1)
        place = place[common.astype(np.int64)]
        self.held, self.length = held > 0, length.astype(np.int64)
        ends = np.cumsum(self.length)
        self.doc = np.repeat(np.arange(len(ends), dtype=np.int32), self.length)
        self.first = ends - self.length
        self.train = ~self.held[self.doc]
        # The start is followed as often as an end is met in training.
        self.word = place[token.astype(np.int64)]
        self.count = np.concatenate([[0], count[rank]])
        self.count[0] = self.count[self.word[ends[0] - 1]]
        self.name = np.concatenate([[0], number[rank] + 1])
        self.id, self.times, self.columns = self.word, self.count, [self.name]
        self.last, self.back = np.arange(len(self.name)), np.zeros(len(self.name), np.int64)  # each n-gram's last word, and its history's place among all
        self.lower = [self.count[self.word]]  # what tells P(w | h) for the mass of the next length
        self.log = one.log10(self.count)[self.word]

    def distinct(self, n: int, parts: int, tokens: int) -> None:
        """Distinct n-grams whose history is known, in the order in which they are asked for."""
        history = np.roll(self.id, 1)
        history[self.first] = 0
        self.at = np.nonzero(self.times[history] > 0)[0]
        # Histories by their last word first, then those before it.
        rank = np.argsort(self.last * (int(self.back.max()) + 1) + self.back)
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        key, self.gram = np.unique(place[history[self.at]] * len(self.name) + self.word[self.at], return_inverse=True)
        self.back, w = np.divmod(key, len(self.name))
        h = rank[self.back]
        self.total, often = self.times[h], self.count[self.last[h]]
        self.columns = [self.columns[-1][h], *(c[h] for c in self.columns[:-1]), self.name[w]]
        self.last = w
        # By the history's last word; its other words and the word itself count only where they must.
        most = tokens / (HOT * parts)
        self.hot = self.total > most
        mixed = self.columns[0].astype(np.uint64) * _MIX
        for c, some in [(c, often > most) for c in self.columns[1:-1]] + [(self.columns[-1], self.hot)]:
            mixed = np.where(some, ((mixed ^ (mixed >> np.uint64(29))) + c.astype(np.uint64)) * _MIX, mixed)
        part = ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        self.order = np.argsort(part, kind="stable")
        self.part = part[self.order]

    def asked(self) -> Iterator[tuple[int, bytes]]:
        """What goes to each partition."""
        local = np.bincount(self.gram, self.train[self.at], len(self.total)).astype(np.int64)
        some = np.empty(len(self.total), np.int64)
        some[self.gram] = self.at  # any token that ends the n-gram
        lower = [x[some] for x in self.lower]
        cuts = np.nonzero(np.diff(self.part))[0] + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(self.order)], strict=True):
            if e > s:
                of = self.order[s:e]
                yield int(self.part[s]), _told([c[of] for c in self.columns], [x[of] for x in lower], local[of], self.hot[of])

    def learn(self, n: int, answers: list[bytes], level: Level) -> None:
        """Counts and log probabilities of n-grams, by the recursion: own where seen, else the shorter one's times alpha."""
        size = len(self.total)
        c, sealed, alpha = np.zeros(size, np.int64), np.zeros(size, bool), np.zeros(size)
        got = [unpack(d) for d in answers]
        if got:
            c[self.order] = np.concatenate([g[0] for g in got]).astype(np.int64)
            sealed[self.order] = np.concatenate([g[1] for g in got]) > 0
        hot = np.nonzero(self.hot)[0]  # successors of a dealt history stand together
        if len(hot):
            opens = _differs([k[hot] for k in self.columns[:-1]])
            shut = {name: not any(sums[:FIRST]) for name, (sums, _) in level.dealt.items()}
            heads = zip(*(k[hot[opens]].tolist() for k in self.columns[:-1]), strict=True)
            sealed[hot] = np.array([shut.get(x, False) for x in heads])[np.cumsum(opens) - 1]
        start = 0
        for g in got:
            miss = self.order[start : start + len(g[0])][g[0] == 0]
            start += len(g[0])
            if not len(miss):
                continue
            use, sums, mass = g[2].astype(np.int64), [x.astype(np.float64) for x in g[3:-1]], g[-1].view(np.float64).copy()
            lead = np.empty(len(mass), np.int64)
            lead[use] = miss
            for k in np.nonzero(self.hot[lead])[0].tolist():
                whole, mass[k] = level.dealt[tuple(int(x[lead[k]]) for x in self.columns[:-1])]
                for x, v in zip(sums, whole, strict=True):
                    x[k] = v
            alpha[miss] = _log_alpha(level.d, self.total[lead].astype(np.float64), sums, mass)[use]
        total = self.total + sealed
        own = np.log10(np.maximum(level.discounted(c), 1e-300) / total)
        self.log[self.at] = np.where(c[self.gram] > 0, own[self.gram], self.log[self.at] + alpha[self.gram])
        self.id = np.full(len(self.word), size + 1)
        self.id[self.at] = self.gram + 1
        self.times = np.concatenate([[self.count[0]], c, [0]])
        self.columns = [np.concatenate([[0], k, [0]]) for k in self.columns]
        self.last, self.back = (np.concatenate([[0], k, [0]]) for k in (self.last, self.back))
        self.lower = [self.times[self.id], np.concatenate([[1], total, [1]])[self.id]]


def _opened(state: pa.Table, answers: pa.Table, one: Unigrams, levels: list[Level], parts: int) -> _Block:
    """A block with all that is answered so far."""
    kinds, part = answers["kind"].to_numpy(), answers["part"].to_numpy()
    of = lambda n: [answers["data"][int(k)].as_py() for k in np.lexsort((part, kinds)) if kinds[k] == ANSWER + n]
    block = _Block(state["data"][0].as_py(), of(1), one)
    for n, level in enumerate(levels, 2):
        block.distinct(n, parts, one.tokens)
        block.learn(n, of(n), level)
    return block


def _asks(one: Unigrams, levels: list[Level], parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The n-grams of a block that are one word longer than the ``levels`` known."""
    n = len(levels) + 2

    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        block = _opened(state, answers, one, levels, parts)
        block.distinct(n, parts, one.tokens)
        return _rows([(ASKED + n, p, state["block"][0].as_py(), data) for p, data in block.asked()])

    return run


def _table(n: int, one: Unigrams, levels: list[Level]) -> Callable[[pa.Table], pa.Table]:
    """A partition of the table of n-grams: counts, and answers to the blocks."""

    def shorter(lower: list[np.ndarray]) -> np.ndarray:
        return one.p(lower[0]) if n == 2 else levels[-1].discounted(lower[0]) / np.maximum(lower[1], 1)

    def run(table: pa.Table) -> pa.Table:
        part, kinds = table["part"][0].as_py(), table["kind"].to_pylist()
        sent = [_heard(n, d.as_py()) for d in table["data"]]
        size = [len(s[2]) for s in sent]
        columns = [np.concatenate([s[0][k] for s in sent]) for k in range(n)]
        lower = [np.concatenate([s[1][k] for s in sent]) for k in range(len(sent[0][1]))]
        local, hot = (np.concatenate([s[k] for s in sent]) for k in (2, 3))
        del sent
        order = np.lexsort(columns[::-1])
        new = _differs([c[order] for c in columns])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        c = np.bincount(group, local).astype(np.int64)
        lead = order[new]
        # Sums over the seen successors of each history.
        opens = _differs([k[lead] for k in columns[:-1]])
        of = np.cumsum(opens) - 1
        hs = int(of[-1]) + 1
        seen = c > 0
        sums = [np.bincount(of, c == r, hs) for r in range(1, FIRST + 1)]
        sums.append(np.bincount(of, np.where(c > FIRST, c, 0), hs))
        mass = np.bincount(of, np.where(seen, shorter([x[lead] for x in lower]), 0.0), hs)
        head = lead[opens]
        dealt = hot[head]
        shut = _sealed(sums) & ~dealt
        rows = [(TIMES + n, part, -1, pack(*np.unique(c[seen], return_counts=True)))]
        if dealt.any():
            rows.append((DEALT + n, part, -1, pack(*(k[head[dealt]] for k in columns[:-1]), *(s[dealt].astype(np.int64) for s in sums), _floats(mass[dealt]))))
        if seen.any():
            of_seen = lead[seen]
            rows.append((TABLE + n, part, -1, _told([k[of_seen] for k in columns], [x[of_seen] for x in lower], c[seen], hot[of_seen])))
        at = 0
        for kind, block, m in zip(kinds, table["block"].to_pylist(), size, strict=True):
            g = group[at : at + m]
            at += m
            if kind == ASKED + n:
                used, use = np.unique(of[g[~seen[g]]], return_inverse=True)
                rows.append((ANSWER + n, part, block, pack(c[g], shut[of[g]], use, *(x[used].astype(np.int64) for x in sums), _floats(mass[used]))))
        return _rows(rows)

    return run


def _scores(one: Unigrams, levels: list[Level], parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A row for each document of a block."""

    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        b = _opened(state, answers, one, levels, parts)
        n = len(b.length)
        per = lambda x: np.bincount(b.doc, x, n)
        return pa.table(
            {
                "doc_id": pa.array(b.own.view(np.int64), pa.int64(), mask=b.null > 0), "held_out": pa.array(b.held), "n_tokens": pa.array(b.length), "n_known": pa.array(per((b.count > 0)[b.word]).astype(np.int64)),
                "train_tokens": pa.array([one.tokens] * n, pa.int64()), "base_score": pa.array(per(one.base(b.count)[b.word])), "score": pa.array(per(b.log)),
            }
        )

    return run


@dataclass
class KatzModel:
    """The stored tables, by length, and the numbers of their partitions."""

    tables: list[DataFrame]
    word_parts: int
    parts: int


def _scored(docs: DataFrame, held_out: Column, text: str, doc_id: str, order: int, word_parts: int, parts: int, stored: KatzModel | None, keep: bool) -> tuple[DataFrame, KatzModel]:
    def asked(rows: DataFrame, n: int) -> DataFrame:
        return rows if stored is None else rows.unionByName(stored.tables[n - 1].where(F.col("kind") == TABLE + n))

    blocks = stage(_blocks(docs, text, doc_id, held_out, word_parts), "blocks", ["kind"])
    first = asked(blocks.where(F.col("kind") == ASKED + 1), 1)
    tables = [stage(first.groupBy("part").applyInArrow(_words(word_parts), _SQL_ROWS), "words", ["kind"])]
    discard(blocks, f"kind={ASKED + 1}")
    one, levels = Unigrams.of(_times(tables[0], 1)), []
    release(docs.sparkSession)
    state = blocks.where(F.col("kind") == STATE)

    def known() -> DataFrame:
        rows = [t.where(F.col("kind") == ANSWER + n) for n, t in enumerate(tables, 1)]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    for n in range(2, order + 1):
        asks = state.groupBy("block").cogroup(known().groupBy("block")).applyInArrow(_asks(one, levels, parts), _SQL_ROWS)
        tables.append(stage(asked(asks, n).groupBy("part").applyInArrow(_table(n, one, levels), _SQL_ROWS), f"grams{n}", ["kind"]))
        del asks
        levels = [*levels, Level.of(tables[-1], n)]
        if not keep and n < order:
            discard(tables[-1], f"kind={TABLE + n}")
        release(docs.sparkSession)  # Spark holds on to the last query until another has run
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = state.groupBy("block").cogroup(known().groupBy("block")).applyInArrow(_scores(one, levels, parts), schema)
    return out, KatzModel(tables, word_parts, parts)


def fit_score(docs: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id", order: int = ORDER, keep: bool = True) -> tuple[DataFrame, KatzModel]:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row, and the tables.

    The model is counted from the rows for which ``held_out`` does not hold. Without ``keep``, tables of n-grams shorter
    than ``order`` go once they have been used: the longest n-grams' counts add up to theirs.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    word_parts, parts = (max(12, size // b) for b in (WORD_PART, GRAM_PART))
    return _scored(docs, held_out, text, doc_id, order, word_parts, parts, None, keep)


def score(docs: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id", order: int = ORDER) -> DataFrame:
    """The rows of ``fit_score``; of the tables, those of words and of the longest n-grams stay."""
    return fit_score(docs, held_out, text, doc_id, order, keep=False)[0]


def score_with(model: KatzModel, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The same columns for other texts, by stored tables; all rows are held out."""
    return _scored(docs, F.lit(True), text, doc_id, len(model.tables), model.word_parts, model.parts, model, keep=False)[0]
