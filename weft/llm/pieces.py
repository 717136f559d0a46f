"""SentencePiece byte-pair encoding by vectorised merge rounds.

No piece of a supported model has a space behind anything else, so a text falls into
words (spaces, then what follows) that never merge with one another; a word is cut
further where no piece spans two neighbouring characters. The distinct words of a batch
lie in one flat symbol array. In each round the pairs of least rank within reach of a
longest piece are found by segmented minima, all of them merge at once, leftmost first
where they overlap or follow one another, the array is compacted, and only the pairs
beside a merge are ranked anew; a part without a pair leaves.

This is equal to the library's queue, which merges the best pair of a word first, the
leftmost of equal ones: a merge further away than the longest piece cannot touch a pair
before its turn, so whatever is least within that reach may go. Where a merge makes a
pair that the queue would prefer, those behind it wait for the next round, and so do
equal pairs behind one that has a lesser pair in its own reach. A word of any length thus
takes as many rounds as its merges nest, not as many as it has symbols.

Encoded words are remembered in two generations of fixed size.

Defined results: a null or empty text is the begin and end ids alone and decodes to
nothing; every row gives one row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.texts import map_batches

REMEMBERED = 120_000  # words in each of two generations
_SPACE = "▁"
_NONE = np.int64(1) << 40
_ROOM = 1 << 20  # symbols merged at a time


def window_least(a: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    span = 1
    while 2 * span <= width:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    return np.minimum(a[: len(a) - (width - span)], a[width - span :])


def beside(at: np.ndarray, sym: np.ndarray, part: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols beside each merge at its turn, those before it done; -1 where there is none."""
    left = np.where((at > 0) & (part[at - 1] == part[at]), sym[at - 1], -1)
    follows = np.nonzero((np.diff(at) == 2) & (part[at[1:]] == part[at[:-1]]))[0] + 1
    left[follows] = made[follows - 1]
    far = np.minimum(at + 2, len(sym) - 1)
    return left, np.where((at + 2 < len(sym)) & (part[far] == part[at]), sym[far], -1)


class PieceModel:
    """Tables of a byte-pair model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.bos, self.eos = lib.bos_id(), lib.eos_id()
        special = np.array([lib.is_control(k) or lib.is_unknown(k) or lib.is_byte(k) for k in range(n)])
        names = [lib.id_to_piece(k) for k in range(n)]
        self.byte_id = {int(names[k][3:5], 16): k for k in range(n) if lib.is_byte(k)}
        text = {k: names[k].replace(_SPACE, " ") for k in range(n) if not special[k]}
        if len(self.byte_id) != 256 or any(lib.is_unused(k) for k in range(n)) or any(" " in t.lstrip(" ") for t in text.values()):
            raise ValueError("only byte-fallback models without pieces across words are supported")
        #: Bytes that each id decodes to.
        self.bytes_of = [b""] * n
        for k, t in text.items():
            self.bytes_of[k] = t.encode()
        for b, k in self.byte_id.items():
            self.bytes_of[k] = bytes([b])
        self.symbol = {t: k for k, t in text.items()}
        for t in text.values():  # characters that are no pieces can still start merges
            for c in t:
                self.symbol.setdefault(c, len(self.symbol) + n)
        self.pieces = n
        self.length_of = np.array([len(b) for b in self.bytes_of])
        self.lone = {k: t for t, k in self.symbol.items() if k >= n}
        self.of_point = np.full(0x110000, -1, np.int64)
        for t, k in self.symbol.items():
            if len(t) == 1:
                self.of_point[ord(t)] = k
        # Both halves of a piece must be symbols for a pair to make it.
        best = sorted(text, key=lambda k: -lib.get_score(k))
        rank = {k: r for r, k in enumerate(best)}
        pairs = {}
        for k, t in text.items():
            for cut in range(1, len(t)):
                a, b = self.symbol.get(t[:cut]), self.symbol.get(t[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = (rank[k], k)
        self.pairs = pairs
        self.key = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.key.tolist()], np.int64)
        self.made = np.array([pairs[k][1] for k in self.key.tolist()], np.int64)
        self.reach = max(map(len, text.values()), default=0) + 1
        self.beside = np.array(sorted({ord(t[k]) << 21 | ord(t[k + 1]) for t in text.values() for k in range(len(t) - 1)}), np.int64)
        inner = {c for t in text.values() if len(t) > 1 for c in t}
        lone = "\n" not in inner
        self.words = re.compile(" *[^ \n]+| +|\n" if lone else " *[^ ]+| +").findall
        # Words met lately, and those of the generation before, which move up when they are met again.
        self.remembered: dict[str, tuple[bytes, int, bytes]] = {}
        self.older: dict[str, tuple[bytes, int, bytes]] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (or none) and where its entry is."""
        key = np.where((left >= 0) & (right >= 0), left << 20 | right, -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], _NONE), at

    def merge(self, sym: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols and their parts, given first symbols by ascending part; negative ones never merge."""
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def ranked(i: np.ndarray) -> np.ndarray:
            r = np.full(len(i), _NONE)
            ok = i + 1 < len(sym)
            ok[ok] = part[i[ok]] == part[i[ok] + 1]
            r[ok] = self._ranks(sym[i[ok]], sym[i[ok] + 1])[0]
            return r

        rank = ranked(np.arange(len(sym)))
        while len(sym):
            first = np.nonzero(np.concatenate([[True], part[1:] != part[:-1]]))[0]
            size = np.diff(np.append(first, len(sym)))
            least = np.minimum.reduceat(rank, first)
            going = least < _NONE
            if not going.all():  # parts without a pair leave
                stay = np.repeat(going, size)
                done.append((sym[~stay], part[~stay]))
                sym, part, rank = sym[stay], part[stay], rank[stay]
                size, least = size[going], least[going]
                if not len(sym):
                    break
            at, waits = self._ready(rank, size, least)
            chain = np.concatenate([[True], (np.diff(at) > self.reach) | (part[at[1:]] != part[at[:-1]])])
            run = np.concatenate([[True], (np.diff(at) != 1) | chain[1:]])
            k = np.arange(len(at))
            even = (k - np.maximum.accumulate(np.where(run, k, 0))) % 2 == 0  # the rest lose a symbol to the pair before
            chain = np.cumsum(chain)
            at, waits, chain = at[even], waits[even], chain[even]
            made = self.made[self._ranks(sym[at], sym[at + 1])[1]]
            left, right = beside(at, sym, part, made)
            better = np.minimum(self._ranks(left, made)[0], self._ranks(made, right)[0]) < rank[at]
            opens = np.concatenate([[True], chain[1:] != chain[:-1]])
            waits[1:] |= better[:-1] & ~opens[1:]
            held = np.cumsum(waits)
            free = held == (held - waits)[opens][np.cumsum(opens) - 1]
            at, made = at[free], made[free]
            sym[at] = made
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, part, rank = sym[keep], part[keep], rank[keep]
            at -= np.arange(len(at))  # one symbol has gone before each later merge
            rank[at] = ranked(at)
            before = at[at > 0] - 1
            rank[before] = ranked(before)
        if not done:
            return sym, part
        sym, part = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(part, kind="stable")
        return sym[order], part[order]

    def _ready(self, rank: np.ndarray, size: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that are least within reach, and whether an equal one before them is not."""
        near = np.repeat(least, size)
        wide = size > self.reach + 2  # elsewhere the whole part is within reach
        if not wide.any():
            at = np.nonzero(rank == near)[0]
            return at, np.zeros(len(at), bool)
        among = np.nonzero(np.repeat(wide, size))[0]
        # Each wide part lies between paddings, so windows don't cross parts.
        place = np.arange(len(among)) + self.reach * (1 + np.repeat(np.arange(wide.sum()), size[wide]))
        padded = np.full(place[-1] + 1 + self.reach, _NONE)
        padded[place] = rank[among]
        near[among] = window_least(padded, 2 * self.reach + 1)[place - self.reach]
        ready = (rank == near) & (rank < _NONE)
        padded[place[ready[among]]] = _NONE
        waits = np.zeros(len(rank), bool)
        waits[among] = window_least(padded, self.reach)[place - self.reach] == rank[among]
        at = np.nonzero(ready)[0]
        return at, waits[at]

    def _symbols(self, points: np.ndarray) -> np.ndarray:
        found = self.of_point[points]
        return np.where(found >= 0, found, ~points.astype(np.int64))

    def learn(self, words: list[str]) -> None:
        """Encode distinct words and remember them."""
        at = total = 0
        for k, w in enumerate(words):  # bounded flat arrays
            if total and total + len(w) > _ROOM:
                self._learn(words[at:k])
                at, total = k, 0
            total += len(w)
        self._learn(words[at:])

    def _learn(self, order: list[str]) -> None:
        if not order:
            return
        points = np.frombuffer("".join(order).encode("utf-32-le"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(len(order)), [len(w) for w in order])
        pair = points[:-1] << 21 | points[1:]
        at = np.minimum(np.searchsorted(self.beside, pair), max(len(self.beside) - 1, 0))
        cut = (word[1:] != word[:-1]) | (self.beside[at] != pair if len(self.beside) else True)
        part = np.concatenate([[0], np.cumsum(cut)])
        of = word[np.concatenate([[True], cut])]  # the word of each part
        sym, out = self._symbols(points), []
        ends = np.nonzero(np.concatenate([cut, [True]]))[0] + 1
        start = 0
        while start < len(sym):  # whole parts of about _ROOM symbols together
            end = int(ends[min(np.searchsorted(ends, start + _ROOM), len(ends) - 1)])
            out.append(self.merge(sym[start:end], part[start:end]))
            start = end
        sym, word = (np.concatenate(x) for x in zip(*out, strict=True))
        word = of[word]
        odd = np.nonzero((sym < 0) | (sym >= self.pieces))[0]
        if len(odd):  # characters without a piece become byte pieces
            raw = [(chr(~s) if s < 0 else self.lone[s]).encode() for s in sym[odd].tolist()]
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(r) for r in raw]
            first = (np.cumsum(times) - times)[odd]
            sym, word = np.repeat(sym, times), np.repeat(word, times)
            for k, r in zip(first.tolist(), raw, strict=True):
                sym[k : k + len(r)] = [self.byte_id[b] for b in r]
        ends = np.cumsum(np.bincount(word, minlength=len(order)))
        ids = sym.astype("<u4").tobytes()
        decoded = self._joined(sym.tolist())
        lengths = np.concatenate([[0], np.cumsum(self.length_of[sym])])
        starts = ends - np.bincount(word, minlength=len(order))
        for w, s, e, i, j in zip(order, starts.tolist(), ends.tolist(), lengths[starts].tolist(), lengths[ends].tolist(), strict=True):
            self.remembered[w] = (ids[4 * s : 4 * e], e - s, decoded[i:j])

    def _joined(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[k] for k in ids])

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[bytes, int, bytes]]:
        """Ids as little-endian 32-bit integers with begin and end, their number, and the decoded bytes."""
        split = [self.words(" " + t.replace(_SPACE, " ")) if t else [] for t in texts]
        if len(self.remembered) > REMEMBERED:
            self.older, self.remembered = self.remembered, {}
        new = {w for words in split for w in words if w not in self.remembered}
        known = new & self.older.keys()
        self.remembered.update((w, self.older[w]) for w in known)
        self.learn(list(new - known))
        begin, end = (np.array([k], "<u4").tobytes() for k in (self.bos, self.eos))
        for words in split:
            got = [self.remembered[w] for w in words]
            decoded = b"".join([g[2] for g in got])
            yield begin + b"".join([g[0] for g in got]) + end, sum([g[1] for g in got]) + 2, decoded[1:] if decoded[:1] == b" " else decoded

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.encode_batch([text]))[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control pieces say nothing, the first space is the encoder's own, broken bytes are replaced."""
        data = self._joined(ids)
        return (data[1:] if data[:1] == b" " else data).decode(errors="replace")


def _models(path: str) -> PieceModel:
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


_LOADED: dict[str, PieceModel] = {}
_TOGETHER = 1 << 20  # characters of texts that are encoded at a time


def encode(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids of each whole text.

    ``model`` is the path of the model file on every executor.
    """
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    schema = schema.add("ids", T.ArrayType(T.IntegerType())) if ids else schema

    def groups(column: pa.Array) -> Iterator[list[str]]:
        group, size = [], 0
        for value in column:
            group.append(value.as_py() or "")
            size += len(group[-1])
            if size >= _TOGETHER:
                yield group
                group, size = [], 0
        yield group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _models(model)
        for batch in batches:
            at = 0
            for group in groups(batch.column(0)):
                rows = list(m.encode_batch(group))
                cols = [
                    pa.array([n for _, n, _ in rows], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x, _, _ in rows], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for _, _, x in rows], pa.string()),
                ]
                if ids:
                    ends = np.cumsum([0, *(n for _, n, _ in rows)]).astype(np.int32)
                    flat = np.frombuffer(b"".join(x for x, _, _ in rows), "<i4")
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())))
                kept = [c.slice(at, len(rows)) for c in batch.columns[1:]]
                at += len(rows)
                yield pa.RecordBatch.from_arrays([*kept, *cols], names=schema.names)
        m.older = {}

    return map_batches(docs.select(F.col(text).alias("_text"), *keep), run, schema)
