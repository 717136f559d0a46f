"""Quality rules: fixed counts, and a linear-chain conditional random field over lines.

The field labels each line of a text with words as content or boilerplate. Its line
features are binary and lie in one integer; Viterbi decoding runs over the whole text.
A document is kept if it doesn't fail the fixed rules and content lines hold at least
CONTENT_SHARE of its word characters. The field is trained on the driver by gradient
ascent on the sequences' likelihood, from a bounded sample: TRAIN_DOCS labelled
documents at most (drawn by a hash, so good and bad ones come as often as among the
labels), of each at most TRAIN_LINES consecutive lines from a place drawn by a hash.

Lines have no labels of their own, so weak ones are made. A line is boilerplate if it
names a licence or a site's navigation, or if it stands in a bad document and in no
good one of all that are labelled; any other is content. Labels thus change within good
and bad documents, and the field learns its steps between labels from that.

Defined results: a null, empty or blank text has no words and fails the fixed rules;
without labelled documents of both kinds every line is content; repeated rows and rows
without a doc_id are judged like any other, and of those that share a labelled doc_id
one text is learned from; of repeated labels of a document the lower quality holds;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.texts import map_batches
from weft.staging import discard, stage

TRAIN_DOCS = 1200
TRAIN_LINES = 120
CONTENT_SHARE = 0.3
_SYMBOLS = re.compile("[#*$%&|<>]")
_WORDS = re.compile("[^\x20\x09-\x0d]+")
WINDOW = 5

#: Words of licence and navigation lines.
BOILERPLATE_WORDS = ("licensed", "license", "licence", "copyright", "rights reserved", "cookie", "privacy", "subscribe", "sign in", "log in", "click here", "terms of")


def repeated_words(words: list[str]) -> int:
    """Words within windows of five that occur twice or more, each word once."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[str, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    if len(seen) == len(words):
        return 0
    # Ranks of runs of two words, of four, then of five: exact, not hashed.
    two = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
    if two.max() == len(two) - 1:
        return 0
    four = np.unique(two[:-2] * np.int64(len(two)) + two[2:], return_inverse=True)[1]
    if four.max() == len(four) - 1:
        return 0
    _, five, times = np.unique(four[:-1] * np.int64(len(seen)) + ids[4:], return_inverse=True, return_counts=True)
    at = np.nonzero(times[five] > 1)[0]
    cover = np.zeros(len(words) + 1, np.int64)
    cover[at] += 1
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    words = _WORDS.findall(text)
    lines, seen = 0, set()
    for line in text.split("\n"):
        if _WORDS.search(line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), lines, repeated_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


N_FEATURES = 26


def line_features(line: str, before: set[str]) -> int:
    """Bits of a line's features; bit 0 is always set."""
    words = line.split()
    n = max(len(words), 1)
    chars = max(sum(map(len, words)), 1)
    symbols = len(_SYMBOLS.findall(line)) / n
    letters = sum(map(str.isalpha, line)) / chars
    mean = chars / n
    most = n - len(set(words))
    low = line.lower()
    tail = line.rstrip()[-1:]
    stops = len(re.findall(r"[.!?](?:\s|$)", line)) / n
    bits = [
        True, n <= 2, 2 < n <= 5, 5 < n <= 12, 12 < n <= 40, n > 40, symbols > 0.5, 0.1 < symbols <= 0.5, 0 < symbols <= 0.1, letters < 0.5,
        0.5 <= letters < 0.8, mean < 3, mean > 8.5, mean > 14, most > 0.3 * n, most > 0.7 * n, tail in tuple(".!?"), tail in tuple("|>:;,"), stops == 0,
        stops > 0.3, named(low), "|" in line, sum(map(str.isdigit, line)) > 0.5 * chars, line in before, line[:1].isupper(), "://" in line or "www." in low,
    ]
    return sum(1 << k for k, b in enumerate(bits) if b)


def named(line: str) -> bool:
    """True if a line, in lower case, names a licence or a site's navigation."""
    return any(w in line for w in BOILERPLATE_WORDS)


def lines_of(text: str) -> tuple[list[int], list[int]]:
    """Features and word characters of each line with words."""
    seen: set[str] = set()
    features, chars = [], []
    for line in text.split("\n"):
        if found := _WORDS.findall(line):
            features.append(line_features(line, seen))
            chars.append(sum(map(len, found)))
            seen.add(line)
    return features, chars


def _bits(features: np.ndarray) -> np.ndarray:
    return (features[:, None] >> np.arange(N_FEATURES) & 1).astype(np.float64)


@dataclass
class LineField:
    """Scores of a line's features for content (boilerplate is zero) and of going from one label to the next."""

    weight: np.ndarray
    step: np.ndarray

    @classmethod
    def none(cls) -> LineField:
        return cls(np.eye(1, N_FEATURES)[0] * 9.0, np.zeros((2, 2)))

    @classmethod
    def fit(cls, sequences: list[tuple[list[int], list[int]]], rounds: int = 120, rate: float = 0.3, ridge: float = 1e-5) -> LineField:
        """Adagrad ascent on the log-likelihood of (features, labels) of sequences, all of them at a time."""
        sequences = sorted((s for s in sequences if s[0]), key=lambda s: -len(s[0]))
        size = np.array([len(f) for f, _ in sequences])
        total = int(size.sum())
        inside = np.arange(size[0])[None] < size[:, None]
        x, y = np.zeros((*inside.shape, N_FEATURES), np.float32), np.zeros(inside.shape, np.int64)
        x[inside] = _bits(np.array([v for f, _ in sequences for v in f]))
        y[inside] = [v for _, labels in sequences for v in labels]
        told = np.zeros((2, 2))
        np.add.at(told, (y[:, :-1][inside[:, 1:]], y[:, 1:][inside[:, 1:]]), 1)
        w, step = np.zeros(N_FEATURES), np.zeros((2, 2))
        square_w, square_step = np.full(N_FEATURES, 1e-6), np.full((2, 2), 1e-6)
        for _ in range(rounds):
            unary = np.zeros((*inside.shape, 2))
            unary[:, :, 1] = x @ w
            one, pair = cls._marginals(unary, step, size)
            gw = np.einsum("dl,dlf->f", np.where(inside, y - one, 0.0), x) / total - ridge * w
            gs = (told - pair) / total - ridge * step
            square_w += gw**2
            square_step += gs**2
            w += rate * gw / np.sqrt(square_w)
            step += rate * gs / np.sqrt(square_step)
        return cls(w, step)

    @staticmethod
    def _marginals(unary: np.ndarray, step: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of content of each line, and expected numbers of steps, by forward-backward; longest sequences first."""
        d, n, _ = unary.shape
        live = [int((size > t).sum()) for t in range(n)]
        a, b = np.zeros((d, n, 2)), np.zeros((d, n, 2))
        a[:, 0] = unary[:, 0]
        for t in range(1, n):
            k = live[t]
            a[:k, t] = np.logaddexp(a[:k, t - 1, 0, None] + step[0], a[:k, t - 1, 1, None] + step[1]) + unary[:k, t]
        for t in range(n - 2, -1, -1):
            k = live[t + 1]
            ahead = unary[:k, t + 1] + b[:k, t + 1]
            b[:k, t] = np.logaddexp(step[:, 0] + ahead[:, 0, None], step[:, 1] + ahead[:, 1, None])
        last = a[np.arange(d), size - 1]
        z = np.logaddexp(last[:, 0], last[:, 1])
        pair = np.zeros((2, 2))
        for t in range(1, n):
            k = live[t]
            pair += np.exp(a[:k, t - 1, :, None] + step + (unary[:k, t] + b[:k, t])[:, None, :] - z[:k, None, None]).sum(axis=0)
        return np.exp(np.minimum(a[:, :, 1] + b[:, :, 1] - z[:, None], 0.0)), pair

    def labels(self, features: list[int]) -> list[int]:
        """The most likely labels (1: content), by Viterbi."""
        if not features:
            return []
        unary = (_bits(np.array(features)) @ self.weight).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        zero, one = 0.0, unary[0]
        back = []
        for u in unary[1:]:
            to_zero, to_one = s10 + one > s00 + zero, s11 + one >= s01 + zero
            back.append((to_zero, to_one))
            zero, one = (s10 + one if to_zero else s00 + zero), (s11 + one if to_one else s01 + zero) + u
        label = int(one >= zero)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]

    def content_share(self, text: str) -> float:
        """Share of word characters that lie in content lines."""
        features, chars = lines_of(text)
        total = sum(chars)
        return sum(c for c, y in zip(chars, self.labels(features), strict=True) if y) / total if total else 0.0


def _segments(docs: DataFrame, drawn: DataFrame, text: str, train_lines: int) -> DataFrame:
    """(doc_id, y, f, h, b) of one segment of each drawn document: its lines' features, hashes, and whether they name a licence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, doc_id, lot in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                t = value.as_py() or ""
                lines = [s for s in t.split("\n") if _WORDS.search(s)]
                cuts = -(-len(lines) // train_lines)
                at = xxhash.xxh64_intdigest(str(doc_id), lot) % cuts if cuts else 0
                part = slice(len(lines) * at // max(cuts, 1), len(lines) * (at + 1) // max(cuts, 1))
                h = np.array([xxhash.xxh64_intdigest(s.encode(errors="replace"), 42) for s in lines[part]], np.uint64).view(np.int64)
                rows.append((lines_of(t)[0][part], h.tolist(), [named(s.lower()) for s in lines[part]]))
            f, h, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(f, pa.list_(pa.int64())), pa.array(h, pa.list_(pa.int64())), pa.array(b, pa.list_(pa.bool_()))], names=["doc_id", "y", "f", "h", "b"]
            )

    some = docs.select(F.col(text).alias("_text"), F.col("doc_id").cast("long").alias("doc_id")).join(F.broadcast(drawn), "doc_id").select("_text", "doc_id", "y", "lot")
    parts = map_batches(some, run, "doc_id long, y int, f array<long>, h array<long>, b array<boolean>")
    # Rows that share a doc_id are one document: the least of them.
    return parts.groupBy("doc_id").agg(F.min(F.struct("y", "f", "h", "b")).alias("s")).select("doc_id", "s.*")


def _elsewhere(docs: DataFrame, wanted: DataFrame, good: DataFrame, text: str) -> DataFrame:
    """Those of the ``wanted`` line hashes ``h`` that stand in a good document, over all rows."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.split(F.col(text), "\n")).alias("line")).select("doc_id", F.xxhash64("line").alias("h"))
    return lines.join(F.broadcast(wanted), "h").join(good, "doc_id", "left_semi").select("h").distinct()


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> LineField:
    """A field from weakly labelled lines of a bounded sample of labelled documents."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    n = known.count()
    # About as many as asked for, by a threshold, so that only few are sorted.
    lot = F.xxhash64("doc_id", F.lit(9))
    some = known.withColumn("lot", F.shiftrightunsigned(lot, 1)).where(F.col("lot") < F.lit((1 << 63) * min(1.0, 1.2 * train_docs / max(n, 1)) - 1).cast("long"))
    drawn = stage(some.orderBy("lot", "doc_id").limit(train_docs), "drawn")
    segments = stage(_segments(docs, drawn, text, train_lines), "segments")
    wanted = segments.where("y = 0").select(F.explode("h").alias("h")).distinct()  # train_docs * train_lines at most
    fine = {r["h"] for r in _elsewhere(docs, wanted, known.where("y = 1"), text).collect()}
    rows = sorted(segments.collect(), key=lambda r: r["doc_id"])
    for t in (drawn, segments):
        discard(t)
    if len({r["y"] for r in rows if r["f"]}) < 2:
        return LineField.none()
    return LineField.fit([(r["f"], [int(not b and (r["y"] == 1 or h in fine)) for h, b in zip(r["h"], r["b"], strict=True)]) for r in rows])


def judge(docs: DataFrame, field: LineField, text: str = "text", keep: tuple[str, ...] = ("doc_id",), share: float = CONTENT_SHARE) -> DataFrame:
    """``keep`` columns, the base counts, base_failed, kept and content_share of each whole text."""
    schema = docs.select(*keep).schema
    for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
        schema = schema.add(name, "long")
    schema = schema.add("base_failed", "boolean").add("kept", "boolean").add("content_share", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(0):
                t = value.as_py() or ""
                c = base_counts(t)
                failed = base_failed(c[0], c[4])
                content = field.content_share(t)
                rows.append((*c, failed, not failed and content >= share, content))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=schema.names)

    return map_batches(docs.select(F.col(text).alias("_text"), *keep), run, schema)
