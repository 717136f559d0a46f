"""Language identification in two steps.

A text is a bag of hashed byte n-grams (1 to 3, lower case), counted over all of it.
Linear support vector machines first choose the language family, one against the
rest, then the languages of that family vote pairwise, one against one. Training
takes a bounded sample of labelled texts, drawn by a hash of the text: ``train_rows``
in all, shared equally by the labels. Texts that are equal and have the same label
are one. Only the features of the sampled texts come to the driver.

Defined results: a null text or one without a letter is ``und`` with score 0; without
any labelled row every text is ``und``; with one label every text with a letter has
it; every row gives one row, repeated rows and rows without a doc_id included; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.llm.linear import fit_svm
from weft.llm.texts import map_batches
from weft.staging import discard, stage

TRAIN_ROWS = 1600
DIMENSIONS = 4096
UNKNOWN = "und"

#: Family of common language codes; any other code is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "yi", "lb"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"),
    "indic": ("hi", "ur", "bn", "pa", "gu", "mr", "ne"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "uralic": ("fi", "et", "hu"),
    "sinitic": ("zh", "yue"),
}


def family_of(code: str) -> str:
    return next((name for name, codes in FAMILIES.items() if code in codes), f"lone:{code}")


_rng = np.random.default_rng(20)
_ONE, _TWO, _THREE = (_rng.integers(0, 1 << 32, 256, dtype=np.uint64) for _ in range(3))
_SPLIT = 1 << 20


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a whole text, in pieces of bounded size."""
    raw = np.frombuffer(f" {text.lower()} ".encode(errors="replace"), np.uint8)
    total = np.zeros(DIMENSIONS, np.int64)
    for k in range(0, len(raw), _SPLIT):
        b = raw[max(0, k - 2) : k + _SPLIT]
        skip = k - max(0, k - 2)
        one, two, three = _ONE[b], _TWO[b], _THREE[b]
        for h in (one[skip:], (one[:-1] * 3 + two[1:])[max(0, skip - 1) :], one[:-2] * 5 + two[1:-1] * 7 + three[2:]):
            total += np.bincount(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64), minlength=DIMENSIONS)
    return total


def scaled(total: np.ndarray) -> np.ndarray:
    """Square roots of counts, to unit length."""
    x = np.sqrt(total.astype(np.float32))
    return x / max(float(np.linalg.norm(x)), 1e-9)


@dataclass
class LanguageModel:
    families: dict[str, list[str]] = field(default_factory=dict)
    by_family: dict[str, np.ndarray] = field(default_factory=dict)
    by_pair: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str]) -> LanguageModel:
        m, of = cls(), np.array(labels)
        for code in sorted(set(labels)):
            m.families.setdefault(family_of(code), []).append(code)
        kin = np.array([family_of(c) for c in labels])
        if len(m.families) > 1:
            for name in m.families:
                m.by_family[name] = fit_svm(x, np.where(kin == name, 1, -1))
        for codes in m.families.values():
            for a, b in combinations(codes, 2):
                rows = (of == a) | (of == b)
                m.by_pair[a, b] = fit_svm(x[rows], np.where(of[rows] == a, 1, -1))
        return m

    def predict(self, text: str | None) -> tuple[str, float]:
        """Label and a score from 0 to 1 that grows with the narrowest margin of the decisions taken."""
        if not self.families or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        x = np.append(scaled(counts(text)), np.float32(1))
        margin = 2.0
        name = next(iter(self.families))
        if self.by_family:
            values = {f: float(x @ w) for f, w in self.by_family.items()}
            ranked = sorted(values, key=lambda f: -values[f])
            name, margin = ranked[0], (values[ranked[0]] - values[ranked[1]]) / 2
        codes = self.families[name]
        votes = dict.fromkeys(codes, 0)
        gain = dict.fromkeys(codes, 0.0)
        least = dict.fromkeys(codes, 2.0)
        for a, b in combinations(codes, 2):
            v = float(x @ self.by_pair[a, b])
            votes[a if v > 0 else b] += 1
            for code, own in ((a, v), (b, -v)):
                gain[code] += own
                least[code] = min(least[code], own)
        best = max(codes, key=lambda c: (votes[c], gain[c]))
        return best, float(1 / (1 + np.exp(-3 * min(margin, least[best]))))


def fit(docs: DataFrame, learn: Column, text: str = "text", label: str = "lang", train_rows: int = TRAIN_ROWS) -> LanguageModel:
    """A model from a bounded sample of the texts of rows for which ``learn`` holds and the label is not null.

    The sample is the least hashes of each label's distinct texts: each task keeps its own least, so no label is sorted as a whole.
    """
    rows = docs.where(learn & F.col(label).isNotNull()).select(F.col(label).alias("_label"), F.col(text).alias("_text"), F.xxhash64(F.col(text)).alias("_lot"))
    lots = stage(rows.select("_label", "_lot").distinct(), "lots")
    sizes = lots.groupBy("_label").agg(F.count("*").alias("_size"))  # one row for each language
    labels = sizes.count()
    if not labels:
        return LanguageModel()
    each = max(2, train_rows // labels)
    # Twice as many as asked for, by a threshold, so that only few of a label are sorted.
    place = F.shiftrightunsigned("_lot", 1)
    few = lots.join(F.broadcast(sizes), "_label").where(place <= F.least(F.lit(1.0), 2.0 * each / F.col("_size")) * float(1 << 63))
    order = F.row_number().over(W.partitionBy("_label").orderBy(place, "_lot"))
    drawn = stage(few.select("_label", "_lot").withColumn("_n", order).where(F.col("_n") <= each).drop("_n"), "drawn")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
            own = [k for k, key in enumerate(keys) if key not in seen and not seen.add(key)]  # copies count once in a task, then once in all
            x = [scaled(counts(batch.column(1)[k].as_py() or "")).astype(np.float16).tobytes() for k in own]
            some = batch.take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(x, pa.binary())], names=["label", "lot", "x"])

    some = rows.join(F.broadcast(drawn), ["_label", "_lot"]).select("_label", "_text", "_lot")  # train_rows at most, or two for each label
    got = map_batches(some, features, "label string, lot long, x binary").groupBy("label", "lot").agg(F.max("x").alias("x")).collect()
    for t in (lots, drawn):
        discard(t)
    got.sort(key=lambda r: (r["label"], r["lot"]))
    x = np.stack([np.frombuffer(bytes(r["x"]), np.float16) for r in got]).astype(np.float32)
    return LanguageModel.fit(x, [r["label"] for r in got])


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns, predicted label and score of each whole text."""
    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS floats for each family and pair

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sent.value.predict(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())],
                names=schema.names,
            )

    return map_batches(docs.select(F.col(text).alias("_text"), *keep), run, schema)


def keep_known(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Rows whose language is found, all columns as they were."""
    cols = docs.columns
    named = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(cols)))
    names = tuple(f"c{k}" for k in range(len(cols)))
    found = predict(named, model, names[cols.index(text)], names, ("_found", "_score"))
    return found.where(F.col("_found") != UNKNOWN).select(*(F.col(n).alias(c) for n, c in zip(names, cols, strict=True)))
