"""Near copies of the pipeline against brute force over sets of 5-word shingles."""

import itertools
import random
from fractions import Fraction

import numpy as np
import pytest
from conftest_llm import prose

from weft.llm import nearcopies


def slow_set(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(" ".join(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([" ".join(w)])


def slow_kept(rows):
    """doc_id of the one row that each group leaves, for rows whose doc_id is unique."""
    sets = [slow_set(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= Fraction(4, 5) and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = [low if g == high else g for g in group]
    return sorted(min(r[0] for r, g in zip(rows, group) if g == k) for k in set(group))


def changed(rng, text, n):
    w = text.split()
    for k in rng.sample(range(len(w)), n):
        w[k] = f"changed{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(6)
    texts = []
    for _ in range(12):
        base = prose(rng, 150)
        texts += [base, base.upper(), base.replace(" ", "\n")] + [changed(rng, base, rng.randint(1, 5)) for _ in range(6)]
        for _ in range(4):  # a chain: ends are further apart than its links
            base = changed(rng, base, 2)
            texts.append(base)
    texts += [None, "", " ", "one", "One", "one two", "one two three four five", "one two three four five six"]
    rng.shuffle(texts)
    return [(k, t, "en", "a", 1) for k, t in enumerate(texts)]


def test_stage_finds_near_copies(spark, make_docs, near_rows):
    import corpus_pipeline

    docs = spark.read.parquet(make_docs(near_rows) + "/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    text = {r[0]: r[1] for r in near_rows}
    got = kept.collect()
    assert sorted(r["doc_id"] for r in got) == slow_kept(near_rows)
    assert all(r["text"] == text[r["doc_id"]] for r in got)


@pytest.mark.parametrize("block", [nearcopies.BLOCK, 1500])
def test_large_groups_in_blocks(spark, make_docs, monkeypatch, block):
    """Buckets over FEW leave no pair out, though most members are first compared with pivots only."""
    monkeypatch.setattr(nearcopies, "FEW", 2)
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    monkeypatch.setattr(nearcopies, "_CELLS", 300)
    rng = random.Random(7)
    rows = []
    for far in (5, 9, 14):  # many of the later ones are apart from what they were made of
        base = prose(rng, 150)
        for k in range(40):
            text = changed(rng, base, rng.randint(1, far))
            rows.append((len(rows), text, "en", "a", 1))
            if k % 8 == 0:  # and have near copies of their own
                rows.append((len(rows), changed(rng, text, 1), "en", "a", 1))
    kept = nearcopies.keep_one(spark.read.parquet(make_docs(rows) + "/documents.parquet"))
    assert sorted(r["doc_id"] for r in kept.collect()) == slow_kept(rows)


def test_blocks_equal_sets():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 63, 90, dtype=np.uint64))
    sets = [base[rng.random(len(base)) < 0.95] for _ in range(40)] + [np.unique(np.concatenate([base, rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in range(1, 40)]
    sets += [np.empty(0, np.uint64), base[:40], base[:45]]
    pivot = sets[3]
    d = [np.setxor1d(pivot, s).view(np.int64) for s in sets]
    size = np.array([len(s) for s in sets])
    found = {(int(x), int(y)) for i, j in nearcopies.near_in_blocks(size[:50], d[:50], size, d) for x, y in zip(i, j)}
    assert found == {(i, j) for i in range(50) for j in range(len(sets)) if nearcopies.similar(sets[i], sets[j])}


def test_odd_and_empty(spark, make_docs, odd_rows):
    docs = spark.read.parquet(make_docs(odd_rows, ("set", "bands", "_text", "key", "root")) + "/documents.parquet")
    kept = nearcopies.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({slow_set(r[1]) for r in odd_rows})
    assert nearcopies.keep_one(spark.read.parquet(make_docs([]) + "/documents.parquet")).count() == 0
