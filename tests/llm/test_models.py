"""Models and search against brute force: neighbours, language model, quality rules, URL filters."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import prose

from weft.llm import katz, quality, queries, urls


def rows_of(spark, name, d):
    return [r.asDict() for r in queries.QUERIES[name](spark, d).collect()]


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


# --- neighbours -------------------------------------------------------------


def vectors(spark, folder, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def slow_near(rows):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    dims = Counter(len(v) for _, v in good)
    dim = max(dims, key=lambda d: (dims[d], d)) if dims else 0
    good = [(i, v) for i, v in good if len(v) == dim]
    out = []
    for k, (q, x) in enumerate(good):
        if q % 20 == 0:
            near = sorted((-round(float(x @ v), 9), i) for j, (i, v) in enumerate(good) if j != k)[:20]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


def test_neighbours_of_few(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=6).astype(np.float32).tolist(), "x") for k in range(30)]
    rows += [(100 + k, rows[3][1], "x") for k in range(30)]  # copies, one of them a query
    rows += [(20, None, "x"), (40, [0.0] * 6, "x"), (60, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x"), (80, [float("nan")] * 6, "x"), (200, [1.0, 2.0], "x"), (None, rows[0][1], "x"), (220, [], "x"), (240, [float("inf")] * 6, "x")]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in rows_of(spark, "op3_ann", vectors(spark, tmp_path, rows)))
    want = slow_near(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-6)


def test_neighbours_recall(spark):
    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.1"
    t = pq.read_table(f"{d}/embeddings.parquet").to_pydict()
    want = slow_near([(i, v, "") for i, v in zip(t["vec_id"], t["embedding"])])
    got = {(r["query_id"], r["vec_id"]): r for r in rows_of(spark, "op3_ann", d)}
    hit = [(q, i) in got for q, _, i, _ in want]
    assert np.mean(hit) >= 0.93
    assert all(abs(got[q, i]["score"] - s) < 1e-6 for q, _, i, s in want if (q, i) in got)
    assert len(got) == len(want)


def test_neighbours_of_none(spark, tmp_path):
    assert rows_of(spark, "op3_ann", vectors(spark, tmp_path / "a", [])) == []
    assert rows_of(spark, "op3_ann", vectors(spark, tmp_path / "b", [(20, [1.0, 2.0], "x")])) == []


# --- language model ---------------------------------------------------------


class SlowKatz:
    """The model's definition over plain counters."""

    def __init__(self, texts, order=katz.ORDER):
        seqs = [self.tokens(t) for t in texts]
        self.order = order
        self.c = Counter(w for s in seqs for w in s)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.one = katz.Unigrams.of(dict(Counter(self.c.values())))
        self.d, self.next, self.h = {}, {}, {}
        for k in range(2, order + 1):
            grams = Counter((h, w) for s in seqs for h, w in self.events(s, k))
            self.d[k] = katz.discounts(dict(Counter(grams.values())))
            self.next[k], self.h[k] = defaultdict(dict), Counter()
            for (h, w), n in grams.items():
                self.next[k][h][w] = n
                self.h[k][h] += n

    @staticmethod
    def tokens(text):
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        return [*words(low), ""]

    @staticmethod
    def events(s, k):
        padded = ["<s>"] * (k - 1) + s
        return [(tuple(padded[j : j + k - 1]), w) for j, w in enumerate(s)]

    def p1(self, w):
        c = self.c.get(w, 0)
        return self.one.d[min(c, katz.FIRST + 1)] * c / self.n if c else self.one.left

    def p(self, w, h):
        """Recursive in the length of the history."""
        if not h:
            return self.p1(w)
        k = len(h) + 1
        after = self.next[k].get(h)
        if not after:
            return self.p(w, h[1:])
        total = self.h[k][h] + (min(after.values()) > katz.FIRST)
        star = {x: (1.0 if n > katz.FIRST else self.d[k][n]) * n / total for x, n in after.items()}
        if w in star:
            return star[w]
        return (1 - math.fsum(star.values())) / (1 - math.fsum(self.p(x, h[1:]) for x in after)) * self.p(w, h[1:])

    def score(self, text):
        return math.fsum(math.log10(self.p(w, h)) for h, w in self.events(self.tokens(text), self.order))


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


@pytest.fixture(scope="module")
def corpus(odd_rows):
    rng = random.Random(2)
    rows = [(2000 + k, prose(rng, rng.randint(1, 120)), "en", "a", 1) for k in range(300)]
    rows += [(4000 + k, "common passage always alike " + prose(rng, 3), "en", "a", 1) for k in range(200)]  # a history with one successor
    rows += [(6000 + k, "always unlike common things passage", "en", "a", 1) for k in range(20)]
    return rows + odd_rows


@pytest.mark.parametrize("small", [False, True])
def test_katz_brute(spark, make_docs, corpus, monkeypatch, small):
    if small:  # many blocks, partitions and dealt histories
        monkeypatch.setattr(katz, "BLOCK_TOKENS", 2000)
        monkeypatch.setattr(katz, "GRAM_PART", 20_000)
        monkeypatch.setattr(katz, "WORD_PART", 20_000)
    got = rows_of(spark, "op8_katz", make_docs(corpus, ("score", "data", "part")))
    model = SlowKatz([r[1] for r in corpus if not held(r[0])])
    want = sorted((str(r[0]), held(r[0]), len(words(r[1])) + 1, round(model.score(r[1]), 4)) for r in corpus)
    have = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], round(r["score"], 4)) for r in got)
    assert len(have) == len(want)
    for a, b in zip(have, want):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=2e-4)
    text = {}
    for r in corpus:
        text.setdefault(r[0], r[1])
    for r in got:
        if r["doc_id"] in (5, None):
            continue
        t = model.tokens(text[r["doc_id"]])
        assert r["n_known"] == sum(model.c[w] > 0 for w in t) and r["train_tokens"] == model.n
        assert r["base_score"] == pytest.approx(sum(math.log10((model.c[w] + 1) / (model.n + model.v + 1)) for w in t), rel=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_orders_and_stored_tables(spark, make_docs, corpus, monkeypatch, order):
    """Any order agrees with brute force, and tables that are read again score held-out texts as the corpus run did."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(katz, "BLOCK_TOKENS", 3000)
    monkeypatch.setattr(katz, "GRAM_PART", 20_000)
    rows = [r for r in corpus if r[0] is not None and r[0] != 5]
    docs = spark.read.parquet(make_docs(rows) + "/documents.parquet")
    out = F.col("doc_id") % 5 == 1
    got, tables = katz.fit_score(docs, out, order=order)
    model = SlowKatz([r[1] for r in rows if r[0] % 5 != 1], order)
    score = {r["doc_id"]: r["score"] for r in got.collect()}
    for r in rows:
        assert score[r[0]] == pytest.approx(model.score(r[1]), abs=2e-4), r[0]
    again = {r["doc_id"]: r["score"] for r in katz.score_with(tables, docs.where(out)).collect()}
    assert again.keys() == {r[0] for r in rows if r[0] % 5 == 1}
    assert all(score[k] == pytest.approx(v, abs=1e-9) for k, v in again.items())
    other = spark.createDataFrame([(1, "common passage never seen before"), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: round(r["score"], 4) for r in katz.score_with(tables, other).collect()} == {k: round(model.score(t), 4) for k, t in ((1, "common passage never seen before"), (2, None))}


@pytest.mark.parametrize("length", [1, 2])
def test_katz_sums_to_one(corpus, length):
    model = SlowKatz([r[1] for r in corpus if not held(r[0])])
    for h in [*list(model.next[length + 1])[:40], ("common", "passage")[:length], ("never", "seen")[:length]]:
        assert math.fsum(model.p(w, h) for w in [*model.c, "never seen"]) == pytest.approx(1, abs=1e-9)


def test_pack():
    rng = np.random.default_rng(0)
    arrays = [rng.integers(0, 1 << k, 50, dtype=np.uint64) for k in (1, 8, 20, 63)] + [np.zeros(0, np.uint64), np.array([(1 << 64) - 1], np.uint64)]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, katz.unpack(katz.pack(*arrays))))


# --- quality ----------------------------------------------------------------


def slow_counts(text):
    w = words(text)
    runs = defaultdict(list)
    for k in range(len(w) - 4):
        runs[tuple(w[k : k + 5])].append(k)
    cover = {j for v in runs.values() if len(v) > 1 for k in v for j in range(k, k + 5)}
    lines = [x for x in text.split("\n") if words(x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(cover)


def test_quality_counts(spark, make_docs, odd_rows, tmp_path):
    rng = random.Random(6)
    rows = list(odd_rows)
    for k in range(120):
        bits = [prose(rng, rng.randint(1, 8), words=("a", "b")) for _ in range(rng.randint(1, 12))]
        rows.append((7000 + k, "".join(b + rng.choice(["\n", " ", " | # ", "\n\n"]) for b in bits), "en", "a", 1))
    d = make_docs(rows, ("kept", "n_words"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    got = Counter(tuple(r[k] for k in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in rows_of(spark, "op9_quality", d))
    want = Counter()
    for r in rows:
        c = slow_counts(r[1] or "")
        want[(r[0], *c, c[0] < 10 or 100 * c[4] > 20 * c[0])] += 1
    assert got == want


def test_quality_verdicts(spark):
    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.1"
    t = pq.read_table(f"{d}/labels.parquet").to_pydict()
    good = dict(zip(t["doc_id"], t["quality"]))
    got = [r for r in rows_of(spark, "op9_quality", d) if r["doc_id"] in good and not r["base_failed"]]
    clean = [r["kept"] for r in got if good[r["doc_id"]] == 1]
    junk = [r["kept"] for r in got if good[r["doc_id"]] == 0]
    assert np.mean(clean) > 0.995, np.mean(clean)
    assert np.mean(junk) < 0.8, np.mean(junk)


def test_viterbi_equals_all_paths():
    import itertools

    rng = np.random.default_rng(3)
    for _ in range(30):
        f = quality.LineField(rng.normal(size=quality.N_FEATURES), rng.normal(size=(2, 2)))
        lines = rng.integers(0, 1 << quality.N_FEATURES, 7).tolist()
        u = [float(quality._bits(np.array([x]))[0] @ f.weight) for x in lines]
        value = lambda y: sum(a * b for a, b in zip(u, y)) + sum(f.step[a, b] for a, b in zip(y, y[1:]))
        assert value(f.labels(lines)) == pytest.approx(max(map(value, itertools.product((0, 1), repeat=7))))


# --- URLs -------------------------------------------------------------------


def slow_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in host)
    fits = [(len(h) + len(p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_urls(spark, tmp_path):
    rng = random.Random(3)
    some = [None, "", "no scheme", "http://", "http://COM/", "http://example.com/en/x?q=://b", "https://www.example.com/en/", "ftp://a.net/es/", "x://net/fr", "http://notnet/fr/", "http://É.com?x", "http://a.com#f/", "://net/fr/\nx"]
    for _ in range(300):
        host = rng.choice(["a.", "www.", "WWW.", ""]) + rng.choice(["example.com", "net", "example.net", "com", "org", "x.org"])
        some.append(f"{rng.choice(['http', 'https'])}://{host}/{rng.choice(['en', 'fr', 'es', 'de'])}/{rng.randint(1, 999)}{rng.choice(['', '?a=1&b=2', '#top', '/'])}")
    some.append("http://long.org/" + "x9" * 20_000)
    rows = [(k, u, "", "x") for k, u in enumerate(some)] + [(None, some[20], "", "x"), (20, some[20], None, "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string, rule string").repartition(2).write.parquet(f"{tmp_path}/pages.parquet")
    got = rows_of(spark, "op10_urls", str(tmp_path))
    want = Counter((i, *slow_url(u)[:3]) for i, u, *_ in rows)
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in got) == want
    verdict = {i: slow_url(u)[3] for i, u, *_ in rows}
    assert all(r["verdict"] in ("allow", "block") and (r["rule"] is None or r["verdict"] == verdict[r["page_id"] if r["page_id"] is not None else 20]) for r in got)
    again = Counter(map(str, rows_of(spark, "op10_urls", str(tmp_path))))
    assert again == Counter(map(str, got))


def test_urls_without_labels(spark, tmp_path):
    spark.createDataFrame([(1, "http://a.org/"), (2, None)], "page_id long, url string").write.parquet(f"{tmp_path}/a/pages.parquet")
    assert {(r["page_id"], r["verdict"]) for r in rows_of(spark, "op10_urls", f"{tmp_path}/a")} == {(1, "allow"), (2, "allow")}
    spark.createDataFrame([], "page_id long, url string").write.parquet(f"{tmp_path}/b/pages.parquet")
    assert rows_of(spark, "op10_urls", f"{tmp_path}/b") == []
