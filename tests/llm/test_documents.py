"""Operators on documents against brute force, on odd rows, an empty table and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from conftest_llm import prose

from weft.llm import mixing, pieces, queries, secrets, sharding, simhash

CLASH = ("fp", "fingerprint", "size", "shard", "slot", "part", "_text", "source_size", "_times", "spans", "score")


def run(spark, name, d):
    return [r.asDict() for r in queries.QUERIES[name](spark, d).collect()]


@pytest.fixture(scope="module")
def odd(make_docs, odd_rows):
    return make_docs(odd_rows, CLASH)


@pytest.fixture(scope="module")
def none(make_docs):
    return make_docs([])


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def slow_print(text):
    w = words(lower(text))
    if not w:
        return 0
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(x.encode(), 42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    prints = [(d, slow_print(t)) for d, t in rows]
    group = list(range(len(prints)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
            group[root(a)] = root(b)
    least = defaultdict(list)
    for k, (d, _) in enumerate(prints):
        least[root(k)].append(d)
    low = {r: min((d for d in v if d is not None), default=None) for r, v in least.items()}
    return sorted(((d, f"{p:016x}", low[root(k)]) for k, (d, p) in enumerate(prints)), key=str)


def test_simhash_brute(spark, odd, odd_rows):
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in run(spark, "op1_simhash", odd)), key=str)
    assert got == slow_components([(r[0], r[1]) for r in odd_rows])


def test_simhash_near_copies(spark, make_docs):
    rng = random.Random(5)
    rows = []
    for k in range(12):
        base = prose(rng, 300).split()
        for _ in range(8):
            w = list(base)
            w[rng.randrange(300)] = "changed"
            rows.append((len(rows), " ".join(w), "en", "a", 1))
    d = make_docs(rows)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in run(spark, "op1_simhash", d)), key=str)
    assert got == slow_components([(r[0], r[1]) for r in rows])


def test_trie_pairs_equal_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 12, 2)).astype(np.uint64)
    values = np.unique(np.concatenate([base, (base[:, None] ^ flips[:, :, 0] ^ flips[:, :, 1]).ravel(), base ^ flips[:, 0, 0]]))
    a, b = values[::2].copy(), values[1::2].copy()
    for x, y in ((values, None), (a, b)):
        found = {(int(i), int(j)) for p, q in simhash.trie_pairs(x, y) for i, j in zip(p, q)}
        other = x if y is None else y
        near = np.argwhere(np.bitwise_count(x[:, None] ^ other[None, :]) <= 2)
        assert found == {(int(i), int(j)) for i, j in near if y is not None or i < j}


def test_trie_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MIN_CELL", 8)
    rng = np.random.default_rng(2)
    base = rng.integers(-(1 << 62), 1 << 62, 60)
    values = np.unique(np.concatenate([base, base ^ 1, base ^ (1 << 40), base ^ (-(1 << 63)) ^ 2, base[:5] ^ 7]))
    fps = spark.createDataFrame([(int(v), k) for k, v in enumerate(values)], "fp long, doc_id long")
    got = {(r["fp"], r["component_id"]) for r in simhash.components(fps).collect()}
    group = {int(v): {int(w) for w in values if (int(v) ^ int(w)).bit_count() <= 2 or (int(v ^ w) & (2**64 - 1)).bit_count() <= 2} for v in values}
    order = {int(v): k for k, v in enumerate(values)}

    def reach(v):
        seen, todo = {v}, [v]
        while todo:
            todo += [w for w in group[todo.pop()] if w not in seen and not seen.add(w)]
        return min(order[w] for w in seen)

    assert got == {(int(v), reach(int(v))) for v in values}


def test_cells_collect_in_proportion_to_cells(spark, monkeypatch):
    """The driver gets a few counts for each wide prefix, not one for nearly each fingerprint."""
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(simhash, "MIN_CELL", 8)
    rng = np.random.default_rng(3)
    values = np.unique(np.concatenate([rng.integers(-(1 << 63), 1 << 63, 40_000), rng.integers(0, 1 << 20, 40)]))
    fps = spark.createDataFrame([(int(v),) for v in values], "fp long")
    collected, collect = [], DataFrame.collect

    def counted(self):
        rows = collect(self)
        collected.append(len(rows))
        return rows

    monkeypatch.setattr(DataFrame, "collect", counted)
    start, depth = simhash._cells(fps, len(values))
    own = np.sort(values.view(np.uint64))
    cell = np.searchsorted(start, own, "right") - 1
    assert (cell >= 0).all() and ((own ^ start[cell]) >> (64 - np.maximum(depth[cell], 1)).astype(np.uint64) == 0).all()
    assert np.bincount(cell, minlength=len(start)).max() <= 8
    assert sum(collected) <= 3 * len(start) and max(collected) < len(values) / 2


def test_keep_one(spark, odd, odd_rows):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    prints = {r[1]: slow_print(r[1]) for r in odd_rows}
    groups = {c for _, _, c in slow_components([(r[0], r[1]) for r in odd_rows])}
    assert kept.count() == len(groups)
    assert len({prints[r["text"]] for r in kept.collect()}) == len(groups)


ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def slow_base(text):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ("assign", "access", "hex")
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(out, key=lambda x: (x[1], order.index(x[0]))))


def test_secrets_base(spark, make_docs, odd_rows):
    rng = random.Random(4)
    bits = ["token: secret: abcdefghij", "API_KEY='x'", "apikey = \"0123456789ab\"", "AKIAAKIA" + "Z" * 12, "AKIA12", "a" * 40, "0" * 31, "ſecret=abcdefghi", "é", " ", "passwd=token=abcdefgh"]
    rows = [(k, "".join(rng.choice(bits) + rng.choice(["", " ", "é "]) for _ in range(rng.randint(1, 8))), "en", "a", 1) for k in range(80)] + odd_rows
    got = Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in run(spark, "op2_secrets", make_docs(rows)))
    want = Counter()
    for d, t, *_ in rows:
        s = slow_base(t or "")
        kinds = [x.split(":")[0] for x in s.split(",")]
        want[d, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(s.encode()).hexdigest()] += 1
    assert got == want


def _der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2, "big")) + body


def test_secrets_by_structure():
    import base64
    import json

    rng = random.Random(1)
    number = lambda n: _der(2, bytes([1]) + rng.randbytes(n - 1))
    rsa = _der(0x30, _der(2, b"\0") + b"".join(number(n) for n in (64, 3, 64, 32, 32, 32, 32, 32)))
    ec = _der(0x30, _der(2, b"\1") + _der(4, rng.randbytes(32)))
    wrapped = _der(0x30, _der(2, b"\0") + _der(0x30, _der(6, b"\x2a\x86\x48")) + _der(4, ec))
    assert all(map(secrets.der_key, (rsa, ec, wrapped)))
    assert not secrets.der_key(rsa[:-1]) and not secrets.der_key(b"\x30\x03\x02\x01") and not secrets.der_key(b"")
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + field(b"none") * 2 + field(b"") + b"\0\0\0\1" + field(b"pub" * 9) + field(rng.randbytes(60))
    assert secrets.openssh_key(ssh) and not secrets.openssh_key(ssh[:-1])
    url = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = f"{url({'alg': 'HS256', 'typ': 'JWT'})}.{url({'sub': '1'})}.c2lnbmF0dXJl"
    b64 = lambda b: base64.b64encode(b).decode()
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(re.findall(".{1,64}", b64(rsa))) + "\n-----END RSA PRIVATE KEY-----"
    text = f"é x {b64(rsa)} y {wrapped.hex()} z {b64(ssh)} {token}, {pem} end"
    kinds = Counter(k for k, _, _ in secrets.confirmed_spans(text))
    assert kinds == {"der": 2, "openssh": 1, "token": 1, "pem": 1}
    for k, s, e in secrets.confirmed_spans(text):
        assert text[s:e] in (b64(rsa), wrapped.hex(), b64(ssh), token, pem)
    assert not secrets.confirmed_spans("eyJh.eyJi. " + "A" * 500 + " " + url({"no": 1}) + "." + url({}) + ".x")
    assert "c2lnbmF0dXJl" not in secrets.redacted(text, secrets.confirmed_spans(text))


def test_redact(spark, make_docs, odd_rows):
    rows = [*odd_rows, (500, "é token = abcdefgh12 end", "en", "a", 24)]
    docs = spark.read.parquet(make_docs(rows, CLASH) + "/documents.parquet")
    out = {(r["doc_id"], r["text"], r["n_chars"]) for r in secrets.redact(docs).collect()}
    assert (500, "é [secret] end", 14) in out
    assert out - {(500, "é [secret] end", 14)} == {(r[0], r[1], r[4]) for r in odd_rows}


PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_equal_library(spark, odd, odd_rows):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = Counter()
    for d, t, *_ in odd_rows:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += 1
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, "op4_pieces", odd))
    assert got == want


def test_pieces_fuzz():
    lib, own = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.PieceModel(PATH)
    rng = random.Random(1)
    letters = "aabcdeétho  \n\t▁中😀<0x41>s/0123.,\0ñAB'"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["thethethe" * 300, "a" * 5000, "ab" * 900, " " * 900, "x" * 399 + "é" * 401, "</s>the<s>", "🤷‍♀️ é"]
    letters = ("ab", "ot", " e", "ehtr", "etaoinshrdlucmfwypvbgkjqxz", "0123456789abcdef", "=-_*", "tion")
    texts += ["".join(rng.choice(a) for _ in range(n)) for n in (30, 100, 1000, 5000) for a in letters for _ in range(8)]  # words far beyond a piece's reach
    texts += ["".join(lib.id_to_piece(rng.randrange(300, 32_000)).replace("▁", "") for _ in range(rng.randint(1, 80))) for _ in range(200)]
    for t in texts:
        ids = lib.encode(t, add_bos=True, add_eos=True)
        assert own.encode(t) == ids, t[:80]
        assert own.decode(ids) == lib.decode(ids), t[:80]


def slow_targets(sizes, total, most=3):
    """By repeated sharing of the excess."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    done = {}
    while True:
        open_ = [s for s in order if s not in done]
        left = total - sum(done.values())
        if not open_:
            return done
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > most * sizes[s] + 1e-9]
        if not above:
            return done | share
        done |= {s: most * sizes[s] for s in above}


def test_mixing(spark, make_docs, odd_rows):
    rng = random.Random(8)
    rows = [(1000 + k, prose(rng, rng.randint(1, 80)), "en", rng.choice(["big"] * 9 + ["tiny", "mid", None]), 1) for k in range(3000)] + odd_rows
    d = make_docs(rows, CLASH)
    got = run(spark, "op5_mixing", d)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = slow_targets(sizes, sum(sizes.values()))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows)
    source = {r[0]: r[3] for r in rows if r[0] is not None}
    taken, largest = Counter(), Counter()
    for r in got:
        s = source.get(r["doc_id"])
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert (len(r["shards"].split(",")) if r["shards"] else 0) == (r["taken"] // r["size"] if r["size"] else len(r["shards"].split(",")) if r["shards"] else 0)
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(largest[s], 1), s
    again = run(spark, "op5_mixing", d)
    assert Counter(map(str, got)) == Counter(map(str, again))
    out = mixing.mixed(spark.read.parquet(f"{d}/documents.parquet"))
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: v for k, v in sum((Counter({r["doc_id"]: len(r["shards"].split(",")) if r["shards"] else 0}) for r in got), Counter()).items() if v})


def test_quotas_are_exact():
    q = np.array([1000, 0, 37, 5])
    s = mixing.split_quotas(q, 16)
    assert (s.sum(axis=0) == q).all() and s.sum(axis=1).max() - s.sum(axis=1).min() <= 4
    assert (mixing.split_quotas(q, 16) == s).all()


def check_shards(got, rows):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(16))


def test_sharding(spark, make_docs, odd_rows):
    rng = random.Random(9)
    same = prose(rng, 50)
    rows = [(k, prose(rng, rng.randint(1, 60)), "en", "a", 1) for k in range(3000)] + [(5000 + k, same, "en", "a", 1) for k in range(1500)]
    got = run(spark, "op6_sharding", make_docs(rows + odd_rows, CLASH))
    check_shards(got, rows + odd_rows)
    total = Counter()
    for r in got:
        total[r["shard"]] += r["size"]
    mean, largest = sum(total.values()) / 16, max(r["size"] for r in got)
    assert max(abs(total[k] - mean) for k in range(16)) <= largest
    docs = spark.range(5000).selectExpr("id", "id % 7 as shard")
    fine = sharding.shard(docs, 4, spark_lit(1), docs_hash(), docs_hash(), rows_each=300).groupBy("shard").agg({"slot": "max", "id": "count"}).collect()
    assert sorted(r["shard"] for r in fine) == [0, 1, 2, 3] and all(r[1] + 1 == r[2] or r[2] + 1 == r[1] or abs(r[1] - r[2]) <= 1 for r in fine)


def spark_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def docs_hash():
    from pyspark.sql import functions as F

    return F.xxhash64("id")


def test_language(spark, odd, odd_rows, none):
    got = run(spark, "op7_language", "/root/testdata/sf0.01")
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pydict()
    lang, text = dict(zip(t["doc_id"], t["lang"])), dict(zip(t["doc_id"], t["text"]))
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"] and any(map(str.isalpha, text[r["doc_id"]] or ""))]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.93 * len(held)
    by = {r["doc_id"]: r["lang_pred"] for r in run(spark, "op7_language", odd)}
    assert by[1] == by[2] == by[3] == by[8] == by[10] == "und" and by[7] != "und"
    assert len(run(spark, "op7_language", odd)) == len(odd_rows)


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n.startswith("op") and n not in ("op3_ann", "op9_quality", "op10_urls")))
def test_empty_and_odd(spark, none, odd, odd_rows, name):
    assert run(spark, name, none) == []
    assert Counter(r["doc_id"] for r in run(spark, name, odd)) == Counter(r[0] for r in odd_rows)


def test_pipeline(spark, odd, odd_rows, none):
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, step in corpus_pipeline.STAGES:
        before = docs.count()
        docs = corpus_pipeline.stage(step(spark, docs, odd), name)
        if name != "tokens":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "language":
            assert all(any(map(str.isalpha, r["text"])) for r in docs.collect())
        if name in ("secrets", "tokens"):
            assert docs.count() == before
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    text = {r[0]: r[1] for r in odd_rows}
    for r in docs.collect():
        assert len(r["ids"]) == r["n_tokens"]
        if r["doc_id"] is not None:
            assert r["ids"] == lib.encode(text[r["doc_id"]], add_bos=True, add_eos=True)
    assert corpus_pipeline.run(spark, none).count() == 0
