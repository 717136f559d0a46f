"""Tables in which most rows are equal, and other cases that once went wrong."""

import base64
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import prose

from weft.llm import ann, copies, language, mixing, quality, queries, secrets, urls
from weft.staging import stage


def rows_of(spark, name, d):
    return [r.asDict() for r in queries.QUERIES[name](spark, d).collect()]


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


@pytest.fixture(scope="module")
def equal_rows():
    """3,000 equal rows in one source beside 60 rows in another."""
    rng = random.Random(11)
    return [(7, "five words are in here", "en", "b", 22)] * 3000 + [(100 + k, prose(rng, 20 + k), "en", "a", 1) for k in range(60)]


def test_numbers_of_equal_rows(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 4000, 1, 7).select((F.col("id") % 10 * (F.col("id") % 2)).alias("key"), F.monotonically_increasing_id().alias(copies.ROW))
    rows = stage(rows.unionByName(rows.limit(1).select(F.lit(77).cast("long").alias("key"), F.lit(1 << 50).cast("long").alias(copies.ROW))), "rows")
    out = [r["key"] for r in copies.numbered(rows, "key").collect()]
    assert len(out) == len(set(out)) == 4001 and {0, 1, 3, 5, 7, 9, 77} <= set(out)
    few = stage(rows.where("key = 77"), "rows")
    assert copies.numbered(few, "key") is few


def test_mixing_of_equal_rows(spark, make_docs, equal_rows):
    d = make_docs(equal_rows, ("size", "_key"))
    got = rows_of(spark, "op5_mixing", d)
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in equal_rows)
    taken, target, largest = Counter(), {}, Counter()
    for r in got:
        s = "b" if r["doc_id"] == 7 else "a"
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["taken"] == 0) == (r["shards"] == "")
        taken[s] += r["taken"]
        target[s] = r["target"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in "ab"), (taken, target)
    assert Counter(map(str, got)) == Counter(map(str, rows_of(spark, "op5_mixing", d)))
    out = mixing.mixed(spark.read.parquet(f"{d}/documents.parquet"))
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: n for k, n in sum((Counter({r["doc_id"]: r["taken"] // r["size"]}) for r in got), Counter()).items() if n})


def test_shards_of_equal_rows(spark, make_docs, equal_rows):
    got = rows_of(spark, "op6_sharding", make_docs(equal_rows, ("shard", "both")))
    total, slots = Counter(), {}
    for r in got:
        total[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    mean = sum(total.values()) / 16
    assert max(abs(total[k] - mean) for k in range(16)) <= max(r["size"] for r in got)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("case", ["equal", "no ids", "one label"])
def test_language_of_equal_rows(spark, make_docs, case):
    rng = random.Random(12)
    same = (9, "the same words again and again", "en", "a", 1)
    rows = {
        "equal": [same] * 20_000,
        "no ids": [(None, f"word {k:05} of one length", rng.choice(["en", "de"]), "a", 1) for k in range(20_000)],
        "one label": [(k, prose(rng, 12), "fr", "a", 1) for k in range(200)] + [same[:2] + ("fr", "a", 1)] * 2000,
    }[case]
    got = rows_of(spark, "op7_language", make_docs(rows))
    assert len(got) == len(rows)
    known = {"equal": {"en", "und"}, "no ids": {"en", "de"}, "one label": {"fr"}}[case]  # 9 may be held out, and nothing else is there
    assert {r["lang_pred"] for r in got} <= known and len({r["lang_pred"] for r in got}) >= 1
    docs = spark.read.parquet(make_docs(rows) + "/documents.parquet")
    from pyspark.sql import functions as F

    model = language.fit(docs, F.lit(True))
    assert model.families and all(model.predict(r[1])[0] in {x[2] for x in rows} for r in rows[:50])


def test_language_votes():
    """The label is that of plain one-against-one votes within the family that scores highest."""
    rng = random.Random(13)
    syllables = {c: [rng.choice("aeiou") + rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(9)] for c in ("en", "de", "nl", "fr", "es", "xx")}
    texts = [(c, " ".join("".join(rng.choice(s) for _ in range(2)) for _ in range(20))) for c, s in syllables.items() for _ in range(30)]
    model = language.LanguageModel.fit(np.stack([language.scaled(language.counts(t)) for _, t in texts]), [c for c, _ in texts])
    for _, t in texts[::3] + [("", "é mixed TEXT 12"), ("", "x" * 3000)]:
        x = np.append(language.scaled(language.counts(t)), 1.0)
        family = max(sorted(model.by_family), key=lambda f: float(x @ model.by_family[f]))
        codes = model.families[family]
        wins = {c: [0, 0.0] for c in codes}
        for (a, b), w in model.by_pair.items():
            if a in codes:
                v = float(x @ w)
                wins[a if v > 0 else b][0] += 1
                wins[a][1] += v
                wins[b][1] -= v
        assert model.predict(t)[0] == max(codes, key=lambda c: tuple(wins[c]))


# --- secrets ----------------------------------------------------------------


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2, "big")) + body


def test_only_what_parses_is_a_key():
    rng = random.Random(14)
    number = lambda n: der(2, bytes([1]) + rng.randbytes(n - 1))
    rsa = der(0x30, der(2, b"\0") + b"".join(number(n) for n in (64, 3, 64, 32, 32, 32, 32, 32)))
    dsa = der(0x30, der(2, b"\0") + b"".join(number(n) for n in (128, 20, 128, 128, 20)))
    algorithm = der(0x30, der(6, b"\x2a\x86\x48\x86\xf7") + der(5, b""))
    pkcs8 = lambda inner: der(0x30, der(2, b"\0") + algorithm + der(4, inner))
    ed = pkcs8(der(4, rng.randbytes(32)))
    assert all(map(secrets.der_key, (rsa, dsa, pkcs8(rsa), ed)))
    for wrong in (rsa[:-1], pkcs8(rsa[:-1]), pkcs8(rsa + b"x"), pkcs8(b"no key in here at all"), der(0x30, der(2, b"\0") + der(0x30, b"\x06\x7f\x01") + der(4, rsa)), der(0x30, rsa)):
        assert not secrets.der_key(wrong)
    deep = b"\x05\x00"
    for _ in range(secrets.DEEPEST + 2):
        deep = der(0x30, deep)
    assert not secrets.der_key(der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a") + deep) + der(4, rsa)))
    locked = der(0x30, der(0x30, der(6, b"\x2a\x86\x48") + der(0x30, der(4, b"salt"))) + der(4, rng.randbytes(64)))
    assert secrets.encrypted_key(locked) and not secrets.encrypted_key(rsa) and not secrets.encrypted_key(locked[:-2])

    b64 = lambda b: base64.b64encode(b).decode()
    frame = lambda kind, body: f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----"
    lines = lambda b: "\n".join(re.findall(".{1,64}", b64(b)))
    dek = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n"
    good = [frame("RSA ", lines(rsa)), frame("DSA ", lines(dsa)), frame("", lines(pkcs8(rsa))), frame("ENCRYPTED ", lines(locked)), frame("RSA ", dek + lines(rng.randbytes(64)))]
    good += [frame("", lines(ed)).replace("\n", "\\n"), frame("RSA ", lines(rsa)).replace("\n", "\r\n"), b64(frame("EC ", lines(rsa)).encode())]
    bad = [frame("", " see the ENCRYPTED docs "), frame("ENCRYPTED ", lines(rsa)), frame("RSA ", lines(rsa[:-1])), frame("RSA ", dek + lines(rng.randbytes(63)))]
    bad += [frame("RSA ", "DEK-Info: none\n\n" + lines(rng.randbytes(64))), frame("RSA ", lines(rsa)).replace("END RSA", "END EC"), "-----BEGIN PRIVATE KEY-----\n" * 20 + "x", frame("", lines(locked)), frame("", "")]
    for text in good:
        assert ("pem", 2, 2 + len(text)) in secrets.confirmed_spans(f"é {text} é"), text[:40]
    for text in bad:
        assert not any(k == "pem" for k, _, _ in secrets.confirmed_spans(text)), text[:60]
    many = "-----BEGIN PRIVATE KEY-----" * 40_000 + "-----END PRIVATE KEY-----"
    assert secrets.pem_spans(many) == []


# --- neighbours, quality and URLs ---------------------------------------------


def test_neighbours_in_many_blocks(spark, monkeypatch):
    """Cells that many queries visit meet them in blocks; nothing is lost by that."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(ann, "QUERY_BLOCK", 64)
    monkeypatch.setattr(ann, "CELL_ROWS", 512)
    d = "/root/testdata/sf0.1"
    t = pq.read_table(f"{d}/embeddings.parquet").to_pydict()
    ids = np.array(t["vec_id"])
    x = np.array(t["embedding"], np.float64)
    got = Counter()
    for r in rows_of(spark, "op3_ann", d):
        got[r["query_id"], r["vec_id"]] = r["score"]
    hits = 0
    asked = np.nonzero(ids % 20 == 0)[0]
    for q in asked:
        score = x @ x[q]
        score[q] = -np.inf
        near = np.lexsort((ids, -score))[:20]
        hits += sum((int(ids[q]), int(ids[k])) in got for k in near)
    assert len(got) == 20 * len(asked) and hits >= 0.9 * 20 * len(asked)


def test_content_share_of_mixed_texts(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    field = quality.fit(docs, labels)
    rng = random.Random(15)
    prose_lines = "\n".join(prose(rng, 14).capitalize() + "." for _ in range(6))
    junk_lines = "\n".join(" | ".join(prose(rng, 1) for _ in range(12)) for _ in range(6))
    half = field.content_share(prose_lines + "\n" + junk_lines)
    assert 0.2 < half < 0.8
    assert field.content_share(prose_lines) > 0.9 and field.content_share(junk_lines) < 0.1
    out = quality.judge(docs, field).where("n_words >= 10 and content_share > 0 and content_share < 1")
    assert out.count() >= 300


def test_quality_on_held_out_documents(spark):
    """Learned from half of the labelled documents, judged on the others."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    field = quality.fit(docs, labels.where("crc32(cast(doc_id as string)) % 2 = 0"))
    other = labels.where("crc32(cast(doc_id as string)) % 2 = 1").select("doc_id", "quality")
    rows = quality.judge(docs, field).join(other, "doc_id").where("not base_failed").select("quality", "kept").collect()
    assert np.mean([r["kept"] for r in rows if r["quality"] == 1]) > 0.99
    assert np.mean([r["kept"] for r in rows if r["quality"] == 0]) < 0.1


def test_line_field_learns_steps():
    """Gradients agree with the likelihood: what is fitted tells alternating lines from runs."""
    rng = np.random.default_rng(4)
    runs = []
    for _ in range(200):
        y = np.repeat(rng.integers(0, 2, 4), 10)
        x = np.where(rng.random(40) < 0.75, y, 1 - y)
        runs.append(((1 + 2 * x).tolist(), y.tolist()))
    f = quality.LineField.fit(runs)
    right = np.mean([np.mean(np.array(f.labels(x)) == y) for x, y in runs])
    plain = np.mean([np.mean((np.array(x) > 1) == np.array(y)) for x, y in runs])
    assert right > plain + 0.05 and f.step[0, 0] + f.step[1, 1] > f.step[0, 1] + f.step[1, 0]


def test_quality_on_empty_tables(spark, make_docs, odd_rows):
    for rows, good in (([], []), ([], [(1, 1, 0), (2, 0, 0)]), (odd_rows, []), (odd_rows, [(5, 1, 0), (7, 0, 0), (5, 0, 1), (None, 0, 0), (3, None, None)])):
        d = make_docs(rows, ("f", "h", "y"))
        spark.createDataFrame(good, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        assert Counter(r["doc_id"] for r in rows_of(spark, "op9_quality", d)) == Counter(r[0] for r in rows)


def test_urls_on_held_out_labels(spark):
    """Trees that learned from two thirds of the URLs that rules judge, on the rest.

    The features tell the suffixes that are blocked throughout, but no language in a path, which the other rules turn on.
    """
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    held = F.pmod(F.xxhash64("u", F.lit(1)), F.lit(3)) == 0
    out = urls.judge(pages.withColumn("held", F.pmod(F.xxhash64("url", F.lit(1)), F.lit(3)) == 0), keep=("page_id", "held"), learn=~held)
    rows = out.where("held and rule is not null").select("rule", "verdict", "p_block").collect()
    bad = np.array([r["p_block"] for r in rows if r["verdict"] == "block"])
    good = np.array([r["p_block"] for r in rows if r["verdict"] == "allow"])
    assert len(bad) > 100 and len(good) > 50
    above = np.mean(bad[:, None] > good) + np.mean(bad[:, None] == good) / 2
    print("held-out URLs", len(rows), "area under the curve", above)
    assert above > 0.65
    assert all(r["p_block"] > 0.5 for r in rows if r["rule"].startswith("net/"))


def test_staging_needs_a_shared_folder(spark, monkeypatch):
    from weft import staging

    monkeypatch.setattr(staging, "on_one_machine", lambda s: False)
    if not spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        with pytest.raises(RuntimeError):
            staging.shared_dir(spark)
