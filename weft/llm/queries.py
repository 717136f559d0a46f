"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import ann, katz, language, mixing, pieces, quality, secrets, sharding, simhash, urls
from weft.llm.texts import remainder


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("high"),
        F.xxhash64("doc_id", F.lit(3)).alias("low"),
    )
    out = sharding.shard(docs, 16, F.col("size"), F.col("high"), F.col("low"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = language.fit(docs, ~held_out)
    return language.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), remainder(F.col("doc_id"), 7) == 2)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality.judge(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_secrets": op2_secrets,
    "op3_ann": op3_ann,
    "op4_pieces": op4_pieces,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_language": op7_language,
    "op8_katz": op8_katz,
    "op9_quality": op9_quality,
    "op10_urls": op10_urls,
}

# --- what SQL can say of them: the same operators' columns that no model decides ---

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's rows without what is drawn."""
    return op5_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def sharding_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether op6's shards hold what they must: sizes within one row of the mean, slots without gaps."""
    by = op6_sharding(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("most"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last"))
    near = F.max("bytes") - F.min("bytes") <= 2 * F.max("most")
    return by.agg(F.sum("n").alias("rows"), F.sum("bytes").alias("bytes"), F.count("*").alias("shards"), F.min((F.col("slots") == F.col("n")) & (F.col("last") == F.col("n") - 1)).alias("gapless"), near.alias("near_equal"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's rows without the field's verdict."""
    return quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), quality.LineField.none()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    )


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's rows that a rule judges, and the host and path of all."""
    return op10_urls(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2's counts of base spans."""
    return op2_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def katz_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8's base columns, with other rows held out, and words alone."""
    out = katz.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("doc_id") % 7 == 2, order=1)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


QUERIES |= {f.__name__: f for f in (mixing_targets, sharding_law, quality_counts, url_rules, secret_counts, katz_counts)}

_HOST = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)

ORACLE_SQL: dict[str, str] = {
    "mixing_targets": (
        f"WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS id FROM d GROUP BY source), "
        "w AS (SELECT *, [5.0, 2.0, 1.0][(id - 1) % 3 + 1] AS weight, 3.0 * source_size AS most FROM s), "
        "l AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(most) OVER (ORDER BY most / weight, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY most / weight, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w) "
        "SELECT doc_id, size, source_size, round(CAST(least(most, weight * (SELECT max(level) FROM l)) AS DOUBLE), 4) AS target FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source"
    ),
    "sharding_law": "SELECT count(*) AS rows, CAST(sum(coalesce(strlen(text), 0) + 1) AS BIGINT) AS bytes, 16 AS shards, true AS gapless, true AS near_equal FROM documents",
    "quality_counts": (
        f"WITH t AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents), "
        "g AS (SELECT id, k, array_to_string(w[k:k + 4], chr(31)) AS five FROM t, unnest(range(1, len(w) - 3)) AS u(k)), "
        "c AS (SELECT id, count(DISTINCT k + j) AS n FROM (SELECT id, k, count(*) OVER (PARTITION BY id, five) AS times FROM g), range(5) r(j) WHERE times > 1 GROUP BY id), "
        r"l AS (SELECT id, count(*) - count(DISTINCT line) AS n FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id), "
        "o AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, "
        "CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM t LEFT JOIN c USING (id) LEFT JOIN l USING (id)) "
        "SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM o"
    ),
    "url_rules": (
        "WITH u AS (SELECT row_number() OVER () AS id, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages), "
        f"h AS (SELECT id, page_id, {_HOST} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u), "
        f"r AS (SELECT id, h || p AS rule, v AS ruled, row_number() OVER (PARTITION BY id ORDER BY length(h || p) DESC) AS k FROM h AS x, (VALUES {_RULES}) AS q(v, h, p) WHERE (x.host = q.h OR ends_with(x.host, '.' || q.h)) AND starts_with(x.path, q.p)) "
        "SELECT page_id, host, path, rule, ruled FROM h LEFT JOIN r ON r.id = h.id AND k = 1"
    ),
    "secret_counts": (
        "WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents) SELECT doc_id, CAST(len(list_filter(regexp_extract_all(x, '((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))"
        r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda v: length(v) >= 8)) AS BIGINT) AS n_assign, """
        "CAST(len(list_filter(regexp_extract_all(x, 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 16)) AS BIGINT) AS n_access, CAST(len(list_filter(regexp_extract_all(x, '[0-9a-f]+'), lambda v: length(v) >= 32)) AS BIGINT) AS n_hex FROM t"
    ),
    "katz_counts": (
        f"WITH t AS (SELECT row_number() OVER () AS id, doc_id, doc_id % 7 = 2 AS held_out, list_append({_WORDS.replace('text', "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, '') AS w FROM documents), "
        "k AS (SELECT id, held_out, unnest(w) AS word FROM t), c AS (SELECT word, count(*) AS c FROM k WHERE NOT held_out GROUP BY word), n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c), "
        "s AS (SELECT k.id, count(*) AS n_tokens, count(c.c) AS n_known, sum(log10((coalesce(c.c, 0) + 1) / (n.n + 1 * (n.v + 1)))) AS b FROM k LEFT JOIN c USING (word), n GROUP BY k.id) "
        "SELECT doc_id, held_out, n_tokens, n_known, n.n AS train_tokens, round(b, 4) AS base_score FROM t JOIN s USING (id), n"
    ),
}
