"""The corpus pipeline: language, near-duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept;
``run`` writes each stage's result to the shared folder and reads it again. Stages read
the columns of documents (COLUMNS) and return these alone: a table's further columns are
left out. A null in any column, repeated rows and empty tables pass through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import language, mixing, nearcopies, pieces, secrets
from weft.staging import discard, release, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can be told; those without text or letters go."""
    docs = docs.select(*COLUMNS)
    return language.keep_known(docs, language.fit(docs, F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group whose 5-word shingles are similar by 0.8 or more: the one with the smallest doc_id.

    The SimHash trie join links the closest copies; bands find those that differ in more bits; all pairs are checked on their texts.
    """
    return nearcopies.keep_one(docs.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets masked in the text and n_chars counted anew where that changed it."""
    return secrets.redact(docs.select(*COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix draws them; rows of a source above its target may go."""
    return mixing.mixed(docs.select(*COLUMNS))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each row's text, with what they decode to as a digest."""
    keep = ("doc_id", "lang", "source", "n_chars")
    return pieces.encode(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"), keep=keep, ids=True)


STAGES = [
    ("language", known_language),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mixture", source_mix),
    ("tokens", token_ids),
]

#: SQL can express neither the fingerprints' components nor the token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
        if kept is not None:
            discard(kept)
            release(spark)
        kept = docs
    return docs
