import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=("the", "of", "and", "tion", "ing", "her", "est", "lor", "ent", "ver", "und", "sch")):
    return " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark, tmp_path_factory):
    """Write rows of documents (extra clashing columns allowed) and give the folder."""

    def make(rows, extra=()):
        d = tmp_path_factory.mktemp("docs")
        schema = SCHEMA + "".join(f", {c} string" for c in extra)
        spark.createDataFrame([(*r, *("x" for _ in extra)) for r in rows], schema).repartition(3).write.parquet(f"{d}/documents.parquet")
        return str(d)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty, blank and long texts, ties and repeated rows."""
    import random

    rng = random.Random(3)
    long = prose(rng, 30_000)
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, "b", 3), (None, "one two three four", "de", None, 18),
        (None, "one two three four", "de", None, 18), (5, "word", "en", "a", 4), (5, "word", "en", "a", 4), (6, "word", "fr", "b", 4),
        (7, long, "en", "c", len(long)), (8, "123 456 !!", "en", "c", 10), (9, "éé ñ 中文 😀 ▁x", "fr", None, 11), (10, None, None, None, None),
        (11, "Ab\x0bC\x0cd e f  g", "es", "a", 12),
    ]
    rows += [(100 + k, prose(rng, rng.randint(3, 60)), rng.choice(["en", "de", "fr", "es"]), rng.choice("abc"), 1) for k in range(60)]
    return rows
