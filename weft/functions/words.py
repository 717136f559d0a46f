"""Column functions that word results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units by language; English has one and many, Serbian one, few and many.
UNITS = {
    "en": {"commits": ("commit", "commits", "commits"), "lines": ("line", "lines", "lines")},
    "sr": {"commits": ("комит", "комита", "комитова"), "lines": ("линија", "линије", "линија")},
}


def count_word(n: Column, unit: str, language: str) -> Column:
    """The number and its unit in the form that the language asks for."""
    one, few, many = UNITS[language][unit]
    if language == "sr":
        is_one = (n % 10 == 1) & (n % 100 != 11)
        is_few = (n % 10).between(2, 4) & ~(n % 100).between(12, 14)
    else:
        is_one, is_few = n == 1, F.lit(False)
    return F.concat_ws(" ", n.cast("string"), F.when(is_one, one).when(is_few, few).otherwise(many))


def community_tag(c: Column) -> Column:
    return F.when(c.isNull(), "weft/c-none").otherwise(F.format_string("weft/c%02d", c))


def wiki(path: Column) -> Column:
    return F.concat(F.lit("[["), path, F.lit("|"), F.substring_index(path, "/", -1), F.lit("]]"))


def code(path: Column) -> Column:
    return F.concat(F.lit("`"), path, F.lit("`"))


def link_reasons(imports: Column, commits: Column, tests: Column, docs: Column, near: Column) -> Column:
    """Why two files are linked, in a fixed order; the directory only where nothing else says so.

    The wordings are fixed values. ``imports`` and ``docs`` are arrays (of import texts, of kinds), ``commits`` a count, ``tests`` and ``near`` booleans; all may be null.
    """
    said = F.concat(
        F.coalesce(imports, F.array().cast("array<string>")),
        F.filter(
            F.array(
                F.when(commits.isNotNull(), F.format_string("changed together in %d commits", commits)),
                F.when(tests, F.lit("test named after the module")),
                F.when(docs.isNotNull(), F.concat(F.lit("documentation reference ("), F.array_join(docs, ", "), F.lit(")"))),
            ),
            lambda x: x.isNotNull(),
        ),
    )
    return F.when((F.size(said) == 0) & F.coalesce(near, F.lit(False)), F.array(F.lit("same directory"))).otherwise(said)
