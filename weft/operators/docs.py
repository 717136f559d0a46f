"""References from prose to files: links, roles, directives and inline code."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import paths
from weft.operators import modules as M

#: The forms of a reference. Python's patterns, as \w is to be Unicode.
LINK = re.compile(r"!?\[[^\]]*\]\(\s*<?([^)\s>]+)>?(?:\s+\"[^\"]*\")?\s*\)")
ROLE = re.compile(r":(?:py:)?(?:mod|class|func|meth|attr|exc|data|obj|doc):`~?!?([^`<]+?)(?:\s*<([^>]+)>)?`")
DIRECTIVE = re.compile(r"^\s*\.\.\s+(automodule|autoclass|autofunction|currentmodule|module|literalinclude|include)::\s*(\S+)", re.MULTILINE)
INLINE = re.compile(r"``?([A-Za-z_][\w./-]*[\w])``?")
DOTTED = re.compile(r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*)+$")
FILE_DIRECTIVES = ("literalinclude", "include")


def _raw(text: str) -> list[tuple[str, str, bool, bool]]:
    """(kind, target, as a path, as a module) of each reference."""
    rows = [("link", t, True, False) for t in LINK.findall(text)]
    rows += [("role", explicit or title, True, True) for title, explicit in ROLE.findall(text)]
    rows += [("directive", t, d in FILE_DIRECTIVES, d not in FILE_DIRECTIVES) for d, t in DIRECTIVE.findall(text)]
    return rows + [("mention", t, True, True) for t in INLINE.findall(text)]


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for p, t in zip(batch["path"], batch["text"], strict=True):
            for k, (kind, target, as_path, as_module) in enumerate(_raw(t or "")):
                name = target.strip().lstrip("~!.")
                rows.append((p, k, kind, target, as_path, name if as_module else None, bool(DOTTED.match(name))))
        yield pd.DataFrame(rows, columns=["doc", "ord", "kind", "target", "as_path", "name", "dotted"])


def target_path(target: Column, doc: Column) -> Column:
    """Project path that a link's target means; null for other sites and mail. Behind # and ? nothing counts."""
    t = F.substring_index(F.substring_index(target, "#", 1), "?", 1)
    from_top = paths.normalized(F.regexp_replace(t, "^/+", ""))
    near = paths.normalized(F.concat_ws("/", paths.parent(doc), t))
    return F.when((t == "") | F.contains(t, F.lit("://")) | t.startswith("mailto:"), None).when(t.startswith("/"), from_top).otherwise(near)


def references(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(doc, ord, kind, target) from ``docs`` (path, text); ``files`` has path and lang of the whole project."""
    raw = docs.select("path", "text").mapInPandas(_extract, "doc string, ord bigint, kind string, target string, as_path boolean, name string, dotted boolean")
    raw = raw.withColumn("rel", F.when(F.col("as_path"), target_path(F.col("target"), F.col("doc"))))
    known = files.select(F.col("path").alias("rel"), F.col("path").alias("p1")).distinct()
    bare = F.substring("path", F.lit(1), F.length("path") - F.length(paths.suffix(F.col("path"))))
    by_stem = files.where(F.col("lang").isin(*paths.DOC_LANGUAGES)).groupBy(bare.alias("rel")).agg(F.min("path").alias("p2"))
    whole = files.select(F.col("path").alias("target"), F.col("path").alias("p3")).distinct()
    modules = M.module_names(files.where("lang = 'python'").select("path").distinct())
    exact = modules.select(F.col("module").alias("name"), F.lit(True).alias("exact")).distinct()
    raw = raw.join(exact, "name", "left").withColumn("asked", F.when(F.col("dotted") | F.col("exact"), F.col("name")))
    found = M.resolve(raw.where("asked is not null").select(F.col("asked").alias("name"), F.lit(None).cast("string").alias("importer")), modules)
    out = raw.join(known, "rel", "left").join(by_stem, "rel", "left").join(whole, "target", "left").join(found.select(F.col("name").alias("asked"), F.col("target").alias("p4")), "asked", "left")
    hit = F.coalesce("p1", "p2", F.when(F.col("kind") == "mention", F.col("p3")), "p4")
    return out.select("doc", "ord", "kind", hit.alias("target")).where("target is not null and target <> doc")


def docs_parts(refs: DataFrame) -> DataFrame:
    """Edge contributions: a link weighs 1, anything else 0.5, however often it occurs."""
    by = refs.groupBy("doc", "target", "kind").agg(F.count("*").alias("mentions"), F.min("ord").alias("seq"))
    weight = F.when(F.col("kind") == "link", 1.0).otherwise(0.5)
    return by.select(F.lit("docs").alias("layer"), F.col("doc").alias("u"), F.col("target").alias("v"), weight.alias("weight"), "kind", "seq", "mentions")
