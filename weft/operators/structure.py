"""Imports between files of a project: Python by its syntax tree, JavaScript by specifiers."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import paths
from weft.operators import modules as M

MOST_SYMBOLS = 12
#: Import, export and require forms, and the suffixes tried for a specifier.
JS_SPECIFIER = re.compile(
    r"""(?:\bimport\s+(?:[\w*{}\s,$]+\s+from\s+)?|\bexport\s+[\w*{}\s,$]+\s+from\s+|\brequire\s*\(\s*|\bimport\s*\(\s*)['"]([^'"]+)['"]"""
)
JS_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")


def python_statements(source: str) -> list[tuple[int, str, str | None, int, str]]:
    """(ord, kind, module, level, name) of each imported name; nothing from source that doesn't parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    rows: list[tuple[int, str, str | None, int, str]] = []
    for node in ast.walk(tree):
        match node:
            case ast.Import(names=names):
                rows += [(len(rows) + k, "import", a.name, 0, a.name) for k, a in enumerate(names)]
            case ast.ImportFrom(module=module, level=level, names=names):
                rows += [(len(rows) + k, "from", module, level, a.name) for k, a in enumerate(names)]
    return rows


def _statements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(p, *r) for p, t in zip(batch["path"], batch["text"], strict=True) for r in python_statements(t or "")]
        yield pd.DataFrame(rows, columns=["importer", "ord", "kind", "module", "level", "name"])


def _specifiers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(p, k, s) for p, t in zip(batch["path"], batch["text"], strict=True) for k, s in enumerate(JS_SPECIFIER.findall(t or "")) if s.startswith(".")]
        yield pd.DataFrame(rows, columns=["importer", "ord", "spec"])


def python_imports(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(importer, target, symbols) from Python ``sources`` (path, text); ``files`` has the paths of all Python files."""
    modules = M.module_names(files.select("path").distinct())
    packages, table = M.package_dirs(files), M.index(modules)
    raw = sources.select("path", "text").mapInPandas(_statements, "importer string, ord bigint, kind string, module string, level int, name string")
    own = modules.select(F.col("path").alias("importer"), F.col("module").alias("own"))
    init = paths.name(F.col("importer")) == "__init__.py"
    base = F.when(F.col("kind") == "import", F.col("module")).otherwise(M.absolute(F.col("module"), F.col("level"), F.col("own"), init))
    rows = raw.join(own, "importer", "left").withColumn("base", base)
    sub = F.when((F.col("kind") == "from") & (F.col("base") != ""), F.concat_ws(".", "base", "name"))
    rows = rows.withColumn("sub", sub).withColumn("who", F.when((F.col("kind") == "import") | (F.col("level") == 0), F.col("importer")))
    full = modules.groupBy(F.col("module").alias("sub")).agg(F.min("path").alias("by_sub"))
    found = M.resolve(rows.select(F.col("base").alias("name"), F.col("who").alias("importer")), modules, packages, table)
    found = found.select(F.col("name").alias("base"), F.col("importer").alias("who"), F.col("target").alias("by_base"))
    same = (rows["base"] == found["base"]) & rows["who"].eqNullSafe(found["who"])
    hit = rows.join(found, same, "left").drop(found["base"]).drop(found["who"]).join(full, "sub", "left").withColumn("target", F.coalesce("by_sub", "by_base"))
    hit = hit.where("target is not null and target <> importer")
    first = hit.groupBy("importer", "target", "name").agg(F.min("ord").alias("ord"))
    named = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ord", "name"))), 1, MOST_SYMBOLS), lambda s: s["name"])
    return first.groupBy("importer", "target").agg(named.alias("symbols"))


def javascript_imports(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(importer, ord, target), one row for each relative specifier that leads to a file of the project."""
    raw = sources.select("path", "text").mapInPandas(_specifiers, "importer string, ord bigint, spec string")
    here = paths.parent(F.col("importer"))
    stem = paths.normalized(F.concat_ws("/", here, "spec"))
    tails = ["", *JS_SUFFIXES, *(f"/index{s}" for s in JS_SUFFIXES)]
    tried = raw.select("importer", "ord", F.posexplode(F.transform(F.array(*map(F.lit, tails)), lambda t: F.concat(stem, t))).alias("n", "path"))
    known = files.select("path").distinct()
    return tried.join(known, "path").where("path <> importer").groupBy("importer", "ord").agg(F.min_by("path", "n").alias("target"))


def structure_parts(python: DataFrame, javascript: DataFrame) -> DataFrame:
    """Edge contributions: one for each pair of Python files, one for each JavaScript import."""
    said = F.array(F.concat_ws(" -> ", "importer", "target"))
    both = python.select("importer", "target", "symbols", F.lit(0).alias("ord")).unionByName(javascript.select("importer", "target", F.lit(None).cast("array<string>").alias("symbols"), "ord"))
    return both.select(
        F.lit("structure").alias("layer"), F.col("importer").alias("u"), F.col("target").alias("v"), F.lit(1.0).alias("weight"), F.lit("import").alias("kind"),
        F.row_number().over(_by_importer()).cast("bigint").alias("seq"), said.alias("imports"), "symbols",
    )


def _by_importer():
    from pyspark.sql import Window as W

    # Order matters only within an edge, whose contributions come from its two ends.
    return W.partitionBy(F.least("importer", "target"), F.greatest("importer", "target")).orderBy("importer", "ord", "target")
