"""Python module names of files, and what file a module name means.

Package directories need no loop: a directory of code is a package if it or a
directory above it has an ``__init__.py``, as all directories between hold code too.
The top directory is never a package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import paths


def package_dirs(files: DataFrame) -> DataFrame:
    """(dir): directories that Python imports as packages. ``files`` has the paths of Python files."""
    regular = files.where(paths.name(F.col("path")) == "__init__.py").select(paths.parent(F.col("path")).alias("dir")).distinct()
    code = files.select(F.explode(paths.ancestors(F.col("path"))).alias("dir")).where("dir <> '.'").distinct()
    above = code.select("dir", F.explode(F.concat(F.array("dir"), paths.ancestors(F.col("dir")))).alias("up"))
    nested = above.join(regular.withColumnRenamed("dir", "up"), "up", "left_semi").where("up <> '.'").select("dir")
    return nested.union(regular.where("dir <> '.'")).distinct()


def module_names(files: DataFrame) -> DataFrame:
    """(path, module): dotted name from the topmost package that holds the file; a script's is its stem."""
    packages = package_dirs(files).withColumn("is_package", F.lit(True))
    up = files.select("path", F.posexplode(paths.ancestors(F.col("path"))).alias("n", "dir"))
    known = up.join(packages, "dir", "left").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("n", "dir", F.coalesce("is_package", F.lit(False)).alias("p")))).alias("up"))
    outside = F.array_position(F.transform("up", lambda u: u["p"]), False)  # the top is never a package, so there is one
    inside = F.reverse(F.transform(F.slice("up", F.lit(1), (outside - 1).cast("int")), lambda u: paths.name(u["dir"])))
    init = paths.name(F.col("path")) == "__init__.py"
    parts = F.when(init, inside).otherwise(F.array_append(inside, paths.stem(F.col("path"))))
    name = F.when(F.size(parts) > 0, F.array_join(parts, ".")).otherwise(paths.name(paths.parent(F.col("path"))))
    return known.select("path", name.alias("module"))


def absolute(module: Column, level: Column, importer_module: Column, is_init: Column) -> Column:
    """Absolute dotted name of a ``from`` import that may be relative."""
    base = F.split(F.coalesce(importer_module, F.lit("")), r"\.")
    base = F.when(is_init, base).otherwise(F.slice(base, F.lit(1), F.greatest(F.size(base) - 1, F.lit(0))))
    base = F.slice(base, F.lit(1), F.greatest(F.size(base) - F.greatest(level - 1, F.lit(0)), F.lit(0)))
    own = F.filter(F.array(module), lambda x: x.isNotNull() & (x != ""))
    return F.when(level == 0, F.coalesce(module, F.lit(""))).otherwise(F.array_join(F.concat(base, own), "."))


def prefixes(name: Column) -> Column:
    """All dotted prefixes with their number of parts."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, F.lit(1), n), ".").alias("prefix")))


def index(modules: DataFrame) -> DataFrame:
    """(prefix, target, exact): the first path of each full name, and of each suffix that one file alone has."""
    full = modules.groupBy(F.col("module").alias("prefix")).agg(F.min("path").alias("target")).withColumn("exact", F.lit(1))
    parts = F.split("module", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "."))
    alone = modules.select("path", F.explode(ends).alias("prefix")).groupBy("prefix").agg(F.min("path").alias("target"), F.max("path").alias("last")).where("target = last")
    return full.unionByName(alone.select("prefix", "target", F.lit(0).alias("exact")))


def resolve(names: DataFrame, modules: DataFrame, packages: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    """``names`` (name, importer; null: none) with target: a sibling of a script, else the longest prefix that is known.

    At equal length a full name is before a suffix. ``own`` replaces ``index(modules)`` where it is at hand.
    """
    keys = names.select("name", "importer").distinct()
    table = own if own is not None else index(modules)
    tried = keys.select("name").distinct().where("name <> ''").select("name", F.explode(prefixes(F.col("name"))).alias("p")).select("name", "p.n", "p.prefix")
    best = tried.join(table, "prefix").groupBy("name").agg(F.max_by("target", F.struct("n", "exact")).alias("known"))
    out = keys.join(best, "name", "left")
    if packages is not None:
        first = F.substring_index("name", ".", 1)
        here = paths.parent(F.col("importer"))
        near = F.when(here == ".", first).otherwise(F.concat_ws("/", here, first))
        asked = keys.where("importer is not null").select("name", "importer", here.alias("dir"), near.alias("near")).join(packages, "dir", "left_anti")
        options = asked.select("name", "importer", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.concat("near", F.lit(".py")).alias("path")), F.struct(F.lit(1).alias("o"), F.concat("near", F.lit("/__init__.py")).alias("path")))).alias("x"))
        sibling = options.select("name", "importer", "x.o", "x.path").join(modules.select("path"), "path").groupBy("name", "importer").agg(F.min_by("path", "o").alias("sibling"))
        out = out.join(sibling, ["name", "importer"], "left").withColumn("known", F.coalesce("sibling", "known"))
    return out.select("name", "importer", F.col("known").alias("target"))
