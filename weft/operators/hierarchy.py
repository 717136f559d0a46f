"""The directory tree, and tests paired with what they are named after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import paths


def containment(files: DataFrame) -> DataFrame:
    """(child, parent) once for each file and each directory below the top; directories are ``dir:`` ids."""
    up = paths.ancestors(F.col("path"))
    chain = F.concat(F.array(F.col("path")), F.transform(up, lambda d: paths.dir_id(d)))
    steps = F.transform(F.sequence(F.lit(1), F.size(chain) - 1), lambda k: F.struct(F.element_at(chain, k).alias("child"), F.element_at(chain, k + 1).alias("parent")))
    return files.select(F.explode(steps).alias("s")).select("s.child", "s.parent").distinct()


def test_pairs(files: DataFrame) -> DataFrame:
    """(test, module): each test file with the module of its language and stem that shares most leading parts; ties to the first path.

    ``files`` has path, lang and is_test. Leading underscores of stems don't count; a test without a stem looks for an empty one.
    """
    bare = lambda c: F.regexp_replace(c, "^_+", "")
    module = files.where("not is_test").select(F.col("path").alias("module"), "lang", bare(paths.stem(F.col("path"))).alias("stem"))
    test = files.where("is_test").select(F.col("path").alias("test"), "lang", bare(F.coalesce(paths.tested_stem(F.col("path")), F.lit(""))).alias("stem"))
    near = paths.shared_prefix(F.col("module"), F.col("test"))
    return test.join(module, ["stem", "lang"]).groupBy("test").agg(F.min_by("module", F.struct(-near, "module")).alias("module"))
