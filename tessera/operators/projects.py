"""Project/version bookkeeping and source-file selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Project versions excluded from the study.
EXCLUDED_VERSIONS = ("cli_6", "lang_2")


def version_ranges(max_versions: DataFrame, project: str = "project", n: str = "max_version",
                   excluded: Sequence[str] = EXCLUDED_VERSIONS) -> DataFrame:
    """Versions ``1..n`` per project minus the exclusion list."""
    spark = max_versions.sparkSession
    ex = spark.createDataFrame([(v,) for v in excluded], "revision string")
    v = max_versions.select(F.col(project).alias("project"),
                            F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))).alias("version"))
    v = v.withColumn("revision", F.concat(F.col("project"), F.lit("_"), F.col("version").cast("string")))
    return v.join(F.broadcast(ex), "revision", "left_anti")


def leaf_dir(path: Column) -> Column:
    """name of the folder holding the file; NULL for a bare file name."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def stem(path: Column) -> Column:
    """file name without its extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def package_path(package: Column) -> Column:
    """``a.b.c`` -> ``a/b/c``."""
    return F.replace(package, F.lit("."), F.lit("/"))


def is_main_source(path: Column, roots: Sequence[str] = ("src/main/java", "src/java", "source/org/jfree")) -> Column:
    """A ``.java`` file under one of the source roots, not ``package-info.java``."""
    under = F.lit(False)
    for r in roots:
        under = under | path.contains(r)
    return path.endswith(".java") & ~path.endswith("package-info.java") & under


def _runs(parts: Column, length: Column) -> Column:
    """All runs of ``length`` items in a row, each joined by ``/``."""
    starts = F.when(F.size(parts) >= length, F.sequence(F.lit(1), F.size(parts) - length + 1)).otherwise(F.array())
    return F.transform(starts.cast("array<int>"), lambda i: F.array_join(F.slice(parts, i, length), "/"))


def match_classes_to_files(classes: DataFrame, files: DataFrame, cls: str = "class_name",
                           pkg: str = "package", path: str = "path") -> DataFrame:
    """Changed classes joined to source files by file name, keeping files
    whose folder contains the package path.

    The join key holds the file name and what of the package path must stand in
    the folder whole: the names between its first and last (those two may be
    parts of longer names), or, for paths of one or two names, the path itself,
    looked up among the folder's substrings of that length. So files of one
    common name meet only the classes whose packages fit their folders. Folders
    are expanded for the lengths that the classes have; ``contains`` decides.
    """
    c = classes.withColumn("_file", F.concat(F.col(cls), F.lit(".java"))).withColumn("_pkg", package_path(F.col(pkg)))
    names = F.split("_pkg", "/")
    inner = F.size(names) - 2
    c = c.withColumn("_n", F.when(inner > 0, inner).otherwise(-F.length("_pkg")))
    c = c.withColumn("_key", F.when(inner > 0, F.array_join(F.slice(names, 2, F.greatest(inner, F.lit(0))), "/"))
                     .otherwise(F.col("_pkg")))
    lengths = c.select("_file", "_n").distinct()
    f = files.withColumn("_file", F.element_at(F.split(F.col(path), "/"), -1)) \
        .withColumn("_dir", F.regexp_extract(F.col(path), r"^(.*)/[^/]*$", 1))
    f = f.join(lengths, "_file")
    width, size = -F.col("_n"), F.length("_dir")
    starts = F.when(size >= width, F.sequence(F.lit(1), size - width + 1)).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(starts, lambda i: F.substring("_dir", i, width))
    keys = F.when(F.col("_n") > 0, _runs(F.split("_dir", "/"), F.col("_n"))).otherwise(pieces)
    f = f.withColumn("_key", F.explode(F.array_distinct(keys)))
    j = c.join(f, ["_file", "_n", "_key"])
    return j.filter(F.col("_dir").contains(F.col("_pkg"))).drop("_file", "_dir", "_n", "_key", "_pkg")


def pick_test_dir(dirs: DataFrame, key: str, package: str, dir_col: str = "dir",
                  order: str = "walk_order") -> DataFrame:
    """Per key, the last (in walk order) test folder ending with the
    package path and outside build outputs; a path with ``gson`` in it must lie
    under ``gson/src/test/`` and only ``target`` is an output there."""
    d = F.col(dir_col)
    plain = d.contains("test") & ~d.contains("test-classes") & ~d.contains("target") & ~d.contains("build")
    gson = d.contains("gson/src/test/") & ~d.contains("target")
    ok = F.when(d.contains("gson"), gson).otherwise(plain)
    return dirs.filter(d.endswith(package_path(F.col(package))) & ok).groupBy(key).agg(F.max_by(d, F.col(order)).alias(dir_col))
