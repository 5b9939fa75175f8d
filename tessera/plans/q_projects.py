"""Registered project/file-selection queries (V3, V9) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import projects as pj
from tessera.operators.results import project_of
from tessera.plans.bindings import v3_results, v9_files
from tessera.plans.sqlbind import V3, V9_FILES


def q_version_ranges(spark, sf_dir):
    r = v3_results(spark, sf_dir)
    mx = r.withColumn("project", project_of(F.col("revision"))).filter(F.col("project") != "") \
        .groupBy("project").agg(F.max(F.split_part("revision", F.lit("_"), F.lit(2)).cast("int") + 1)
                                .alias("max_version"))
    return pj.version_ranges(mx).select("project", F.col("version").cast("long").alias("version"), "revision")


def q_path_parts(spark, sf_dir):
    f = v9_files(spark, sf_dir)
    p = F.col("path")
    return f.select("page_id", pj.leaf_dir(p).alias("leaf"), pj.stem(p).alias("stem"),
                    F.element_at(F.split("package", r"\."), -1).alias("last_part"),
                    pj.package_path(F.col("package")).alias("package_path"))


def q_main_sources(spark, sf_dir):
    f = v9_files(spark, sf_dir)
    return f.filter(pj.is_main_source(F.col("path"))).select("page_id", "path")


def q_changed_class_files(spark, sf_dir):
    f = v9_files(spark, sf_dir)
    classes = f.filter("changed").select("class_name", "package").distinct()
    files = f.filter(pj.is_main_source(F.col("path"))).select("path")
    return pj.match_classes_to_files(classes, files).select("class_name", "package", "path")


def q_test_dir_selection(spark, sf_dir):
    f = v9_files(spark, sf_dir)
    # every sixth page belongs to a gson tree, every ninth to a build output
    path = F.concat(F.when(F.col("page_id") % 9 == 2, "build/").otherwise(""),
                    F.when(F.col("page_id") % 6 == 5, "gson/").otherwise(""), F.col("path"))
    dirs = f.select(F.concat_ws(":", "package", (F.col("page_id") % 12).cast("string")).alias("class_key"), "package",
                    F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("dir"), path.alias("walk_order"))
    return pj.pick_test_dir(dirs, "class_key", "package")


SQL = {
    "version_ranges": f"""WITH v3 AS ({V3}),
k AS (SELECT split_part(revision, '_', 1) AS project, CAST(split_part(revision, '_', 2) AS INTEGER) AS v
      FROM v3 WHERE strpos(revision, '_') > 0),
mx AS (SELECT project, max(v) + 1 AS m FROM k GROUP BY project),
r AS (SELECT project, unnest(range(1, m + 1)) AS version FROM mx)
SELECT project, CAST(version AS BIGINT) AS version, project || '_' || CAST(version AS VARCHAR) AS revision FROM r
WHERE project || '_' || CAST(version AS VARCHAR) NOT IN ('cli_6', 'lang_2')""",
    "path_parts": f"""WITH f AS ({V9_FILES})
SELECT page_id, string_split(path, '/')[-2] AS leaf, regexp_extract(path, '([^/]+?)(\\.[^./]*)?$', 1) AS stem,
       string_split(package, '.')[-1] AS last_part, replace(package, '.', '/') AS package_path FROM f""",
    "main_sources": f"""WITH f AS ({V9_FILES})
SELECT page_id, path FROM f WHERE ends_with(path, '.java') AND NOT ends_with(path, 'package-info.java')
  AND (contains(path, 'src/main/java') OR contains(path, 'src/java') OR contains(path, 'source/org/jfree'))""",
    "changed_class_files": f"""WITH f AS ({V9_FILES}),
c AS (SELECT DISTINCT class_name, package FROM f WHERE changed),
s AS (SELECT path FROM f WHERE ends_with(path, '.java') AND NOT ends_with(path, 'package-info.java')
        AND (contains(path, 'src/main/java') OR contains(path, 'src/java') OR contains(path, 'source/org/jfree')))
SELECT c.class_name, c.package, s.path FROM c JOIN s
  ON string_split(s.path, '/')[-1] = c.class_name || '.java'
 AND contains(regexp_extract(s.path, '^(.*)/[^/]*$', 1), replace(c.package, '.', '/'))""",
    "test_dir_selection": f"""WITH f AS ({V9_FILES}),
p AS (SELECT package, package || ':' || CAST(page_id % 12 AS VARCHAR) AS class_key,
        CASE WHEN page_id % 9 = 2 THEN 'build/' ELSE '' END || CASE WHEN page_id % 6 = 5 THEN 'gson/' ELSE '' END || path AS path
      FROM f),
d AS (SELECT package, class_key, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, path AS walk_order FROM p)
SELECT class_key, arg_max(dir, walk_order) AS dir FROM d
WHERE ends_with(dir, replace(package, '.', '/')) AND NOT contains(dir, 'target')
  AND CASE WHEN contains(dir, 'gson') THEN contains(dir, 'gson/src/test/')
           ELSE contains(dir, 'test') AND NOT contains(dir, 'test-classes') AND NOT contains(dir, 'build') END
GROUP BY class_key""",
}

QUERIES = {
    "version_ranges": q_version_ranges,
    "path_parts": q_path_parts,
    "main_sources": q_main_sources,
    "changed_class_files": q_changed_class_files,
    "test_dir_selection": q_test_dir_selection,
}
