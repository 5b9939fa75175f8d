"""Registered curation queries (V1) and their DuckDB oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import curate
from tessera.plans.bindings import V1_PARAMS, v1_corpus
from tessera.plans.sqlbind import V1, toks

P = V1_PARAMS


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.annotate(v1_corpus(spark, sf_dir), P)


def q_curation_stages(spark, sf_dir):
    return _annotated(spark, sf_dir)


def q_curation_funnel(spark, sf_dir):
    return curate.funnel(_annotated(spark, sf_dir))


def q_curation_repo_policy(spark, sf_dir):
    a = _annotated(spark, sf_dir)
    surv = a.filter(F.col("stage").isin("under", "over", "kept"))
    return curate.repo_policy(surv, P).select(
        "repo", F.col("survivors").cast("long").alias("survivors"), "decision")


def q_curation_kept_rows(spark, sf_dir):
    corpus = v1_corpus(spark, sf_dir)
    kept = curate.kept_rows(corpus, curate.annotate(corpus, P))
    return kept.select("id", "repo", "path", "target")


def q_curation_audit(spark, sf_dir):
    return curate.audit(_annotated(spark, sf_dir), P)


def q_curation_manifest(spark, sf_dir):
    m = curate.manifest(_annotated(spark, sf_dir))
    return m.select("repo", F.size("paths").cast("long").alias("n_paths"),
                    F.array_join("paths", ",").alias("paths"))


def q_dedup_first_copy(spark, sf_dir):
    d = curate.dedup_keep_first(v1_corpus(spark, sf_dir))
    return d.select("id", "path")


def q_shape_filter(spark, sf_dir):
    from tessera.functions.text import shape_ok
    c = v1_corpus(spark, sf_dir)
    return c.filter(shape_ok(F.col("target"), P.prefix, P.open_, P.close, P.follow, P.offset)) \
        .select("id", "path")


def q_token_length_filter(spark, sf_dir):
    from tessera.functions.text import token_count
    c = v1_corpus(spark, sf_dir)
    nt = token_count("target", P.token_pattern, P.specials)
    ns = token_count("src", P.token_pattern, P.specials)
    return c.filter(nt.between(P.target_min, P.target_max - 1)
                    & ns.between(P.src_min, P.src_max - 1)) \
        .select("id", nt.cast("long").alias("target_tokens"), ns.cast("long").alias("src_tokens"))


def q_filter_reason(spark, sf_dir):
    c = v1_corpus(spark, sf_dir)
    return c.select("id", curate.filter_reason(F.col("target"), F.col("src"), P).alias("reason"))


# ---------------------------------------------------------------------------
# Oracle SQL
# ---------------------------------------------------------------------------

_PRE = f"""
WITH v1 AS ({V1}),
r AS (
  SELECT *, (src IS NOT NULL AND src <> '') AS ne,
         len({toks('target')}) + 2 AS nt, len({toks('src')}) + 2 AS ns,
         strpos(target, ',') AS p1
  FROM v1),
r2 AS (SELECT *, CASE WHEN p1 > 0 THEN instr(substr(target, p1), '.') ELSE 0 END AS rel FROM r),
r3 AS (SELECT *, CASE WHEN rel > 0 THEN p1 + rel - 1 ELSE 0 END AS p2 FROM r2),
r4 AS (
  SELECT *,
    (p1 > 0 AND p2 > 0 AND p2 + 1 <= length(target) AND substr(target, p2 + 1, 1) = ' ') AS shape_ok,
    (nt >= 16 AND nt < 512 AND ns >= 64 AND ns < 2048) AS len_ok
  FROM r3),
reason AS (
  SELECT *, CASE WHEN NOT shape_ok THEN 'construct' WHEN NOT coalesce(len_ok, false) THEN 'token_length' END AS reason
  FROM r4),
firsts AS (SELECT min(path) AS fp FROM reason WHERE ne GROUP BY src),
pre AS (
  SELECT repo, path, id, target,
    CASE WHEN NOT ne THEN 'empty'
         WHEN path NOT IN (SELECT fp FROM firsts) THEN 'dedup'
         ELSE reason END AS stage
  FROM reason),
pol AS (SELECT repo, count(*) AS n FROM pre WHERE stage IS NULL GROUP BY repo),
samp AS (
  SELECT path, row_number() OVER (PARTITION BY repo ORDER BY md5('42|' || path), path) AS rk
  FROM pre WHERE stage IS NULL),
ann AS (
  SELECT pre.repo, pre.path, pre.id, pre.target,
    coalesce(stage, CASE WHEN pol.n < 12 THEN 'under'
                         WHEN pol.n >= 18 AND samp.rk > 18 THEN 'over'
                         ELSE 'kept' END) AS stage
  FROM pre LEFT JOIN pol USING (repo) LEFT JOIN samp USING (path))
"""

SQL = {
    "curation_stages": _PRE + "SELECT repo, path, stage FROM ann",
    "curation_funnel": _PRE + """
SELECT count(*) AS total_data_number,
       count_if(stage = 'empty') AS reduce_by_empty,
       count_if(stage = 'token_length') AS reduce_by_token_length,
       count_if(stage = 'construct') AS reduce_by_construct,
       count_if(stage = 'dedup') AS reduce_by_dedup,
       count_if(stage = 'under') AS reduce_by_under_threshold,
       count_if(stage = 'over') AS reduce_by_over_threshold,
       count_if(stage = 'kept') AS rest_number
FROM ann""",
    "curation_repo_policy": _PRE + """
SELECT repo, count(*) AS survivors,
       CASE WHEN count(*) < 12 THEN 'under' WHEN count(*) >= 18 THEN 'over' ELSE 'keep' END AS decision
FROM ann WHERE stage IN ('under', 'over', 'kept') GROUP BY repo""",
    "curation_kept_rows": _PRE + "SELECT id, repo, path, target FROM ann WHERE stage = 'kept'",
    "curation_audit": _PRE + """
SELECT repo AS dir,
       CASE WHEN count_if(stage = 'under') > 0 THEN 'under 12' ELSE 'over 18' END AS reason
FROM ann WHERE stage IN ('under', 'over', 'kept') GROUP BY repo
HAVING count_if(stage = 'under') > 0 OR count(*) >= 18""",
    "curation_manifest": _PRE + """
SELECT repo, count(*) AS n_paths, string_agg(path, ',' ORDER BY path) AS paths
FROM ann WHERE stage = 'kept' GROUP BY repo""",
    "dedup_first_copy": _PRE + "SELECT id, path FROM reason WHERE ne AND path IN (SELECT fp FROM firsts)",
    "shape_filter": _PRE + "SELECT id, path FROM reason WHERE shape_ok",
    "token_length_filter": _PRE + """
SELECT id, nt AS target_tokens, ns AS src_tokens FROM reason
WHERE nt >= 16 AND nt < 512 AND ns >= 64 AND ns < 2048""",
    "filter_reason": _PRE + "SELECT id, reason FROM reason",
}

QUERIES = {
    "curation_stages": q_curation_stages,
    "curation_funnel": q_curation_funnel,
    "curation_repo_policy": q_curation_repo_policy,
    "curation_kept_rows": q_curation_kept_rows,
    "curation_audit": q_curation_audit,
    "curation_manifest": q_curation_manifest,
    "dedup_first_copy": q_dedup_first_copy,
    "shape_filter": q_shape_filter,
    "token_length_filter": q_token_length_filter,
    "filter_reason": q_filter_reason,
}
