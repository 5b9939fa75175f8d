"""Registered split queries over V1 and their DuckDB oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import curate, splits
from tessera.plans.bindings import V1_PARAMS, v1_corpus
from tessera.plans.q_curation import _PRE


def _kept(spark, sf_dir):
    corpus = v1_corpus(spark, sf_dir)
    return curate.kept_rows(corpus, curate.annotate(corpus, V1_PARAMS))


def _repo_sizes(spark, sf_dir):
    return _kept(spark, sf_dir).groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


def q_split_by_repo_count(spark, sf_dir):
    return splits.split_by_count(_repo_sizes(spark, sf_dir), "repo").select("repo", "rank", "split")


def q_split_greedy(spark, sf_dir):
    return splits.greedy_split(_repo_sizes(spark, sf_dir), "repo", "n")


def q_split_rows(spark, sf_dir):
    sp = splits.greedy_split(_repo_sizes(spark, sf_dir), "repo", "n")
    return splits.assign_split(_kept(spark, sf_dir), sp, "repo").select("id", "repo", "split")


def q_split_sizes(spark, sf_dir):
    sp = splits.greedy_split(_repo_sizes(spark, sf_dir), "repo", "n")
    rows = splits.assign_split(_kept(spark, sf_dir), sp, "repo")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("rows"),
                                     F.count_distinct("repo").alias("repos"))


def q_validation_cut(spark, sf_dir):
    return splits.validation_cut(v1_corpus(spark, sf_dir), "path").select("id", "rank", "split")


_SIZES = _PRE + """,
kept AS (SELECT * FROM ann WHERE stage = 'kept'),
sizes AS (SELECT repo, count(*) AS n FROM kept GROUP BY repo),
ordered AS (SELECT repo, n, row_number() OVER (ORDER BY md5('42|' || repo), repo) AS i FROM sizes),
caps AS (SELECT round_even(0.8 * sum(n), 0) AS tc, round_even(0.1 * sum(n), 0) AS vc FROM sizes)
"""

_GREEDY = "WITH RECURSIVE" + _SIZES.replace("WITH v1 AS", " v1 AS", 1) + """,
walk AS (
  SELECT o.i, o.repo, o.n,
    CASE WHEN o.n <= c.tc THEN 'train' WHEN o.n <= c.vc THEN 'eval' ELSE 'test' END AS split,
    CASE WHEN o.n <= c.tc THEN o.n ELSE 0 END AS t,
    CASE WHEN o.n > c.tc AND o.n <= c.vc THEN o.n ELSE 0 END AS v
  FROM ordered o, caps c WHERE o.i = 1
  UNION ALL
  SELECT o.i, o.repo, o.n,
    CASE WHEN w.t + o.n <= c.tc THEN 'train' WHEN w.v + o.n <= c.vc THEN 'eval' ELSE 'test' END,
    CASE WHEN w.t + o.n <= c.tc THEN w.t + o.n ELSE w.t END,
    CASE WHEN w.t + o.n > c.tc AND w.v + o.n <= c.vc THEN w.v + o.n ELSE w.v END
  FROM walk w JOIN ordered o ON o.i = w.i + 1, caps c)
"""

SQL = {
    "split_by_repo_count": _SIZES + """,
rk AS (SELECT repo, i - 1 AS rank, count(*) OVER () AS total FROM ordered)
SELECT repo, rank,
  CASE WHEN rank < round_even(total * 0.8, 0) THEN 'train'
       WHEN rank < round_even(total * 0.8, 0) + round_even(total * 0.1, 0) THEN 'eval'
       ELSE 'test' END AS split
FROM rk""",
    "split_greedy": _GREEDY + "SELECT repo, n, split FROM walk",
    "split_rows": _GREEDY + "SELECT k.id, k.repo, w.split FROM kept k JOIN walk w USING (repo)",
    "split_sizes": _GREEDY + """
SELECT w.split, count(*) AS rows, count(DISTINCT k.repo) AS repos
FROM kept k JOIN walk w USING (repo) GROUP BY w.split""",
    "validation_cut": _PRE + """,
rk AS (SELECT id, row_number() OVER (ORDER BY md5('42|' || path), path) - 1 AS rank,
             count(*) OVER () AS total FROM v1)
SELECT id, rank, CASE WHEN rank < floor(total / 9) THEN 'validation' ELSE 'train' END AS split FROM rk""",
}

QUERIES = {
    "split_by_repo_count": q_split_by_repo_count,
    "split_greedy": q_split_greedy,
    "split_rows": q_split_rows,
    "split_sizes": q_split_sizes,
    "validation_cut": q_validation_cut,
}
