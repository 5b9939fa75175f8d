"""Registered run-result queries over V3/V8 and their DuckDB oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import results as rs
from tessera.plans.bindings import PROJECTS, v3_results, v8_tool_logs
from tessera.plans.sqlbind import V3, V8_LOGS

_COUNTS = ["correct", "pass", "te", "ce", "se"]


def q_run_classifier(spark, sf_dir):
    logs = v8_tool_logs(spark, sf_dir)
    return logs.select("event_id", rs.classify_run(
        F.col("exit_code"), F.col("stdout"), F.col("code"), F.col("coverage_exit"), F.col("coverage_stdout")).alias("result"))


def q_markdown_document(spark, sf_dir):
    """Heading, text, the table of the models and a code cell with the run that came last."""
    results = v3_results(spark, sf_dir)
    summary = rs.per_model(results).select("model", "pass", "total")
    table = rs.markdown_table(summary, ["model", "pass", "total"], ["total", "model"])
    rows = results.agg(F.count(F.lit(1)).alias("n"), F.max_by("revision", "event_id").alias("last"))
    return rs.markdown_document([
        rows.select(rs.markdown_heading(F.lit("Results"), 2).alias("report")),
        rows.select(rs.markdown_text(F.concat(F.col("n").cast("string"), F.lit(" runs"))).alias("report")),
        table, rows.select(rs.markdown_code(F.col("last"), "text").alias("report"))])


def q_results_per_model(spark, sf_dir):
    return rs.with_percentages(rs.per_model(v3_results(spark, sf_dir)))


def q_results_per_project(spark, sf_dir):
    return rs.with_percentages(rs.per_project(v3_results(spark, sf_dir), PROJECTS)).drop("pos")


def q_results_markdown(spark, sf_dir):
    return rs.markdown_report(rs.per_model(v3_results(spark, sf_dir)), "model")


def q_project_markdown(spark, sf_dir):
    return rs.markdown_report(rs.per_project(v3_results(spark, sf_dir), PROJECTS), "project", "pos")


def q_bug_detection(spark, sf_dir):
    return rs.detect(v3_results(spark, sf_dir))


def q_env_elapsed(spark, sf_dir):
    r = v3_results(spark, sf_dir).withColumn("project", rs.project_of(F.col("revision")))
    j = r.join(v8_tool_logs(spark, sf_dir), "event_id")
    return rs.elapsed_and_verdict(j, "project", "ts", "stdout")


_COUNT_SQL = """
  count_if(result = 'CORRECT') AS correct,
  count_if(result IN ('CORRECT', 'PASS')) AS pass,
  count_if(result = 'TE') AS te, count_if(result = 'CE') AS ce, count_if(result = 'SE') AS se,
  count(*) AS total"""

_PCT_SQL = ", ".join(
    f"printf('%.2f%%', CASE WHEN total > 0 THEN {c} * 100.0 / total ELSE 0.0 END) AS {c}_pct"
    for c in _COUNTS)

_PROJ_SQL = f"""
WITH v3 AS ({V3}),
dim AS (SELECT * FROM (VALUES ('chart', 0), ('cli', 1), ('csv', 2), ('gson', 3), ('lang', 4)) t(project, pos)),
k AS (SELECT CASE WHEN strpos(revision, '_') > 0 THEN split_part(revision, '_', 1) ELSE '' END AS project,
             result FROM v3),
kk AS (SELECT * FROM k WHERE project IN (SELECT project FROM dim)),
agg AS (SELECT project, {_COUNT_SQL} FROM kk GROUP BY project
        UNION ALL SELECT 'total', {_COUNT_SQL} FROM kk),
full_dim AS (SELECT * FROM dim UNION ALL SELECT 'total', 5),
s AS (SELECT d.project, d.pos,
        {', '.join(f'CAST(coalesce(a.{c}, 0) AS BIGINT) AS {c}' for c in _COUNTS + ['total'])}
      FROM full_dim d LEFT JOIN agg a USING (project))
"""

_HEADER = ("| Model Name | CORRECT Count | PASS Count | TE Count | CE Count | SE Count | Total "
           "| CORRECT % | PASS % | TE % | CE % | SE % |' || chr(10) || "
           "'|------------|---------------|------------|----------|----------|----------|-------"
           "|-----------|--------|------|------|------|")


def _md_sql(src: str, key: str, order: str) -> str:
    cells = " || ' | ' || ".join([key] + [f"CAST({c} AS VARCHAR)" for c in _COUNTS + ["total"]]
                                 + [f"{c}_pct" for c in _COUNTS])
    return f"""{src},
p AS (SELECT *, {_PCT_SQL} FROM s)
SELECT '{_HEADER}' || chr(10) || string_agg('| ' || {cells} || ' |', chr(10) ORDER BY {order}) || chr(10) AS report
FROM p"""


_DETECT_SQL = f"""
WITH v3 AS ({V3}),
m AS (SELECT *, row_number() OVER (PARTITION BY model, revision, run ORDER BY event_id) AS method_idx FROM v3),
f AS (SELECT model, revision, method_idx, result AS fr FROM m WHERE run = 'fixed'),
b AS (SELECT model, revision, method_idx, result AS br FROM m WHERE run = 'buggy'),
p AS (SELECT coalesce(f.model, b.model) AS model, coalesce(f.revision, b.revision) AS revision,
             coalesce(f.method_idx, b.method_idx) AS method_idx, fr, br
      FROM f FULL OUTER JOIN b ON f.model = b.model AND f.revision = b.revision AND f.method_idx = b.method_idx),
per AS (SELECT model, revision,
          bool_or(fr = 'SE') AS se, bool_or(fr = 'CORRECT') AS rerun,
          bool_or(fr = 'CORRECT' AND br IS NOT NULL AND br <> 'CORRECT') AS det,
          arg_max(fr, method_idx) FILTER (WHERE fr IS NOT NULL) AS last_f,
          arg_max(br, method_idx) FILTER (WHERE br IS NOT NULL) AS last_b
        FROM p GROUP BY model, revision)
SELECT model, revision,
  CASE WHEN coalesce(se, false) THEN 'SE'
       WHEN coalesce(det, false) THEN 'DETECT'
       WHEN coalesce(rerun, false) AND last_b IS NOT NULL THEN last_b
       ELSE coalesce(last_f, 'none') END AS result
FROM per"""

SQL = {
    "run_classifier": f"""
WITH l AS ({V8_LOGS})
SELECT event_id,
  CASE WHEN code LIKE '%Syntax Error%' THEN 'SE'
       WHEN exit_code <> 0 THEN 'CE'
       WHEN stdout NOT LIKE '%Failing tests: 0%' THEN 'TE'
       WHEN coverage_exit = 0 AND regexp_extract(coverage_stdout, 'Lines covered:\\s*(\\d+)', 1) NOT IN ('', '0') THEN 'CORRECT'
       ELSE 'PASS' END AS result
FROM l""",
    "markdown_document": f"""
WITH v3 AS ({V3}), s AS (SELECT model, {_COUNT_SQL} FROM v3 GROUP BY model)
SELECT chr(10) || '## Results' || chr(10) || (SELECT CAST(count(*) AS VARCHAR) || ' runs' FROM v3) || chr(10)
    || '| model | pass | total |' || chr(10) || '|-------|------|-------|' || chr(10)
    || string_agg('| ' || model || ' | ' || pass || ' | ' || total || ' |' || chr(10), '' ORDER BY total, model) || chr(10)
    || '```text' || chr(10) || (SELECT arg_max(revision, event_id) FROM v3) || chr(10) || '```' || chr(10) AS report
FROM s""",
    "results_per_model": f"""
WITH v3 AS ({V3}), s AS (SELECT model, {_COUNT_SQL} FROM v3 GROUP BY model)
SELECT *, {_PCT_SQL} FROM s""",
    "results_per_project": _PROJ_SQL + f"SELECT * EXCLUDE (pos), {_PCT_SQL} FROM s",
    "results_markdown": _md_sql(f"WITH v3 AS ({V3}), s AS (SELECT model, {_COUNT_SQL} FROM v3 GROUP BY model)",
                                "model", "model"),
    "project_markdown": _md_sql(_PROJ_SQL.rstrip(), "project", "pos"),
    "bug_detection": _DETECT_SQL,
    "env_elapsed": f"""
WITH v3 AS ({V3}), l AS ({V8_LOGS}),
j AS (SELECT CASE WHEN strpos(revision, '_') > 0 THEN split_part(revision, '_', 1) ELSE '' END AS project,
             ts, stdout FROM v3 JOIN l USING (event_id))
SELECT project, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS elapsed_s,
       CASE WHEN count_if(stdout NOT LIKE '%Failing tests: 0%') = 0 THEN 'ready' ELSE 'fail' END AS verdict
FROM j GROUP BY project""",
}

QUERIES = {
    "run_classifier": q_run_classifier,
    "results_per_model": q_results_per_model,
    "results_per_project": q_results_per_project,
    "results_markdown": q_results_markdown,
    "markdown_document": q_markdown_document,
    "project_markdown": q_project_markdown,
    "bug_detection": q_bug_detection,
    "env_elapsed": q_env_elapsed,
}
