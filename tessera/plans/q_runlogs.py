"""Registered training-log queries over V5 and their DuckDB oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import runlogs as rl
from tessera.plans.bindings import v5_curves
from tessera.plans.sqlbind import V5


def q_loss_curve_ema(spark, sf_dir):
    s = rl.ema_smooth(v5_curves(spark, sf_dir), ["run", "metric"], "step", "value")
    return s.select(F.col("run").cast("long").alias("run"), "metric", "step", "value",
                    F.round("smoothed", 6).alias("smoothed"))


def q_best_checkpoint(spark, sf_dir):
    ev = v5_curves(spark, sf_dir).filter(F.col("metric") == "eval_loss")
    return rl.best_checkpoint(ev, "run", "step", "value").select(
        F.col("run").cast("long").alias("run"), "best_step", "best_value")


def q_early_stop(spark, sf_dir):
    ev = v5_curves(spark, sf_dir).filter(F.col("metric") == "eval_loss")
    return rl.early_stop(ev, "run", "step", "value", patience=2).select(
        F.col("run").cast("long").alias("run"), "stop_step")


def q_log_entries_with_key(spark, sf_dir):
    v5 = v5_curves(spark, sf_dir)
    entries = v5.select("run", F.create_map(F.lit("step"), F.col("step").cast("double"),
                                            F.col("metric"), F.col("value")).alias("entry"))
    kept = rl.entries_with_key(entries, "eval_loss")
    return kept.select(F.col("run").cast("long").alias("run"),
                       F.col("entry")["step"].cast("long").alias("step"),
                       F.col("entry")["eval_loss"].alias("value"))


SQL = {
    "loss_curve_ema": f"""
WITH RECURSIVE v5 AS ({V5}),
s AS (SELECT run, metric, step, value,
        row_number() OVER (PARTITION BY run, metric ORDER BY step) AS i,
        1.8 * (1.0 / (1.0 + exp(-0.05 * count(*) OVER (PARTITION BY run, metric))) - 0.5) AS w
      FROM v5),
e AS (
  SELECT run, metric, i, step, value, w, value * w + (1.0 - w) * value AS y FROM s WHERE i = 1
  UNION ALL
  SELECT s.run, s.metric, s.i, s.step, s.value, s.w, e.y * s.w + (1.0 - s.w) * s.value
  FROM e JOIN s ON s.run = e.run AND s.metric = e.metric AND s.i = e.i + 1)
SELECT CAST(run AS BIGINT) AS run, metric, CAST(step AS BIGINT) AS step, value, round(y, 6) AS smoothed FROM e""",
    "best_checkpoint": f"""
WITH v5 AS ({V5})
SELECT CAST(run AS BIGINT) AS run, CAST(arg_min(step, (value, step)) AS BIGINT) AS best_step,
       min(value) AS best_value
FROM v5 WHERE metric = 'eval_loss' GROUP BY run""",
    "early_stop": f"""
WITH v5 AS ({V5}),
ev AS (SELECT run, step, value,
         row_number() OVER (PARTITION BY run ORDER BY step) AS i,
         min(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm
       FROM v5 WHERE metric = 'eval_loss'),
im AS (SELECT *, pm IS NULL OR value < pm AS impr FROM ev),
la AS (SELECT *, max(CASE WHEN impr THEN i END) OVER (PARTITION BY run ORDER BY step
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM im)
SELECT CAST(run AS BIGINT) AS run, CAST(min(CASE WHEN i - last >= 2 THEN step END) AS BIGINT) AS stop_step
FROM la GROUP BY run""",
    "log_entries_with_key": f"""
WITH v5 AS ({V5})
SELECT CAST(run AS BIGINT) AS run, CAST(step AS BIGINT) AS step, value FROM v5 WHERE metric = 'eval_loss'""",
}

QUERIES = {
    "loss_curve_ema": q_loss_curve_ema,
    "best_checkpoint": q_best_checkpoint,
    "early_stop": q_early_stop,
    "log_entries_with_key": q_log_entries_with_key,
}
