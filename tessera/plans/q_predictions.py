"""Registered prediction-handling queries (V2 predictions, V8 replies) and oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import predictions as pr
from tessera.plans.bindings import v2_pairs, v2_predictions, v8_chat_replies
from tessera.plans.sqlbind import V2, V2_PRED, V8_CHAT


def _corpus(spark, sf_dir):
    return v2_pairs(spark, sf_dir).select("id", "revision", F.col("label").alias("target"))


def _flat(spark, sf_dir):
    p = v2_predictions(spark, sf_dir)
    return p.withColumn("flat", pr.flatten_predict(F.col("predict"), F.col("items")))


def q_extract_fenced_code(spark, sf_dir):
    r = v8_chat_replies(spark, sf_dir)
    return r.select("conv_id", "turn", pr.extract_fenced_code("reply").alias("code"))


def q_prediction_flatten(spark, sf_dir):
    return _flat(spark, sf_dir).select("id", "ord", "flat")


def q_attach_predictions(spark, sf_dir):
    j = pr.attach_predictions(_corpus(spark, sf_dir), _flat(spark, sf_dir), ["id", "revision"],
                              "flat", "ord")
    return j.orderBy("revision", "id").select("id", "revision", "target")


def q_replace_by_label(spark, sf_dir):
    p = _flat(spark, sf_dir).withColumn("_o", F.struct("id", "ord"))
    j = pr.replace_by_label(_corpus(spark, sf_dir), p, "target", "label", "flat", "_o")
    return j.select("id", "revision", F.sha2("target", 256).alias("target_sha"))


def q_retry_set(spark, sf_dir):
    r = pr.retry_set(_corpus(spark, sf_dir), v2_predictions(spark, sf_dir), ["id", "revision"], "predict")
    return r.select("id", "revision")


def q_nothing_predictions(spark, sf_dir):
    p = v2_predictions(spark, sf_dir)
    return p.filter(F.col("predict") == "nothing").select("id", "revision", "ord")


HEAD = 500  # as in the reference; a table with fewer pairs gives all, as the SQL does


def q_head_in_file_order(spark, sf_dir):
    """O2: the first pairs in file order (a distributed top-k, not a scan cap)."""
    return pr.head_rows(v2_pairs(spark, sf_dir), "idx", HEAD, short=True).select("idx", "revision")


def q_resume_filter(spark, sf_dir):
    done = v2_predictions(spark, sf_dir).filter(F.col("predict") != "nothing")
    return pr.resume_filter(_corpus(spark, sf_dir), done, ["id", "revision"]).select("id", "revision")


_FLAT = f"""
WITH p AS ({V2_PRED}),
fl AS (SELECT *, coalesce(predict, CASE WHEN len(items) >= 1 THEN array_to_string(
          list_slice(list_concat(['@'], list_slice(items, 2, len(items))), 1, len(items) - 1), ' ') END) AS flat
       FROM p),
corpus AS (SELECT id, revision, label AS target FROM ({V2}))
"""

SQL = {
    "head_in_file_order": f"WITH v2 AS ({V2}) SELECT idx, revision FROM v2 ORDER BY idx LIMIT {HEAD}",
    "extract_fenced_code": f"""WITH r AS ({V8_CHAT})
SELECT conv_id, turn,
  CASE WHEN regexp_matches(reply, '(?s)```java\\s+(.*?)\\s+```')
       THEN regexp_replace(regexp_extract(reply, '(?s)```java\\s+(.*?)\\s+```', 1), '^\\s+|\\s+$', '', 'g')
       ELSE 'nothing' END AS code
FROM r""",
    "prediction_flatten": _FLAT + "SELECT id, ord, flat FROM fl",
    "attach_predictions": _FLAT + """,
last AS (SELECT id, revision, arg_max(flat, ord) AS pred FROM fl GROUP BY id, revision)
SELECT c.id, c.revision, l.pred AS target FROM corpus c LEFT JOIN last l USING (id, revision)""",
    "replace_by_label": _FLAT + """,
last AS (SELECT label, arg_max(flat, (id, ord)) AS new FROM fl GROUP BY label)
SELECT c.id, c.revision, sha256(coalesce(l.new, c.target)) AS target_sha
FROM corpus c LEFT JOIN last l ON c.target = l.label""",
    "retry_set": _FLAT + """
SELECT id, revision FROM corpus
WHERE (id, revision) IN (SELECT (id, revision) FROM fl WHERE predict = 'nothing')""",
    "nothing_predictions": _FLAT + "SELECT id, revision, ord FROM fl WHERE predict = 'nothing'",
    "resume_filter": _FLAT + """
SELECT id, revision FROM corpus c
WHERE NOT EXISTS (SELECT 1 FROM fl WHERE fl.predict <> 'nothing' AND fl.id = c.id AND fl.revision = c.revision)""",
}

QUERIES = {
    "extract_fenced_code": q_extract_fenced_code,
    "prediction_flatten": q_prediction_flatten,
    "attach_predictions": q_attach_predictions,
    "replace_by_label": q_replace_by_label,
    "retry_set": q_retry_set,
    "nothing_predictions": q_nothing_predictions,
    "resume_filter": q_resume_filter,
    "head_in_file_order": q_head_in_file_order,
}
