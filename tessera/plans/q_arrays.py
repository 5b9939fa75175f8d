"""Registered token-array and beam queries over V7 and their DuckDB oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import arrays as ar
from tessera.operators import predictions as pr
from tessera.plans.bindings import EOS_ID, PAD_ID, v7_arrays, v7_beams
from tessera.plans.sqlbind import V7, V7_BEAMS

MAXLEN = 512


def q_token_truncate_eos(spark, sf_dir):
    v = v7_arrays(spark, sf_dir)
    x = ar.add_eos("ids", EOS_ID, MAXLEN)
    return v.select("idx", F.size(x).cast("long").alias("n"), ar.as_text(x).alias("input_ids"))


def _masked(v):
    source = F.concat("p1", "p2")
    full = ar.add_eos(F.concat(source, F.col("p3"), F.array(F.lit(EOS_ID))), EOS_ID, MAXLEN)
    prompt = ar.add_eos(source, EOS_ID, MAXLEN)
    k = F.size(prompt) - 1
    return k, ar.mask_prompt(full, k)


def q_prompt_masked_labels(spark, sf_dir):
    v = v7_arrays(spark, sf_dir)
    k, labels = _masked(v)
    return v.select("idx", k.cast("long").alias("masked"), ar.as_text(labels).alias("labels"))


def q_ignore_to_pad(spark, sf_dir):
    v = v7_arrays(spark, sf_dir)
    _, labels = _masked(v)
    return v.select("idx", ar.as_text(ar.ignore_to_pad(labels, PAD_ID)).alias("labels"))


def q_fixed_length_padding(spark, sf_dir):
    v = v7_arrays(spark, sf_dir)
    t = ar.truncate("ids", 256)
    return v.select("idx", ar.as_text(ar.pad_right(t, 256, PAD_ID)).alias("input_ids"),
                    ar.as_text(ar.attention_mask(t, 256)).alias("attention_mask"))


def q_three_part_packing(spark, sf_dir):
    v = v7_arrays(spark, sf_dir)
    full, labels = ar.pack_three("p1", "p2", "p3", "ids", MAXLEN, EOS_ID)
    return v.select("idx", ar.as_text(full).alias("input_ids"), ar.as_text(labels).alias("labels"))


def q_three_part_packing_padded(spark, sf_dir):
    v = v7_arrays(spark, sf_dir)
    return v.select("idx", ar.as_text(ar.pack_three_padded("p1", "p2", "p3", 384, PAD_ID)).alias("input_ids"))


def q_pad_rotation(spark, sf_dir):
    v = v7_arrays(spark, sf_dir)
    return v.select("idx", ar.as_text(ar.rotate_pads("padded_pred", PAD_ID)).alias("pred"))


def q_batch_padding(spark, sf_dir):
    v = v7_arrays(spark, sf_dir).select("idx", "batch", ar.add_eos("ids", EOS_ID, MAXLEN).alias("ids"))
    v = v.withColumn("labels", F.col("ids"))
    b = ar.batch_pad(v, "batch", "ids", "labels", PAD_ID)
    return b.select("idx", "batch", F.col("padded_len").cast("long").alias("padded_len"),
                    ar.as_text("ids").alias("input_ids"), ar.as_text("labels").alias("labels"))


def q_best_beam(spark, sf_dir):
    b = pr.best_beam(v7_beams(spark, sf_dir), "sample", "beam", "tokens", "label")
    return b.select("sample", F.col("beam").cast("long").alias("beam"), "xmatch",
                    F.size("tokens").cast("long").alias("n_tokens"))


def q_top1_prediction(spark, sf_dir):
    b = v7_beams(spark, sf_dir)
    per = b.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("beam", "tokens"))).alias("r"))
    return per.select("sample", ar.as_text(pr.top1(F.transform("r", lambda s: s["tokens"]))).alias("top1"))


def _t(x):
    return f"array_to_string({x}, ',')"


def _eos_sql(a):
    """add_eos on a DuckDB list expression (max 512, eos 2)."""
    t = f"list_slice({a}, 1, {MAXLEN})"
    app = (f"(CASE WHEN len({t}) < {MAXLEN} AND (len({t}) = 0 OR {t}[-1] <> {EOS_ID}) "
           f"THEN list_append({t}, {EOS_ID}) ELSE {t} END)")
    return (f"(CASE WHEN len({app}) >= {MAXLEN} THEN list_append(list_slice({app}, 1, {MAXLEN - 1}), {EOS_ID}) "
            f"ELSE {app} END)")


def _mask_sql(lab, k):
    return (f"list_concat(list_resize([]::INTEGER[], greatest(least({k}, len({lab})), 0), -100), "
            f"list_slice({lab}, greatest(least({k}, len({lab})), 0) + 1, len({lab})))")


_MASK = f"""
WITH v AS ({V7}),
m AS (SELECT idx, {_eos_sql('list_concat(list_concat(p1, p2), list_concat(p3, [2]))')} AS fullids,
             len({_eos_sql('list_concat(p1, p2)')}) - 1 AS k FROM v),
mm AS (SELECT idx, k, {_mask_sql('fullids', 'k')} AS labels FROM m)
"""

_PACK = f"""
WITH v AS ({V7}),
pk AS (SELECT idx, list_concat(list_concat(list_slice(p1, 1, 128), list_slice(p2, 1, 128)), list_slice(p3, 1, 128)) AS prompt,
              list_slice(ids, 1, 127) AS tgt FROM v),
f AS (SELECT idx, list_append(list_concat(prompt, tgt), {EOS_ID}) AS fullids, len(prompt) AS k FROM pk)
"""


def _pad_sql(a, n, pad):
    return f"list_concat({a}, list_resize([]::INTEGER[], greatest({n} - len({a}), 0), {pad}))"


SQL = {
    "token_truncate_eos": f"WITH v AS ({V7}) SELECT idx, CAST(len({_eos_sql('ids')}) AS BIGINT) AS n, "
                          f"{_t(_eos_sql('ids'))} AS input_ids FROM v",
    "prompt_masked_labels": _MASK + f"SELECT idx, CAST(k AS BIGINT) AS masked, {_t('labels')} AS labels FROM mm",
    "ignore_to_pad": _MASK + f"SELECT idx, {_t('list_transform(labels, lambda x: CASE WHEN x = -100 THEN 0 ELSE x END)')} AS labels FROM mm",
    "fixed_length_padding": f"""WITH v AS ({V7})
SELECT idx, {_t(_pad_sql('list_slice(ids, 1, 256)', 256, 0))} AS input_ids,
  {_t("list_concat(list_resize([]::INTEGER[], least(len(ids), 256), 1), list_resize([]::INTEGER[], 256 - least(len(ids), 256), 0))")} AS attention_mask
FROM v""",
    "three_part_packing": _PACK + f"SELECT idx, {_t('fullids')} AS input_ids, {_t(_mask_sql('fullids', 'k'))} AS labels FROM f",
    "three_part_packing_padded": f"""WITH v AS ({V7})
SELECT idx, {_t('list_concat(list_concat(' + _pad_sql('list_slice(p1, 1, 128)', 128, 0) + ', ' + _pad_sql('list_slice(p2, 1, 128)', 128, 0) + '), ' + _pad_sql('list_slice(p3, 1, 128)', 128, 0) + ')')} AS input_ids FROM v""",
    "pad_rotation": f"""WITH v AS ({V7}),
f AS (SELECT idx, padded_pred AS a, list_position(list_transform(padded_pred, lambda x: x <> 0), true) AS fp FROM v)
SELECT idx, {_t("CASE WHEN fp IS NOT NULL THEN list_concat(list_slice(a, fp, len(a)), list_resize([]::INTEGER[], fp - 1, 0)) ELSE a END")} AS pred FROM f""",
    "batch_padding": f"""WITH v AS ({V7}),
e AS (SELECT idx, batch, {_eos_sql('ids')} AS ids FROM v),
p AS (SELECT *, CAST(ceil(max(len(ids)) OVER (PARTITION BY batch) / 8) * 8 AS INTEGER) AS padded_len FROM e)
SELECT idx, batch, CAST(padded_len AS BIGINT) AS padded_len, {_t(_pad_sql('ids', 'padded_len', 0))} AS input_ids,
       {_t(_pad_sql('ids', 'padded_len', -100))} AS labels FROM p""",
    "best_beam": f"""WITH b AS ({V7_BEAMS}),
c AS (SELECT sample, beam, tokens, tokens = label AS xmatch FROM b WHERE tokens = label OR beam = 0)
SELECT sample, CAST(arg_min(beam, (CASE WHEN xmatch THEN 0 ELSE 1 END, beam)) AS BIGINT) AS beam,
       arg_min(xmatch, (CASE WHEN xmatch THEN 0 ELSE 1 END, beam)) AS xmatch,
       CAST(arg_min(len(tokens), (CASE WHEN xmatch THEN 0 ELSE 1 END, beam)) AS BIGINT) AS n_tokens
FROM c GROUP BY sample""",
    "top1_prediction": f"""WITH b AS ({V7_BEAMS})
SELECT sample, {_t('tokens')} AS top1 FROM b WHERE beam = 0""",
}

QUERIES = {
    "token_truncate_eos": q_token_truncate_eos,
    "prompt_masked_labels": q_prompt_masked_labels,
    "ignore_to_pad": q_ignore_to_pad,
    "fixed_length_padding": q_fixed_length_padding,
    "three_part_packing": q_three_part_packing,
    "three_part_packing_padded": q_three_part_packing_padded,
    "pad_rotation": q_pad_rotation,
    "batch_padding": q_batch_padding,
    "best_beam": q_best_beam,
    "top1_prediction": q_top1_prediction,
}
