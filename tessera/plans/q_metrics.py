"""Registered text-metric queries over V2 and their DuckDB oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import ASCII_WS
from tessera.operators import textmetrics as tm
from tessera.plans.bindings import v2_pairs, ws_tokens
from tessera.plans.sqlbind import V2, toks

R6 = 6  # scores are compared at 6 decimals in both engines


def _r(c, name):
    return F.round(c, R6).alias(name)


def q_exact_match_accuracy(spark, sf_dir):
    v2 = v2_pairs(spark, sf_dir)
    gold = v2.select("idx", F.col("label").alias("text"))
    out = v2.select("idx", F.col("predict").alias("text"))
    return tm.accuracy(tm.align(gold, out))


def q_xmatch_rows(spark, sf_dir):
    return tm.with_xmatch(v2_pairs(spark, sf_dir)).select("idx", "xmatch")


def q_xmatch_rate(spark, sf_dir):
    return tm.xmatch_rate(tm.with_xmatch(v2_pairs(spark, sf_dir)))


def q_ngram_overlap_by_order(spark, sf_dir):
    v2 = v2_pairs(spark, sf_dir, second_ref=True)
    sides = tm.sides_frame(v2, "idx", "predict", ["label", "ref2"], ASCII_WS)
    gt = tm.gram_table(sides, 2, 4)
    refs, grams = tm.ref_cols(2), F.col("grams")
    return gt.groupBy("order").agg(
        F.sum(grams).alias("distinct_grams"),
        F.sum(F.col("h") * grams).cast("long").alias("hyp_grams"),
        F.sum(tm.union_max(refs) * grams).cast("long").alias("ref_union"),
        F.sum(tm.clipped(F.col("h"), refs) * grams).cast("long").alias("clipped")
    ).select(F.col("order").cast("long").alias("ord"), "distinct_grams", "hyp_grams",
             "ref_union", "clipped")


def q_padded_ngrams(spark, sf_dir):
    """n-grams of the labels' lines padded on both sides, per order."""
    lines = v2_pairs(spark, sf_dir).select(F.explode(F.split("label", "\n")).alias("line"))
    lines = lines.select(ws_tokens("line").alias("toks"))

    def grams(toks, n):
        return tm.ngram_array(tm.pad_sequence(toks, n, "<s>", "</s>"), n)

    return tm.gram_totals(lines, "toks", (1, 2, 3), grams, "<s>", "</s>")


def _stats(spark, sf_dir, refs, max_order=4, keywords=None):
    v2 = v2_pairs(spark, sf_dir, second_ref="ref2" in refs)
    return tm.item_stats(v2, "idx", "predict", refs, max_order, ASCII_WS, keywords)


def q_bleu_v1_corpus(spark, sf_dir):
    b = tm.bleu_v1(_stats(spark, sf_dir, ["label"]))
    return b.select("bleu", *[_r(F.col(f"precision_{k}"), f"precision_{k}") for k in range(1, 5)],
                    _r(F.col("bp"), "bp"), _r(F.col("ratio"), "ratio"),
                    "translation_length", "reference_length")


def q_bleu_v1_smooth(spark, sf_dir):
    b = tm.bleu_v1(_stats(spark, sf_dir, ["label", "ref2"]), smooth=True)
    return b.select("bleu", _r(F.col("bp"), "bp"), "translation_length", "reference_length")


def q_bleu_v2_corpus(spark, sf_dir):
    b = tm.corpus_bleu_v2(_stats(spark, sf_dir, ["label", "ref2"]))
    return b.select(_r(F.col("bleu"), "bleu"), _r(F.col("bp"), "bp"), "hyp_length", "ref_length")


def q_sentence_bleu(spark, sf_dir):
    s = tm.sentence_bleu_v2(_stats(spark, sf_dir, ["label"]))
    return s.select(F.col("item").alias("idx"), _r(F.col("bleu"), "bleu"))


def q_sentence_bleu_smoothing(spark, sf_dir):
    st = _stats(spark, sf_dir, ["label"], max_order=5)
    return st.select(F.col("item").alias("idx"), *[
        _r(tm.sentence_bleu_expr(st.columns, smoothing=m), f"bleu_m{m}") for m in range(8)])


def q_weighted_ngram_match(spark, sf_dir):
    w = tm.weighted_ngram_match(_stats(spark, sf_dir, ["label"], keywords=tm.KEYWORDS["java"]), compat=True)
    return w.select(_r(F.col("weighted_ngram_match"), "weighted_ngram_match"), _r(F.col("bp"), "bp"))


def q_weighted_ngram_match_exact_bp(spark, sf_dir):
    w = tm.weighted_ngram_match(_stats(spark, sf_dir, ["label", "ref2"], keywords=tm.KEYWORDS["java"]), compat=False)
    return w.select(_r(F.col("weighted_ngram_match"), "weighted_ngram_match"), _r(F.col("bp"), "bp"))


# ---------------------------------------------------------------------------
# Oracle SQL
# ---------------------------------------------------------------------------

def stats_sql(refs, max_order=4):
    """CTE chain ending in ``stats(item, hl, rmin, rclose, m1..mN)`` and ``cnt``."""
    sides = [f"SELECT idx AS item, 'h' AS side, 0 AS ref_idx, {toks('predict')} AS t FROM v2"]
    for k, r in enumerate(refs):
        sides.append(f"SELECT idx, 'r', {k}, {toks(r)} FROM v2")
    ms = ",\n  ".join(f"coalesce(sum(CASE WHEN ord = {k} THEN m END), 0) AS m{k}"
                      for k in range(1, max_order + 1))
    return f"""
WITH v2 AS ({V2}),
sides AS ({' UNION ALL '.join(sides)}),
ords AS (SELECT s.*, o.ord FROM sides s, (SELECT unnest(range(1, {max_order + 1})) AS ord) o
         WHERE len(s.t) >= o.ord),
grams AS (
  SELECT item, side, ref_idx, ord, array_to_string(list_slice(t, i, i + ord - 1), ' ') AS gram
  FROM (SELECT item, side, ref_idx, ord, t, unnest(range(1, len(t) - ord + 2)) AS i FROM ords)),
cnt AS (SELECT item, side, ref_idx, ord, gram, count(*) AS c FROM grams GROUP BY ALL),
hc AS (SELECT item, ord, gram, c AS h FROM cnt WHERE side = 'h'),
rc AS (SELECT item, ord, gram, max(c) AS r FROM cnt WHERE side = 'r' GROUP BY ALL),
clip AS (SELECT hc.item, hc.ord, sum(least(hc.h, coalesce(rc.r, 0))) AS m
         FROM hc LEFT JOIN rc USING (item, ord, gram) GROUP BY ALL),
hl AS (SELECT item, len(t) AS hl FROM sides WHERE side = 'h'),
rl AS (SELECT s.item, min(len(s.t)) AS rmin,
              first(len(s.t) ORDER BY abs(len(s.t) - hl.hl), len(s.t)) AS rclose
       FROM sides s JOIN hl USING (item) WHERE s.side = 'r' GROUP BY s.item),
mm AS (SELECT item,
  {ms}
  FROM clip GROUP BY item),
stats AS (SELECT hl.item, hl.hl, rl.rmin, rl.rclose,
  {', '.join(f'coalesce(mm.m{k}, 0) AS m{k}' for k in range(1, max_order + 1))}
  FROM hl JOIN rl USING (item) LEFT JOIN mm USING (item))
"""


def _bleu_v1_sql(smooth: bool, cols: str, refs):
    sums = ", ".join([f"sum(m{k}) AS M{k}, sum(greatest(hl - {k - 1}, 0)) AS PS{k}"
                      for k in range(1, 5)])
    if smooth:
        prec = [f"(M{k} + 1.0) / (PS{k} + 1.0)" for k in range(1, 5)]
    else:
        prec = [f"CASE WHEN PS{k} > 0 THEN M{k} / PS{k} ELSE 0.0 END" for k in range(1, 5)]
    pcols = ", ".join(f"{p} AS p{k}" for k, p in enumerate(prec, 1))
    return stats_sql(refs) + f""",
tot AS (SELECT sum(hl) AS tl, sum(rmin) AS rl, {sums} FROM stats),
pr AS (SELECT *, {pcols}, CAST(tl AS DOUBLE) / rl AS ratio FROM tot),
bb AS (SELECT *,
  CASE WHEN p1 > 0 AND p2 > 0 AND p3 > 0 AND p4 > 0
       THEN exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) ELSE 0.0 END AS geo,
  CASE WHEN ratio > 1 THEN 1.0 WHEN ratio = 0 THEN 0.0 ELSE exp(1 - 1 / ratio) END AS bp
  FROM pr)
SELECT {cols} FROM bb"""


def _v2_prec(nums, dens, method):
    """SQL smoothed precisions for methods 0-4 (lists of SQL expressions)."""
    n = len(nums)
    raw = [f"({nums[i]}) / ({dens[i]})" for i in range(n)]
    if method == 0:
        return [f"CASE WHEN {nums[i]} = 0 THEN 2.2250738585072014e-308 ELSE {raw[i]} END"
                for i in range(n)]
    if method == 1:
        return [f"CASE WHEN {nums[i]} = 0 THEN ({nums[i]} + 0.1) / ({dens[i]}) ELSE {raw[i]} END"
                for i in range(n)]
    if method == 2:
        return [f"({nums[i]} + 1.0) / ({dens[i]} + 1.0)" for i in range(n)]
    if method == 3:
        out = []
        for i in range(n):
            inc = "1" + "".join(f" + CASE WHEN {nums[j]} = 0 THEN 1 ELSE 0 END" for j in range(i))
            out.append(f"CASE WHEN {nums[i]} = 0 THEN 1.0 / (pow(2.0, {inc}) * ({dens[i]})) "
                       f"ELSE {raw[i]} END")
        return out
    raise ValueError(method)


def _v2_score(nums, dens, method, c, r, weights=(0.25, 0.25, 0.25, 0.25), prec=None):
    ps = prec or _v2_prec(nums, dens, method)
    s = " + ".join(f"{w} * ln(CASE WHEN ({p}) > 0 THEN ({p}) END)" for w, p in zip(weights, ps))
    bp = f"(CASE WHEN {c} > {r} THEN 1.0 WHEN {c} = 0 THEN 0.0 ELSE exp(1 - ({r}) / ({c})) END)"
    undefined = f"WHEN {nums[2]} = 0 THEN NULL " if method == 6 else ""
    return f"(CASE WHEN {nums[0]} = 0 THEN 0.0 {undefined}ELSE {bp} * exp({s}) END)", bp


def _bleu_v2_sql(refs=("label", "ref2")):
    nums = [f"CAST(M{k} AS DOUBLE)" for k in range(1, 5)]
    dens = [f"CAST(D{k} AS DOUBLE)" for k in range(1, 5)]
    score, bp = _v2_score(nums, dens, 1, "c", "r")
    sums = ", ".join(f"sum(m{k}) AS M{k}, sum(greatest(hl - {k - 1}, 1)) AS D{k}"
                     for k in range(1, 5))
    return stats_sql(list(refs)) + f""",
tot AS (SELECT sum(hl) AS c, sum(rclose) AS r, {sums} FROM stats)
SELECT round({score}, 6) AS bleu, round({bp}, 6) AS bp, c AS hyp_length, r AS ref_length FROM tot"""


def _sentence_sql(methods):
    hl = "CAST(hl AS DOUBLE)"
    nums = [f"CAST(m{k} AS DOUBLE)" for k in range(1, 6)]
    dens = [f"CAST(greatest(hl - {k - 1}, 1) AS DOUBLE)" for k in range(1, 6)]
    cols = []
    for m in methods:
        n4, d4 = nums[:4], dens[:4]
        if m in (0, 1, 2, 3):
            prec = _v2_prec(n4, d4, m)
        elif m in (4, 7):
            prec = [f"CASE WHEN {n4[i]} = 0 AND hl <> 0 THEN ({i}.0 + (CASE WHEN hl = 1 THEN NULL ELSE 5.0 / ln({hl}) END)) / ({d4[i]}) "
                    f"ELSE {n4[i]} / {d4[i]} END" for i in range(4)]
            if m == 7:
                prec = _m5_sql(prec, f"{nums[4]} / {dens[4]}")
        elif m == 5:
            prec = _m5_sql([f"{n4[i]} / {d4[i]}" for i in range(4)], f"{nums[4]} / {dens[4]}")
        elif m == 6:
            prec = [f"{n4[i]} / {d4[i]}" for i in range(4)]
            for i in range(2, 4):
                pi0 = (f"(CASE WHEN ({prec[i - 2]}) = 0 THEN 0.0 "
                       f"ELSE pow({prec[i - 1]}, 2) / ({prec[i - 2]}) END)")
                prec[i] = f"(({n4[i]} + 5.0 * {pi0}) / (greatest(hl - {i}, 0) + 5.0))"
        name = "bleu" if len(methods) == 1 else f"bleu_m{m}"
        score, _ = _v2_score(n4, d4, m, "hl", "rclose", prec=prec)
        cols.append(f"round({score}, 6) AS {name}")
    return stats_sql(["label"], max_order=5) + f"SELECT item AS idx, {', '.join(cols)} FROM stats"


def _m5_sql(p, extra):
    nxt = list(p) + [extra]
    out, prev = [], f"({p[0]} + 1.0)"
    for i in range(len(p)):
        v = f"(({prev}) + ({p[i]}) + ({nxt[i + 1]})) / 3.0"
        out.append(v)
        prev = v
    return out


_KW = ", ".join(f"'{k}'" for k in tm.JAVA_KEYWORDS)


def _weighted_sql(refs, compat):
    n = ", ".join(f"sum(CASE WHEN ord = {k} THEN least(rc, h) * w END) AS n{k}" for k in range(1, 5))
    dk = ", ".join(f"sum(greatest(rl - {k - 1}, 1)) AS d{k}" for k in range(2, 5))
    rexpr = "2 * count(*)" if compat else "sum(rclose)"
    nums = [f"N{k}" for k in range(1, 5)]
    dens = [f"D{k}" for k in range(1, 5)]
    score, bp = _v2_score(nums, dens, 1, "c", "r")
    return stats_sql(refs) + f""",
wr AS (
  SELECT c.item, c.ref_idx, c.ord, c.c AS rc, coalesce(h.h, 0) AS h,
         CASE WHEN c.ord = 1 THEN (CASE WHEN c.gram IN ({_KW}) THEN 1.0 ELSE 0.2 END) ELSE 1.0 END AS w
  FROM cnt c LEFT JOIN hc h USING (item, ord, gram) WHERE c.side = 'r'),
per_ref AS (SELECT item, ref_idx, {n}, sum(CASE WHEN ord = 1 THEN rc * w END) AS w1
            FROM wr GROUP BY item, ref_idx),
refs AS (SELECT s.item, s.ref_idx, len(s.t) AS rl, p.* EXCLUDE (item, ref_idx)
         FROM sides s LEFT JOIN per_ref p USING (item, ref_idx) WHERE s.side = 'r'),
per_item AS (
  SELECT item, {', '.join(f'sum(coalesce(n{k}, 0)) AS n{k}' for k in range(1, 5))},
         sum(greatest(coalesce(w1, 0), 1)) AS d1, {dk}
  FROM refs GROUP BY item),
tot AS (SELECT sum(stats.hl) AS c, {rexpr} AS r,
   {', '.join(f'sum(n{k}) AS N{k}, sum(d{k}) AS D{k}' for k in range(1, 5))}
   FROM stats JOIN per_item USING (item))
SELECT round({score}, 6) AS weighted_ngram_match, round({bp}, 6) AS bp FROM tot"""


_OVERLAP_SQL = stats_sql(["label", "ref2"]) + """,
g AS (SELECT coalesce(hc.item, rc.item) AS item, coalesce(hc.ord, rc.ord) AS ord,
             coalesce(hc.h, 0) AS h, coalesce(rc.r, 0) AS r
      FROM hc FULL OUTER JOIN rc USING (item, ord, gram))
SELECT CAST(ord AS BIGINT) AS ord, count(*) AS distinct_grams, CAST(sum(h) AS BIGINT) AS hyp_grams,
       CAST(sum(r) AS BIGINT) AS ref_union, CAST(sum(least(h, r)) AS BIGINT) AS clipped
FROM g GROUP BY ord"""

SQL = {
    "exact_match_accuracy": f"""
WITH v2 AS ({V2})
SELECT count(*) AS total, CAST(sum(CASE WHEN label = predict THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       round_even(sum(CASE WHEN label = predict THEN 1 ELSE 0 END) * 100.0 / count(*), 3) AS accuracy
FROM v2""",
    "xmatch_rows": f"WITH v2 AS ({V2}) SELECT idx, label = predict AS xmatch FROM v2",
    "xmatch_rate": f"""WITH v2 AS ({V2})
SELECT round_even(avg(CASE WHEN label = predict THEN 1.0 ELSE 0.0 END) * 100.0, 4) AS xmatch FROM v2""",
    "ngram_overlap_by_order": _OVERLAP_SQL,
    "padded_ngrams": f"""WITH v2 AS ({V2}),
lines AS (SELECT {toks('line')} AS t FROM (SELECT unnest(string_split(label, chr(10))) AS line FROM v2)),
padded AS (SELECT n, list_concat(list_concat([CAST('<s>' AS VARCHAR) FOR x IN range(n - 1)], t),
                                 [CAST('</s>' AS VARCHAR) FOR x IN range(n - 1)]) AS t FROM lines, range(1, 4) o(n)),
g AS (SELECT n, array_to_string(list_slice(t, i, i + n - 1), ' ') AS gram
      FROM (SELECT n, t, unnest(range(1, len(t) - n + 2)) AS i FROM padded WHERE len(t) >= n)),
c AS (SELECT n, gram, count(*) AS k FROM g GROUP BY n, gram)
SELECT n AS ord, count(*) AS distinct_grams, CAST(sum(k) AS BIGINT) AS grams,
       CAST(sum(CASE WHEN starts_with(gram, '<s>') THEN k ELSE 0 END) AS BIGINT) AS left_padded,
       CAST(sum(CASE WHEN ends_with(gram, '</s>') THEN k ELSE 0 END) AS BIGINT) AS right_padded
FROM c GROUP BY n""",
    "bleu_v1_corpus": _bleu_v1_sql(False, "round_even(geo * bp * 100.0, 2) AS bleu, "
                                   + ", ".join(f"round(p{k}, 6) AS precision_{k}" for k in range(1, 5))
                                   + ", round(bp, 6) AS bp, round(ratio, 6) AS ratio, "
                                   "CAST(tl AS BIGINT) AS translation_length, "
                                   "CAST(rl AS BIGINT) AS reference_length", ["label"]),
    "bleu_v1_smooth": _bleu_v1_sql(True, "round_even(geo * bp * 100.0, 2) AS bleu, round(bp, 6) AS bp, "
                                   "CAST(tl AS BIGINT) AS translation_length, "
                                   "CAST(rl AS BIGINT) AS reference_length", ["label", "ref2"]),
    "bleu_v2_corpus": _bleu_v2_sql(),
    "sentence_bleu": _sentence_sql([1]),
    "sentence_bleu_smoothing": _sentence_sql(list(range(8))),
    "weighted_ngram_match": _weighted_sql(["label"], True),
    "weighted_ngram_match_exact_bp": _weighted_sql(["label", "ref2"], False),
}

QUERIES = {
    "exact_match_accuracy": q_exact_match_accuracy,
    "xmatch_rows": q_xmatch_rows,
    "xmatch_rate": q_xmatch_rate,
    "ngram_overlap_by_order": q_ngram_overlap_by_order,
    "padded_ngrams": q_padded_ngrams,
    "bleu_v1_corpus": q_bleu_v1_corpus,
    "bleu_v1_smooth": q_bleu_v1_smooth,
    "bleu_v2_corpus": q_bleu_v2_corpus,
    "sentence_bleu": q_sentence_bleu,
    "sentence_bleu_smoothing": q_sentence_bleu_smoothing,
    "weighted_ngram_match": q_weighted_ngram_match,
    "weighted_ngram_match_exact_bp": q_weighted_ngram_match_exact_bp,
}
