"""Registered flow/subtree/comment queries (V9, V10) and CodeBLEU, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import ASCII_WS
from tessera.operators import flow as fl
from tessera.operators import textmetrics as tm
from tessera.plans import q_metrics
from tessera.plans.bindings import v2_pairs, v9_code_text, v9_nodes, v10_edges, v10_repeated_edges
from tessera.plans.sqlbind import V2, toks


def _r(c, name):
    return F.round(c, 6).alias(name)


def q_dataflow_match(spark, sf_dir):
    d = fl.dataflow_match(v10_repeated_edges(spark, sf_dir), together=True)
    return d.select(_r(F.col("dataflow_match"), "dataflow_match"), "matched", "total")


def q_syntax_match(spark, sf_dir):
    s = fl.syntax_match(fl.subtrees(v9_nodes(spark, sf_dir)))
    return s.select(_r(F.col("syntax_match"), "syntax_match"), "matched", "total")


def q_reaching_definitions(spark, sf_dir):
    t = v10_edges(spark, sf_dir).select("item", "side", "pos", "name", "is_def")
    r = fl.reaching_definitions(t, together=True)
    return r.groupBy("item", "side").agg(
        F.count(F.col("def_pos")).alias("linked"),
        F.sum(F.col("pos") - F.col("def_pos")).cast("long").alias("distance"))


def q_comment_strip(spark, sf_dir):
    c = v9_code_text(spark, sf_dir)
    return c.select("page_id", fl.comment_strip(F.col("code")).alias("code"))


def q_block_comment_strip(spark, sf_dir):
    c = v9_code_text(spark, sf_dir)
    return c.select("page_id", fl.block_comment_strip(F.col("code")).alias("code"))


def q_codebleu(spark, sf_dir):
    st = tm.item_stats(v2_pairs(spark, sf_dir), "idx", "predict", ["label"], 4, ASCII_WS, tm.KEYWORDS["java"])
    syn = fl.syntax_match(fl.subtrees(v9_nodes(spark, sf_dir))).select("syntax_match")
    dfm = fl.dataflow_match(v10_repeated_edges(spark, sf_dir), together=True).select("dataflow_match")
    parts = tm.ngram_scores(st).select("ngram_match", "weighted_ngram_match", syn.scalar().alias("syntax_match"),
                                       dfm.scalar().alias("dataflow_match"))
    score = tm.codebleu(*[F.col(c) for c in parts.columns])
    return parts.select(*[_r(F.col(c), c) for c in parts.columns], _r(score, "codebleu"))


_EDGES = f"""
WITH v2 AS ({V2}),
sides AS (SELECT idx AS item, 'ref' AS side, {toks('label')} AS t FROM v2
          UNION ALL SELECT idx, 'cand', {toks('predict')} FROM v2),
e AS (SELECT item, side, CAST(i - 1 AS INTEGER) AS pos, t[i] AS name,
        CASE WHEN (i - 1) % 3 = 0 THEN 'computedFrom' ELSE 'comesFrom' END AS rel,
        CASE WHEN i > 1 THEN [t[i - 1]] ELSE []::VARCHAR[] END AS parents,
        CASE WHEN i > 1 THEN [CAST(i - 2 AS INTEGER)] ELSE []::INTEGER[] END AS parent_pos,
        (i - 1) % 3 = 0 AS is_def
      FROM (SELECT item, side, t, unnest(range(1, len(t) + 1)) AS i FROM sides))
"""

_DATAFLOW = _EDGES + """,
r AS (SELECT item, side, name, pos, pos * 2 AS ord, rel, parents, parent_pos FROM e
      UNION ALL
      SELECT item, side, name, pos, pos * 2 + 1, 'mergedFrom', [], [] FROM e WHERE pos % 5 = 4),
m AS (SELECT item, side, pos, arg_max(name, ord) AS name, arg_max(rel, ord) AS rel,
        list_sort(list_distinct(flatten(list(parents)))) AS parents,
        list_sort(list_distinct(flatten(list(parent_pos)))) AS parent_pos
      FROM r GROUP BY item, side, pos),
keep AS (SELECT item, side, unnest(parent_pos) AS pos FROM m
         UNION SELECT item, side, pos FROM m WHERE len(parent_pos) > 0),
k AS (SELECT m.* FROM m SEMI JOIN keep USING (item, side, pos)),
occ AS (SELECT item, side, pos, l[j] AS nm, j - 1 AS kk
        FROM (SELECT item, side, pos, l, unnest(range(1, len(l) + 1)) AS j
              FROM (SELECT item, side, pos, list_concat(parents, [name]) AS l FROM k))),
fo AS (SELECT item, side, nm, min({'pos': pos, 'kk': kk}) AS f FROM occ GROUP BY item, side, nm),
ids AS (SELECT item, side, nm, 'var_' || CAST(dense_rank() OVER (PARTITION BY item, side ORDER BY f) - 1 AS VARCHAR) AS var FROM fo),
pe AS (SELECT o.item, o.side, o.pos, list(i.var ORDER BY o.kk) AS v
       FROM occ o JOIN ids i USING (item, side, nm) GROUP BY o.item, o.side, o.pos),
nrm AS (SELECT k.item, k.side, concat_ws('|', pe.v[-1], k.rel, array_to_string(list_slice(pe.v, 1, len(pe.v) - 1), ',')) AS norm
        FROM k JOIN pe USING (item, side, pos)),
cnt AS (SELECT item, norm, count_if(side = 'ref') AS r, count_if(side = 'cand') AS c FROM nrm GROUP BY item, norm)
SELECT round(CASE WHEN sum(r) > 0 THEN sum(least(r, c)) / sum(r) ELSE 0.0 END, 6) AS dataflow_match,
       CAST(sum(least(r, c)) AS BIGINT) AS matched, CAST(sum(r) AS BIGINT) AS total
FROM cnt"""

_SYNTAX = """
WITH s AS (
  SELECT page_id AS item, 'ref' AS side, regexp_extract_all(html, '</?[a-z0-9]+') AS tags FROM pages
  UNION ALL
  SELECT page_id, 'cand', regexp_extract_all(regexp_replace(regexp_replace(html, '<b>', '<strong>', 'g'), '</b>', '</strong>', 'g'), '</?[a-z0-9]+') FROM pages),
ex AS (SELECT item, side, j - 1 AS pos, tags[j] AS tag FROM (SELECT item, side, tags, unnest(range(1, len(tags) + 1)) AS j FROM s)),
d AS (SELECT *, sum(CASE WHEN starts_with(tag, '</') THEN -1 ELSE 1 END) OVER (PARTITION BY item, side ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS depth FROM ex),
nodes AS (SELECT item, side, pos, depth, substr(tag, 2) AS label FROM d WHERE NOT starts_with(tag, '</')),
ends AS (SELECT a.item, a.side, a.pos, a.depth, min(b.pos) AS stop FROM nodes a
         LEFT JOIN nodes b ON b.item = a.item AND b.side = a.side AND b.pos > a.pos AND b.depth <= a.depth GROUP BY ALL),
st AS (SELECT a.item, a.side, a.pos, string_agg(n.label || ':' || CAST(n.depth - a.depth AS VARCHAR), ',' ORDER BY n.pos) AS subtree
       FROM ends a JOIN nodes n ON n.item = a.item AND n.side = a.side AND n.pos >= a.pos AND (a.stop IS NULL OR n.pos < a.stop)
       GROUP BY a.item, a.side, a.pos),
cand AS (SELECT DISTINCT item, subtree FROM st WHERE side = 'cand'),
ref AS (SELECT r.item, r.subtree, c.subtree IS NOT NULL AS hit FROM st r LEFT JOIN cand c USING (item, subtree) WHERE r.side = 'ref')
SELECT round(count_if(hit) / count(*), 6) AS syntax_match, count_if(hit) AS matched, count(*) AS total FROM ref"""

def _unrounded(sql):
    """A component's statement with its result to 15 decimals."""
    return sql.replace(", 6) AS ", ", 15) AS ")


# The same tokens without possessive runs, which RE2 does not have.
_LEX = (r"""(?s)//[^\n]*|/\*([^*]|\*+[^*/])*\*+/|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'"""
        r"""|[^/"']+|.""").replace("'", "''")
_CODE = """
WITH c AS (SELECT page_id, 'u="' || url || '"; // ' || regexp_extract(url, '//([^/]+)', 1) || chr(10) ||
                 '/* ad */ y();' || chr(10) || chr(10) || '/** doc */ z();' || chr(10) || html || chr(10) ||
                 '/** ' || html || ' */' || chr(10) || 'end();' || chr(10) AS code FROM pages)
"""

SQL = {
    "dataflow_match": _DATAFLOW,
    "syntax_match": _SYNTAX,
    "reaching_definitions": _EDGES + """,
r AS (SELECT item, side, pos,
        last(CASE WHEN is_def THEN pos END IGNORE NULLS) OVER (PARTITION BY item, side, name ORDER BY pos
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def_pos FROM e)
SELECT item, side, count(def_pos) AS linked, CAST(sum(pos - def_pos) AS BIGINT) AS distance FROM r GROUP BY item, side""",
    "comment_strip": _CODE + f"""
SELECT page_id, array_to_string(list_filter(string_split(array_to_string(list_transform(
    regexp_extract_all(code, '{_LEX}'),
    lambda p: CASE WHEN starts_with(p, '//') OR (starts_with(p, '/*') AND ends_with(p, '*/') AND length(p) >= 4)
                   THEN ' ' ELSE p END), ''), chr(10)),
  lambda ln: length(regexp_replace(ln, '\\s', '', 'g')) > 0), chr(10)) AS code
FROM c""",
    "block_comment_strip": _CODE + "SELECT page_id, regexp_replace(code, '(?s)/\\*\\*?\\s.*?\\*/', '', 'g') AS code FROM c",
    "codebleu": f"""
SELECT round(a.bleu, 6) AS ngram_match, round(b.weighted_ngram_match, 6) AS weighted_ngram_match,
       round(c.syntax_match, 6) AS syntax_match, round(d.dataflow_match, 6) AS dataflow_match,
       round(0.25 * a.bleu + 0.25 * b.weighted_ngram_match + 0.25 * c.syntax_match + 0.25 * d.dataflow_match, 6) AS codebleu
FROM ({_unrounded(q_metrics._bleu_v2_sql(("label",)))}) a, ({_unrounded(q_metrics.SQL["weighted_ngram_match"])}) b,
     ({_unrounded(_SYNTAX)}) c, ({_unrounded(_DATAFLOW)}) d""",
}

QUERIES = {
    "dataflow_match": q_dataflow_match,
    "syntax_match": q_syntax_match,
    "reaching_definitions": q_reaching_definitions,
    "comment_strip": q_comment_strip,
    "block_comment_strip": q_block_comment_strip,
    "codebleu": q_codebleu,
}
