"""The operators over the driver tables: one query each, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, collocations, common, decontaminate, divergence, minhash, packing, personal_data, quality_gam,
               quality_rules, suffix_dedup, token_counts, toxicity, url_filter)

# (verdict, host and path)
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MAX_TOKENS = 2048


def _held_out(modulus: int, remainder: int):
    """A document without an id is never learnt from."""
    return F.coalesce(common.crc_bucket(F.col("doc_id"), modulus) == remainder, F.lit(True)).alias("held_out")


def op1_line_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.clean_lines(common.read_table(spark, sf_dir, "documents"))


def op2_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    scores = toxicity.toxicity_scores(docs, toxicity.fit(docs, labels))
    return scores.select("doc_id", _held_out(3, 1), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_spaced_seed_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(common.read_table(spark, sf_dir, "documents"),
                               common.read_table(spark, sf_dir, "benchmark"))


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    scores = quality_gam.quality_scores(docs, quality_gam.fit(docs, labels))
    return scores.select("doc_id", _held_out(5, 0), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = minhash.near_duplicates(common.read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(common.read_table(spark, sf_dir, "documents"))
    return cut.select("carried.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.read_table(spark, sf_dir, "documents"),
                        public_tokenizers.path("byte_bpe_50k.json"), MAX_TOKENS)


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"))
    windows = chat.format_windows(turns.unionByName(probe), public_tokenizers.path("byte_bpe_50k.json"))
    return chat.read_back(windows)


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.parse_rule(*r) for r in URL_RULES]
    return url_filter.url_verdicts(common.read_table(spark, sf_dir, "pages"), rules)


def op10_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(common.read_table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("word_bpe_49k.json"), MAX_TOKENS)


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.personal_data(common.read_table(spark, sf_dir, "documents"))

    def of(*kinds):
        return F.filter("personal", lambda s: s["kind"].isin(*kinds))

    base = of(*personal_data.BASE)
    counts = [F.size(of(kind)).cast("bigint").alias(f"n_{kind}") for kind in personal_data.BASE]
    return found.select("doc_id", *counts, F.sha2(personal_data.written_out(base), 256).alias("base_sha256"),
                        personal_data.written_out(F.col("personal")).alias("spans"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(common.read_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(common.read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_line_quality_rules, op2_toxicity_trees, op3_spaced_seed_leaks, op4_quality_gam, op5_tensored_minhash,
    op6_suffix_dedup, op7_best_fit_packing, op8_chat_windows,
    op9_url_rules, op10_prefix_token_counts, op11_personal_data, op12_source_divergence, op13_collocations)}

SQL = {
    "op1_line_quality_rules": r"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT d, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (SELECT d, i, w[i:i + 7] AS g FROM (SELECT d, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) > 7)),
again AS (SELECT d, unnest(list(i)) AS i FROM windows GROUP BY d, g HAVING count(*) > 1),
cover AS (SELECT d, count(DISTINCT i + k) AS n FROM again, range(0, 8) t(k) GROUP BY d),
lines AS (SELECT d, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w
          FROM (SELECT d, unnest(string_split(text, chr(10))) AS line FROM docs)),
counts AS (
  SELECT d, line, len(w) AS n, len(regexp_extract_all(line, '[!?]+')) AS exclaims,
         len(regexp_extract_all(line, '[|»›>]')) AS separators, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
         len(regexp_extract_all(line, '\p{Lu}')) AS capitals, len(regexp_extract_all(line, '\p{Ll}')) AS small,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS stutters
  FROM lines WHERE len(w) > 0),
judged AS (
  SELECT *, NOT regexp_matches(line, '[.!?:;…。！？]+["''”’»)\]]*(?:\s|$)')
    OR (exclaims >= 3 AND 100 * exclaims >= 30 * n) OR (separators >= 2 AND 100 * separators >= 10 * n)
    OR regexp_matches(line, '(?i){BOILERPLATE}') OR (symbols >= 2 AND 100 * symbols >= 10 * length(line))
    OR (capitals >= 10 AND 100 * capitals >= 80 * (capitals + small)) OR (stutters >= 3 AND 100 * stutters >= 30 * n) AS fails
  FROM counts),
by_line AS (SELECT d, count(*) - count(DISTINCT line) AS n_dup_lines, count_if(fails) AS n_failed_lines,
                   coalesce(sum(n) FILTER (WHERE fails), 0) AS lost_words FROM judged GROUP BY d),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(n_failed_lines, 0)::BIGINT AS n_failed_lines,
         coalesce(lost_words, 0)::BIGINT AS lost_words
  FROM words LEFT JOIN by_line USING (d) LEFT JOIN cover c USING (d))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost_words <= 50 * n_words AS kept
FROM base""".replace("{BOILERPLATE}", "|".join(quality_rules.BOILERPLATE)),
    "op5_tensored_minhash": r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM docs WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
          WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM docs
  UNION
  SELECT r.doc_id, l.y FROM reach r JOIN both_ways l ON l.x = r.other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)""",
    "op9_url_rules": """
WITH parsed AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1, 's'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1, 's') AS path FROM parsed),
judged AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged""",
    "op12_source_divergence": r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
words AS (SELECT d, lang, source, unnest(terms) AS term FROM docs),
terms AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 10),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN terms USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n_lang FROM terms GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(l.v, 0) AS v, coalesce(l.n_lang, 0) AS n_lang,
         coalesce((SELECT sum(n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0)::HUGEINT AS n_group
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs l USING (lang)),
shares AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n_group + 2 * g.v) AS p,
         1 + (1000000000::HUGEINT * (t.total + 2)) // (g.n_lang + 2 * g.v) AS q
  FROM groups g JOIN terms t USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, b.source, 0 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0),
own AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item COLLATE "binary") AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item COLLATE "binary") FROM own
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item COLLATE "binary") <= 10)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked""",
    "op13_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words), range(1, 6) t(k)
  WHERE i + k - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, sum(a) AS n FROM grams WHERE k = 1 GROUP BY lang),
frequent AS (SELECT * FROM grams WHERE a >= 100),
candidates AS (
  SELECT c.*, string_split(phrase, ' ') AS w FROM frequent c
  WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM frequent x WHERE x.lang = c.lang AND x.k > c.k AND x.a >= c.a
                              AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT c.lang, c.phrase, c.a, cut, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:], ' ') AS rest
  FROM candidates c, range(1, 5) t(cut) WHERE cut < k),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, n,
         (1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN totals USING (lang) JOIN frequent x ON x.lang = c.lang AND x.phrase = c.first
  JOIN frequent y ON y.lang = c.lang AND y.phrase = c.rest
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, cut) = 1)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "binary") AS rank FROM scored)
WHERE rank <= 2000""",
}
