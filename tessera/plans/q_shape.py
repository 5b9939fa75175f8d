"""Registered text-shaping queries (V4 chat, V1/V2 text) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import prompts as pm
from tessera.functions import text as tx
from tessera.operators.curate import length_percentiles
from tessera.plans.bindings import v1_corpus, v4_chat
from tessera.plans.sqlbind import V1, V4, toks


def q_prompt_assertion(spark, sf_dir):
    v = v4_chat(spark, sf_dir)
    return v.select("conv_id", "turn", pm.fill(pm.ASSERTION_PROMPT, source=F.col("source")).alias("prompt"))


def q_prompt_test_generation(spark, sf_dir):
    v = v4_chat(spark, sf_dir)
    return v.select("conv_id", "turn", pm.fill(pm.TEST_GENERATION_PROMPT, signature=F.col("signature"),
                                               source=F.col("source")).alias("prompt"))


def q_prompt_test_evolution(spark, sf_dir):
    v = v4_chat(spark, sf_dir)
    return v.select("conv_id", "turn", pm.fill(
        pm.TEST_EVOLUTION_PROMPT, focal_src=F.col("focal_src"),
        focal_tgt=F.coalesce("focal_tgt", F.lit("")), test_src=F.coalesce("test_src", F.lit(""))).alias("prompt"))


def q_chat_messages(spark, sf_dir):
    v = v4_chat(spark, sf_dir)
    msgs = pm.chat_messages(pm.fill(pm.ASSERTION_PROMPT, source=F.col("source")))
    return v.select("conv_id", "turn", F.size(msgs).cast("long").alias("n_messages"),
                    F.array_join(F.transform(msgs, lambda m: F.concat(m["role"], F.lit(": "), m["content"])),
                                 "\n").alias("rendered"))


def q_task_projection(spark, sf_dir):
    v = v4_chat(spark, sf_dir)
    return pm.project_task(v, "tu")


def q_normalize_source(spark, sf_dir):
    c = v1_corpus(spark, sf_dir)
    return c.select("id", tx.normalize_source(F.col("src")).alias("norm"))


def q_literal_filter_code(spark, sf_dir):
    c = v1_corpus(spark, sf_dir)
    return c.select("id", tx.filter_code(tx.py_literal_body(F.col("src"))).alias("code"))


def q_brace_placeholders(spark, sf_dir):
    v = v4_chat(spark, sf_dir)
    code = F.concat(F.lit("if (c == '{') { "), F.col("source"), F.lit(" } // '}'"))
    esc = tx.escape_braces(code)
    return v.select("conv_id", "turn", esc.alias("escaped"), (tx.restore_braces(esc) == code).alias("round_trip"))


def q_token_length_histogram(spark, sf_dir):
    c = v1_corpus(spark, sf_dir)
    n = tx.token_count("src", tx.ASCII_WS)
    return c.groupBy((F.floor(n / 64) * 64).cast("long").alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"), F.max(n).cast("long").alias("max_tokens"))


def q_token_length_percentiles(spark, sf_dir):
    p = length_percentiles(v1_corpus(spark, sf_dir), tx.token_count("src", tx.ASCII_WS))
    return p.select(*[F.round(c, 6).alias(c) for c in p.columns])


def _fill_sql(template: str, **cols: str) -> str:
    out, rest = [], template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        out += [_lit(pre), cols[name]]
    out.append(_lit(rest))
    return " || ".join(out)


def _lit(s: str) -> str:
    parts = s.replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{p}'" for p in parts)


_AG = _fill_sql(pm.ASSERTION_PROMPT, source="source")

SQL = {
    "prompt_assertion": f"WITH v AS ({V4}) SELECT conv_id, turn, {_AG} AS prompt FROM v",
    "prompt_test_generation": f"WITH v AS ({V4}) SELECT conv_id, turn, "
                              f"{_fill_sql(pm.TEST_GENERATION_PROMPT, signature='signature', source='source')} AS prompt FROM v",
    "prompt_test_evolution": f"WITH v AS ({V4}) SELECT conv_id, turn, "
                             f"{_fill_sql(pm.TEST_EVOLUTION_PROMPT, focal_src='focal_src', focal_tgt='coalesce(focal_tgt, \'\')', test_src='coalesce(test_src, \'\')')} AS prompt FROM v",
    "chat_messages": f"WITH v AS ({V4}) SELECT conv_id, turn, CAST(2 AS BIGINT) AS n_messages, "
                     f"'system: {pm.SYSTEM_MESSAGE}' || chr(10) || 'user: ' || {_AG} AS rendered FROM v",
    "task_projection": f"WITH v AS ({V4}) SELECT focal_src, focal_tgt, test_src, CAST(NULL AS VARCHAR) AS test_tgt FROM v",
    "normalize_source": f"""WITH c AS ({V1})
SELECT id, trim(regexp_replace(replace(replace(translate(src, chr(10) || chr(9), '  '), '{{', ' {{ '), '}}', ' }} '), '\\s+', ' ', 'g')) AS norm FROM c""",
    "literal_filter_code": f"""WITH c AS ({V1}),
e AS (SELECT id, replace(replace(replace(replace(src, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') AS s FROM c),
q AS (SELECT id, CASE WHEN contains(s, '''') AND contains(s, '"') THEN replace(s, '''', '\\''') ELSE s END AS s FROM e),
x AS (SELECT id, array_to_string(list_transform(string_split(s, ''), lambda c:
        CASE WHEN c <> '' AND (unicode(c) < 32 OR unicode(c) BETWEEN 127 AND 160 OR unicode(c) = 173)
             THEN '\\x' || printf('%02x', unicode(c)) ELSE c END), '') AS s FROM q)
SELECT id, regexp_replace(translate(s, chr(13) || chr(10) || chr(9), '   '), ' +', ' ', 'g') AS code FROM x""",
    "brace_placeholders": f"""WITH v AS ({V4}),
c AS (SELECT conv_id, turn, 'if (c == ''{{'') {{ ' || source || ' }} // ''}}''' AS code FROM v),
e AS (SELECT *, replace(replace(code, '''{{''', '6416864816840'), '''}}''', '6416864816841') AS escaped FROM c)
SELECT conv_id, turn, escaped,
       replace(replace(escaped, '6416864816840', '''{{'''), '6416864816841', '''}}''') = code AS round_trip FROM e""",
    "token_length_histogram": f"""WITH c AS ({V1}), n AS (SELECT len({toks('src')}) + 2 AS n FROM c)
SELECT CAST(floor(n / 64) * 64 AS BIGINT) AS bucket, count(*) AS rows, CAST(max(n) AS BIGINT) AS max_tokens FROM n GROUP BY 1""",
    "token_length_percentiles": f"""WITH c AS ({V1}), n AS (SELECT len({toks('src')}) + 2 AS n FROM c)
SELECT round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90,
       round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99 FROM n""",
}

QUERIES = {
    "prompt_assertion": q_prompt_assertion,
    "prompt_test_generation": q_prompt_test_generation,
    "prompt_test_evolution": q_prompt_test_evolution,
    "chat_messages": q_chat_messages,
    "task_projection": q_task_projection,
    "normalize_source": q_normalize_source,
    "literal_filter_code": q_literal_filter_code,
    "brace_placeholders": q_brace_placeholders,
    "token_length_histogram": q_token_length_histogram,
    "token_length_percentiles": q_token_length_percentiles,
}
