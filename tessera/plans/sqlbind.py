"""DuckDB twins of the bindings in ``tessera.plans.bindings`` (CTE bodies).

The oracle SQL is written independently of the Spark code: plain window
functions and joins over the pre-registered driver views.
"""

WS = r"'[ \t\r\n\f]+'"


def toks(expr: str) -> str:
    """ASCII-whitespace tokens of ``expr`` (empty pieces dropped)."""
    return f"list_filter(string_split_regex({expr}, {WS}), lambda x: x <> '')"


V1 = """
SELECT doc_id AS id, source || '_' || CAST(doc_id // 1000 AS VARCHAR) AS repo,
       source || '_' || CAST(doc_id // 1000 AS VARCHAR) || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.json' AS path,
       CASE WHEN doc_id % 53 = 7 THEN '' WHEN doc_id % 59 <> 11 THEN text END AS src,
       string_split(text, chr(10))[1] AS target
FROM documents
"""

V2 = f"""
SELECT d.doc_id AS idx, d.doc_id AS id,
       d.source || '_' || CAST(d.doc_id % 7 AS VARCHAR) AS revision,
       d.text AS label,
       CASE d.doc_id % 4
         WHEN 0 THEN d.text
         WHEN 1 THEN array_to_string(list_slice({toks('d.text')}, 6, 2147483647), ' ')
         WHEN 2 THEN coalesce(p.text, '')
         ELSE replace(d.text, 'the', 'of') END AS predict,
       coalesce(n.text, '') AS ref2
FROM documents d
LEFT JOIN documents p ON p.doc_id = d.doc_id - 1
LEFT JOIN documents n ON n.doc_id = d.doc_id + 1
"""

V3 = """
SELECT event_id, ts,
  'm' || CAST(user_id % 6 AS VARCHAR) AS model,
  CASE WHEN event_id % 97 = 0 THEN 'unknown'
       WHEN event_id % 89 = 0 THEN 'math_' || CAST(event_id // 400 AS VARCHAR)
       ELSE (['chart', 'cli', 'csv', 'gson', 'lang'])[user_id % 5 + 1] || '_' || CAST(event_id // 400 AS VARCHAR)
  END AS revision,
  CASE WHEN event_id % 2 = 0 THEN 'fixed' ELSE 'buggy' END AS run,
  CASE event_type WHEN 'purchase' THEN 'CORRECT' WHEN 'view' THEN 'PASS' WHEN 'click' THEN 'TE'
                  WHEN 'signup' THEN 'CE' WHEN 'error' THEN 'SE' END AS result
FROM events
"""

V8_LOGS = """
SELECT event_id,
  CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS exit_code,
  'Running tests...' || chr(10) || 'Failing tests: ' || CAST(event_id % 3 AS VARCHAR) || chr(10) AS stdout,
  CASE WHEN event_id % 11 = 3 THEN 1 ELSE 0 END AS coverage_exit,
  CASE WHEN event_id % 13 = 6 THEN ''
       ELSE 'Lines covered: ' || coalesce(json_extract_string(props, '$.k'), '0') || chr(10) END AS coverage_stdout,
  CASE WHEN event_type = 'error' THEN 'class T { Syntax Error }' ELSE 'class T { void t() {} }' END AS code
FROM events
"""

V5 = """
SELECT user_id % 20 + 20 * (event_id // 10000) AS run,
  row_number() OVER (PARTITION BY user_id % 20 + 20 * (event_id // 10000) ORDER BY ts, event_id) AS step,
  CASE WHEN event_id % 4 = 0 THEN 'eval_loss' ELSE 'loss' END AS metric,
  value
FROM events
"""


def rot(ids: str, b: str) -> str:
    return (f"list_concat(list_slice({ids}, {b} + 1, len({ids})), "
            f"list_slice({ids}, 1, least({b}, len({ids}))))")


V7 = f"""
SELECT idx, ids, list_slice(ids, 1, k) AS p1, list_slice(ids, k + 1, 2 * k) AS p2,
       list_slice(ids, 2 * k + 1, len(ids)) AS p3, CAST(floor(idx / 16) AS BIGINT) AS batch,
       list_concat(list_resize([]::INTEGER[], CAST(idx % 3 AS INTEGER), 0), ids) AS padded_pred
FROM (SELECT idx, ids, CAST(floor(len(ids) / 3) AS INTEGER) AS k
      FROM (SELECT doc_id AS idx,
                   list_transform({toks('text')}, lambda t: CAST(length(t) * 31 + unicode(t) AS INTEGER)) AS ids
            FROM documents))
"""

V7_BEAMS = f"""
SELECT idx AS sample, beam, {rot('ids', 'beam')} AS tokens, {rot('ids', 'CAST(idx % 5 AS INTEGER)')} AS label
FROM (SELECT idx, ids FROM ({V7})), (SELECT unnest(range(0, 4)) AS beam)
"""

V8_CHAT = """
SELECT conv_id, turn,
  CASE WHEN conv_id % 3 <> 0
       THEN 'Here is the test:' || chr(10) || '```java' || chr(10) || text || chr(10) || '```' || chr(10) || 'Done.'
       ELSE text END AS reply
FROM conversations WHERE role = 'assistant'
"""

V2_PRED = f"""
SELECT id, revision, label, ord,
  CASE WHEN id % 6 <> 5 THEN p END AS predict,
  CASE WHEN id % 6 = 5 THEN string_split(p, ' ') END AS items
FROM (
  SELECT id, revision, label, 1 AS ord, CASE WHEN id % 11 = 0 THEN 'nothing' ELSE predict END AS p FROM ({V2})
  UNION ALL
  SELECT id, revision, label, 2, predict || ' (retry)' FROM ({V2}) WHERE id % 5 = 0)
"""

V6 = """
SELECT class_id, n, 'm' || CAST(n AS VARCHAR) AS name, n * 10 AS start,
  CAST(n * 10 + floor(l_quantity / 4) AS BIGINT) AS "end", modifiers, body, params, return_type,
  import_list, l_linenumber, 'proj' || CAST(class_id % 7 AS VARCHAR) AS project,
  'org.example.p' || CAST(class_id % 3 AS VARCHAR) AS package_info
FROM (
  SELECT l.l_orderkey AS class_id,
    row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey,
                       l.l_extendedprice, l.l_shipdate) AS n,
    l.l_quantity, l.l_linenumber,
    CASE l.l_returnflag WHEN 'A' THEN ['public'] WHEN 'N' THEN ['public', 'static'] ELSE ['private'] END AS modifiers,
    p.p_name AS body, [p.p_type] AS params,
    CASE WHEN l.l_linestatus = 'F' THEN NULL ELSE 'int' END AS return_type,
    [p.p_brand, p.p_type, 'org.junit.Test'] AS import_list
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)
"""

V4 = f"""
SELECT conv_id, turn, text AS source, next1 AS target,
  array_to_string(list_slice({toks('text')}, 1, 5), ' ') AS signature,
  text AS focal_src, next1 AS focal_tgt, next2 AS test_src
FROM (SELECT *, lead(text, 1) OVER (PARTITION BY conv_id ORDER BY turn) AS next1,
             lead(text, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS next2 FROM conversations)
WHERE role = 'user'
"""

V9_FILES = """
SELECT page_id, package, 'Page' || CAST(page_id AS VARCHAR) AS class_name,
  (['src/main/java', 'src/java', 'source/org/jfree', 'src/test/java'])[page_id % 4 + 1] || '/' ||
    replace(package, '.', '/') || '/' ||
    CASE WHEN page_id % 10 = 0 THEN 'package-info.java' ELSE 'Page' || CAST(page_id AS VARCHAR) || '.java' END AS path,
  contains(html, '<footer') AS changed
FROM (SELECT page_id, html,
        'org.site.' || CASE WHEN regexp_extract(url, '\\.[a-z]+/([a-z]{2})/', 1) = '' THEN 'xx'
                            ELSE regexp_extract(url, '\\.[a-z]+/([a-z]{2})/', 1) END AS package
      FROM pages)
"""
