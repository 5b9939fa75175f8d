"""Prediction post-processing: code extraction, repair, joins back to the corpus.

Joins are plain equi-joins (AQE picks broadcast or sort-merge from measured
sizes and splits skewed keys). "Last row wins" rules are ``max_by`` over an
explicit order column, which aggregates partially map-side, so a key repeated
a billion times is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import bound

FENCE = r"(?s)```java\s+(.*?)\s+```"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(col: Column | str) -> Column:
    """Python ``str.strip()``: Unicode whitespace on either side."""
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


def extract_fenced_code(text: Column | str, missing: str = "nothing") -> Column:
    """the first ```` ```java ```` block, stripped; ``missing`` if none."""
    t = _c(text)
    return F.when(t.rlike(FENCE), strip_ws(F.regexp_extract(t, FENCE, 1))).otherwise(F.lit(missing))


def tail_from(code: Column | str, marker: str = "public void") -> Column:
    """F8: text from the first ``marker`` to the end, else the input."""
    c = _c(code)
    pos = F.instr(c, marker)
    return F.when(pos > 0, F.substring(c, pos, F.lit(2147483647))).otherwise(c)


def repair_truncated(code: Column | str) -> Column:
    """keep text ending with ``}``; else cut after the last ``;`` and close
    with ``}``; else append ``}``."""
    c = _c(code)
    cut = F.left(c, F.length(c) - F.length(F.substring_index(c, ";", -1)))
    return (F.when(c.endswith("}"), c)
            .when(c.contains(";"), F.concat(cut, F.lit("}")))
            .otherwise(F.concat(c, F.lit("}"))))


def rename_first(code: Column | str, name: Column | str, prefix: str = "test",
                 suffix: str = "") -> Column:
    """rewrite the first occurrence of ``name`` as prefix+name+suffix."""
    c, n = _c(code), _c(name)
    p = F.position(n, c)  # 1-based, 0 if absent
    return F.when((p > 0) & (F.length(n) > 0), F.overlay(
        c, F.concat(F.lit(prefix), n, F.lit(suffix)), p, F.length(n))).otherwise(c)


def flatten_predict(text: Column | str, items: Column | str) -> Column:
    """a string prediction stays; a list becomes ``@`` plus the middle
    items joined by spaces (first replaced, last dropped)."""
    t, a = _c(text), _c(items)
    n = F.size(a)
    from_list = F.when(n >= 1, F.array_join(
        F.slice(F.concat(F.array(F.lit("@")), F.slice(a, 2, F.greatest(n - 1, F.lit(0)))),
                1, F.greatest(n - 1, F.lit(0))), " "))
    return F.coalesce(t, from_list)


def attach_predictions(corpus: DataFrame, preds: DataFrame, keys: Sequence[str],
                       value: str, order: str) -> DataFrame:
    """Corpus LEFT JOIN predictions on ``keys``; duplicate keys keep the
    prediction with the largest ``order`` (the last one written)."""
    last = preds.groupBy(*keys).agg(F.max_by(F.col(value), F.col(order)).alias("_pred"))
    return corpus.join(last, list(keys), "left").withColumn("target", F.col("_pred")).drop("_pred")


def replace_by_label(corpus: DataFrame, preds: DataFrame, target: str, label: str,
                     value: str, order: str) -> DataFrame:
    """Where the corpus target equals a prediction's label, the target
    becomes that prediction (single step; the last matching prediction wins).
    Texts meet by their SHA-256 digests."""
    last = preds.groupBy(F.sha2(F.col(label), 256).alias("_lbl")).agg(
        F.max_by(F.col(value), F.col(order)).alias("_new"))
    j = corpus.withColumn("_lbl", F.sha2(F.col(target), 256)).join(last, "_lbl", "left")
    return j.withColumn(target, F.coalesce(F.col("_new"), F.col(target))).drop("_lbl", "_new")


def retry_set(corpus: DataFrame, earlier: DataFrame, keys: Sequence[str], value: str,
              missing: str = "nothing") -> DataFrame:
    """J3 + P14: corpus rows whose earlier prediction is ``missing``."""
    todo = earlier.filter(F.col(value) == missing).select(*keys).distinct()
    return corpus.join(todo, list(keys), "left_semi")


def resume_filter(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows not yet present in the sink (restart without a hard index)."""
    return todo.join(done.select(*keys), list(keys), "left_anti")


def best_beam(beams: DataFrame, sample: str, beam: str, tokens: str, label: str) -> DataFrame:
    """J9 + O7: per sample, the first beam equal to the label, else beam 0.
    ``beams`` holds ``(sample, beam, tokens)`` and ``label`` per row."""
    hit = F.col(tokens) == F.col(label)
    rank = F.struct(F.when(hit, F.lit(0)).otherwise(F.lit(1)).alias("miss"), F.col(beam).alias("b"))
    pick = beams.filter(hit | (F.col(beam) == 0)).groupBy(sample).agg(
        F.min_by(F.struct(F.col(beam).alias("beam"), F.col(tokens).alias("tokens"),
                          hit.alias("xmatch")), rank).alias("best"))
    return pick.select(sample, "best.beam", "best.tokens", "best.xmatch")


def head_rows(df: DataFrame, order: str, n: int, short: bool = False) -> DataFrame:
    """O2: the first ``n`` rows by ``order`` (a distributed top-k); fails if there are fewer.

    The check is a job of its own and reads no more than it needs; ``short``
    leaves it out, and a shorter input comes whole.
    """
    if not short and df.select(order).limit(n).count() < n:
        raise ValueError(f"fewer than {n} rows")
    return df.orderBy(order).limit(n)


def top1(returned: Column | str) -> Column:
    """The first returned sequence; NULL if there is none."""
    return F.try_element_at(_c(returned), F.lit(1))


def returned(sequences: Column | str) -> tuple[Column, Column]:
    """``(predict, items)`` of the returned sequences: the item itself if there is one, else
    the whole list (an empty one included) and no single prediction."""
    s = _c(sequences)
    return F.when(F.size(s) == 1, F.try_element_at(s, F.lit(1))), F.when(F.size(s) != 1, s)


def test_class(package: Column, imports: Column, class_name: Column, code: Column,
               frame_imports: Sequence[str] = ("junit.framework.TestCase", "junit.framework.Test",
                                               "junit.framework.TestSuite", "junit.textui.TestRunner",
                                               "java.io.*", "java.util.*")) -> Column:
    """F12 + P10: a JUnit3 test class around ``code`` (4-space indented lines);
    imports holding ``org.junit.Assert`` or ``org.junit.Test`` are dropped."""
    kept = F.filter(imports, lambda x: ~x.contains("org.junit.Assert") & ~x.contains("org.junit.Test"))
    all_imports = F.concat(kept, F.array(*[F.lit(i) for i in frame_imports]))
    import_lines = F.concat(F.lit("import "), F.array_join(all_imports, ";\nimport "), F.lit(";\n"))
    if not frame_imports:
        import_lines = F.when(F.size(F.array_compact(kept)) == 0, F.lit("")).otherwise(import_lines)
    body = F.concat(F.lit("    "), F.replace(code, F.lit("\n"), F.lit("\n    ")), F.lit("\n"))
    return F.concat(F.lit("package "), package, F.lit(";\n\n"), import_lines, F.lit("\n"),
                    F.lit("import "), package, F.lit(".*;\n\n"),
                    F.lit("public class "), class_name, F.lit(" extends TestCase {\n"), body, F.lit("}\n"))


def matching_close(text: Column | str, marker: str, open_: str = "{", close: str = "}") -> Column:
    """0-based position where bracket depth first returns to zero,
    counted from the first ``marker``; NULL when it never does.

    One pass over the runs that end in a bracket with a scalar state (depth,
    offset, found), so it is linear in the text length.
    """
    t = _c(text)
    start = F.instr(t, marker)  # 1-based
    rest = F.substring(t, start, F.lit(2147483647))
    o, c = open_.replace("\\", "\\\\"), close.replace("\\", "\\\\")
    runs = F.regexp_extract_all(rest, F.lit(f"[^\\{o}\\{c}]*+[\\{o}\\{c}]"), 0)
    init = F.struct(F.lit(0).alias("d"), F.lit(0).alias("off"), F.lit(None).cast("int").alias("found"))

    def step(acc, r):
        closes = r.endswith(close)
        off = acc["off"] + F.length(r)
        return F.when(acc["found"].isNotNull(), acc).otherwise(F.struct(
            (acc["d"] + F.when(closes, -1).otherwise(1)).alias("d"), off.alias("off"),
            F.when(closes & (acc["d"] == 1), off - 1).alias("found")))

    return F.aggregate(runs, init, step)["found"] + F.nullif(start, F.lit(0)) - 1


def _lstrip_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def line_span(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start..end`` (1-based) of ``text``, with ``start`` moved up
    over directly preceding annotation lines (``@...``) and every line
    dedented by the first line's indentation."""
    lines = F.split(text, "\n")
    above = F.reverse(F.slice(lines, 1, F.greatest(start - 1, F.lit(0))))
    init = F.struct(F.lit(0).alias("n"), F.lit(False).alias("stop"))

    def step(acc, ln):
        ann = ln.rlike(r"(?U)^\s*+@")
        return F.when(acc["stop"], acc).when(ann, F.struct((acc["n"] + 1).alias("n"), F.lit(False).alias("stop"))) \
            .otherwise(F.struct(acc["n"].alias("n"), F.lit(True).alias("stop")))

    def dedented(content):
        first = F.get(content, F.lit(0))
        indent = F.length(first) - F.length(_lstrip_ws(first))
        return bound(indent, lambda k: F.array_join(F.transform(content, lambda ln: F.substring(ln, k + 1, 2147483647)), "\n"))

    s = start - F.aggregate(above, init, step)["n"]
    content = bound(s, lambda at: F.slice(lines, at, F.greatest(end - at + 1, F.lit(0))))
    return bound(content, dedented)
