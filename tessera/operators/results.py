"""Run-result analytics: outcome classifier, roll-ups per model/project, DETECT.

Scale notes: every roll-up is a ``groupBy`` with partial aggregation, so a
model or project holding a third of all rows is combined map-side. The
method index of A16 is a window over one item (one generated test class),
whose size is bounded by the class, not by the data. The project dimension
is a fixed five-row list and is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OUTCOMES = ("CORRECT", "PASS", "TE", "CE", "SE")


def classify_run(exit_code: Column, stdout: Column, code: Column, coverage_exit: Column,
                 coverage_stdout: Column) -> Column:
    """SE if the code holds ``Syntax Error``; CE if the test run exits with another code
    than 0; TE unless it prints ``Failing tests: 0``. Then the coverage run, a
    call of its own, tells CORRECT (``Lines covered: N`` with N != 0) from PASS;
    one that fails or prints no such line is PASS."""
    covered = F.regexp_extract(coverage_stdout, r"Lines covered:\s*(\d+)", 1)
    return (F.when(code.contains("Syntax Error"), F.lit("SE"))
            .when(exit_code != 0, F.lit("CE"))
            .when(~stdout.contains("Failing tests: 0"), F.lit("TE"))
            .when((coverage_exit == 0) & (covered != "") & (covered != "0"), F.lit("CORRECT"))
            .otherwise(F.lit("PASS")))


def project_of(revision: Column) -> Column:
    """text before the first ``_``; empty when there is no ``_``."""
    return F.when(revision.contains("_"), F.split_part(revision, F.lit("_"), F.lit(1))) \
        .otherwise(F.lit(""))


def _counts(result: Column) -> list[Column]:
    return [
        F.count_if(result == "CORRECT").alias("correct"),
        F.count_if(result.isin("CORRECT", "PASS")).alias("pass"),
        F.count_if(result == "TE").alias("te"),
        F.count_if(result == "CE").alias("ce"),
        F.count_if(result == "SE").alias("se"),
        F.count(F.lit(1)).alias("total"),
    ]


def with_percentages(df: DataFrame, digits: int = 2) -> DataFrame:
    """``x.xx%`` strings next to each counter (0 when total is 0)."""
    out = df
    for c in ("correct", "pass", "te", "ce", "se"):
        pct = F.coalesce(F.try_divide(F.col(c) * 100.0, F.col("total")), F.lit(0.0))
        out = out.withColumn(f"{c}_pct", F.format_string(f"%.{digits}f%%", pct))
    return out


def per_model(results: DataFrame, model: str = "model", result: str = "result") -> DataFrame:
    """A3: outcome counts per model; CORRECT also counts as PASS; unknown
    results only count in the total."""
    return results.groupBy(model).agg(*_counts(F.col(result)))


def per_project(results: DataFrame, projects: Sequence[str], revision: str = "revision",
                result: str = "result") -> DataFrame:
    """A4 + J11: counts per known project plus a ``total`` row; projects with
    no rows stay with zeros; unknown projects are ignored everywhere."""
    spark = results.sparkSession
    dim = spark.createDataFrame([(p, i) for i, p in enumerate(projects)], "project string, pos int")
    known = results.withColumn("project", project_of(F.col(revision))) \
        .join(F.broadcast(dim.select("project")), "project", "left_semi")
    # Rows are counted once; the total comes from the few rows of the projects.
    agg = known.groupBy("project").agg(*_counts(F.col(result)))
    agg = agg.rollup("project").agg(*[F.sum(c).alias(c) for c in ("correct", "pass", "te", "ce", "se", "total")]) \
        .withColumn("project", F.coalesce(F.col("project"), F.lit("total")))
    full = dim.unionByName(spark.createDataFrame([("total", len(projects))], "project string, pos int"))
    out = full.join(agg, "project", "left")
    return out.select("project", "pos", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                                          for c in ("correct", "pass", "te", "ce", "se", "total")])


# The columns of the outcome report.
REPORT_COLUMNS = ("Model Name", "CORRECT Count", "PASS Count", "TE Count", "CE Count", "SE Count", "Total",
                  "CORRECT %", "PASS %", "TE %", "CE %", "SE %")
REPORT_RULE = ("|------------|---------------|------------|----------|----------|----------|-------"
               "|-----------|--------|------|------|------|")


def markdown_table(rows: DataFrame, columns: Sequence[str], order: Sequence[str], titles: Sequence[str] | None = None,
                   rule: str | None = None) -> DataFrame:
    """One row ``report`` with a pipe table of a small frame, its rows in the given order.

    NULL cells are empty; a pipe inside a cell is escaped and a line end becomes a space.
    """
    titles = list(titles or columns)
    cells = [F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\R", " ")
             for c in columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = f"| {' | '.join(titles)} |\n" + (rule or "|" + "|".join("-" * (len(t) + 2) for t in titles) + "|") + "\n"
    rows = rows.select(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)]).alias("_o"), line.alias("_l"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_o", "_l"))), lambda s: F.concat(s["_l"], F.lit("\n")))
    return rows.agg(F.concat(F.lit(head), F.array_join(lines, "")).alias("report"))


def markdown_heading(text: Column, level: int = 1) -> Column:
    """A heading between blank lines' ends."""
    return F.concat(F.lit(f"\n{'#' * level} "), text, F.lit("\n"))


def markdown_code(text: Column, language: str = "java") -> Column:
    """A fenced code cell."""
    return F.concat(F.lit(f"```{language}\n"), text, F.lit("\n```\n"))


def markdown_text(text: Column) -> Column:
    """A line of text."""
    return F.concat(text, F.lit("\n"))


def markdown_document(blocks: Sequence[DataFrame]) -> DataFrame:
    """One row ``report``: the blocks (one-row frames ``report``) one after the other, a
    blank line after each table."""
    numbered = [b.select(F.lit(i).alias("_i"), F.when(F.col("report").startswith("| "), F.concat("report", F.lit("\n")))
                         .otherwise(F.col("report")).alias("_b")) for i, b in enumerate(blocks)]
    rows = numbered[0]
    for b in numbered[1:]:
        rows = rows.unionByName(b)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_b"))), lambda s: s["_b"]), "")
    return rows.agg(joined.alias("report"))


def markdown_report(summary: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The outcome report of a (small) summary frame as a one-row Markdown table."""
    counts = ["correct", "pass", "te", "ce", "se"]
    columns = [key, *counts, "total", *[f"{c}_pct" for c in counts]]
    return markdown_table(with_percentages(summary), columns, [order or key], REPORT_COLUMNS, REPORT_RULE)


def method_runs(results: DataFrame, item: Sequence[str], run: str = "run",
                order: str = "event_id") -> DataFrame:
    """Method position inside one run of one item (``method_idx`` from 1)."""
    w = Window.partitionBy(*item, run).orderBy(order)
    return results.withColumn("method_idx", F.row_number().over(w))


def detect(results: DataFrame, item: Sequence[str] = ("model", "revision"),
           run: str = "run", result: str = "result", order: str = "event_id") -> DataFrame:
    """A16 + J8: item verdict from its fixed and buggy runs.

    DETECT when some method is CORRECT on the fixed version and the method at
    the same position is present and not CORRECT on the buggy version. The
    buggy run only counts when some fixed method was CORRECT. Otherwise the
    item result is the last method's result of the last run performed; SE on
    any fixed method marks the whole item SE (the class does not compile).
    """
    item = list(item)
    m = method_runs(results, item, run, order)
    fixed = m.filter(F.col(run) == "fixed").select(*item, "method_idx", F.col(result).alias("fr"))
    buggy = m.filter(F.col(run) == "buggy").select(*item, "method_idx", F.col(result).alias("br"))
    pairs = fixed.join(buggy, [*item, "method_idx"], "full_outer")
    per = pairs.groupBy(*item).agg(
        F.bool_or(F.col("fr") == "SE").alias("_se"),
        F.bool_or(F.col("fr") == "CORRECT").alias("_rerun"),
        F.bool_or((F.col("fr") == "CORRECT") & F.col("br").isNotNull()
                  & (F.col("br") != "CORRECT")).alias("_detect"),
        F.max_by(F.col("fr"), F.when(F.col("fr").isNotNull(), F.col("method_idx"))).alias("_last_f"),
        F.max_by(F.col("br"), F.when(F.col("br").isNotNull(), F.col("method_idx"))).alias("_last_b"),
    )
    verdict = (F.when(F.coalesce(F.col("_se"), F.lit(False)), F.lit("SE"))
               .when(F.coalesce(F.col("_detect"), F.lit(False)), F.lit("DETECT"))
               .when(F.coalesce(F.col("_rerun"), F.lit(False)) & F.col("_last_b").isNotNull(),
                     F.col("_last_b"))
               .otherwise(F.coalesce(F.col("_last_f"), F.lit("none"))))
    return per.select(*item, verdict.alias("result"))


def elapsed_and_verdict(logs: DataFrame, key: str, ts: str, stdout: str) -> DataFrame:
    """Seconds between first and last log line per key, and ``ready``
    when every run printed ``Failing tests: 0``."""
    return logs.groupBy(key).agg(
        ((F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / 1e6).alias("elapsed_s"),
        F.when(F.count_if(~F.col(stdout).contains("Failing tests: 0")) == 0, F.lit("ready"))
        .otherwise(F.lit("fail")).alias("verdict"))
