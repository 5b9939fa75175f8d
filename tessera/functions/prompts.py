"""Prompt templates (F13), chat messages (F14) and task projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prompt texts for the three tasks, as used at inference time.
ASSERTION_PROMPT = (
    "Given the following Java test case, complete the <AssertPlaceHolder> with an appropriate assertion.\n"
    "Your task is to generate the correct assertion statement that should replace the <AssertPlaceHolder>.\n"
    "The output should only include the generated assertion statement, wrapped in a Java code cell.\n"
    "### Test Case\n{source}")
TEST_GENERATION_PROMPT = (
    "Please write JUnit 3 unit test for function: `{signature}`, output completed test code in a java "
    "code cell.\n The full content is given below: \n {source}")
TEST_EVOLUTION_PROMPT = (
    "Please write the updated test case based on original method, updated method and original test case. \n"
    "Output updated test case in a java code cell.\n\n"
    "## Original Method\n{focal_src}\n## Updated Method\n{focal_tgt}\n## Original Test Case\n{test_src}")
SYSTEM_MESSAGE = "You are a helpful assistant."

# Task -> the columns a training example is built from.
TASK_COLUMNS = {
    "ag": ("source", "target"),
    "tg": ("src_fm_fc_ms_ff", "target"),
    "tu": ("focal_src", "focal_tgt", "test_src", "test_tgt"),
}


def fill(template: str, **cols: Column) -> Column:
    """Fill ``{name}`` slots of a template with column values (JVM-side concat)."""
    parts, rest = [], template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(pre), cols[name]]
    parts.append(F.lit(rest))
    return F.concat(*parts)


def chat_messages(prompt: Column, system: str = SYSTEM_MESSAGE) -> Column:
    """``[system, user]`` message list."""
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
                   F.struct(F.lit("user").alias("role"), prompt.alias("content")))


def project_task(df: DataFrame, task: str) -> DataFrame:
    """Keep the task's columns; a missing column becomes NULL."""
    cols = []
    for c in TASK_COLUMNS[task]:
        cols.append(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c))
    return df.select(*cols)
