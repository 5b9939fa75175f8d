"""Pipeline stages: operators applied to documents, returning the documents kept.

Each takes (spark, docs, sf_dir) and returns rows with the columns of ``docs``
(the last one packed pieces). The other columns travel in one struct, so their
names cannot clash with an operator's own.

Rows: null texts count as empty; an empty table gives none at every stage; a
null doc_id, repeated rows, ties and very long texts are as the stage's operator
has them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, minhash, packing, suffix_dedup
from . import quality_rules as rules


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("text", "n_chars")]


def _with_text(rows: DataFrame, docs: DataFrame, text) -> DataFrame:
    """The columns of ``docs`` from the struct ``carried`` and a new text; n_chars follows the text."""
    columns = []
    for field in docs.schema.fields:
        if field.name == "text":
            value = text
        elif field.name == "n_chars":
            value = F.length(text).cast(field.dataType)
        else:
            value = F.col("carried").getField(field.name)
        columns.append(value.alias(field.name))
    return rows.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without their failing lines."""
    rows = docs.select(F.struct(*_others(docs)).alias("carried"), "text")
    cleaned = rules.clean_lines(rows, keep=("carried",), with_text=True).filter("kept")
    return _with_text(cleaned, docs, F.col("clean_text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group; rows without doc_id or without a word stay."""
    return minhash.one_of_each(docs)


def suffix_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; those left without a word go."""
    rows = docs.select("doc_id", F.struct(*_others(docs)).alias("carried"), "text")
    cut = suffix_dedup.remove_repeats(rows, keep=("carried",)).withColumn("carried", F.col("carried.carried"))
    cut = cut.filter((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"\S"))
    return _with_text(cut, docs, F.col("kept_text"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with a benchmark item."""
    rows = docs.select(F.struct(*_others(docs)).alias("carried"), "text")
    marked = decontaminate.with_leaks(rows, common.read_table(spark, sf_dir, "benchmark"), keep=("carried", "text"))
    return _with_text(marked.filter(F.size("leaks") == 0), docs, F.col("text"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, with their places in the packed sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
