"""Corpus pipeline: the stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns what it kept, in the columns
of ``documents``; the last returns packed pieces. Between stages the rows are
written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common, stages

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("near_duplicates", stages.near_duplicates),
    ("suffix_repeats", stages.suffix_repeats),
    ("decontamination", stages.decontamination),
    ("best_fit_packing", stages.best_fit_packing),
]

# The last stages (token ids, byte-level matches across documents) are beyond SQL;
# tests/llm/test_pipeline.py holds every stage and the whole against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with common.own_folder(spark):  # what only this stage needed goes with it
            docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}", outside=True)
    return STAGES[-1][1](spark, docs, sf_dir)
