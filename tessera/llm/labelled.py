"""Labelled rows for the two classifiers: a bounded sample, learnt from on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, bound: int) -> DataFrame:
    """(doc_id, text, y, part) of ``bound`` labelled documents at most, written to the shared folder.

    Rows whose crc32(doc_id as text) mod ``modulus`` is ``held_out`` are never
    among them. Above the bound the documents with the smallest hashes of doc_id
    are taken. Rows without doc_id or label are left out; of several labels for
    one document the smallest counts, of several texts the one that hashes least
    (repeated rows are one). ``part`` in 0..99 deals them out at random.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.filter(C.crc_bucket(F.col("doc_id"), modulus) != held_out)
    known = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    # At most ``bound`` rows of two numbers: the size of what is broadcast is fixed.
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    chosen = chosen.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(100)).cast("int")
    return C.written(chosen.withColumn("part", part), f"labelled-{label}")
