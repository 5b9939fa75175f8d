"""Structured Streaming over an append-only result folder.

New ``<model>_result.jsonl`` files dropped into a folder are counted
incrementally; the checkpoint replaces the reference's hard-coded restart
index, and ``(model, id, revision)`` de-duplication makes a replayed file
harmless. State lives in the checkpoint under the shared folder named by
``spark.checkpoint.dir`` so a lost executor or a restarted driver resumes.

State is bounded: a key is remembered for ``remember`` after it arrived and then
given up, so the state holds the distinct results of that stretch of time,
whatever the stream's age. A row that is replayed later than that counts again;
choose ``remember`` longer than any replay. The counts hold one row per model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.results import per_model
from tessera.sources.files import RESULT_SCHEMA
from tessera.sources.versions import VersionedFolder

KEY = ["model", "id", "revision"]


def result_stream(spark: SparkSession, folder: str, suffix: str = "_result.jsonl",
                  max_files: int = 1000, arrived: Column | None = None) -> DataFrame:
    """Streaming rows ``(model, id, revision, result, arrived)`` from the folder.

    ``arrived`` is the time of the batch that read the row: it never runs
    backwards, so no row comes too late to be counted.
    """
    s = (spark.readStream.schema(RESULT_SCHEMA).option("pathGlobFilter", f"*{suffix}")
         .option("maxFilesPerTrigger", max_files).json(folder))
    model = F.regexp_extract(F.col("_metadata.file_name"), "^(.*)" + suffix.replace(".", r"\.") + "$", 1)
    time = F.current_timestamp() if arrived is None else arrived
    return s.select(model.alias("model"), "id", "revision", "result", time.alias("arrived"))


def first_results(rows: DataFrame, remember: str = "30 days") -> DataFrame:
    """The first row of each key within ``remember``; state older than that is dropped."""
    return rows.withWatermark("arrived", remember).dropDuplicatesWithinWatermark(KEY)


def running_outcome_counts(spark: SparkSession, folder: str, checkpoint: str, output: str,
                           available_now: bool = True, remember: str = "30 days", keep: int = 3,
                           max_files: int = 1000, arrived: Column | None = None) -> StreamingQuery:
    """X1 + X2: per-model outcome counts, published as a whole table per batch.

    Every micro-batch publishes the complete counts as a version of
    ``VersionedFolder(output)``, so a reader never meets a half-written table; a
    batch that is run again after a failure finds its version published and
    leaves it. All but the last ``keep`` versions are removed.
    """
    rows = first_results(result_stream(spark, folder, max_files=max_files, arrived=arrived), remember)
    counts = per_model(rows)

    def publish(batch: DataFrame, epoch: int) -> None:
        versions = VersionedFolder(batch.sparkSession, output)
        at = versions.current()
        if at is None or at[0] < epoch:
            versions.publish(batch, epoch)
        versions.vacuum(keep)

    w = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint) \
        .foreachBatch(publish)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def latest_counts(spark: SparkSession, output: str) -> DataFrame | None:
    """The counts that were published last; None before the first batch."""
    return VersionedFolder(spark, output).read()
