"""Session helpers: a local session for tests/bench and table loading."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Tables the driver generates under each scale-factor directory.
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None,
                  app: str = "tessera") -> SparkSession:
    """A local session configured the way the library expects a cluster to be.

    On a real cluster the same settings belong in spark-defaults; nothing here
    is local-only except the master URL and the fallback checkpoint folder.
    """
    if shuffle_partitions is None:
        shuffle_partitions = int(cpus) if str(cpus).isdigit() else 8
    parts = shuffle_partitions
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.legacy.javaCharsets", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.tessera.scanPartitions", str(parts))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the operator sets this to shared storage; it is only filled
    in here (with a fresh local folder) when it is unset, as in tests.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="tessera-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    try:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
    except Exception:  # noqa: BLE001 - no SparkContext on a Connect session
        pass
    return current


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one driver table.

    A scan has one task per file split. Where files are single row groups, as
    the small test files are, ``spark.tessera.scanPartitions`` (set by
    ``local_session``, unset on a cluster) spreads the rows over that many
    tasks; the plan follows from this setting, never from the input's size.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    spread = spark.conf.get("spark.tessera.scanPartitions", None)
    return df.repartition(int(spread)) if spread else df
