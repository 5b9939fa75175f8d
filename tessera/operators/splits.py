"""Dataset splits: seeded ranks, count-based and greedy repo splits, validation cut.

Seeded order is ``md5(seed|key)`` then ``key`` (reproducible in any engine).

Scale notes
-----------
``hash_rank`` gives every row its exact global position in that order without
a single-partition window: rows fall into 65,536 buckets by the first four hex
digits of the digest (uniform for distinct keys), a bucket table of at most
65,536 rows yields each bucket's starting offset, and the rank inside a
bucket is a window over that bucket only (about n/65,536 rows).

The greedy split (O5) is sequential by definition: each decision depends on
all earlier ones, but only through how much room train and eval have left. So
repos fall into ``16 ** WALK_HEX`` buckets of the seeded order, and the driver walks over a
summary of the buckets (counts, sums and extremes by power of two of the size:
a fixed number of rows at any input). A bucket whose repos fit whole is settled
by the rooms it starts with; only a bucket in which a limit could be crossed is
folded repo by repo, in one task that holds two numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.curate import hash_order
from tessera.session import ensure_checkpoint_dir

BUCKET_HEX = 4  # 16^4 = 65,536 buckets
WALK_HEX = 3


def hash_rank(df: DataFrame, key: str, seed: str = "42", rank: str = "rank") -> DataFrame:
    """Exact 0-based rank of each row by ``(md5(seed|key), key)``."""
    h = hash_order(F.col(key), seed)
    x = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, BUCKET_HEX))
    buckets = x.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    offs = buckets.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))).select("_b", "_off")
    # at most 16^BUCKET_HEX rows: a proven bound, so broadcasting it is safe
    y = x.join(F.broadcast(offs), "_b")
    within = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1
    return y.withColumn(rank, (F.col("_off") + within).cast("long")).drop("_h", "_b", "_off")


def validation_cut(df: DataFrame, key: str, seed: str = "42", divisor: int = 9) -> DataFrame:
    """O3: after a seeded shuffle the first ``floor(n / divisor)`` rows are
    validation, the rest train."""
    total = df.agg(F.count(F.lit(1))).scalar()  # scalar subquery, one value
    return hash_rank(df, key, seed).withColumn(
        "split", F.when(F.col("rank") < F.floor(total / divisor), F.lit("validation"))
        .otherwise(F.lit("train")))


def split_by_count(units: DataFrame, key: str, seed: str = "42",
                   train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """Shuffled units; first ``round(train n)`` train, next ``round(valid n)``
    eval, rest test (Python rounding: half to even)."""
    total = units.agg(F.count(F.lit(1))).scalar()  # scalar subquery, one value
    a = F.bround(total * train, 0)
    b = F.bround(total * valid, 0)
    return hash_rank(units, key, seed).withColumn(
        "split", F.when(F.col("rank") < a, F.lit("train"))
        .when(F.col("rank") < a + b, F.lit("eval")).otherwise(F.lit("test")))


def greedy_split(sizes: DataFrame, key: str, size: str, seed: str = "42",
                 train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """Walk repos in seeded order; a repo goes to train if train still fits
    ``round(train * total)`` rows, else to eval if eval fits
    ``round(valid * total)``, else to test. Returns ``(key, size, split)``.

    ``sizes`` has one row per repo; a null size counts as 0. The summary per repo
    is checkpointed, as it is read once for the buckets and once for the result.
    """
    ensure_checkpoint_dir(sizes.sparkSession)
    h = hash_order(F.col(key), seed)
    repos = sizes.select(h.alias("h"), F.substring(h, 1, WALK_HEX).alias("bucket"), F.col(key).alias("k"),
                         F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias("n")).checkpoint()
    power = F.when(F.col("n") > 0, F.floor(F.log2("n"))).otherwise(-1).cast("int")
    summary = repos.groupBy("bucket", power.alias("p")).agg(
        F.count(F.lit(1)).alias("repos"), F.sum("n").alias("total"), F.min("n").alias("least"), F.max("n").alias("most"))
    buckets: dict[str, list] = {}
    for row in summary.collect():  # at most 16 ** WALK_HEX * 64 rows
        buckets.setdefault(row["bucket"], []).append(row)
    total = sum(r["total"] for rows in buckets.values() for r in rows)
    rooms = (round(train * total), round(valid * total))
    settled, folded = [], []
    for bucket in sorted(buckets):
        taken = _whole_bucket(buckets[bucket], *rooms)
        if taken is None:
            walked = repos.filter(F.col("bucket") == bucket).repartition(1).sortWithinPartitions("h", "k")
            walked = walked.select("k", "n").mapInPandas(_walk(*rooms), walked.select("k", "n", F.lit("").alias("split")).schema)
            folded.append(walked.checkpoint())
            sums = folded[-1].groupBy("split").agg(F.sum("n").alias("n")).collect()
            by_split = {r["split"]: r["n"] for r in sums}
            taken = (by_split.get("train", 0), by_split.get("eval", 0))
        else:
            settled.append((bucket, *rooms))
        rooms = (rooms[0] - taken[0], rooms[1] - taken[1])
    # At most 16 ** WALK_HEX rows, so broadcasting them is safe.
    rule = F.broadcast(sizes.sparkSession.createDataFrame(settled, "bucket string, t long, v long"))
    split = F.when(F.col("n") <= F.col("t"), "train").when(F.col("n") <= F.col("v"), "eval").otherwise("test")
    out = repos.join(rule, "bucket").select("k", "n", split.alias("split"))
    for part in folded:
        out = out.unionByName(part)
    return out.select(F.col("k").alias(key), F.col("n").alias(size), "split")


def _whole_bucket(rows: list, train: int, valid: int) -> tuple[int, int] | None:
    """What train and eval take of a bucket if every repo that fits its room at the start still
    fits in the end, whatever the order; None if that is not sure."""
    taken = [0, 0]
    for r in rows:
        for which, room in enumerate((train, valid)):
            if r["most"] <= room:
                taken[which] += r["total"]
                break
            if r["least"] <= room:
                return None  # some of these fit and some do not
    return (taken[0], taken[1]) if taken[0] <= train and taken[1] <= valid else None


def _walk(train: int, valid: int):
    """Label repos that come in seeded order, from the given rooms."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        room = [train, valid]
        for frame in frames:
            labels = []
            for n in frame["n"].tolist():
                at = 0 if n <= room[0] else 1 if n <= room[1] else 2
                if at < 2:
                    room[at] -= n
                labels.append(("train", "eval", "test")[at])
            yield frame.assign(split=labels)

    return run


def assign_split(rows: DataFrame, repo_split: DataFrame, key: str) -> DataFrame:
    """Attach each row's split by its repo (AQE broadcasts the map when
    its measured size is small)."""
    return rows.join(repo_split.select(key, "split"), key, "inner")
