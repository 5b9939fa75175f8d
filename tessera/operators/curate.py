"""Corpus curation: exact dedup, shape/length filters, repo policy, funnel.

One lazy plan gives every input row exactly one fate (``stage``):

``empty``        dedup key missing or blank (not counted as dedup loss)
``dedup``        a later copy of an already seen source text
``construct``    first copy, but the target fails the shape predicate
``token_length`` shape ok, token length out of range
``under``        survivor of a repo with fewer than ``lower`` survivors
``over``         survivor of a capped repo that was not sampled
``kept``         final row

Scale notes
-----------
* Dedup shuffles a 256-bit digest of the text plus the path, never the text:
  ``min(path)`` per digest is a partial (map-side) aggregate, and the join back
  is on ``(digest, path)`` which is unique, so a text copied a billion times
  does not land in one task.
* Per-repo survivor counts are a partial aggregate (one row per repo); the
  join back to rows is many-to-one on ``repo``. AQE turns it into a broadcast
  join when the measured repo table is small and splits skewed repo
  partitions otherwise.
* The capped sample is ``row_number() <= cap`` over a hash order; Catalyst
  inserts a partial ``WindowGroupLimit`` before the shuffle, so a hot repo
  sends at most ``cap`` rows per map task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import UNICODE_WS, shape_ok, token_count


@dataclass(frozen=True)
class CurationParams:
    # Shape predicate on the target
    prefix: str = "@Test public void test"
    open_: str = "("
    close: str = ")"
    follow: str = "{"
    offset: int = 2
    # Half-open token-length ranges (P5)
    target_min: int = 16
    target_max: int = 512
    src_min: int = 64
    src_max: int = 2048
    token_pattern: str = UNICODE_WS
    specials: int = 2
    # Repo policy (A1/W4): drop below ``lower``, sample ``cap`` at >= ``upper``
    lower: int = 50
    upper: int = 200
    cap: int = 200
    seed: str = "42"


def hash_order(key: Column, seed: str = "42") -> Column:
    """Portable seeded order key: ``md5(seed|key)`` (same value in DuckDB)."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key))


def _keyed(df: DataFrame, src: str, order: str) -> DataFrame:
    """``(order, _src_key)``: SHA-256 of each non-blank source, computed where the text is."""
    nonempty = F.col(src).isNotNull() & (F.col(src) != "")
    return df.select(F.col(order), F.when(nonempty, F.sha2(F.col(src), 256)).alias("_src_key"))


def _firsts(keyed: DataFrame, order: str) -> DataFrame:
    return keyed.filter(F.col("_src_key").isNotNull()).groupBy("_src_key").agg(F.min(order).alias(order))


def first_copy_flag(df: DataFrame, src: str = "src", order: str = "path") -> DataFrame:
    """``(order, is_first)`` of every row: whether it is the first copy (smallest ``order``) of
    its source, NULL for blank ones. Only digests and ``order`` are shuffled."""
    keyed = _keyed(df, src, order)
    joined = keyed.join(_firsts(keyed, order).withColumn("_first", F.lit(True)), ["_src_key", order], "left")
    flag = F.when(F.col("_src_key").isNotNull(), F.coalesce(F.col("_first"), F.lit(False)))
    return joined.select(order, flag.alias("is_first"))


def dedup_keep_first(df: DataFrame, src: str = "src", order: str = "path") -> DataFrame:
    """W1 as a filter: keep the first copy of every non-blank source text.

    The winners are found from digests alone; then the rows are semi-joined with
    the winners' ``order``, so no text meets its copies. Rows that share an
    ``order`` value must share the text.
    """
    return df.join(_firsts(_keyed(df, src, order), order).select(order), order, "left_semi").select(*df.columns)


def filter_reason(target: Column, src: Column, p: CurationParams) -> Column:
    """First failing reason, shape before length (NULL = passes)."""
    nt = token_count(target, p.token_pattern, p.specials)
    ns = token_count(src, p.token_pattern, p.specials)
    shape = shape_ok(target, p.prefix, p.open_, p.close, p.follow, p.offset)
    length = ((nt >= p.target_min) & (nt < p.target_max)
              & (ns >= p.src_min) & (ns < p.src_max))
    return (F.when(~shape, F.lit("construct"))
            .when(~F.coalesce(length, F.lit(False)), F.lit("token_length")))


def length_percentiles(df: DataFrame, length: Column, percents: tuple[int, ...] = (50, 90, 95, 99)) -> DataFrame:
    """Exact, interpolated percentiles of a length as ``p50 ...``; a task holds one count per distinct length."""
    return df.select(length.alias("_n")).agg(*[F.percentile("_n", F.lit(p / 100)).alias(f"p{p}") for p in percents])


def repo_policy(survivors: DataFrame, p: CurationParams, repo: str = "repo") -> DataFrame:
    """A1: survivor count per repo and its decision (under / over / keep)."""
    return (survivors.groupBy(repo).agg(F.count(F.lit(1)).alias("survivors"))
            .withColumn("decision",
                        F.when(F.col("survivors") < p.lower, F.lit("under"))
                        .when(F.col("survivors") >= p.upper, F.lit("over"))
                        .otherwise(F.lit("keep"))))


def annotate(df: DataFrame, p: CurationParams, src: str = "src", target: str = "target",
             repo: str = "repo", path: str = "path") -> DataFrame:
    """Give every row its curation ``stage`` (see module doc).

    Returns the narrow frame ``(repo, path, stage)``: predicates are evaluated
    map-side while the text is at hand, then only digests and paths move
    through the shuffles. ``kept_rows`` brings the text back for the kept set.
    """
    nonempty = F.col(src).isNotNull() & (F.col(src) != "")
    narrow = df.select(
        F.col(repo).alias(repo), F.col(path).alias(path),
        nonempty.alias("_nonempty"),
        F.when(nonempty, F.sha2(F.col(src), 256)).alias("_src_key"),
        filter_reason(F.col(target), F.col(src), p).alias("_reason"))
    firsts = (narrow.filter("_nonempty")
              .groupBy("_src_key").agg(F.min(path).alias(path))
              .withColumn("_first", F.lit(True)))
    pre = (narrow.join(firsts, ["_src_key", path], "left")
           .withColumn("stage",
                       F.when(~F.col("_nonempty"), F.lit("empty"))
                       .when(F.col("_first").isNull(), F.lit("dedup"))
                       .otherwise(F.col("_reason")))
           .select(repo, path, "stage"))
    survivors = pre.filter(F.col("stage").isNull())
    policy = repo_policy(survivors, p, repo).select(repo, "decision")
    sampled = (survivors.join(policy.filter("decision = 'over'").select(repo), repo, "left_semi")
               .withColumn("_rk", F.row_number().over(
                   Window.partitionBy(repo).orderBy(hash_order(F.col(path), p.seed), F.col(path))))
               .filter(F.col("_rk") <= p.cap)
               .select(path).withColumn("_sampled", F.lit(True)))
    return (pre.join(policy, repo, "left").join(sampled, path, "left")
            .withColumn("stage", F.coalesce(
                F.col("stage"),
                F.when(F.col("decision") == "under", F.lit("under"))
                .when((F.col("decision") == "over") & F.col("_sampled").isNull(), F.lit("over"))
                .otherwise(F.lit("kept"))))
            .select(repo, path, "stage"))


def kept_rows(df: DataFrame, annotated: DataFrame, path: str = "path") -> DataFrame:
    """The full rows (text included) whose stage is ``kept``."""
    return df.join(annotated.filter(F.col("stage") == "kept").select(path), path, "left_semi")


def funnel(annotated: DataFrame) -> DataFrame:
    """A2: one-row report; counters partition ``total`` exactly."""
    s = F.col("stage")
    return annotated.agg(
        F.count(F.lit(1)).alias("total_data_number"),
        F.count_if(s == "empty").alias("reduce_by_empty"),
        F.count_if(s == "token_length").alias("reduce_by_token_length"),
        F.count_if(s == "construct").alias("reduce_by_construct"),
        F.count_if(s == "dedup").alias("reduce_by_dedup"),
        F.count_if(s == "under").alias("reduce_by_under_threshold"),
        F.count_if(s == "over").alias("reduce_by_over_threshold"),
        F.count_if(s == "kept").alias("rest_number"),
    )


def audit(annotated: DataFrame, p: CurationParams, repo: str = "repo") -> DataFrame:
    """One ``(dir, reason)`` row per dropped or capped repo."""
    per_repo = (annotated.filter(F.col("stage").isin("under", "over", "kept"))
                .groupBy(repo).agg(F.count_if(F.col("stage") == "under").alias("u"),
                                   F.count_if(F.col("stage") == "over").alias("o"),
                                   F.count(F.lit(1)).alias("n")))
    return (per_repo.withColumn(
        "reason",
        F.when(F.col("u") > 0, F.lit(f"under {p.lower}"))
        .when(F.col("n") >= p.upper, F.lit(f"over {p.upper}")))
        .filter(F.col("reason").isNotNull())
        .select(F.col(repo).alias("dir"), "reason"))


def manifest(annotated: DataFrame, repo: str = "repo", path: str = "path") -> DataFrame:
    """Kept paths per repo as ``(repo, paths array<string>)`` sorted by path."""
    return (annotated.filter(F.col("stage") == "kept")
            .groupBy(repo).agg(F.array_sort(F.collect_list(path)).alias("paths")))
