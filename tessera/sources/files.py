"""Readers and writers for the corpus file layouts.

All readers are plain ``spark.read`` scans with an explicit schema, so they
split across executors and push projections down; per-file metadata comes
from the ``_metadata`` column instead of listing files on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources.versions import Conflict, VersionedFolder, exists

PAIR_SCHEMA = "source string, target string"
CURATED_SCHEMA = "src_fm_fc_ms_ff string, target string"
EVOLUTION_SCHEMA = "focal_src string, focal_tgt string, test_src string, test_tgt string"
RESULT_SCHEMA = "id long, revision string, result string"


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: str,
               corrupt: str | None = None) -> DataFrame:
    """JSON Lines with a fixed schema (no inference pass). With ``corrupt``, lines that
    are not JSON are kept whole in a column of that name instead of a row of nulls."""
    if corrupt is None:
        return spark.read.schema(schema).json(path)
    return (spark.read.schema(f"{schema}, {corrupt} string").option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", corrupt).json(path))


def read_json_documents(spark: SparkSession, path: str, schema: str,
                        strip_surrogates: bool = True) -> DataFrame:
    """S2 + F16: files each holding one JSON array of records.

    Undecodable files come back as one row with ``_corrupt_record`` set (the
    reference prints a message and skips them; ``.filter`` on that column does
    the same). Lone UTF-16 surrogate escapes are removed from the raw text
    before parsing, as the reference does.
    """
    raw = spark.read.text(path, wholetext=True).select(
        F.col("value"), F.col("_metadata.file_path").alias("file_path"))
    text = F.col("value")
    if strip_surrogates:
        # A high and a low half together are a character and stay; a half alone goes.
        half = r"\\u[dD][{}][0-9a-fA-F]{{2}}"
        pair = half.format("89abAB") + half.format("c-fC-F")
        text = F.regexp_replace(text, f"({pair})|{half.format('89a-fA-F')}", "$1")
    arr = F.from_json(text, f"array<struct<{schema.replace(' string', ':string')}>>")
    parsed = raw.select("file_path", arr.alias("records"), F.col("value").alias("_raw"))
    ok = parsed.filter(F.col("records").isNotNull()).select("file_path", F.inline("records"))
    bad = parsed.filter(F.col("records").isNull()).select(
        "file_path", F.col("_raw").alias("_corrupt_record"))
    cols = [c.strip().split(" ")[0] for c in schema.split(",")]
    return ok.withColumn("_corrupt_record", F.lit(None).cast("string")).unionByName(
        bad.select("file_path", *[F.lit(None).cast("string").alias(c) for c in cols], "_corrupt_record"))


def _folder(path):
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def leaf_folders(spark: SparkSession, root: str) -> DataFrame:
    """S3: ``(repo_dir, repo, files)`` of every folder under ``root`` that has files and no folder
    with files below it; ``files`` counts all of them, whatever their type.

    Only file metadata is read. A folder without a file anywhere below is not seen.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select(_folder(F.col("_metadata.file_path")).alias("repo_dir")))
    folders = files.groupBy("repo_dir").agg(F.count(F.lit(1)).alias("files"))
    parts = F.split("repo_dir", "/")
    above = folders.select(F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("repo_dir")).distinct()
    leaves = folders.join(above, "repo_dir", "left_anti")
    return leaves.select("repo_dir", F.element_at(F.split("repo_dir", "/"), -1).alias("repo"), "files")


def read_record_tree(spark: SparkSession, root: str, schema: str = CURATED_SCHEMA,
                     leaves_only: bool = True) -> DataFrame:
    """S3: one JSON record per ``*.json`` file of the leaf folders under ``root`` (or of all
    folders); the repo key is the full parent folder, ``repo`` its last component."""
    df = (spark.read.schema(schema).option("recursiveFileLookup", "true")
          .option("pathGlobFilter", "*.json").option("multiLine", "true").json(root))
    df = df.select("*", F.col("_metadata.file_path").alias("path"))
    df = df.withColumn("repo_dir", _folder(F.col("path")))
    df = df.withColumn("repo", F.element_at(F.split("repo_dir", "/"), -1))
    return df.join(leaf_folders(spark, root).select("repo_dir"), "repo_dir", "left_semi") if leaves_only else df


def read_splits(spark: SparkSession, data_path: str, files: dict[str, str | None],
                schema: str) -> DataFrame:
    """Optional train/eval/test files under ``data_path`` (in any store) with a ``split`` column."""
    paths = {k: f"{data_path.rstrip('/')}/{f}" for k, f in files.items() if f}
    frames = [read_jsonl(spark, p, schema).withColumn("split", F.lit(k)) for k, p in paths.items() if exists(spark, p)]
    if not frames:
        raise FileNotFoundError(f"none of {list(files.values())} under {data_path}")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def read_concatenated_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Pretty-printed JSON objects written back to back (``indent=4``).

    A closing brace alone on a line ends a record, as inner ones are indented,
    so the reader cuts there and one large file is read by many tasks; the brace
    is put back. Objects without members (``{}``) stand on lines of their own.
    """
    raw = spark.read.option("lineSep", "\n}\n").text(path)
    objs = F.split(F.col("value"), r"(?<=^\{\})\n|(?<=\n\{\})\n")
    one = raw.select(F.posexplode(objs).alias("i", "obj"), F.size(objs).alias("n"))
    whole = F.rtrim(F.col("obj"), F.lit("\n"))
    cut = (F.col("i") == F.col("n") - 1) & ~whole.endswith("\n}") & (whole != "{}")
    text = F.when(cut, F.concat("obj", F.lit("\n}"))).otherwise(whole)
    one = one.filter(whole != "").select(F.from_json(text, schema).alias("record"))
    return one.select("record.*")


def write_tsv(df: DataFrame, idx: str, text: str, path: str, compat: bool = False) -> None:
    """``idx<TAB>text`` lines. ``compat`` flattens tabs/newlines in the text
    the way the reference format silently breaks them."""
    t = F.col(text)
    if compat:
        t = F.translate(t, "\t\n\r", "   ")
    df.select(F.concat_ws("\t", F.col(idx).cast("string"), t).alias("value")) \
        .write.mode("overwrite").text(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``(idx, text)`` where text is the second tab field only, NULL on a line without
    a tab; an ``idx`` that is not a number is NULL."""
    raw = spark.read.text(path)
    parts = F.split(F.col("value"), "\t")
    return raw.select(parts[0].try_cast("long").alias("idx"), F.try_element_at(parts, F.lit(2)).alias("text"))


def read_charset_text(spark: SparkSession, path: str, charset: str = "windows-1254",
                      glob: str = "*.java") -> DataFrame:
    """Whole files decoded from a legacy charset
    (needs ``spark.sql.legacy.javaCharsets=true``)."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", glob) \
        .option("recursiveFileLookup", "true").load(path)
    return b.select(F.col("path"), F.decode(F.col("content"), charset).alias("text"))


@dataclass(frozen=True)
class RoutedRows:
    """What one write put where; ``rows == good + rejected``."""

    rows: int
    good: int
    rejected: int


def write_splits(df: DataFrame, path: str, split: str = "split", valid: str | None = None,
                 corrupt: str | None = None, verdict: str = "verdict") -> RoutedRows:
    """JSONL output in folders ``verdict=good|rejected / split=...``, in one pass.

    A row is good if ``valid`` (a SQL predicate) is true, its split is known and
    its ``corrupt`` column (see ``read_jsonl``) is empty; every other row, a null
    verdict included, is reported and kept among the rejected ones. The counts
    come from the write itself.
    """
    if verdict in df.columns:
        raise ValueError(f"{verdict} is a column of the rows; name another")
    good = F.col(split).isNotNull()
    if valid is not None:
        good = good & F.coalesce(F.expr(valid), F.lit(False))
    if corrupt is not None:
        good = good & F.col(corrupt).isNull()
    seen = Observation()
    routed = df.withColumn(verdict, F.when(good, "good").otherwise("rejected")).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(verdict) == "good").alias("good"),
        F.count_if(F.col(verdict) == "rejected").alias("rejected"))
    routed.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy(verdict, split).json(path)
    return RoutedRows(**seen.get)


def read_routed(spark: SparkSession, path: str, schema: str, which: str = "good", split: str = "split",
                verdict: str = "verdict") -> DataFrame:
    """The good (or rejected) rows of ``write_splits``; only their folders are read."""
    df = spark.read.schema(f"{schema}, {verdict} string, {split} string").json(path)
    return df.filter(F.col(verdict) == which).drop(verdict)


def upsert_manifest(existing: DataFrame, new: DataFrame, key: str = "repo",
                    value: str = "paths") -> DataFrame:
    """Manifest update; keys of ``new`` replace old ones, others stay."""
    o = existing.select(F.col(key), F.col(value).alias("_old"))
    n = new.select(F.col(key), F.col(value).alias("_new"), F.lit(True).alias("_is_new"))
    merged = F.when(F.col("_is_new"), F.col("_new")).otherwise(F.col("_old")).alias(value)
    return o.join(n, key, "full_outer").select(key, merged)


def write_manifest(spark: SparkSession, root: str, new: DataFrame, key: str = "repo", value: str = "paths",
                   attempts: int = 3, keep: int = 2) -> int:
    """Upsert ``new`` into the manifest kept under ``root``; returns its version.

    Readers see the old manifest until the new one is whole. A failed write
    leaves the old one, and the next call starts from it. When another writer
    publishes first the update is made again on top of theirs, ``attempts``
    times in all; then ``Conflict`` is raised. Of a key that ``new`` has twice
    one row counts (the largest value).
    """
    folder = VersionedFolder(spark, root)
    once = new.groupBy(key).agg(F.max(value).alias(value))
    for left in reversed(range(attempts)):
        try:
            version = folder.next_version()
            old = folder.read()
            folder.publish(once if old is None else upsert_manifest(old, once, key, value), version)
            folder.vacuum(keep)
            return version
        except Conflict:
            if not left:
                raise
    raise ValueError("attempts must be positive")


def read_manifest(spark: SparkSession, root: str) -> DataFrame | None:
    """The manifest published last; None before the first."""
    return VersionedFolder(spark, root).read()


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append a batch of result rows (files are immutable; a batch is a file set)."""
    df.write.mode("append").json(path)


def read_suffix_union(spark: SparkSession, folder: str, suffix: str, schema: str) -> DataFrame:
    """One scan of every ``*<suffix>`` file; ``name`` is the file name
    without the suffix (e.g. the model name of ``X_result.jsonl``)."""
    df = spark.read.schema(schema).option("pathGlobFilter", f"*{suffix}").json(folder)
    name = F.regexp_extract(F.col("_metadata.file_name"), "^(.*)" + suffix.replace(".", r"\.") + "$", 1)
    return df.withColumn("name", name)


def write_ordered(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """JSON Lines whose rows, read part file by part file in name order, are in the order
    of ``keys``. Rows are dealt by ranges of the keys, so no task sorts more than its range."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").json(path)


def write_class_info(members: DataFrame, path: str, cls: str = "class_name",
                     start: str = "start") -> None:
    """One JSON record per class, classes sorted by name, methods by start."""
    cols = [start, *(c for c in members.columns if c not in (cls, start))]
    classes = members.groupBy(cls).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("methods"))
    write_ordered(classes, path, [cls])


def write_method_list(members: DataFrame, path: str, cls: str = "class_name", start: str = "start") -> None:
    """The flat list, one JSON record per method, by class and start."""
    write_ordered(members, path, [cls, start])
