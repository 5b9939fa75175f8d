"""Helpers shared by the operators: table scans, written intermediates, Arrow text batches."""

from __future__ import annotations

import ctypes
import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import ensure_checkpoint_dir

U64 = np.uint64
# Freed Arrow buffers go back to the system: workers are reused by many operators.
pa.set_memory_pool(pa.system_memory_pool())
# Text handled at a time inside a task; bounds memory whatever the batch size is.
SLICE_BYTES = 3 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_FOLDER: ContextVar[str] = ContextVar("folder", default="")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in ``spark.checkpoint.dir``, which driver and executors share.

    It goes when the application ends. Only a local session without the setting
    gets a folder of its own; a cluster has to name one.
    """
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tessera-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str, at_exit: bool) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(p) if at_exit else fs.delete(p, True)


@contextmanager
def own_folder(spark: SparkSession):
    """Intermediates written inside go to a folder of their own, which is deleted in the end.

    Whatever is to be kept has to be written (``written(..., outside=True)``) before that.
    """
    name = uuid.uuid4().hex
    token = _FOLDER.set(name)
    try:
        yield
    finally:
        _FOLDER.reset(token)
        _delete(spark, f"{shared_folder(spark)}/{name}", at_exit=False)


def written(df: DataFrame, label: str, outside: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts the lineage: what follows starts from files that every executor can
    read, so a lost executor costs no recomputation of what came before.
    """
    spark = df.sparkSession
    top = shared_folder(spark)
    _delete(spark, top, at_exit=True)
    within = [] if outside or not _FOLDER.get() else [_FOLDER.get()]
    path = "/".join([top, *within, f"{label}-{uuid.uuid4().hex}"])
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], text: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with about ``max_bytes`` of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size.astype(np.int64) + 1) // max_bytes
        cuts = np.flatnonzero(np.diff(group)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The text column as an Arrow string array; null texts are empty."""
    return pc.fill_null(batch.column(column).cast(pa.string()), "")


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text.

    Returns (codes, bounds, words): the words of text i are
    ``words[codes[bounds[i]:bounds[i + 1]]]``.
    """
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    return encode_flat(flat, offsets)


def byte_words(texts: pa.Array, separators: bytes, breaks: bytes = b"") -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Words of texts: runs of bytes that are neither ASCII ``separators`` nor ASCII ``breaks``.

    Returns (codes, words, bounds, joined): the words of text i are
    ``words[codes[bounds[i]:bounds[i + 1]]]``; ``joined`` tells of each word
    whether it follows another of its text without a break between them.
    """
    kind = np.zeros(256, np.uint8)
    kind[list(separators)], kind[list(breaks)] = 1, 2
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    kinds = kind[data]
    inside = kinds == 0
    fresh = np.append(True, ~inside)  # whether a word may start at a byte: after another kind or a text's end
    fresh[offsets] = True
    starts = np.flatnonzero(inside & fresh[:-1])
    cut = np.append(np.cumsum(inside, dtype=np.int32)[starts] - 1, np.int32(inside.sum()))
    flat = pa.StringArray.from_buffers(len(starts), pa.py_buffer(cut), pa.py_buffer(data[inside]))
    encoded = flat.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.searchsorted(starts, offsets)
    n_breaks = np.cumsum(kinds == 2, dtype=np.int32)[starts] if len(breaks) else np.zeros(len(starts), np.int64)
    joined = np.zeros(len(starts), bool)
    joined[1:] = n_breaks[1:] == n_breaks[:-1]
    joined[bounds[:-1][bounds[:-1] < len(starts)]] = False
    return codes, encoded.dictionary, bounds, joined


def give_back() -> None:
    """Let the allocator return freed memory to the system, where it can: workers live on after a task."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def combined(batches: Iterable[pa.RecordBatch], keys: list[str], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Rows of equal ``keys`` summed up (all other columns) as far as ``most`` rows in memory allow."""
    held, n = [], 0

    def merged(held):
        table = pa.Table.from_batches(held)
        sums = [c for c in table.column_names if c not in keys]
        out = table.group_by(keys).aggregate([(c, "sum") for c in sums])
        return out.rename_columns([c.removesuffix("_sum") for c in out.column_names]).select(table.column_names)

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            table = merged(held)
            held, n = table.to_batches(), table.num_rows
            give_back()
            if n > most // 2:
                yield from held
                held, n = [], 0
    if held:
        yield from merged(held).to_batches(max_chunksize=1 << 16)
    held.clear()
    give_back()


def encode_flat(flat: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Dictionary codes of the non-empty strings of ``flat`` and the bounds moved accordingly."""
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    encoded = flat.filter(pa.array(full)).dictionary_encode()
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes, before[offsets], encoded.dictionary.to_pylist()


def hash_words(words: list[str]) -> np.ndarray:
    """A fixed 64-bit hash of each string (the same in every process)."""
    if not words:
        return np.empty(0, U64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def odd_constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers drawn from ``seed``."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * U64(2) + U64(1)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each [bounds[i], bounds[i + 1]); empty runs give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


# Bits of a bitmap of hashes: 8 MB, whatever the number of hashes; with very many it fills up and spares less.
BITS = 26


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """``1 << BITS`` bits, those of the keys (64-bit hashes in a bigint column ``key``) set.

    Bits are combined within the tasks; the driver gets the bits and nothing else.
    """
    slot = F.shiftrightunsigned("key", 64 - BITS) + 1
    chunks = keys.groupBy(F.bitmap_bucket_number(slot).alias("chunk")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for chunk in chunks.collect():
        at = (chunk["chunk"] - 1) * len(chunk["bits"])
        out[at : at + len(chunk["bits"])] = np.frombuffer(chunk["bits"], np.uint8)
    return out


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key (unsigned) is set: always for the bitmap's own, by chance for others."""
    slot = keys >> U64(64 - BITS)
    return (bits[(slot >> U64(3)).astype(np.int64)] >> (slot & U64(7)).astype(np.uint8)) & 1 == 1


def crc_bucket(column, modulus: int):
    """crc32 of the value written as text, modulo ``modulus`` (the held-out rule)."""
    return F.crc32(column.cast("string")) % modulus


def schema_of(df: DataFrame, keep: Iterable[str], more: str) -> T.StructType:
    """The schema of ``keep`` columns followed by the columns of ``more`` (DDL).

    A kept column whose name is among the others' (whatever its case) is called ``<name>_kept``.
    """
    own = T.StructType.fromDDL(more).fields
    taken = {f.name.lower() for f in own}
    kept = [T.StructField(k + "_kept" * (k.lower() in taken), df.schema[k].dataType) for k in keep]
    return T.StructType(kept + own)


def unsigned_crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
