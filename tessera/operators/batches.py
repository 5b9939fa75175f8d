"""Arrow batches of rows that lie together by item, for steps that count inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt(df: DataFrame, item: str, partitions: int) -> DataFrame:
    """The rows of an item in one partition, one behind the other.

    By a digest of the item: behind a join on the item Spark drops a repartition
    by the same column and may then read the join's sides undealt, as no later
    step asks for it.
    """
    return df.repartition(partitions, F.xxhash64(item)).sortWithinPartitions(item)


def numbered(values: pa.Array) -> np.ndarray:
    """A number for every value, the same for equal ones and one for null."""
    return values.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 for the distinct keys, and these keys."""
    encoded = pa.array(keys).dictionary_encode()
    return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary.to_numpy()


def starts(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def whole_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows that lie together by item, cut between items."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        item = batch.column("item")
        cuts = np.flatnonzero(starts(numbered(item)))  # the first one is 0
        if held and not held[0].column("item")[0].equals(item[0]):
            yield pa.concat_batches(held)
            held = []
        first = int(cuts[1]) if held and len(cuts) > 1 else 0
        if first:  # the held item ends here
            yield pa.concat_batches([*held, batch.slice(0, first)])
            held = []
        if cuts[-1] > first:
            yield batch.slice(first, int(cuts[-1]) - first)
        held.append(batch.slice(int(cuts[-1])))
    if held:
        yield pa.concat_batches(held)


def pieces(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """A batch of whole items in pieces of whole items, of about ``most`` in size or one item each."""
    begins = np.flatnonzero(starts(numbered(batch.column("item"))))
    before = np.concatenate([[0], np.cumsum(sizes)])[begins]
    begins = begins[starts(before // most)] if len(begins) else begins
    for a, b in zip(begins, [*begins[1:], batch.num_rows]):
        yield batch.slice(int(a), int(b - a))
