"""Best-fit packing: documents into sequences of a fixed number of tokens.

A document's tokens end with ``end_id``. Longer documents than a sequence are
cut into full pieces, the first of which may be shorter. Pieces are packed by
best-fit decreasing: longest first, each into the fullest open sequence that
still has room, found in logarithmic time in a segment tree over remaining
capacities.

Where a piece goes depends on its length alone, so the decisions are made once
for each run of equal lengths: the tree holds the number of open sequences by
remaining capacity, fed by a histogram of at most ``capacity`` lengths. That is
all that reaches the driver, whatever the number of documents, and the result
is the packing that document-by-document best-fit decreasing gives. The plan
(ranges of ranks among the pieces of one length, and where each range goes) is
bounded by the capacity too; every piece finds its place from its rank. Ranks
are counted per (length, salt), so that a length with many pieces is spread.

Rows: a null text is empty and packs as ``end_id`` alone; repeated rows are
packed each; pieces of equal length are ranked by doc_id and piece; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .tokenizing import encoder

SALTS = 64


class CapacityTree:
    """Counts of open sequences by remaining capacity, with the tightest fit in O(log capacity)."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.total = [0] * (2 * self.leaves)

    def add(self, remaining: int, n: int) -> None:
        at = self.leaves + remaining
        while at:
            self.total[at] += n
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` that an open sequence has."""
        at = self.leaves + length
        if self.total[at]:
            return length
        while at > 1:
            if not at & 1 and self.total[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.total[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def plan_packing(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing of all pieces, as (length, first rank, end rank, first sequence, per sequence, offset).

    Piece number r of its length, first rank <= r < end rank, goes to sequence
    ``first + (r - first rank) // per`` at ``offset + (r - first rank) % per * length``.
    """
    tree = CapacityTree(capacity)
    open_: dict[int, list[tuple[int, int]]] = {}
    out = []
    n_sequences = 0

    def hold(remaining, first, n):
        if n:
            open_.setdefault(remaining, []).append((first, n))
            tree.add(remaining, n)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                per = capacity // length
                first, n, room = n_sequences, -(-left // per), capacity
                n_sequences += n
            else:
                first, n = open_[room].pop()
                tree.add(room, -n)
                per = room // length
            full = min(n, left // per)
            if full:
                out.append((length, rank, rank + full * per, first, per, capacity - room))
                hold(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < n:
                if left:  # fewer than fill one sequence: they all go to the next
                    out.append((length, rank, rank + left, first + full, left, capacity - room))
                    hold(room - left * length, first + full, 1)
                    full, left = full + 1, 0
                hold(room, first + full, n - full)
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, text: str = "text",
           with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if with_ids:
        schema, names = schema + ", ids array<int>", [*names, "ids"]

    def run(batches):
        for batch in C.slices(batches, text, 2 * C.SLICE_BYTES):
            texts = C.texts_of(batch, text)
            ids, bounds = encoder(tokenizer).encode(texts)
            n = np.diff(bounds) + 1
            ends = np.cumsum(n)
            full = np.full(int(n.sum()), end_id, dtype="<u4")
            full[C.ragged(ends - n, n - 1)] = ids
            n_pieces = -(-n // capacity)
            piece = C.ragged(np.zeros(len(n), np.int64), n_pieces)
            doc = np.repeat(np.arange(len(n)), n_pieces)
            first = n[doc] - (n_pieces[doc] - 1) * capacity
            start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
            length = np.where(piece == 0, first, capacity)
            at = (ends - n)[doc] + start
            crc = [C.unsigned_crc32(full[a : a + k].tobytes()) for a, k in zip(at, length)]
            columns = [batch.column("doc_id").cast(pa.int64()).take(pa.array(doc)), pa.array(piece.astype(np.int32)),
                       pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if with_ids:
                cut = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
                columns.append(pa.ListArray.from_arrays(cut, pa.array(full[C.ragged(at, length)].astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", text).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, text: str = "text",
         with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and its offset there; ``with_ids`` keeps the token ids."""
    cut = C.written(pieces(docs, tokenizer, capacity, end_id, text, with_ids), "pieces")
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int")
    # A piece of full length is a sequence by itself: it needs no place in an order.
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    whole = cut.filter(F.col("length") == capacity).select(
        *names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    cut = cut.filter(F.col("length") < capacity).withColumn("salt", salt)
    # At most capacity * SALTS rows, whatever the input.
    sizes = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = sorted(plan_packing(histogram, capacity))
    table = np.array(plan, np.int64).reshape(-1, 6)
    # Ranges of one length are in order of rank; a length's ranks are below 2**44.
    keys = (table[:, 0] << 44) + table[:, 1]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = table[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            within = rank - row[:, 1]
            columns = [batch.column(n) for n in names]
            columns += [pa.array(row[:, 3] + within // row[:, 4]),
                        pa.array(row[:, 5] + within % row[:, 4] * row[:, 0])]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    ranked = cut.withColumn("in_salt", F.row_number().over(
        Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(F.broadcast(firsts), ["length", "salt"])
    ranked = ranked.select(*names, (F.col("first") + F.col("in_salt") - 1).cast("bigint").alias("rank"))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    schema += ", ids array<int>" * with_ids + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(place, schema).unionByName(whole)
