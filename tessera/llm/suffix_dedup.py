"""Suffix-array de-duplication: distributed prefix doubling over byte positions.

A byte is removed if it lies in a ``2 * HALF``-byte string (a window) that also
starts in a document with a smaller doc_id; matches never cross documents and
are judged on the input.

Prefix doubling ranks positions by their first HALF bytes, drops those whose
rank is unique, and ranks the survivors by the pair (rank here, rank HALF bytes
on), which orders them by 2 * HALF bytes: the threshold. To rank every byte
position would move many times the text, so the first round ranks anchors only:
in each window the position whose HALF-byte rank is smallest. An anchor depends
on the window's bytes alone, so equal windows have equal anchors, and windows
side by side share them: about one position in fourteen is ranked.

1. Ranks: every document belongs to a bucket by its doc_id. The ranks of the
   anchors go to rank partitions with their bucket, combined before they are
   sent; a rank found in one document only is unique and its windows are out.
   The buckets are told the others.
2. Pairs: the documents meet in their buckets. For each shared rank a bucket
   sends the bytes around the anchor (all of its windows), once for equal bytes,
   to the partition of the rank.
   There equal bytes are settled at once, and what is left is sorted by rank
   pairs, window by window; every window whose pair a smaller doc_id has is
   reported back to its bucket.
3. Cut: each bucket merges its documents' windows and cuts them out.

A rank that very many documents have would fill one partition with contexts;
above ``hot_docs`` documents its windows are dealt by their own rank pairs
instead, so only windows that are really equal meet, and those once per bucket.
Each phase ends in files in the shared folder.

Disk: the share of ranks that two documents have grows with the table, and with
it the contexts of phase 2, which take several times the bytes of their text.
So phase 2 goes over the rank partitions in passes; phase 1 knows how many
contexts there are, and a pass gets as many as fill ``share`` of the text's
bytes. The shuffle files of a pass are let go before the next one.

Rows: null and short texts have nothing to remove; a row without doc_id neither
loses bytes nor makes others lose any; rows with one doc_id do not cut each
other, whatever their texts; repeated rows give repeated results; texts are
read whole, very long ones in overlapping stretches; extra columns may have any
names; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
HALF = 25
WINDOW = 2 * HALF
_STRETCH = 1 << 20
# About the bytes that phase 2 shuffles for a context and for the windows around a hot rank, and a text's bytes per anchor.
_CONTEXT_BYTES, _HOT_BYTES, _TEXT_BYTES = 28, 400, 14
_PLACE = U64((1 << 28) - 1)
_MULTIPLIER = C.odd_constants(1, 25)[0]
_BYTES = C.mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def half_ranks(data: np.ndarray) -> np.ndarray:
    """A 64-bit rank (fingerprint) of the HALF bytes from each position, by doubling: 1, 2, 4, 8, 16, 24, 25."""
    if len(data) < HALF:
        return np.empty(0, U64)
    power = [U64(pow(int(_MULTIPLIER), 2**k, 2**64)) for k in range(4)]
    one = _BYTES[data]
    two = one[:-1] * power[0] + one[1:]
    four = two[:-2] * power[1] + two[2:]
    eight = four[:-4] * power[2] + four[4:]
    sixteen = eight[:-8] * power[3] + eight[8:]
    most = sixteen[:-8] * power[3] + eight[16:]
    return C.mix(most[:-1] * power[0] + one[HALF - 1 :])


def window_runs(ranks: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """(text, first window, last window, anchor) of runs of windows with one anchor, texts side by side in the data."""
    key = (ranks & ~_PLACE) | np.arange(len(ranks), dtype=U64)
    least = key
    for step in (1, 2, 4, 8):
        least = np.minimum(least[:-step], least[step:])
    least = np.minimum(least[: len(least) - 10], least[10:])  # of HALF + 1 positions, the first of equals
    at = C.ragged(starts, lengths - WINDOW + 1)
    anchor = (least[at] & _PLACE).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(at) else at
    tail = np.concatenate([head[1:], [len(at)]]) - 1 if len(at) else at
    text = np.searchsorted(starts, at[head], side="right") - 1
    return text, at[head], at[tail], anchor[head]


def stretches(texts: pa.Array, limit: int = _STRETCH):
    """Texts of a window or more, about ``limit`` bytes at a time, longer ones in stretches that overlap.

    Yields (data, starts, lengths, text number, offset in the text) of the stretches side by side.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    held, size = [], 0

    def out():
        number, offset, a, b = (np.array(x, np.int64) for x in zip(*held))
        lengths = b - a
        return (np.concatenate([data[i:j] for i, j in zip(a, b)]), np.cumsum(lengths) - lengths, lengths, number, offset)

    for number in np.flatnonzero(np.diff(offsets) >= WINDOW).tolist():
        first, last = int(offsets[number]), int(offsets[number + 1])
        for a in range(first, last - WINDOW + 1, limit):
            b = min(last, a + limit + WINDOW - 1)
            held.append((number, a - first, a, b))
            size += b - a
            if size >= limit:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def runs_of(texts: pa.Array):
    """(data, ranks, text number, first window, last window, anchor, shift) of a slice's texts.

    Window and anchor are positions in the data; position + shift is the place in the text.
    """
    for data, starts, lengths, number, offset in stretches(texts):
        ranks = half_ranks(data)
        text, first, last, anchor = window_runs(ranks, starts, lengths)
        yield data, ranks, number[text], first, last, anchor, (offset - starts)[text]


def context_part(keys: np.ndarray, n_parts: int) -> np.ndarray:
    """The partition where the contexts of a rank meet."""
    return (C.mix(keys) >> U64(33)) % U64(n_parts)


def keys_of(ranks: np.ndarray, n_parts: int) -> np.ndarray:
    """Rank partition (high 32 bits) and shortened rank (low 32); that two ranks fall together does no harm."""
    return (((ranks >> U64(33)) % U64(n_parts)) << U64(32)) | (ranks & U64(0xFFFFFFFF))


def by_key(batches, column: str):
    """(key, list of consecutive batches) of batches that arrive sorted by an integer column."""
    held, key = [], None
    for batch in batches:
        values = batch.column(column).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if held and values[a] != key:
                yield key, held
                held = []
            key = int(values[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield key, held


def _blob(array: np.ndarray, dtype) -> bytes:
    return np.ascontiguousarray(array, dtype).tobytes()


def _joined(rows: list[dict], name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(r[name] for r in rows), dtype)


def _packed(values: np.ndarray) -> bytes:
    """Integers by their steps, compressed byte by byte: sorted or small ones take a byte or two. Their number comes first."""
    step = np.diff(values.astype(np.int64), prepend=np.int64(0))
    planes = ((step << 1) ^ (step >> 63)).view(np.uint8).reshape(-1, 8).T
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _count(blob: bytes) -> int:
    return int.from_bytes(blob[:8], "little")


def _unpacked(rows: list[dict], name: str) -> np.ndarray:
    out = [np.empty(0, np.int64)]
    for r in rows:
        n = _count(r[name])
        planes = np.frombuffer(pa.decompress(r[name][8:], 8 * n, "zstd", asbytes=True), np.uint8)
        step = np.ascontiguousarray(planes.reshape(8, n).T).view(U64).reshape(n)
        out.append(np.cumsum(((step >> U64(1)) ^ (~(step & U64(1)) + U64(1))).view(np.int64)))
    return np.concatenate(out)


def _dealt(docs: DataFrame, doc_id: str, text: str, n_buckets: int, carried: Column | None = None) -> DataFrame:
    """The rows with their bucket; ``place`` orders them in it."""
    columns = [F.pmod(F.xxhash64(doc_id), F.lit(n_buckets)).cast("int").alias("bucket"), F.lit(1).alias("kind"),
               F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("place"),
               F.col(text).cast("string").alias("text")]
    return docs.select(*columns, *([carried.alias("carried")] if carried is not None else []))


def _matchable(dealt: DataFrame) -> DataFrame:
    return dealt.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= WINDOW))


def _in_buckets(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "kind", "doc_id", "place")


def _release(table: DataFrame) -> None:
    """Let Spark's cleaner free the shuffle files of a phase whose result, ``table``, is written.

    The scheduler holds on to its last job until another one runs.
    """
    table.count()
    gc.collect()
    if hasattr(table.sparkSession, "_jvm"):
        table.sparkSession._jvm.System.gc()


# -- phase 1: ranks


def _send_ranks(n_parts: int):
    """Ranks of the anchors with the bucket of their document, once per bucket and about 32 MB of text."""

    def out(keys, buckets, docs):
        key, bucket, doc = (np.concatenate(x) for x in (keys, buckets, docs))
        order = np.lexsort((doc, bucket, key))
        key, bucket, doc = key[order], bucket[order], doc[order]
        head = np.concatenate([[True], (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])])
        new = head | np.concatenate([[True], doc[1:] != doc[:-1]])
        count = np.add.reduceat(new.astype(np.int64), np.flatnonzero(head))
        key, bucket = key[head], bucket[head]
        part = (key >> U64(32)).astype(np.int64)
        order = np.lexsort((key, bucket, part))
        key, bucket, count, part = key[order], bucket[order], count[order], part[order]
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        blobs = [(_blob(key[a:b] & U64(0xFFFFFFFF), np.uint32), _blob(bucket[a:b], np.int32),
                  _blob(np.minimum(count[a:b], 255), np.uint8)) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array(part[cuts[:-1]].astype(np.int32)), *(pa.array(x, pa.binary()) for x in zip(*blobs))],
            names=["part", "ranks", "buckets", "counts"])

    def run(batches):
        keys, buckets, docs, size = [], [], [], 0
        for batch in C.slices(batches, "text"):
            ids, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "bucket"))
            for data, ranks, number, _, _, anchor, _ in runs_of(C.texts_of(batch, "text")):
                keys.append(keys_of(ranks[anchor], n_parts))
                buckets.append(own[number])
                docs.append(ids[number])
                size += len(data)
            if size > 32 << 20:
                yield out(keys, buckets, docs)
                keys, buckets, docs, size = [], [], [], 0
        if keys:
            yield out(keys, buckets, docs)

    return run


def _shared_ranks(hot_docs: int):
    """Back to each bucket: its ranks that another document has too, and which of them are hot."""

    def run(batches):
        for part, own in by_key(batches, "part"):
            rows = [r for b in own for r in b.to_pylist()]
            rank, bucket = _joined(rows, "ranks", np.uint32), _joined(rows, "buckets", np.int32)
            count = _joined(rows, "counts", np.uint8)
            _, which = np.unique(rank, return_inverse=True)
            total = np.bincount(which, count)[which]
            shared = total > 1
            contexts = int(count[shared & (total <= hot_docs)].sum())
            rank, bucket, hot = rank[shared], bucket[shared], total[shared] > hot_docs
            order = np.lexsort((rank, bucket))
            rank, bucket, hot = rank[order], bucket[order], hot[order]
            new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (rank[1:] != rank[:-1])])[: len(rank)]
            rank, bucket, hot = rank[new], bucket[new], hot[new]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(rank) else []
            out = [(int(bucket[a]), rank[a:b].tobytes(), hot[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
            if out:
                to, ranks, hots = zip(*out)
                none = [0] * (len(out) - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.int32()), pa.array([0] * len(out), pa.int32()),
                     pa.array([part] * len(out), pa.int32()), pa.array(ranks, pa.binary()), pa.array(hots, pa.binary()),
                     pa.array([_TEXT_BYTES * int(count.sum()), *none], pa.int64()),
                     pa.array([_CONTEXT_BYTES * contexts + _HOT_BYTES * int(hot.sum()), *none], pa.int64())],
                    names=["bucket", "kind", "part", "ranks", "hot", "text_bytes", "pair_bytes"])

    return run


def _phase_ranks(dealt: DataFrame, n: int, n_parts: int, hot_docs: int) -> DataFrame:
    sent = _matchable(dealt).mapInArrow(_send_ranks(n_parts), "part int, ranks binary, buckets binary, counts binary")
    met = sent.repartition(n, "part").sortWithinPartitions("part")
    return C.written(met.mapInArrow(_shared_ranks(hot_docs), "bucket int, kind int, part int, ranks binary, hot binary, "
                                                             "text_bytes bigint, pair_bytes bigint"), "ranks")


def _passes(shared: DataFrame, n_ranks: int, share: float) -> int:
    """How many passes phase 2 takes for each to send about ``share`` of the text's bytes, or a rank partition's."""
    text, pairs = shared.agg(F.sum("text_bytes"), F.sum("pair_bytes")).first()
    return min(n_ranks, max(1, math.ceil(pairs / (share * text)))) if text else 1


# -- phase 2: rank pairs


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Overlapping or touching intervals of one document as one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    # Running ends restart with each document: shift documents apart first.
    span = int(end.max()) + 1
    reach = np.maximum.accumulate(doc * span + end)
    head = np.concatenate([[True], doc[1:] * span + start[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(head)[1:], [len(doc)]]) - 1
    return doc[head], start[head], reach[last] - doc[head] * span


_PAIR_SCHEMA = ("part int, kind int, bucket int, numbers binary, docs binary, starts binary, lengths binary, "
                "anchors binary, bytes binary")
_PAIR_NAMES = ["part", "kind", "bucket", "numbers", "docs", "starts", "lengths", "anchors", "bytes"]
_SETTLED, _CONTEXT, _SINGLE = 0, 1, 2


def _pair_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32()] * 3 + [pa.binary()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=_PAIR_NAMES)


def _send_pairs(n_ranks: int, n_parts: int):
    """Contexts of the windows whose anchor's rank is shared, once for equal ones in the bucket.

    ``numbers`` count the bucket's documents in order; a context that a smaller
    doc_id of the same bucket has as well is settled here.
    """

    def run(batches):
        for bucket, own in by_key(batches, "bucket"):
            keys, hots = [], []
            contexts, singles = [], []
            known = hot = None
            n = 0
            for batch in own:
                told = batch.filter(pa.array(batch.column("kind").to_numpy(zero_copy_only=False) == 0))
                for r in told.to_pylist():
                    keys.append((U64(r["part"]) << U64(32)) | np.frombuffer(r["ranks"], np.uint32).astype(U64))
                    hots.append(np.frombuffer(r["hot"], bool))
                batch = batch.filter(pa.array(batch.column("kind").to_numpy(zero_copy_only=False) == 1))
                if not batch.num_rows:
                    continue
                if known is None:
                    known = np.concatenate([*keys, np.empty(0, U64)])
                    hot = np.concatenate([*hots, np.empty(0, bool)])
                    order = np.argsort(known)
                    known, hot = known[order], hot[order]
                for part in C.slices([batch], "text"):
                    ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                    if len(known):
                        _gather(part, ids, n, known, hot, n_ranks, n_parts, contexts, singles)
                    n += part.num_rows
            rows = [*_context_rows(bucket, contexts, n_parts), *_single_rows(bucket, singles, n_parts)]
            if rows:
                yield _pair_rows(rows)

    return run


def _gather(batch, ids, n, known, hot, n_ranks, n_parts, contexts, singles) -> None:
    for data, ranks, number, first, last, anchor, shift in runs_of(C.texts_of(batch, "text")):
        key = keys_of(ranks[anchor], n_ranks)
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        shared = known[at] == key
        if not shared.any():
            continue
        plain, dense = shared & ~hot[at], shared & hot[at]
        length = last - first + WINDOW
        if plain.any():
            a, z, k = first[plain], last[plain], length[plain]
            same = C.mix(ranks[a] + C.mix(ranks[a + HALF] + C.mix(ranks[z + HALF] + k.astype(U64))))
            contexts.append((context_part(key[plain], n_parts), same, ids[number[plain]], number[plain] + n, a + shift[plain], k,
                             anchor[plain] - a, data[C.ragged(a, k)]))
        if dense.any():
            k = length[dense] - WINDOW + 1
            at = C.ragged(first[dense], k)
            owner = np.repeat(number[dense], k)
            singles.append((ranks[at], ranks[at + HALF], ids[owner], owner + n, at + np.repeat(shift[dense], k)))


def _context_rows(bucket: int, contexts: list, n_parts: int):
    if not contexts:
        return
    part, same, doc, number, start, length, anchor = (np.concatenate([c[i] for c in contexts]) for i in range(7))
    data = np.concatenate([c[7] for c in contexts])
    at = np.cumsum(length) - length
    order = np.lexsort((doc, same))
    head = np.concatenate([[True], same[order][1:] != same[order][:-1]])
    owner = np.empty(len(doc), np.int64)
    owner[order] = doc[order][np.flatnonzero(head)[np.cumsum(head) - 1]]
    done = doc > owner
    settled = _merged(number[done], start[done], (start + length)[done])
    if len(settled[0]):
        yield (bucket % n_parts, _SETTLED, bucket, _packed(settled[0]), b"", _packed(settled[1]),
               _packed(settled[2] - settled[1]), b"", b"")
    left = np.flatnonzero(~done)
    left = left[np.argsort(part[left], kind="stable")]
    to = part[left].astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        i = left[a:b]
        yield (int(to[a]), _CONTEXT, bucket, _packed(number[i]), _packed(doc[i]),
               _packed(start[i]), _blob(length[i], np.uint8), _blob(anchor[i], np.uint8),
               pa.compress(data[C.ragged(at[i], length[i])].tobytes(), "zstd", asbytes=True))


def _single_rows(bucket: int, singles: list, n_parts: int):
    if not singles:
        return
    one, two, doc, number, start = (np.concatenate([s[i] for s in singles]) for i in range(5))
    owner = _least_doc(one, two, doc)
    done = doc > owner
    settled = _merged(number[done], start[done], start[done] + WINDOW)
    if len(settled[0]):
        yield (bucket % n_parts, _SETTLED, bucket, _packed(settled[0]), b"", _packed(settled[1]),
               _packed(settled[2] - settled[1]), b"", b"")
    part = (C.mix(one + C.mix(two)) >> U64(33)) % U64(n_parts)
    left = np.flatnonzero(~done)
    left = left[np.argsort(part[left], kind="stable")]
    to = part[left].astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        i = left[a:b]
        yield (int(to[a]), _SINGLE, bucket, _packed(number[i]), _packed(doc[i]),
               _packed(start[i]), b"", b"", _blob(one[i], U64) + _blob(two[i], U64))


def _least_doc(one: np.ndarray, two: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position the smallest doc among those with its rank pair, by sorting the pairs."""
    order = np.lexsort((doc, two, one))
    a, b = one[order], two[order]
    head = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(order) else np.empty(0, bool)
    out = np.empty(len(doc), np.int64)
    out[order] = doc[order][np.flatnonzero(head)[np.cumsum(head) - 1]]
    return out


def _settle_pairs(batches):
    """Windows to remove: (bucket, numbers, starts, ends), from all that met in a rank partition."""
    for _, own in by_key(batches, "part"):
        rows = [r for b in own for r in b.to_pylist()]
        found = [(r["bucket"], _unpacked([r], "numbers"), _unpacked([r], "starts"), _unpacked([r], "lengths"))
                 for r in rows if r["kind"] == _SETTLED]
        for kind, settle in ((_CONTEXT, _settle_contexts), (_SINGLE, _settle_singles)):
            some = [r for r in rows if r["kind"] == kind]
            if some:
                source = np.repeat(np.arange(len(some)), [_count(r["numbers"]) for r in some])
                number = _unpacked(some, "numbers")
                row, start, end = settle(some)
                buckets = np.array([r["bucket"] for r in some])[source[row]]
                order = np.lexsort((start, number[row], buckets))
                cuts = np.flatnonzero(np.concatenate([[True], np.diff(buckets[order]) != 0, [True]])) if len(row) else []
                found += [(int(buckets[order[a]]), number[row[order[a:b]]], start[order[a:b]], (end - start)[order[a:b]])
                          for a, b in zip(cuts[:-1], cuts[1:])]
        if found:
            buckets, *columns = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(buckets, pa.int32()), pa.array([0] * len(found), pa.int32()),
                 *(pa.array([_packed(x) for x in c], pa.binary()) for c in columns)],
                names=["bucket", "kind", "numbers", "starts", "lengths"])


def _settle_contexts(rows: list[dict]):
    doc, start = _unpacked(rows, "docs"), _unpacked(rows, "starts")
    length = _joined(rows, "lengths", np.uint8).astype(np.int64)
    anchor = _joined(rows, "anchors", np.uint8).astype(np.int64)
    data = np.frombuffer(b"".join(
        pa.decompress(r["bytes"], sum(r["lengths"]), "zstd", asbytes=True) for r in rows), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(length)])
    contexts = pa.Array.from_buffers(pa.large_binary(), len(length),
                                     [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    code = contexts.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # Equal contexts: all but the smallest doc_id lose them whole.
    owner = np.full(int(code.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(owner, code, doc)
    whole = doc > owner[code]
    first = np.unique(code, return_index=True)[1]
    # Different contexts of one rank: window by window, by rank pairs.
    size = length[first]
    data = data[C.ragged(offsets[first], size)]
    offsets = np.cumsum(size) - size
    ranks = half_ranks(data)
    del data, contexts
    gram = ranks[offsets + anchor[first]]
    _, which, n = np.unique(gram, return_inverse=True, return_counts=True)
    several = np.flatnonzero(n[which] > 1)
    n_windows = size[several] - WINDOW + 1
    at = C.ragged(offsets[several], n_windows)
    of = np.repeat(several, n_windows)
    lose = owner[of] > _least_doc(ranks[at], ranks[at + HALF], owner[of])
    del ranks
    at, of = at[lose] - offsets[of[lose]], of[lose]
    # Windows in a row make one interval of their context.
    head = np.concatenate([[True], (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)]) if len(of) else np.empty(0, bool)
    i = np.flatnonzero(head)
    last = np.concatenate([i[1:], [len(of)]]) - 1 if len(of) else i
    of, low, high = of[i], at[i], at[last] + WINDOW
    # The intervals of a context hold for every row that has it under the smallest doc_id.
    holders = np.flatnonzero(~whole)
    holders = holders[np.argsort(code[holders], kind="stable")]
    a, b = np.searchsorted(code[holders], of, "left"), np.searchsorted(code[holders], of, "right")
    row = holders[C.ragged(a, b - a)]
    low, high = np.repeat(low, b - a), np.repeat(high, b - a)
    full = np.flatnonzero(whole)
    return (np.concatenate([full, row]), np.concatenate([start[full], start[row] + low]),
            np.concatenate([start[full] + length[full], start[row] + high]))


def _settle_singles(rows: list[dict]):
    doc, start = _unpacked(rows, "docs"), _unpacked(rows, "starts")
    one = np.concatenate([np.frombuffer(r["bytes"], U64)[: _count(r["docs"])] for r in rows])
    two = np.concatenate([np.frombuffer(r["bytes"], U64)[_count(r["docs"]) :] for r in rows])
    row = np.flatnonzero(doc > _least_doc(one, two, doc))
    return row, start[row], start[row] + WINDOW


def _phase_pairs(dealt: DataFrame, shared: DataFrame, n: int, n_ranks: int, n_parts: int) -> DataFrame:
    rows = _matchable(dealt).unionByName(shared.drop("text_bytes", "pair_bytes"), allowMissingColumns=True)
    sent = _in_buckets(rows, n).mapInArrow(_send_pairs(n_ranks, n_parts), _PAIR_SCHEMA)
    met = sent.repartition(n, "part").sortWithinPartitions("part", "kind", "bucket")
    return C.written(met.mapInArrow(_settle_pairs, "bucket int, kind int, numbers binary, starts binary, lengths binary"),
                     "windows")


# -- phase 3: cut


def _cut(batches):
    for _, own in by_key(batches, "bucket"):
        doc = start = end = None
        told, n = [], 0
        for batch in own:
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            told += batch.filter(pa.array(kind == 0)).select(["numbers", "starts", "lengths"]).to_pylist()
            batch = batch.filter(pa.array(kind == 1))
            if not batch.num_rows:
                continue
            if doc is None:
                start = _unpacked(told, "starts")
                doc, start, end = _merged(_unpacked(told, "numbers"), start, start + _unpacked(told, "lengths"))
            for part in C.slices([batch], "text"):
                out = {"removed": [], "spans": [], "sha": [], "bytes": [], "left": []}
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    data = (text or "").encode("utf-8")
                    a = b = 0
                    if doc_id is not None and len(data) >= WINDOW:
                        a, b = np.searchsorted(doc, n, "left"), np.searchsorted(doc, n, "right")
                        n += 1
                    left, at, removed = [], 0, 0
                    for s, e in zip(start[a:b].tolist(), end[a:b].tolist()):
                        left.append(data[at:s])
                        at, removed = e, removed + e - s
                    kept = b"".join([*left, data[at:]])
                    out["bytes"].append(len(data))
                    out["removed"].append(removed)
                    out["spans"].append(int(b - a))
                    out["sha"].append(hashlib.sha256(kept).hexdigest())
                    # A cut may fall inside a character; what is left of it goes.
                    out["left"].append(text if removed == 0 else kept.decode("utf-8", "ignore"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("carried"), pa.array(out["bytes"], pa.int64()), pa.array(out["removed"], pa.int64()),
                     pa.array(out["spans"], pa.int64()), pa.array(out["sha"]), pa.array(out["left"], pa.string())],
                    names=["carried", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   keep: tuple[str, ...] = ("doc_id",), hot_docs: int = 4096, share: float = 0.5) -> DataFrame:
    """Per row: ``carried`` (a struct of the ``keep`` columns), n_bytes, n_removed, n_spans, kept_sha256, kept_text.

    ``kept_text`` is what is left, without the rests of cut characters; the
    digest is of the bytes left.
    """
    n = C.partitions(docs.sparkSession)
    n_buckets, n_ranks = n, max(n, 64)
    dealt = _dealt(docs, doc_id, text, n_buckets)
    shared = _phase_ranks(dealt, n, n_ranks, hot_docs)
    _release(shared)
    passes, windows = _passes(shared, n_ranks, share), None
    n_parts = 2 * n if passes == 1 else n
    for k in range(passes):
        found = _phase_pairs(dealt, shared.filter(F.col("part") % passes == k), n, n_ranks, n_parts)
        _release(found)
        windows = found if windows is None else windows.unionByName(found)
    rows = _dealt(docs, doc_id, text, n_buckets, F.struct(*[F.col(k) for k in keep]))
    schema = C.schema_of(rows, ["carried"], "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
                                            "kept_text string")
    return _in_buckets(rows.unionByName(windows, allowMissingColumns=True), n).mapInArrow(
        _cut, schema)
