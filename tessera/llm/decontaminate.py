"""Benchmark decontamination: spaced-seed hashing with verified overlaps.

Texts are compared by words (in lower case, without punctuation at the ends;
words of punctuation alone do not count). A spaced seed is a fixed mask over a
run of words: the words at its ones are hashed, those at its zeros may differ.
The seeds of all benchmark items are joined with those of all documents;
around each hit, document and item are laid over each other along the hit's
diagonal. If three quarters of the item's words agree there, all of it is the
overlap; else it is the stretch with the most equal words among those in which
at least three words in four agree. An overlap counts as a leak when it has
``min_words`` equal words or, in short items, three fifths of the item's words.
Of an item all overlaps are given that do not run into a better one.

1. Items with equal words become one; their seeds are a table, and a bitmap of
   fixed size of their hashes goes to the tasks.
2. A task sends, of the documents' seeds, those whose bit is set: one row for a
   text and hash, with all places. They meet the items' seeds by hash.
3. The texts that have met an item send their words once; each is read with its
   candidates in a stream, diagonals are marked before any is looked at, and
   overlaps are verified.
4. What was found goes back to the documents by the digest of the text; a bitmap
   of the digests tells which rows to ask, so clean rows are not shuffled.

Rows: null and empty documents have no leaks; null and empty items, and items
of fewer than five words, match nothing; an item without item_id is left out;
items with equal words count once, under their smallest id; repeated documents
are judged alike, once; of equally good overlaps the first in the text is given;
very long texts are compared whole; an empty table of documents gives no rows,
one of items no leaks; columns named in ``keep`` pass through (one called
``leaks`` as ``leaks_kept``), others are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
# Masks of six or seven words: runs between substitutions, and shapes that bridge one or several.
MASKS = ("111111", "1110111", "11011011", "1101010111")
MIN_ITEM = 5
EDGES = ".,;:!?\"'()[]{}<>«»“”‘’*#%&$|-–—_~+=/\\…"
LEAK = "array<struct<item_id:bigint,n_equal:int,n_compared:int,word_start:int,word_end:int>>"


def word_values(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, bounds, place): a hash per word, the words of each text, and each word's number in its text."""
    codes, bounds, words = C.split_words(texts)
    plain = [w.lower().strip(EDGES) for w in words]
    counts = np.array([bool(w) for w in plain], bool)
    value = C.mix(C.hash_words(plain))
    place = C.ragged(np.zeros(len(bounds) - 1, np.int64), np.diff(bounds))
    keep = counts[codes]
    before = np.concatenate([[0], np.cumsum(keep)])
    return value[codes[keep]], before[bounds], place[keep]


def seed_hashes(values: np.ndarray, bounds: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of every placement of the mask within a text."""
    offsets = [i for i, c in enumerate(mask) if c == "1"]
    n = len(values) - len(mask) + 1
    if n <= 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    weights = C.odd_constants(len(offsets), len(mask) * 1000 + offsets[-1] + sum(offsets))
    hashed = np.zeros(n, U64)
    for o, w in zip(offsets, weights):
        hashed += values[o : o + n] * w
    inside = np.zeros(len(values) + 1, bool)
    # A start is inside if no text ends before the mask does.
    full = np.diff(bounds) >= len(mask)
    inside[C.ragged(bounds[:-1][full], np.diff(bounds)[full] - len(mask) + 1)] = True
    at = np.flatnonzero(inside[:n])
    return C.mix(hashed[at]), at


def all_seeds(values: np.ndarray, bounds: np.ndarray, masks: list[str], bits: np.ndarray | None = None):
    """(hash, text, places) of every seed hash of each text, once a text; only marked ones if ``bits`` are given."""
    hashes, places = [], []
    for mask in masks:
        hashed, at = seed_hashes(values, bounds, mask)
        if bits is not None:
            likely = C.marked(bits, hashed)
            hashed, at = hashed[likely], at[likely]
        hashes.append(hashed)
        places.append(at)
    hashed, at = np.concatenate(hashes), np.concatenate(places)
    text = np.searchsorted(bounds, at, side="right") - 1
    order = np.lexsort((at, hashed, text))
    hashed, at, text = hashed[order], at[order], text[order]
    again = np.zeros(len(at), bool)  # two masks of equal shape
    again[1:] = (hashed[1:] == hashed[:-1]) & (at[1:] == at[:-1])
    hashed, at, text = hashed[~again], at[~again], text[~again]
    head = np.ones(len(at), bool)
    head[1:] = (hashed[1:] != hashed[:-1]) | (text[1:] != text[:-1])
    cut = np.append(np.flatnonzero(head), len(at)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(cut), pa.array((at - bounds[text]).astype(np.int32)))
    return hashed[head], text[head], lists


def overlap(text: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """(equal words, start, end in the text) of the overlap of the two along a diagonal."""
    low, high = max(0, -diagonal), min(len(item), len(text) - diagonal)
    equal = text[diagonal + low : diagonal + high] == item[low:high]
    if 4 * equal.sum() >= 3 * len(item):
        at = np.flatnonzero(equal)
        return len(at), diagonal + low + int(at[0]), diagonal + low + int(at[-1]) + 1
    at = np.flatnonzero(equal)
    if not len(at):
        return 0, diagonal + low, diagonal + low
    # From equal word a to equal word b at least three in four agree if level[a] <= level[b] + 1.
    level = 4 * np.arange(len(at)) - 3 * at
    first = np.searchsorted(-np.minimum.accumulate(level), -(level + 1))
    b = int((np.arange(len(at)) - first).argmax())
    a = int(first[b])
    return b - a + 1, diagonal + low + int(at[a]), diagonal + low + int(at[b]) + 1


def merged_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, words): the items that can match, those with equal words under their smallest id."""

    def run(batches):
        for batch in C.slices(batches, "text"):
            values, bounds, _ = word_values(C.texts_of(batch, "text"))
            words = [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array(np.diff(bounds)), pa.array(words, pa.binary())],
                names=["item_id", "n", "words"])

    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    items = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    items = items.mapInArrow(run, "item_id bigint, n bigint, words binary").filter(F.col("n") >= MIN_ITEM)
    items = items.groupBy(F.sha2("words", 256).alias("sha")).agg(
        F.min("item_id").alias("item_id"), F.first("n").alias("n"), F.first("words").alias("words"))
    return C.written(items.drop("sha"), "items")


def item_seeds(items: DataFrame, masks: list[str]) -> DataFrame:
    """(key, item_id, places): the items' seeds; items shorter than the longest mask have one of all their words too."""

    def run(batches):
        for batch in C.slices(batches, "words", 1 << 20):
            words = batch.column("words").to_pylist()
            bounds = np.cumsum([0, *(len(w) // 8 for w in words)])
            values = np.frombuffer(b"".join(words), U64)
            hashed, text, places = all_seeds(values, bounds, masks)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashed.view(np.int64)), batch.column("item_id").take(pa.array(text)), places],
                names=["key", "item_id", "places"])

    return C.written(items.mapInArrow(run, "key bigint, item_id bigint, places array<int>"), "seeds")


def text_digests(texts: pa.Array) -> list[bytes]:
    """128 bits of each text."""
    return [hashlib.blake2b(t, digest_size=16).digest() for t in texts.cast(pa.binary()).to_pylist()]


def _head(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), U64)


def _sent(df: DataFrame):
    """A broadcast bitmap of the digests in column ``sha``."""

    def keys(batches):
        for batch in batches:
            key = _head(batch.column("sha").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    return df.sparkSession.sparkContext.broadcast(C.bitmap_of(df.select("sha").mapInArrow(keys, "key bigint")))


def candidates(docs: DataFrame, items: DataFrame, text: str) -> DataFrame:
    """(sha, item_id, hits, words): the items that a text shares a seed with, their words, and where they meet."""
    short = [r["n"] for r in items.filter(F.col("n") < max(map(len, MASKS))).select("n").distinct().collect()]
    masks = [*MASKS, *("1" * n for n in sorted(short))]
    seeds = item_seeds(items, masks)
    sent = docs.sparkSession.sparkContext.broadcast(C.bitmap_of(seeds.select("key")))

    def run(batches):
        for batch in C.slices(batches, text):
            texts = C.texts_of(batch, text)
            values, bounds, _ = word_values(texts)
            hashed, of, at = all_seeds(values, bounds, masks, sent.value)
            met = np.unique(of)
            digest = dict(zip(met.tolist(), text_digests(texts.take(pa.array(met)))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashed.view(np.int64)), pa.array([digest[t] for t in of.tolist()], pa.binary()), at],
                names=["key", "sha", "at"])

    hits = docs.select(text).mapInArrow(run, "key bigint, sha binary, at array<int>").dropDuplicates(["key", "sha"])
    met = hits.join(seeds, "key").groupBy("sha", "item_id").agg(F.collect_list(F.struct("at", "places")).alias("hits"))
    return C.written(met.join(items.select("item_id", "words"), "item_id"), "candidates")


def words_of(docs: DataFrame, wanted, text: str) -> DataFrame:
    """(sha, words, place) of the texts whose bit is set, each once."""

    def run(batches):
        for batch in C.slices(batches, text):
            texts = C.texts_of(batch, text)
            sha = text_digests(texts)
            likely = np.flatnonzero(C.marked(wanted.value, _head(sha)))
            values, bounds, place = word_values(texts.take(pa.array(likely)))
            pairs = list(zip(bounds[:-1], bounds[1:]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([sha[i] for i in likely], pa.binary()), pa.array([values[a:b].tobytes() for a, b in pairs], pa.binary()),
                 pa.array([place[a:b].astype(np.int32).tobytes() for a, b in pairs], pa.binary())],
                names=["sha", "words", "place"])

    rows = docs.select(text).mapInArrow(run, "sha binary, words binary, place binary")
    return rows.groupBy("sha").agg(F.first("words").alias("words"), F.first("place").alias("place"))


def diagonals(hits: list[dict], n_text: int, n_item: int) -> np.ndarray:
    """The distinct differences of where text and item have a common seed."""
    found = np.zeros(n_text + n_item, bool)
    for hit in hits:
        at, places = np.array(hit["at"]), np.array(hit["places"])
        few, many = sorted((at, -places), key=len)
        for k in few.tolist():
            found[many + (k + n_item)] = True
    return np.flatnonzero(found) - n_item


def disjoint_overlaps(text: np.ndarray, item: np.ndarray, along: np.ndarray, min_words: int) -> list[tuple[int, int, int]]:
    """(equal words, start, end) of the overlaps that count, in the text's order; none runs into a better one."""
    need = min(min_words, -(-3 * len(item) // 5))
    found = (overlap(text, item, d) for d in along.tolist())
    ranked = sorted((-equal, start, end) for equal, start, end in found if equal >= need)
    taken = np.zeros(len(text) + 1, bool)
    out = []
    for equal, start, end in ranked:
        if not taken[start:end].any():
            taken[start:end] = True
            out.append((-equal, start, end))
    return sorted(out, key=lambda x: x[1])


def verified(met: DataFrame, docs: DataFrame, text: str, min_words: int) -> DataFrame:
    """(sha, leaks) of the texts with leaks: each text's candidates are read in a stream behind its words."""
    words = words_of(docs, _sent(met), text)
    none = F.lit(None)
    rows = met.select("sha", "item_id", "hits", "words", none.cast("binary").alias("place")).unionByName(
        words.select("sha", none.cast("bigint").alias("item_id"), none.cast(met.schema["hits"].dataType).alias("hits"),
                     "words", "place"))
    # The row without an item comes first.
    dealt = rows.repartition(C.partitions(docs.sparkSession), "sha").sortWithinPartitions("sha", "item_id")

    def run(batches):
        sha = values = place = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = np.frombuffer(row["words"], U64)
                if row["item_id"] is None:
                    sha, values, place = row["sha"], own, np.frombuffer(row["place"], np.int32)
                elif row["sha"] == sha:
                    along = diagonals(row["hits"], len(values), len(own))
                    for equal, start, end in disjoint_overlaps(values, own, along, min_words):
                        out.append({"sha": sha, "item_id": row["item_id"], "word_start": int(place[start]), "n_equal": equal,
                                    "n_compared": end - start, "word_end": int(place[end - 1]) + 1})
            yield pa.RecordBatch.from_pylist(out, schema=_FOUND)

    found = dealt.mapInArrow(run, "sha binary, item_id bigint, word_start int, n_equal int, n_compared int, word_end int")
    inside = F.array_sort(F.collect_list(F.struct("item_id", "word_start", "n_equal", "n_compared", "word_end")))
    leaks = F.transform(inside, lambda x: F.struct(*[x[c].alias(c) for c in (
        "item_id", "n_equal", "n_compared", "word_start", "word_end")]))
    return C.written(found.groupBy("sha").agg(leaks.alias("leaks")), "leaks")


_FOUND = pa.schema([("sha", pa.binary()), ("item_id", pa.int64()), *((c, pa.int32()) for c in (
    "word_start", "n_equal", "n_compared", "word_end"))])


def _judged(docs: DataFrame, benchmark: DataFrame, text: str, keep: tuple[str, ...], min_words: int):
    """(kept, sha, likely) of every row, and the leaks by sha: a row without ``likely`` has none."""
    found = verified(candidates(docs, merged_items(benchmark), text), docs, text, min_words)
    sent = _sent(found)
    rows = docs.select(F.struct(*[F.col(k) for k in keep]).alias("kept"), F.col(text).alias("text"))

    def run(batches):
        for batch in C.slices(batches, "text"):
            sha = text_digests(C.texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("kept"), pa.array(sha, pa.binary()), pa.array(C.marked(sent.value, _head(sha)))],
                names=["kept", "sha", "likely"])

    schema = C.schema_of(rows, ["kept"], "sha binary, likely boolean")
    return rows.mapInArrow(run, schema), found


def _unpacked(keep: tuple[str, ...], own: tuple[str, ...]):
    return [F.col(f"kept.`{k}`").alias(k + "_kept" * (k.lower() in own)) for k in keep]


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
               min_words: int = 10) -> DataFrame:
    """``keep`` columns plus ``leaks``: the verified overlaps of each document, by item and place."""
    rows, found = _judged(docs, benchmark, text, keep, min_words)
    none = F.expr(f"CAST(array() AS {LEAK})")
    clean = rows.filter("NOT likely").select("kept", none.alias("leaks"))
    asked = rows.filter("likely").join(found, "sha", "left").select("kept", F.coalesce("leaks", none).alias("leaks"))
    return clean.unionByName(asked).select(*_unpacked(keep, ("leaks",)), "leaks")


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
          min_words: int = 10) -> DataFrame:
    """One row per document and overlap: the ``keep`` columns, item_id and the overlap."""
    rows, found = _judged(docs, benchmark, text, keep, min_words)
    own = ("item_id", "n_equal", "n_compared", "word_start", "word_end")
    met = rows.filter("likely").join(found, "sha").select("kept", F.explode("leaks").alias("leak"))
    return met.select(*_unpacked(keep, own), "leak.*")
