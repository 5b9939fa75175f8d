"""Near-duplicate groups: MinHash with tensored banding, links confirmed on full sets.

A text's set holds the 64-bit hashes of its distinct word shingles. Two small
collections of half-keys (``halves`` each, of ``rows`` minhashes) are computed
per set, and every pair of one half-key from either collection is the key of a
table: ``halves ** 2`` tables with ``2 * rows`` minhashes per key from only
``2 * halves * rows`` minhashes, about the square root of what independent
tables would need. Two sets of similarity s meet in a table with probability
``(1 - (1 - s ** rows) ** halves) ** 2``; with the defaults 0.997 at s = 0.75,
0.9996 at 0.8 and 0.99998 at 0.85.

Half-keys that nobody shares are dropped before any table key is formed, so a
text unlike all others sends its half-keys and nothing else. Whatever meets in
a table is confirmed on the full sets. Equal sets are one class from the start.
In every table each class is compared with the first one (by smallest doc_id)
that has the same key; keys that meet within a batch are tied there already and cross the shuffle
once, so that a very large group of near copies does not fill one task.

After the components of those links are known, only keys that still hold
several components are opened again, and the pairs across components in them
are confirmed too, unless they cannot be similar. Two sets share as many
shingles as their sizes tell, or are not similar; so either they share a rare
one (one that at most ``RARE`` of the opened sets have), and are found by it, or
both have enough that are not rare. Only the pairs of these two kinds are
confirmed, and no others can be links. In a large family of copies that are all
edited in different places this settles the outliers without comparing each
with the whole family.

Rows: null and empty texts have empty sets and are linked with nothing; a row
without doc_id is linked with nothing, has no component and is kept; repeated
rows form one class; several texts under one doc_id are linked by their texts,
not by the id; ties do not arise, as the smallest id stands for a group; extra
columns are ignored, whatever their names; very long texts give large sets, a
few texts at a time; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .graph import components

U64 = np.uint64
SHINGLE, PERCENT = 5, 75
HALVES, ROWS = 12, 3
RARE = 8


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; words are compared with A-Z in lower case."""
    codes, bounds, words = C.split_words(pc.ascii_lower(texts))
    weights = C.odd_constants(k, 5)
    value = C.mix(C.hash_words(words))[codes]
    n = len(codes)
    hashed = np.zeros(max(n - k + 1, 0), U64)
    for i in range(k):
        hashed += value[i : n - k + 1 + i] * weights[i]
    hashed = C.mix(hashed)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(hashed[a : b - k + 1]))
        elif b > a:  # fewer words than a shingle: the whole sequence is one
            one = (value[a:b] * weights[: b - a]).sum(dtype=U64) + U64(b - a)
            out.append(C.mix(np.array([one], U64)))
        else:
            out.append(np.empty(0, U64))
    return out


def half_keys(sets: list[np.ndarray], halves: int, rows: int) -> np.ndarray:
    """2 * halves half-keys (32 bits) of each set; zeros for empty sets."""
    out = np.zeros((len(sets), 2 * halves), np.uint32)
    full = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if not len(full):
        return out
    values = np.concatenate([sets[i] for i in full])
    starts = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
    factors = C.odd_constants(2 * halves * rows, 17)
    for h in range(2 * halves):
        key = np.zeros(len(full), U64)
        for r in range(rows):
            least = np.minimum.reduceat((values * factors[h * rows + r]) >> U64(20), starts)
            key = C.mix(key * U64(31) + least)
        out[full, h] = key >> U64(32)
    return out


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """A 128-bit digest of each set, as two numbers."""
    flat = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
    return np.frombuffer(flat, np.int64).reshape(-1, 2)


def signatures(docs: DataFrame, text: str, halves: int, rows: int) -> DataFrame:
    """(doc_id, n, d1, d2, halves, text_sha): set size, 128-bit digest of the set, its half-keys, digest of the text."""

    def run(batches):
        for batch in C.slices(batches, text):
            texts = C.texts_of(batch, text)
            sets = shingle_sets(texts)
            d = digests(sets)
            keys = half_keys(sets, halves, rows)
            sha = [hashlib.sha256(t).digest() for t in texts.cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array([k.tobytes() for k in keys], pa.binary()),
                 pa.array(sha, pa.binary())],
                names=["doc_id", "n", "d1", "d2", "halves", "text_sha"])

    return docs.select("doc_id", text).mapInArrow(
        run, "doc_id bigint, n bigint, d1 bigint, d2 bigint, halves binary, text_sha binary")


def table_keys(halves_column: pa.Array, halves: int) -> np.ndarray:
    """The key of every table (all pairs of a left and a right half-key), one row per set."""
    flat = np.frombuffer(b"".join(halves_column.to_pylist()), np.uint32).reshape(-1, 2 * halves).astype(U64)
    left, right = flat[:, :halves], flat[:, halves:]
    pair = (left[:, :, None] << U64(32)) | right[:, None, :]
    table = C.mix(np.arange(1, halves * halves + 1, dtype=U64)).reshape(halves, halves)
    return C.mix(pair ^ table).reshape(len(flat), halves * halves)


def shared_halves(classes: DataFrame, halves: int) -> DataFrame:
    """The classes that share half-keys with others, with ``mask``: which of their half-keys those are."""

    def run(batches):
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column("halves").to_pylist()), np.uint32).astype(U64)
            slot = np.tile(np.arange(2 * halves), batch.num_rows)
            key = C.mix((slot.astype(U64) << U64(32)) | flat)
            at = pa.array(np.repeat(np.arange(batch.num_rows), 2 * halves))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), batch.column("id").take(at), pa.array(1 << slot.astype(np.int64))],
                names=["half", "id", "bit"])

    keys = classes.select("id", "halves").mapInArrow(run, "half bigint, id bigint, bit bigint")
    several = keys.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    masks = keys.join(several, "half").groupBy("id").agg(F.bit_or("bit").alias("mask"))
    left, right = (1 << halves) - 1, ((1 << halves) - 1) << halves
    return classes.join(masks.filter(f"mask & {left} > 0 AND mask & {right} > 0"), "id")


def live_tables(batch: pa.RecordBatch, halves: int) -> np.ndarray:
    """Which tables have a key of both shared halves, one row per class."""
    mask = batch.column("mask").to_numpy(zero_copy_only=False)
    bits = (mask[:, None] >> np.arange(2 * halves)) & 1 == 1
    return (bits[:, :halves, None] & bits[:, None, halves:]).reshape(len(mask), halves * halves)


def deal(classes: DataFrame, halves: int) -> DataFrame:
    """(k, id, n): one row per class and live table key; keys met twice within a batch are tied there.

    Of the classes of a batch that share a key only the smallest id carries
    it on. The others are tied to that id by a key that only the two have.
    """

    def run(batches):
        for batch in batches:
            batch = batch.sort_by("id")
            ids, sizes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "n"))
            live = live_tables(batch, halves)
            flat = table_keys(batch.column("halves"), halves)[live]
            owner = np.repeat(np.arange(len(ids)), live.sum(1))
            by_key = np.argsort(flat, kind="stable")  # within a key by id
            flat, owner = flat[by_key], owner[by_key]
            head = np.concatenate([[True], flat[1:] != flat[:-1]])[: len(flat)]
            first = owner[np.maximum.accumulate(np.where(head, np.arange(len(flat)), 0))]
            tied = np.unique(first[~head] * len(ids) + owner[~head])
            a, b = tied // max(len(ids), 1), tied % max(len(ids), 1)
            own = C.mix(C.mix(ids[a].astype(U64)) * U64(3) + ids[b].astype(U64))
            k = np.concatenate([flat[head], own, own])
            rows = np.concatenate([owner[head], a, b])
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(ids[rows]), pa.array(sizes[rows])],
                                             names=["k", "id", "n"])

    return classes.select("id", "n", "halves", "mask").mapInArrow(run, "k bigint, id bigint, n bigint")


def explode_keys(classes: DataFrame, halves: int) -> DataFrame:
    """(k, id, n, component, halves, left, right) of every class given and every live table."""

    def run(batches):
        # A row becomes up to halves ** 2, so only a few are opened at a time.
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            live = live_tables(batch, halves)
            k = table_keys(batch.column("halves"), halves)[live]
            row, table = np.nonzero(live)
            columns = [batch.column(c).take(pa.array(row)) for c in ("id", "n", "component", "halves")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(k.view(np.int64)), *columns, pa.array(table // halves), pa.array(table % halves)],
                names=["k", "id", "n", "component", "halves", "left", "right"])

    return classes.select("id", "n", "halves", "mask", "component").mapInArrow(
        run, "k bigint, id bigint, n bigint, component bigint, halves binary, left bigint, right bigint")


def first_meeting(halves: int):
    """Is this the first of the tables where the rows and ``other_halves`` meet? A pair is looked at there only."""

    def same(slot):
        at = (slot * 4 + 1).cast("int")
        return F.substring("halves", at, F.lit(4)) == F.substring("other_halves", at, F.lit(4))

    slots = F.array(*[F.lit(i) for i in range(halves)])
    return ~(F.exists(slots, lambda i: (i < F.col("left")) & same(i))
             | F.exists(slots, lambda i: (i < F.col("right")) & same(i + halves)))


def sizes_allow(n: str, m: str, percent: int):
    """Sets whose sizes differ too much cannot be similar enough, whatever they share."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def full_sets(docs: DataFrame, classes: DataFrame, text: str) -> DataFrame:
    """(id, members): the full set of each class given (id, least, d1, d2), once, written to the shared folder.

    The texts are those under the classes' smallest doc_ids; a set belongs to
    the class of its digest, however many rows have it. A bitmap of those ids,
    of a fixed size, tells the tasks which texts to look at, so no text is
    shuffled; the classes grow with the input and are joined.
    """

    def hashed(ids):
        return C.mix(ids.astype(np.int64).view(U64) * U64(2) + U64(1))

    def keys(batches):
        for batch in batches:
            key = hashed(batch.column("least").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    wanted = docs.sparkSession.sparkContext.broadcast(
        C.bitmap_of(classes.select("least").mapInArrow(keys, "key bigint")))

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            likely = C.marked(wanted.value, hashed(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)))
            batch = batch.filter(pa.array(likely & ids.is_valid().to_numpy(zero_copy_only=False)))
            for part in C.slices([batch], text):
                sets = shingle_sets(C.texts_of(part, text))
                d = digests(sets)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]),
                     pa.array([s.tobytes() for s in sets], pa.binary())], names=["least", "d1", "d2", "members"])

    sets = docs.select("doc_id", text).mapInArrow(run, "least bigint, d1 bigint, d2 bigint, members binary")
    sets = sets.join(classes.select("least", "d1", "d2", "id").hint("merge"), ["least", "d1", "d2"])
    sets = sets.groupBy("id").agg(F.first("members").alias("members"))
    return C.written(sets.select("id", "members"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have intersection / union >= percent / 100."""

    def compare(batches):
        for batch in C.slices(batches, "left"):
            keep = []
            for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(
        compare, "a bigint, b bigint")


def rare_members(sets: DataFrame, most: int = RARE) -> DataFrame:
    """(member, id, n_sets) of the members that at most ``most`` of the sets have."""

    def run(batches):
        for batch in C.slices(batches, "members", 4 << 20):
            flat = np.frombuffer(b"".join(batch.column("members").to_pylist()), np.int64)
            size = pc.binary_length(batch.column("members")).to_numpy(zero_copy_only=False) // 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat), pa.array(np.repeat(batch.column("id").to_numpy(zero_copy_only=False), size))],
                names=["member", "id"])

    members = sets.mapInArrow(run, "member bigint, id bigint")
    rare = members.groupBy("member").agg(F.count("*").alias("n_sets")).filter(F.col("n_sets") <= most)
    return members.join(rare, "member")


def pairs_by_size(dense: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``dense`` rows on one key k that their sizes n and common members allow.

    With ``common`` shared members at most, a set of size n has only partners
    of sizes up to ``common * (100 + p) / p - n``. So a row looks into the size
    classes between that and p percent of n, and the outliers of a large family,
    who have no such class, meet nobody.
    """
    step = 1.1
    size_class = lambda n: F.floor(F.log(n) / float(np.log(step))).cast("int")
    least = F.ceil(F.col("n") * percent / 100)
    most = F.least(F.floor(F.col("n") * 100 / percent), F.floor(F.col("common") * (100 + percent) / percent) - F.col("n"))
    # A class more on either side makes up for rounding.
    looking = dense.withColumn("least", least).withColumn("most", most).filter("most >= least")
    looking = looking.withColumn("size", F.explode(F.sequence(size_class(F.col("least")) - 1, size_class(F.col("most")) + 1)))
    other = dense.select("k", F.col("id").alias("b"), F.col("n").alias("m"), F.col("component").alias("c"),
                         F.col("common").alias("d"), F.col("halves").alias("other_halves"), size_class(F.col("n")).alias("size"))
    enough = F.least("common", "d") * (100 + percent) >= (F.col("n") + F.col("m")) * percent
    different = (F.col("id") < F.col("b")) & (F.col("component") != F.col("c")) & sizes_allow("n", "m", percent)
    return looking.join(other, ["k", "size"]).filter(different & enough)


def near_duplicates(docs: DataFrame, text: str = "text", percent: int = PERCENT, halves: int = HALVES,
                    rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, d1, d2, text_sha) of every row.

    d1, d2 identify the row's set, text_sha (SHA-256) its text.
    """
    signed = C.written(signatures(docs, text, halves, rows), "signatures")
    classes = signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("halves").alias("halves"))
    # Numbered in the order of their smallest doc_ids: two texts under one doc_id are two classes.
    classes = classes.orderBy("least", "d1", "d2").withColumn("id", F.monotonically_increasing_id())
    classes = C.written(classes, "classes")
    live = C.written(shared_halves(classes, halves), "live")

    by_key = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hub = F.first(F.struct("id", "n")).over(by_key)
    met = deal(live, halves).withColumn("hub", hub).filter("id <> hub.id")
    # Sizes decide only whether a pair is confirmed; whoever met somebody is looked at again below.
    met = C.written(met.select(F.col("hub.id").alias("a"), F.col("id").alias("b"),
                               sizes_allow("n", "hub.n", percent).alias("possible")).distinct(), "met")
    suspects = met.select(F.col("a").alias("id")).unionByName(met.select(F.col("b").alias("id"))).distinct()
    suspects = C.written(live.join(suspects, "id", "left_semi"), "suspects")
    sets = full_sets(docs, suspects, text)
    links = C.written(confirmed(met.filter("possible").select("a", "b"), sets, percent), "links")
    labels = C.written(components(links), "components")

    # Keys that still hold several components: the pairs across components that were not looked at.
    keys = explode_keys(suspects.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")), halves)
    mixed = keys.groupBy("k").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    open_ = C.written(keys.join(mixed.filter("low < high").select("k"), "k"), "open")
    rare = C.written(rare_members(sets.join(open_.select("id").distinct(), "id", "left_semi")), "rare")

    # x and y at percent p share p / (100 + p) of both sizes together, and y has at least p percent of x's size.
    common = F.col("n") - F.coalesce("n_rare", F.lit(0))
    n_rare = rare.groupBy("id").agg(F.count("*").alias("n_rare"))
    dense = open_.join(n_rare, "id", "left").withColumn("common", common)
    dense = C.written(dense.filter(F.col("common") * 100 >= F.col("n") * percent), "dense")
    by_table = pairs_by_size(dense, percent).filter(first_meeting(halves))
    facts = open_.select("id", "n", "component").distinct()
    met_rare = rare.filter("n_sets > 1").select("member", "id").join(facts, "id")
    other = met_rare.select("member", F.col("id").alias("b"), F.col("n").alias("m"), F.col("component").alias("c"))
    by_rare = met_rare.join(other, "member").filter(
        (F.col("id") < F.col("b")) & (F.col("component") != F.col("c")) & sizes_allow("n", "m", percent))
    across = (by_table.select(F.col("id").alias("a"), "b").unionByName(by_rare.select(F.col("id").alias("a"), "b"))
              .distinct().join(met.select("a", "b"), ["a", "b"], "left_anti"))
    more = C.written(confirmed(C.written(across, "across"), sets, percent), "links")
    labels = C.written(components(links.unionByName(more)), "components")

    # The smallest number of a component is that of its smallest doc_id.
    first = classes.select(F.col("id").alias("component"), F.col("least").alias("first"))
    names = classes.select("d1", "d2", "id", "least").join(labels.join(first, "component"), "id", "left")
    names = names.select("d1", "d2", F.coalesce("first", "least").alias("component"))
    found = signed.join(names, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "d1", "d2", "text_sha")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their groups, with all their columns.

    Of a group one row stays: of the rows with its smallest id the one whose
    text has the least set and digest, and of equal texts the one whose other
    columns hash least. Rows without an id or without a word are in no group
    and stay as they are. Texts are shuffled once, by (id, digest); of rows that
    repeat only one leaves each task.
    """
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), whole)
    found = near_duplicates(rows.select("doc_id", "text"))
    chosen = found.filter("kept AND doc_id IS NOT NULL AND n_shingles > 0").groupBy(F.col("doc_id").alias("id")).agg(
        F.min(F.struct("d1", "d2", "text_sha"))["text_sha"].alias("sha"))
    grouped = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = rows.withColumn("grouped", grouped)
    sha = F.unhex(F.sha2("text", 256))
    own = rows.filter("grouped").select(F.col("doc_id").alias("id"), sha.alias("sha"), "row",
                                        F.xxhash64("row").alias("tie"))
    first = F.row_number().over(Window.partitionBy("id", "sha").orderBy("tie"))
    own = own.withColumn("nth", first).filter("nth = 1").join(chosen, ["id", "sha"], "left_semi")
    return own.select("row.*").unionByName(rows.filter(~F.col("grouped")).select("row.*"))
