"""Source divergence audit: how far the sources of a language differ in their terms, from count-level bitmaps.

Terms are runs of ASCII letters and characters beyond ASCII, with A-Z in lower
case. A language keeps the terms that at least ``min_docs`` of its documents
have. A group (language and source) gives a kept term the smoothed share
``1 + floor(10^9 * (count + 2) / (N + 2 V))``, and two shares differ by
``floor((p - q)^2 / (p + q))``.

A share depends on nothing but the group and the count. So the difference of
two groups, summed over all kept terms, needs only the numbers of terms that
one has ``a`` times and the other ``b`` times. Term ids are dealt into blocks
of about ``block_terms``; in a block every (group, count) has the bitset of its
term ids, an AND and a population count of two bitsets is a joint cell, each
cell is multiplied by its difference, and the cells of count 0 follow from the
complement. As in any compressed bitmap, a level with fewer ids than its bitset
has machine words is held as the list of its ids, and AND tests their bits.

Scale: occurrences are summed inside the tasks before one shuffle by
(language, term); a block has about ``block_terms`` terms, whatever the
vocabulary, and its sums are added up by pair. The result itself has a row for
every pair of sources of a language.

Rows: null texts, languages and sources count as ''; a group without terms has
count 0 everywhere; repeated documents count each time; ties of a rank go to
the item that comes first in UTF-8 order; very long texts are read a slice of a
batch at a time; other columns are passed over; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

MIN_DOCS, BLOCK_TERMS, TERM_RANKS = 10, 4096, 10
SCALE = 1_000_000_000
# All ASCII characters but the letters.
_BETWEEN = bytes(b for b in range(128) if not chr(b).isalpha())


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs) with several rows for a term and group, already summed within tasks."""

    def counted(batches):
        for batch in C.slices(batches, "text"):
            codes, words, bounds, _ = C.byte_words(pc.ascii_lower(C.texts_of(batch, "text")), _BETWEEN)
            lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            width = max(1, len(words))
            in_doc, n = np.unique(doc * width + codes, return_counts=True)
            key, of = np.unique(group[in_doc // width] * width + in_doc % width, return_inverse=True)
            group, term = key // width, key % width
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(group // len(source.dictionary))),
                 source.dictionary.take(pa.array(group % len(source.dictionary))), words.take(pa.array(term)),
                 pa.array(np.bincount(of, n, len(key)).astype(np.int64)),
                 pa.array(np.bincount(of, minlength=len(key)).astype(np.int64))],
                names=["lang", "source", "term", "n", "n_docs"])

    return docs.select("lang", "source", "text").mapInArrow(
        lambda batches: C.combined(counted(batches), ["lang", "source", "term"]),
        "lang string, source string, term string, n bigint, n_docs bigint")


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, source, n, total, lead) of the kept terms; total is over the language, lead marks one row a term."""
    counts = term_counts(docs).repartition("lang", "term")
    counts = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    term = Window.partitionBy("lang", "term")
    counts = counts.select("*", F.sum("n").over(term).alias("total"), F.sum("n_docs").over(term).alias("in_docs"),
                           (F.col("source") == F.min("source").over(term)).alias("lead"))
    return counts.filter(F.col("in_docs") >= min_docs).select("lang", "term", "source", "n", "total", "lead")


def share(count, total):
    """1 + floor(10^9 * (count + 2) / (total + 2 V)) with V in column ``n_terms``; 0 without terms."""
    numerator = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    whole = (total + 2 * F.col("n_terms")).cast("decimal(20,0)")
    return F.when(F.col("n_terms") > 0, 1 + F.call_function("div", numerator, whole).cast("bigint")).otherwise(0)


def difference(p, q):
    """floor((p - q)^2 / (p + q)) of shares, as numbers or arrays."""
    return (p - q) * (p - q) // (p + q)


class CountBitmaps:
    """The term-id bitsets of one group in a block, one for each count."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, shares: np.ndarray, zero_share: int, n_ids: int):
        self.n_ids, self.n, self.p0 = n_ids, len(ids), zero_share
        words = -(-n_ids // 64)
        levels, first, level, size = np.unique(counts, return_index=True, return_inverse=True, return_counts=True)
        dense = np.flatnonzero(size >= max(2, words))
        row = np.full(len(levels), -1)
        row[dense] = np.arange(len(dense))
        self.p, self.size = shares[first][dense], size[dense]
        self.bits = np.zeros((len(dense), words), np.uint64)
        at = row[level]
        np.bitwise_or.at(self.bits, (at[at >= 0], ids[at >= 0] >> 6), np.uint64(1) << (ids[at >= 0] & 63).astype(np.uint64))
        by_id = np.argsort(ids[at < 0])
        self.ids, self.ids_p = ids[at < 0][by_id], shares[at < 0][by_id]

    def has(self, ids: np.ndarray) -> np.ndarray:
        """Whether each bitset has each id."""
        return (self.bits[:, ids >> 6] >> (ids & 63).astype(np.uint64)) & np.uint64(1) == 1

    def differs(self, other: CountBitmaps) -> int:
        """The sum of the two groups' differences over all term ids of the block."""
        cells = np.bitwise_count(self.bits[:, None, :] & other.bits[None, :, :]).sum(2, dtype=np.int64)
        total = (cells * difference(self.p[:, None], other.p[None, :])).sum()
        here, there = other.has(self.ids), self.has(other.ids)
        total += (here * difference(other.p[:, None], self.ids_p[None, :])).sum()
        total += (there * difference(self.p[:, None], other.ids_p[None, :])).sum()
        _, i, j = np.intersect1d(self.ids, other.ids, assume_unique=True, return_indices=True)
        total += difference(self.ids_p[i], other.ids_p[j]).sum()
        both = cells.sum() + here.sum() + there.sum() + len(i)
        for own, met, has, listed, p0 in (
                (self, cells.sum(1) + there.sum(1), here, i, other.p0), (other, cells.sum(0) + here.sum(1), there, j, self.p0)):
            total += ((own.size - met) * difference(own.p, p0)).sum()
            alone = ~has.any(0)
            alone[listed] = False
            total += difference(own.ids_p[alone], p0).sum()
        return int(total + (self.n_ids - self.n - other.n + both) * difference(self.p0, other.p0))


_SUMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def block_sums(block: pa.Table) -> pa.Table:
    """(lang, source, item, value) of every pair of groups over one block; rows without a term name the groups."""
    block = block.combine_chunks()
    source = pc.rank(block["source"], tiebreaker="dense").to_numpy().astype(np.int64) - 1
    term = block["term"].combine_chunks().dictionary_encode()
    named = term.is_null().to_numpy(zero_copy_only=False)
    ids = term.indices.fill_null(0).to_numpy().astype(np.int64)
    n, p = block["n"].to_numpy(), block["p"].to_numpy()
    names = block["source"].filter(pa.array(named)).to_pylist()
    zero = dict(zip(source[named].tolist(), p[named].tolist()))
    names = [x for _, x in sorted(zip(source[named].tolist(), names))]
    order = np.argsort(source[~named], kind="stable")
    ids, n, p, owner = ids[~named][order], n[~named][order], p[~named][order], source[~named][order]
    cut = np.searchsorted(owner, np.arange(len(names) + 1))
    groups = [CountBitmaps(ids[a:b], n[a:b], p[a:b], zero[k], len(term.dictionary))
              for k, (a, b) in enumerate(zip(cut[:-1], cut[1:]))]
    pairs = [(names[i], names[k], groups[i].differs(groups[k])) for i in range(len(names)) for k in range(i)]
    lang = block["lang"][0].as_py()
    return pa.Table.from_pylist([{"lang": lang, "source": a, "item": b, "value": v} for a, b, v in pairs], _SUMS)


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, block_terms: int = BLOCK_TERMS,
                      term_ranks: int = TERM_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources, ``term`` the group's own terms."""
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
                       F.coalesce("text", F.lit("")).alias("text"))
    kept = C.written(kept_terms(rows, min_docs), "kept-terms")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.sum(F.col("lead").cast("bigint")).alias("leads"))
    langs = sums.groupBy("lang").agg(F.sum("n_group").alias("n_lang"), F.sum("leads").alias("n_terms"))
    zero = F.lit(0).cast("bigint")
    groups = (rows.select("lang", "source").distinct().join(sums.drop("leads"), ["lang", "source"], "left")
              .join(langs, "lang", "left").fillna(0, ["n_group", "n_lang", "n_terms"]))
    blocks = F.ceil(F.col("n_terms") / block_terms).cast("bigint")
    groups = C.written(groups.withColumn("p", share(zero, F.col("n_group"))).withColumn("n_blocks", blocks), "groups")

    cells = kept.join(groups.drop("p"), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("n_group")))
    block = F.pmod(F.xxhash64("term"), "n_blocks")
    named = groups.filter("n_blocks > 0").select(
        "lang", F.explode(F.sequence(zero, F.col("n_blocks") - 1)).alias("block"), "source",
        F.lit(None).cast("string").alias("term"), zero.alias("n"), "p")
    dealt = cells.select("lang", block.alias("block"), "source", "term", "n", "p").unionByName(named)
    by_pair = dealt.groupBy("lang", "block").applyInArrow(
        block_sums, "lang string, source string, item string, value bigint")
    by_pair = by_pair.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # A language without kept terms has no block; its pairs differ by nothing.
    other = groups.select("lang", F.col("source").alias("item"), "n_terms")
    bare = groups.filter("n_terms = 0").select("lang", "source").join(other.drop("n_terms"), "lang").filter("source <> item")
    pairs = by_pair.unionByName(by_pair.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = pairs.unionByName(bare.select("lang", "source", "item", zero.alias("value")))

    q = share(F.col("total"), F.col("n_lang"))
    terms = cells.withColumn("q", q).filter("p > q")
    value = F.expr("(p - q) * (p - q) div (p + q)")
    terms = terms.select("lang", "source", F.col("term").alias("item"), value.alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(by_value).cast("int")
    terms = terms.withColumn("rank", rank).filter(F.col("rank") <= term_ranks)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (pairs.withColumn("rank", rank).withColumn("part", F.lit("pair")).select(*columns)
            .unionByName(terms.withColumn("part", F.lit("term")).select(*columns)))
