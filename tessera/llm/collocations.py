"""Phrase collocations, mined by SON partitioning.

Texts, with A-Z in lower case, are cut into pieces at punctuation and line
ends, and pieces into words at spaces and tabs. A phrase is 2 to ``longest``
words in a row of a piece; it is a candidate if its language has it ``support``
times or more.

The corpus is dealt into ``SHARDS`` shards of whole scan partitions. A phrase
that a shard has fewer than ``ceil(support / SHARDS)`` times in every shard is
not had ``support`` times by all; so each shard is mined completely at that
lowered support, level by level: a phrase is counted only if its first and last
words but one were locally frequent somewhere. Mining goes by 64-bit hashes of
(language, phrase), where a collision adds a candidate and loses none. The
union of what is locally frequent is kept as bitmaps of ``1 << C.BITS`` bits, a
fixed size at any input; the last pass counts, word for word, every phrase
whose bit is set, over all texts, and keeps those with the support.

A candidate is cut in two after each of its words; l and r count both parts and
``floor(1000 a n / (l r))`` is the cut's score, the lowest of which is the
candidate's. A candidate inside a longer one that is as frequent is dropped; it
is enough to look one word further, since the phrases between are as frequent.

Scale: counts are summed inside the tasks before every shuffle, and no word or
phrase is collected anywhere; with very many candidates a bitmap fills up and
spares less work, but nothing is lost. Rows: null texts are empty, a null
language is ``und``; repeated documents count each time; very long texts are read
a slice of a batch at a time; ties of a rank go by frequency, then by the
phrase in UTF-8 order; other columns are passed over; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
SUPPORT, LONGEST, TOP = 100, 5, 2000
SHARDS = 8
SLICE = 3 << 19
_BREAKS, _SPACES = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"


def tokens_of(batch: pa.RecordBatch):
    """(codes, words, joined, language number of each word, languages) of a slice of documents."""
    codes, words, bounds, joined = C.byte_words(pc.ascii_lower(C.texts_of(batch, "text")), _SPACES, _BREAKS)
    lang = batch.column("lang").dictionary_encode()
    return codes, words, joined, np.repeat(lang.indices.to_numpy().astype(np.int64), np.diff(bounds)), lang.dictionary


def word_values(words: pa.Array) -> np.ndarray:
    return C.mix(C.hash_words(words.to_pylist()))


def phrase_keys(values: np.ndarray, of_lang: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words that start at each word."""
    weights = C.odd_constants(max(k, LONGEST), 13)
    n = max(len(values) - k + 1, 0)
    key = of_lang[:n] + U64(k)
    for i in range(k):
        key = key + values[i : n + i] * weights[i]
    return C.mix(key)


def in_row(joined: np.ndarray, k: int) -> np.ndarray:
    """Whether the k words that start at each word are in one piece."""
    n = max(len(joined) - k + 1, 0)
    out = np.ones(n, bool)
    for i in range(1, k):
        out &= joined[i : n + i]
    return out


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, phrase, a) of all single words."""

    def counted(batches):
        for batch in C.slices(batches, "text", SLICE):
            codes, words, _, lang, langs = tokens_of(batch)
            key, n = np.unique(lang * max(1, len(words)) + codes, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(key // max(1, len(words)))), words.take(pa.array(key % max(1, len(words)))),
                 pa.array(n.astype(np.int64))], names=["lang", "phrase", "a"])

    counts = rows.mapInArrow(lambda b: C.combined(counted(b), ["lang", "phrase"]), "lang string, phrase string, a bigint")
    return counts.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def word_keys(words: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            keys = phrase_keys(word_values(batch.column("phrase")), C.hash_words(batch.column("lang").to_pylist()), 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])

    return words.select("lang", "phrase").mapInArrow(run, "key bigint")


def locally_frequent(rows: DataFrame, k: int, shorter, least: int) -> DataFrame:
    """The distinct hashes (key) of k-word phrases that some shard has ``least`` times or more."""

    def counted(batches):
        shard = TaskContext.get().partitionId() % SHARDS
        bits = shorter.value
        for batch in C.slices(batches, "text", SLICE):
            codes, words, joined, lang, langs = tokens_of(batch)
            values, of_lang = word_values(words)[codes], C.hash_words(langs.to_pylist())[lang]
            ok = C.marked(bits, phrase_keys(values, of_lang, k - 1))
            at = np.flatnonzero(in_row(joined, k) & ok[:-1] & ok[1:]) if len(codes) >= k else np.empty(0, np.int64)
            keys, n = np.unique(phrase_keys(values, of_lang, k)[at], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), shard, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))],
                names=["shard", "key", "n"])

    counts = rows.mapInArrow(lambda b: C.combined(counted(b), ["shard", "key"]), "shard int, key bigint, n bigint")
    counts = counts.groupBy("shard", "key").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= least).select("key")


def phrase_counts(rows: DataFrame, maps, longest: int) -> DataFrame:
    """(lang, phrase, a) over all texts of the phrases whose bits are set, told apart by their words."""

    def counted(batches):
        for batch in C.slices(batches, "text", SLICE):
            codes, words, joined, lang, langs = tokens_of(batch)
            values, of_lang = word_values(words)[codes], C.hash_words(langs.to_pylist())[lang]
            width = max(1, len(words))
            number = lang * width + codes  # of the phrase that starts at each word; equal phrases have equal numbers
            at = np.arange(len(codes))
            for k, bits in zip(range(2, longest + 1), maps.value):
                whole = in_row(joined, k) & C.marked(bits, phrase_keys(values, of_lang, k)) if len(codes) >= k else np.empty(0, bool)
                stays = (at < len(whole)) & np.append(whole, False)[np.minimum(at, len(whole))]
                at, number = at[stays], number[stays]
                if not len(at):
                    break
                _, first, number, n = np.unique(number * width + codes[at + k - 1], return_index=True,
                                                return_inverse=True, return_counts=True)
                parts = [words.take(pa.array(codes[at[first] + i])) for i in range(k)]
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(lang[at[first]])), pc.binary_join_element_wise(*parts, " "),
                     pa.array(n.astype(np.int64))], names=["lang", "phrase", "a"])

    counts = rows.mapInArrow(lambda b: C.combined(counted(b), ["lang", "phrase"]), "lang string, phrase string, a bigint")
    return counts.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def frequent_phrases(rows: DataFrame, support: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, a) of all phrases of 1 to ``longest`` words with the support, and (lang, n) of all words."""
    context = rows.sparkSession.sparkContext
    words = C.written(word_counts(rows), "words")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    frequent = words.filter(F.col("a") >= support)
    shorter, maps = C.bitmap_of(word_keys(frequent)), []
    for k in range(2, longest + 1):
        sent = context.broadcast(shorter)
        shorter = C.bitmap_of(locally_frequent(rows, k, sent, -(-support // SHARDS)))
        sent.unpersist()
        maps.append(shorter)
    phrases = phrase_counts(rows, context.broadcast(maps), longest).filter(F.col("a") >= support)
    found = frequent.unionByName(phrases).withColumn("k", F.size(F.split("phrase", " ")))
    return C.written(found, "phrases"), totals


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` collocations."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    found, totals = frequent_phrases(rows, support, longest)
    candidates = found.filter("k > 1")
    inner = F.array(F.expr("array_join(slice(split(phrase, ' '), 1, k - 1), ' ')"),
                    F.expr("array_join(slice(split(phrase, ' '), 2, k - 1), ' ')"))
    longer = candidates.filter("k > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("a_longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a_longer").alias("a_longer"))
    stay = candidates.join(longer, ["lang", "phrase"], "left").filter("a_longer IS NULL OR a_longer < a").drop("a_longer")

    cuts = stay.select("*", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.withColumn("first", F.expr("array_join(slice(split(phrase, ' '), 1, cut), ' ')"))
    cuts = cuts.withColumn("rest", F.expr("array_join(slice(split(phrase, ' '), cut + 1, k - cut), ' ')"))
    parts = found.select("lang", "phrase", "a")
    cuts = cuts.join(parts.withColumnsRenamed({"phrase": "first", "a": "l"}), ["lang", "first"])
    cuts = cuts.join(parts.withColumnsRenamed({"phrase": "rest", "a": "r"}), ["lang", "rest"]).join(totals, "lang")
    product = F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(15,0)") * F.col("n").cast("decimal(16,0)")
    parts_of = F.col("l").cast("decimal(15,0)") * F.col("r").cast("decimal(15,0)")
    cuts = cuts.withColumn("score", F.call_function("div", product, parts_of).cast("bigint"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    best = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
