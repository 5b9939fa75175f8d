"""Corpus text metrics: exact match, two BLEU variants, weighted n-gram recall.

Data layout
-----------
Input is a pairs frame with an ``item`` key, a hypothesis text column and one
or more reference text columns. Everything is computed from one *gram table*

    (item, order, keyword, h, r0..r{n-1}, grams)

with ``h`` the hypothesis count and ``rk`` each reference's count of an n-gram,
``grams`` the number of the item's n-grams with these counts.

Scale notes
-----------
* The pairs are hash-partitioned and sorted by ``item`` once (the only shuffle
  that moves text). A task then makes and counts the n-grams of whole items as
  columns of numbers, some items at a time; they are never rows of Spark's.
* The corpus totals are a final tiny aggregate over ``order`` (<= 5 rows
  after partial aggregation).
* Keyword weights (J12) are a set test against a fixed list (~100 tokens).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import UNICODE_WS, bound, tokens
from tessera.operators.batches import dealt, dense, numbered, pieces, starts, whole_items

# Java keyword list used for unigram weights (weight 1, else 0.2).
JAVA_KEYWORDS = (
    "abstract assert boolean break byte case catch char class const continue "
    "default do double else enum extends final finally float for goto if "
    "implements import instanceof int interface long native new package "
    "private protected public return short static strictfp super switch "
    "synchronized this throw throws transient try void volatile while"
).split()

# C# keyword list.
C_SHARP_KEYWORDS = (
    "abstract as base bool break byte case catch char checked class const "
    "continue decimal default delegate do double else enum event explicit "
    "extern false finally fixed float for foreach goto if implicit in int "
    "interface internal is lock long namespace new null object operator out "
    "override params private protected public readonly ref return sbyte sealed "
    "short sizeof stackalloc static string struct switch this throw true try "
    "typeof uint ulong unchecked unsafe ushort using virtual void volatile while "
    "add alias ascending async await by descending dynamic equals from get "
    "global group into join let nameof notnull on orderby partial remove select "
    "set unmanaged value var when where yield"
).split()

# Python keyword list.
PYTHON_KEYWORDS = (
    "False None True and as assert async await break class continue def del "
    "elif else except finally for from global if import in is lambda nonlocal "
    "not or pass raise return try while with yield"
).split()

KEYWORDS = {"java": JAVA_KEYWORDS, "c_sharp": C_SHARP_KEYWORDS, "python": PYTHON_KEYWORDS}


def keyword_table(spark: SparkSession, lang: str = "java") -> DataFrame:
    """Keyword list as a small DataFrame ``(token)``."""
    return spark.createDataFrame([(t,) for t in KEYWORDS[lang]], "token string")


# ---------------------------------------------------------------------------
# Exact match (A5, A6) with positional alignment
# ---------------------------------------------------------------------------

def align(gold: DataFrame, output: DataFrame, idx: str = "idx", text: str = "text") -> DataFrame:
    """Pair gold and output lines by index (``zip``: unmatched dropped)."""
    return gold.select(F.col(idx), F.col(text).alias("gold")).join(
        output.select(F.col(idx), F.col(text).alias("output")), idx, "inner")


def accuracy(aligned: DataFrame, gold: str = "gold", output: str = "output",
             digits: int = 3) -> DataFrame:
    """A5: percent of exactly equal strings, rounded half-to-even."""
    eq = (F.col(gold) == F.col(output)).cast("int")
    return aligned.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(eq).cast("long").alias("correct"),
        F.bround(F.try_divide(F.sum(eq) * 100.0, F.count(F.lit(1))), digits).alias("accuracy"))


def with_xmatch(df: DataFrame, label: str = "label", predict: str = "predict") -> DataFrame:
    """Per-row exact match flag."""
    return df.withColumn("xmatch", F.col(label) == F.col(predict))


def xmatch_rate(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.agg(F.bround(F.avg(F.col("xmatch").cast("double")) * 100.0, digits).alias("xmatch"))


# ---------------------------------------------------------------------------
# N-grams (F26) and the gram table
# ---------------------------------------------------------------------------

def ngram_array(toks: Column | TokenRows, n: int | Column) -> Column | GramRows:
    """all contiguous n-grams of a token array, each joined by a space.

    The array is computed once, not once for every n-gram. Those of ``TokenRows`` stay numbers.
    """
    if isinstance(toks, TokenRows):
        return _gram_rows(toks, n)
    nn = F.lit(n) if isinstance(n, int) else n

    def grams(t):
        return F.when(
            F.size(t) >= nn,
            F.transform(F.sequence(F.lit(1), F.size(t) - nn + 1), lambda i: F.array_join(F.slice(t, i, nn), " ")),
        ).otherwise(F.array().cast("array<string>"))

    return bound(toks, grams)


class TokenRows(NamedTuple):
    """Token arrays as columns of numbers: the ``words`` of the ``codes`` of all rows side by side, ``sizes`` of the rows.

    ``digests`` has two 64-bit hashes for every word, equal for equal words of any ``TokenRows``.
    """

    words: pa.Array
    digests: np.ndarray
    codes: np.ndarray
    sizes: np.ndarray


class GramRows(NamedTuple):
    """All n-grams of ``TokenRows``: ``codes[i]`` to ``codes[i + n - 1]`` of every ``i`` in ``at``."""

    toks: TokenRows
    at: np.ndarray
    n: int


def token_rows(joined: pa.Array) -> TokenRows:
    """``TokenRows`` of token arrays that come as strings, joined by a space, which no token holds."""
    lists = pc.split_pattern(joined.cast(pa.large_binary()).cast(pa.large_string(), safe=False), " ")
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # an empty string is no token
    before = np.concatenate([[0], np.cumsum(full)])
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    encoded = flat.filter(pa.array(full)).dictionary_encode()
    words = encoded.dictionary.cast(pa.large_binary())
    return TokenRows(words, _digests(words), encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
                     np.diff(before[offsets]))


def _digests(words: pa.Array) -> np.ndarray:
    values = np.array([*words.to_pylist(), None], object)[:-1]  # bytes of any length, kept whole
    return np.stack([pd.util.hash_array(values, hash_key=k, categorize=False) if len(values) else np.empty(0, np.uint64)
                     for k in ("tessera n-grams1", "tessera n-grams2")])


def pad_sequence(toks: Column | TokenRows, n: int, left: str | None = None,
                 right: str | None = None) -> Column | TokenRows:
    """F26 padding: ``n-1`` pad symbols on either side before making n-grams."""
    if isinstance(toks, TokenRows):
        return _padded_rows(toks, n, left, right)
    out = toks
    if left is not None:
        out = F.concat(F.array_repeat(F.lit(left), n - 1), out)
    if right is not None:
        out = F.concat(out, F.array_repeat(F.lit(right), n - 1))
    return out


def _padded_rows(toks: TokenRows, n: int, left: str | None, right: str | None) -> TokenRows:
    before, after = (n - 1) * (left is not None), (n - 1) * (right is not None)
    pads = pa.array([(left or "").encode(), (right or "").encode()], pa.large_binary())
    sizes = toks.sizes + before + after
    ends = np.cumsum(sizes)
    codes = np.full(int(sizes.sum()), len(toks.words) + 1, np.int64)
    inside = np.arange(len(toks.codes)) + np.repeat(np.arange(len(sizes)) * (before + after) + before, toks.sizes)
    codes[inside] = toks.codes
    for k in range(before):
        codes[ends - sizes + k] = len(toks.words)
    return TokenRows(pa.concat_arrays([toks.words, pads]), np.concatenate([toks.digests, _digests(pads)], 1), codes, sizes)


def _gram_rows(toks: TokenRows, n: int) -> GramRows:
    left = np.repeat(np.cumsum(toks.sizes), toks.sizes) - np.arange(len(toks.codes))  # tokens from here to the row's end
    return GramRows(toks, np.flatnonzero(left >= n), n)


_ZSTD = pa.Codec("zstd")
_GRAM_BYTES = 24 << 20  # a task makes the grams of about as much text together


def gram_totals(lines: DataFrame, toks: str, orders: Sequence[int], grams: Callable[[TokenRows, int], GramRows],
                left: str, right: str) -> DataFrame:
    """``(ord, distinct_grams, grams, left_padded, right_padded)`` of the ``grams`` of token arrays.

    ``grams`` makes those of an order; ``left_padded`` of them begin with the
    text ``left`` and ``right_padded`` end with ``right``. A task makes the grams
    of some lines as columns of numbers and sends every distinct one once, as 80
    bits of digest (two of a billion grams agree in them with a chance below one
    in a million), dealt by 4,096 ranges of digests; where they meet, they are
    counted range by range. Grams are never strings or rows of Spark's.
    """
    texts = lines.filter(F.col(toks).isNotNull()).select(F.array_join(toks, " ").alias("line"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for some in _cut_at(batch.column("line"), _GRAM_BYTES):
                held.append(some)
                size += some.nbytes
                if size >= _GRAM_BYTES:
                    yield from _sent(pa.concat_arrays(held), orders, grams, left, right)
                    held, size = [], 0
        if held:
            yield from _sent(pa.concat_arrays(held), orders, grams, left, right)

    sent = texts.mapInArrow(send, "ord bigint, part int, keys binary, grams bigint, left_padded bigint, right_padded bigint")
    met = sent.repartition(_parallelism(lines), "ord", "part").sortWithinPartitions("ord", "part")
    counts = met.mapInArrow(_met, "ord bigint, distinct_grams bigint, grams bigint, left_padded bigint, right_padded bigint")
    return counts.groupBy("ord").agg(F.coalesce(F.sum("distinct_grams"), F.lit(0)).alias("distinct_grams"), *[
        F.sum(c).alias(c) for c in ("grams", "left_padded", "right_padded")])


def _cut_at(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Texts in runs of about ``most`` bytes or one text each."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1).tolist(), len(texts)]
    for a, b in zip(bounds, bounds[1:]):
        if a < b:
            yield texts.slice(a, b - a)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the 64 reaches every other; different numbers stay different."""
    for shift, factor in ((31, 0x9E3779B97F4A7C15), (29, 0xD6E8FEB86659FD93)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def _sent(joined: pa.Array, orders: Sequence[int], grams: Callable[[TokenRows, int], GramRows],
          left: str, right: str) -> Iterator[pa.RecordBatch]:
    """The distinct grams of every order by ranges of their digests; the first range has the counts of all."""
    rows = token_rows(joined)
    for order in orders:
        toks, at, n = grams(rows, order)
        if not len(at):
            continue
        begins, closes = (f(toks.words, x.encode()).to_numpy(zero_copy_only=False)
                          for f, x in ((pc.starts_with, left), (pc.ends_with, right)))
        sums = [len(at), int(begins[toks.codes[at]].sum()), int(closes[toks.codes[at + n - 1]].sum())]
        if n == 1:  # once for each word
            where = np.full(len(toks.words), -1, np.int64)
            where[toks.codes[at]] = at
            at = where[where >= 0]
        one, two = (_chained(d[toks.codes], at, n) for d in toks.digests)
        by = np.argsort(one)
        one, two = one[by], (two >> np.uint64(48)).astype("<u2")[by]
        new = starts(one, two)
        one, two = one[new], two[new]
        part = (one >> np.uint64(52)).astype(np.int32)
        cuts = np.append(np.flatnonzero(starts(part)), len(part))
        low = one & np.uint64((1 << 52) - 1)
        step = np.diff(low, prepend=np.uint64(0))
        step[cuts[:-1]] = low[cuts[:-1]]
        keys = [_range_of(step[a:b], two[a:b]) for a, b in zip(cuts, cuts[1:])]
        none = [0] * (len(keys) - 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([order] * len(keys), pa.int64()), pa.array(part[cuts[:-1]]), pa.array(keys, pa.binary()),
             *(pa.array([x, *none], pa.int64()) for x in sums)],
            names=["ord", "part", "keys", "grams", "left_padded", "right_padded"])


def _range_of(step: np.ndarray, two: np.ndarray) -> bytes:
    """Keys of one range: their number, the second halves, the steps of the sorted first halves byte by byte.

    Only the upper bytes of a step have anything to compress.
    """
    planes = step.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return (len(two).to_bytes(4, "little") + two.tobytes() + planes[:5].tobytes()
            + _ZSTD.compress(planes[5:7].tobytes(), asbytes=True))


def _halves(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :5] = np.frombuffer(blob, np.uint8, 5 * n, 4 + 2 * n).reshape(5, n).T
    wide[:, 5:7] = np.frombuffer(_ZSTD.decompress(blob[4 + 7 * n:], 2 * n, asbytes=True), np.uint8).reshape(2, n).T
    return np.cumsum(wide.view("<u8")[:, 0]), np.frombuffer(blob, "<u2", n, 4)


def _chained(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A digest of the ``n`` words from every position, from the words' digests."""
    out = _mixed(words[at])
    for k in range(1, n):
        out = _mixed(out * np.uint64(0xD1342543DE82EF95) + words[at + k])
    return out


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct grams and the sums of the counts, for each range that has come together."""
    counts = ("grams", "left_padded", "right_padded")
    key, keys, sums = None, [], [0] * 3

    def out():
        return pa.RecordBatch.from_pydict(
            {"ord": [key[0]], "distinct_grams": [_distinct(keys)], **{c: [x] for c, x in zip(counts, sums)}},
            schema=pa.schema([(c, pa.int64()) for c in ("ord", "distinct_grams", *counts)]))

    for batch in batches:
        for order, part, some, *add in zip(*(batch.column(c).to_pylist() for c in ("ord", "part", "keys", *counts))):
            if key is not None and key != (order, part):
                yield out()
                keys, sums = [], [0] * 3
            key = (order, part)
            keys.append(some)
            sums = [a + b for a, b in zip(sums, add)]
    if key is not None:
        yield out()


def _distinct(keys: list[bytes]) -> int:
    """The number of different keys of ``_sent`` in one range."""
    one, two = (np.concatenate(x) for x in zip(*map(_halves, keys)))
    by = np.argsort(one)
    one, two = one[by], two[by]
    if ((one[1:] == one[:-1]) & (two[1:] != two[:-1])).any():
        by = np.lexsort((two, one))
        one, two = one[by], two[by]
    return int(starts(one, two).sum())


def _parallelism(df: DataFrame) -> int:
    spark = df.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    try:
        return max(shuffle, spark.sparkContext.defaultParallelism * 2)
    except Exception:  # noqa: BLE001 - no SparkContext on a Connect session
        return shuffle


def sides_frame(df: DataFrame, item: str, hyp: str, refs: Sequence[str],
                pattern: str = UNICODE_WS, partitions: int | None = None) -> DataFrame:
    """Tokenised sides ``(item, side, ref_idx, toks)``; ``side`` is ``h`` or ``r``.

    The frame is hash-partitioned and sorted by item, so the n-grams of an item
    can be counted where its sides lie.
    """
    parts = [F.struct(F.lit("h").alias("side"), F.lit(0).alias("ref_idx"),
                      tokens(hyp, pattern).alias("toks"))]
    for k, r in enumerate(refs):
        parts.append(F.struct(F.lit("r").alias("side"), F.lit(k).alias("ref_idx"),
                              tokens(r, pattern).alias("toks")))
    # An explicit count keeps AQE from coalescing this shuffle into a few large
    # tasks: n-gram generation multiplies each row's work many times over.
    n = partitions or _parallelism(df)
    base = dealt(df, item, n)
    return base.select(F.col(item).alias("item"), F.inline(F.array(*parts)))


def ngrams_regex(joined: Column, n: int) -> Column:
    """All n-grams of a space-joined token string via one overlapping regex
    scan (lookahead capture per token start); no per-gram lambda calls."""
    if n == 1:
        return F.split(joined, " ")
    return F.regexp_extract_all(joined, F.lit("(?=([^ ]+(?: [^ ]+){%d}))[^ ]+" % (n - 1)), 1)


def gram_rows(sides: DataFrame, max_order: int = 4) -> DataFrame:
    """One row per n-gram occurrence: ``(item, side, ref_idx, order, gram)``.

    Tokens never contain a space, so joining them with single spaces gives a
    string whose n-grams are found by a regex scan; this keeps the generator
    on compiled expressions instead of interpreted higher-order lambdas.
    """
    joined = F.array_join(F.col("toks"), " ")
    per_order = F.array(*[F.struct(F.lit(k).alias("order"), F.when(F.size("toks") >= k, ngrams_regex(joined, k))
                                   .otherwise(F.array().cast("array<string>")).alias("grams"))
                          for k in range(1, max_order + 1)])
    x = sides.select("item", "side", "ref_idx", F.inline(per_order))
    return x.select("item", "side", "ref_idx", "order", F.explode("grams").alias("gram"))


TOKENS_AT_ONCE = 1 << 18  # a task counts the grams of about as many tokens together


def gram_table(sides: DataFrame, n_refs: int, max_order: int = 4, keywords: Sequence[str] = ()) -> DataFrame:
    """``(item, order, keyword, h, r0..r{n-1}, grams)``: how many of an item's
    distinct n-grams have these counts, ``h`` in the hypothesis and ``rk`` in
    each reference; ``keyword`` marks the unigrams among ``keywords``.

    ``sides`` come from ``sides_frame``, item by item, so a task makes and
    counts the n-grams of whole items as columns of numbers, some items at a
    time: an n-gram is the pair of the one shorter by a token and its last
    token, numbered anew at every order. No n-gram leaves the task, and only
    one item's tokens have to be in memory together.
    """
    known, most = pa.array(list(keywords), pa.string()), TOKENS_AT_ONCE
    counts = ", ".join(f"{c} long" for c in ("h", *(f"r{k}" for k in range(n_refs)), "grams"))
    item_type = sides.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_items(batches):
            sizes = pc.fill_null(pc.list_value_length(whole.column("toks")), 0).to_numpy(zero_copy_only=False)
            for some in pieces(whole, sizes, most):
                yield from _counted(some, n_refs, max_order, known)

    s = sides.select("item", (F.col("side") == "h").alias("of_h"), "ref_idx", "toks")
    return s.mapInArrow(run, f"item {item_type}, order int, keyword boolean, {counts}")


def _counted(batch: pa.RecordBatch, n_refs: int, max_order: int, keywords: pa.Array) -> Iterator[pa.RecordBatch]:
    """The rows of ``gram_table`` for whole items, a batch for each order."""
    head = starts(numbered(batch.column("item")))
    toks = batch.column("toks")
    size = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    of_h = batch.column("of_h").to_numpy(zero_copy_only=False)
    column = np.where(of_h, 0, batch.column("ref_idx").to_numpy(zero_copy_only=False) + 1)
    row = np.repeat(np.arange(len(size)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(row))  # tokens from here to the text's end
    words = toks.flatten().dictionary_encode()
    width = max(len(words.dictionary), 1)
    word, keys = dense((np.cumsum(head) - 1)[row] * width + words.indices.to_numpy(zero_copy_only=False))
    item = keys // width  # of a class of equal grams
    keyword = pc.is_in(words.dictionary, keywords.cast(words.dictionary.type)).to_numpy(zero_copy_only=False)[keys % width]
    width, at, gram, column = max(len(keys), 1), np.arange(len(row)), word, column[row]
    for order in range(1, max_order + 1):
        if order > 1:
            longer = left[at] >= order
            at = at[longer]
            gram, keys = dense(gram[longer] * width + word[at + order - 1])
            item, keyword = item[keys // width], np.zeros(len(keys), bool)
        if not len(at):
            return
        seen = np.bincount(gram * (n_refs + 1) + column[at], minlength=len(item) * (n_refs + 1)).reshape(len(item), -1)
        form, span = item, int(item.max()) + 1
        for c in (keyword.astype(np.int64), *seen.T):
            if span * (int(c.max()) + 1) >= 1 << 62:
                form, span = dense(form)[0], len(form)
            form, span = form * (int(c.max()) + 1) + c, span * (int(c.max()) + 1)
        form, distinct = dense(form)
        one = np.empty(len(distinct), np.int64)
        one[form] = np.arange(len(form))  # a class of each form
        items = batch.column("item").take(pa.array(np.flatnonzero(head)[item[one]]))
        yield pa.RecordBatch.from_arrays(
            [items, pa.array(np.full(len(one), order, np.int32)), pa.array(keyword[one]),
             *[pa.array(c[one]) for c in seen.T], pa.array(np.bincount(form))],
            names=["item", "order", "keyword", "h", *[f"r{k}" for k in range(n_refs)], "grams"])


def ref_cols(n_refs: int) -> list[Column]:
    return [F.col(f"r{k}") for k in range(n_refs)]


def union_max(refs: Sequence[Column]) -> Column:
    """Multiset union over references = max count per gram."""
    return F.greatest(*refs) if len(refs) > 1 else refs[0]


def clipped(h: Column, refs: Sequence[Column]) -> Column:
    """Multiset intersection of hypothesis and merged references."""
    return F.least(h, union_max(refs))


def lengths(sides: DataFrame) -> DataFrame:
    """Per item: hypothesis length, all reference lengths."""
    return sides.groupBy("item").agg(
        F.sum(F.when(F.col("side") == "h", F.size("toks"))).alias("hyp_len"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "r", F.size("toks")))).alias("ref_lens"))


def closest_ref_len(ref_lens: Column, hyp_len: Column) -> Column:
    """reference length closest to the hypothesis; ties take the shorter."""
    best = F.array_min(F.transform(ref_lens, lambda r: F.struct(
        F.abs(r - hyp_len).alias("d"), r.alias("r"))))
    return best["r"]


def brevity_penalty(ref_len: Column, hyp_len: Column) -> Column:
    """1 when longer than the reference, 0 for empty, else exp(1 - r/c)."""
    return (F.when(hyp_len > ref_len, F.lit(1.0))
            .when(hyp_len == 0, F.lit(0.0))
            .otherwise(F.exp(1 - ref_len / hyp_len)))


# ---------------------------------------------------------------------------
# Per-item statistics: one row per item, one column per order
# ---------------------------------------------------------------------------

def item_stats(pairs: DataFrame, item: str, hyp: str, refs: Sequence[str],
               max_order: int = 4, pattern: str = UNICODE_WS,
               keywords: Sequence[str] | None = None) -> DataFrame:
    """``(item, hyp_len, ref_lens, m1..mN)`` with ``mk`` the clipped k-gram matches.

    With ``keywords`` also A10's recall numerators ``n1..nN`` and denominators
    ``d1..dN``, from the same gram table. Per reference, each order contributes
    ``sum min(rc, h)`` over the reference's grams and ``max(1, sum rc)``;
    unigrams are weighted by 1 for a keyword, else 0.2. Sums run over all
    references of the item.

    The texts are dealt once; behind ``gram_table`` only a row per item travels.
    """
    orders = range(1, max_order + 1)
    sides = sides_frame(pairs, item, hyp, refs, pattern)
    gt = gram_table(sides, len(refs), max_order, keywords or ())
    order, h, grams, counts = F.col("order"), F.col("h"), F.col("grams"), ref_cols(len(refs))
    sums = [F.sum(F.when(order == k, clipped(h, counts) * grams)).alias(f"m{k}") for k in orders]
    if keywords is not None:
        weight = F.when((order != 1) | F.col("keyword"), F.lit(1.0)).otherwise(F.lit(0.2)) * grams
        shared = _total([F.least(c, h) for c in counts])
        sums += [F.sum(F.when(order == k, shared * weight)).alias(f"n{k}") for k in orders]
        sums += [F.sum(F.when(order == 1, c * weight)).alias(f"w{j}") for j, c in enumerate(counts)]
    out = lengths(sides).join(gt.groupBy("item").agg(*sums), "item", "left")
    out = out.fillna(0, [f"m{k}" for k in orders])
    if keywords is None:
        return out
    # A null reference has no length and counts nowhere.
    d1 = (_total([F.greatest(F.coalesce(f"w{j}", F.lit(0.0)), F.lit(1.0)) for j in range(len(refs))])
          - (F.lit(len(refs)) - F.size("ref_lens")))
    return out.select(
        "item", "hyp_len", "ref_lens", *[f"m{k}" for k in orders],
        *[F.coalesce(f"n{k}", F.lit(0.0)).alias(f"n{k}") for k in orders], d1.alias("d1"),
        *[F.aggregate("ref_lens", F.lit(0).cast("long"), _grams_at_least_one(k)).cast("double").alias(f"d{k}")
          for k in orders[1:]])


def _total(columns: Sequence[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def _grams_at_least_one(k: int):
    def step(acc, r):
        return acc + F.greatest(r - (k - 1), F.lit(1))
    return step


def _grams(hyp_len: Column, k: int) -> Column:
    return F.greatest(hyp_len - F.lit(k - 1), F.lit(0))


# ---------------------------------------------------------------------------
# BLEU variant 1 (A7): shortest reference, zero precision -> 0, optional +1
# ---------------------------------------------------------------------------

def bleu_v1(stats: DataFrame, max_order: int = 4, smooth: bool = False) -> DataFrame:
    """Corpus BLEU from ``item_stats``; one row, score x100 to 2 decimals."""
    n = max_order
    tot = stats.agg(
        F.sum("hyp_len").alias("tl"), F.sum(F.array_min("ref_lens")).alias("rl"),
        *[F.sum(f"m{k}").alias(f"M{k}") for k in range(1, n + 1)],
        *[F.sum(_grams(F.col("hyp_len"), k)).alias(f"P{k}") for k in range(1, n + 1)])
    precs = []
    for k in range(1, n + 1):
        mk, pk = F.col(f"M{k}").cast("double"), F.col(f"P{k}").cast("double")
        precs.append((mk + 1.0) / (pk + 1.0) if smooth
                     else F.when(pk > 0, mk / pk).otherwise(F.lit(0.0)))
    positive = precs[0] > 0
    log_sum = F.log(precs[0])
    for p in precs[1:]:
        positive = positive & (p > 0)
        log_sum = log_sum + F.log(p)
    geo = F.when(positive, F.exp(log_sum / n)).otherwise(F.lit(0.0))
    ratio = F.try_divide(F.col("tl").cast("double"), F.col("rl").cast("double"))
    bp = F.when(ratio > 1.0, F.lit(1.0)).when(ratio == 0, F.lit(0.0)) \
        .otherwise(F.exp(1 - 1.0 / ratio))
    return tot.select(
        F.bround(geo * bp * 100.0, 2).alias("bleu"),
        *[precs[k].alias(f"precision_{k + 1}") for k in range(n)],
        bp.alias("bp"), ratio.alias("ratio"),
        F.col("tl").cast("long").alias("translation_length"),
        F.col("rl").cast("long").alias("reference_length"))


# ---------------------------------------------------------------------------
# BLEU variant 2 (A8, A9, A11): closest reference, max(1, .) denominators
# ---------------------------------------------------------------------------

TINY = 2.2250738585072014e-308  # smallest normal double: log() of it ~ -708.4


def smooth(nums: list[Column], dens: list[Column], method: int, hyp_len: Column,
           extra_p: Column | None = None, epsilon: float = 0.1, alpha: float = 5.0,
           k: float = 5.0) -> list[Column]:
    """Smoothed precisions for methods 0-7 as Column expressions.

    ``extra_p`` is the order ``N+1`` precision, needed by methods 5 and 7.
    """
    n = len(nums)
    raw = [nums[i] / dens[i] for i in range(n)]
    if method == 0:
        return [F.when(nums[i] == 0, F.lit(TINY)).otherwise(raw[i]) for i in range(n)]
    if method == 1:
        return [F.when(nums[i] == 0, (nums[i] + epsilon) / dens[i]).otherwise(raw[i])
                for i in range(n)]
    if method == 2:
        return [(nums[i] + 1.0) / (dens[i] + 1.0) for i in range(n)]
    if method == 3:
        out, inc = [], F.lit(1)
        for i in range(n):
            zero = nums[i] == 0
            out.append(F.when(zero, 1.0 / (F.pow(F.lit(2.0), inc) * dens[i])).otherwise(raw[i]))
            inc = inc + zero.cast("int")
        return out
    if method in (4, 7):
        ln = F.log(hyp_len.cast("double"))
        out = [F.when((nums[i] == 0) & (hyp_len != 0),
                      (F.lit(float(i)) + F.try_divide(F.lit(k), ln)) / dens[i])
               .otherwise(raw[i]) for i in range(n)]
        return out if method == 4 else _method5(out, extra_p)
    if method == 5:
        return _method5(raw, extra_p)
    if method == 6:
        out = list(raw)
        for i in range(2, n):
            pi0 = F.when(out[i - 2] == 0, F.lit(0.0)).otherwise(F.pow(out[i - 1], 2) / out[i - 2])
            grams = F.greatest(hyp_len - F.lit(i), F.lit(0))
            out[i] = (nums[i] + alpha * pi0) / (grams + alpha)
        return out
    raise ValueError(f"unknown smoothing method {method}")


def _method5(p: list[Column], extra_p: Column | None) -> list[Column]:
    if extra_p is None:
        raise ValueError("smoothing methods 5 and 7 need the next-order precision")
    nxt = list(p) + [extra_p]
    out, prev = [], p[0] + 1.0
    for i in range(len(p)):
        v = (prev + p[i] + nxt[i + 1]) / 3.0
        out.append(v)
        prev = v
    return out


def _bleu_expr(nums, dens, weights, method, hyp_len, ref_len, extra_p=None):
    ps = smooth(nums, dens, method, hyp_len, extra_p)
    log_sum = F.lit(weights[0]) * F.log(ps[0])
    for w, p in zip(weights[1:], ps[1:]):
        log_sum = log_sum + F.lit(w) * F.log(p)
    bp = brevity_penalty(ref_len.cast("double"), hyp_len.cast("double"))
    score = F.when(nums[0] == 0, F.lit(0.0)).otherwise(bp * F.exp(log_sum))
    if method == 6:  # defined only with a non-zero trigram precision
        score = F.when((nums[0] != 0) & (nums[2] == 0), F.lit(None).cast("double")).otherwise(score)
    return score, bp


def corpus_bleu_v2(stats: DataFrame, weights: Sequence[float] = (0.25, 0.25, 0.25, 0.25),
                   smoothing: int = 1, auto_reweigh: bool = False) -> DataFrame:
    """Corpus BLEU, closest reference length, method-1 smoothing by default.

    ``auto_reweigh``: with the default weights and hypotheses of ``c < 4`` tokens
    in all, the first ``c`` orders count ``1 / c`` each and the others nothing.
    """
    if auto_reweigh and tuple(weights) == (0.25, 0.25, 0.25, 0.25):
        if smoothing == 7:
            raise ValueError("method 7 mixes in the next order, which auto_reweigh leaves out")
        c = F.col("c")
        weights = [F.when(c >= 4, F.lit(w)).when(c >= k, 1.0 / c).otherwise(F.lit(0.0))
                   for k, w in enumerate(weights, 1)]
    score, bp = _bleu_score(weights, smoothing)
    return stats.agg(*_bleu_sums(len(weights))).select(
        score.alias("bleu"), bp.alias("bp"), F.col("c").cast("long").alias("hyp_length"),
        F.col("r").cast("long").alias("ref_length"))


def _bleu_sums(n: int) -> list[Column]:
    hyp_len = F.col("hyp_len")
    return [F.sum(hyp_len).alias("c"), F.sum(closest_ref_len(F.col("ref_lens"), hyp_len)).alias("r"),
            *[F.sum(f"m{k}").alias(f"M{k}") for k in range(1, n + 1)],
            *[F.sum(F.greatest(_grams(hyp_len, k), F.lit(1))).alias(f"D{k}") for k in range(1, n + 1)]]


def _bleu_score(weights: Sequence[float | Column], smoothing: int) -> tuple[Column, Column]:
    orders = range(1, len(weights) + 1)
    return _bleu_expr([F.col(f"M{k}").cast("double") for k in orders], [F.col(f"D{k}").cast("double") for k in orders],
                      weights, smoothing, F.col("c"), F.col("r"))


def sentence_bleu_expr(columns: Sequence[str], weights: Sequence[float] = (0.25, 0.25, 0.25, 0.25),
                       smoothing: int = 1) -> Column:
    """A9 (+A11): BLEU of one item as an expression over ``item_stats`` columns.

    Methods 5 and 7 need the order ``N+1`` column (``item_stats(max_order=N+1)``)."""
    n = len(weights)
    hl = F.col("hyp_len")
    nums = [F.col(f"m{k}").cast("double") for k in range(1, n + 1)]
    dens = [F.greatest(_grams(hl, k), F.lit(1)).cast("double") for k in range(1, n + 1)]
    extra = None
    if f"m{n + 1}" in columns:
        extra = F.col(f"m{n + 1}") / F.greatest(_grams(hl, n + 1), F.lit(1))
    ref = closest_ref_len(F.col("ref_lens"), hl)
    score, _ = _bleu_expr(nums, dens, weights, smoothing, hl, ref, extra)
    return score


def sentence_bleu_v2(stats: DataFrame, weights: Sequence[float] = (0.25, 0.25, 0.25, 0.25),
                     smoothing: int = 1) -> DataFrame:
    """BLEU per item (same formula as A8, no cross-item sums)."""
    return stats.select("item", sentence_bleu_expr(stats.columns, weights, smoothing).alias("bleu"))


# ---------------------------------------------------------------------------
# Weighted n-gram recall (A10)
# ---------------------------------------------------------------------------

def _recall_sums(n: int, compat: bool) -> list[Column]:
    ref_len = F.lit(2) if compat else closest_ref_len(F.col("ref_lens"), F.col("hyp_len"))
    return [F.sum(ref_len).alias("wr"), *[F.sum(f"n{k}").alias(f"N{k}") for k in range(1, n + 1)],
            *[F.sum(f"d{k}").alias(f"E{k}") for k in range(1, n + 1)]]


def _recall_score(weights: Sequence[float]) -> tuple[Column, Column]:
    orders = range(1, len(weights) + 1)
    return _bleu_expr([F.col(f"N{k}") for k in orders], [F.col(f"E{k}") for k in orders], weights, 1,
                      F.col("c"), F.col("wr"))


def weighted_ngram_match(stats: DataFrame, weights: Sequence[float] = (0.25, 0.25, 0.25, 0.25),
                         compat: bool = True) -> DataFrame:
    """A10 corpus score from ``item_stats`` with keywords. ``compat`` reproduces the reference quirk
    where each reference length is 2 (the length of the ``[tokens, weights]`` pair)."""
    score, bp = _recall_score(weights)
    return stats.agg(F.sum("hyp_len").alias("c"), *_recall_sums(len(weights), compat)).select(
        score.alias("weighted_ngram_match"), bp.alias("bp"))


def ngram_scores(stats: DataFrame, weights: Sequence[float] = (0.25, 0.25, 0.25, 0.25)) -> DataFrame:
    """A8 and A10 of one pass over ``item_stats`` with keywords: ``(ngram_match, weighted_ngram_match)``."""
    n = len(weights)
    return stats.agg(*_bleu_sums(n), *_recall_sums(n, True)).select(
        _bleu_score(weights, 1)[0].alias("ngram_match"), _recall_score(weights)[0].alias("weighted_ngram_match"))


def codebleu(ngram: Column, weighted: Column, syntax: Column, dataflow: Column,
             params: str = "0.25,0.25,0.25,0.25") -> Column:
    """Weighted sum of the four component scores (E4: params string)."""
    a, b, g, t = (float(x) for x in params.split(","))
    return ngram * a + weighted * b + syntax * g + dataflow * t
