"""Token-array shaping for model inputs (integers only; all Catalyst expressions).

Every function maps one row's arrays to new arrays, so the work is
embarrassingly parallel; only ``batch_pad`` looks across rows, through a window
over one batch (a fixed, small number of rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORE_INDEX = -100


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def truncate(ids: Column | str, max_len: int) -> Column:
    """keep the first ``max_len`` ids."""
    return F.slice(_c(ids), 1, max_len)


def add_eos(ids: Column | str, eos: int, max_len: int) -> Column:
    """after truncation, append EOS when there is room and the last id is
    not EOS; when the array is at ``max_len`` the last id becomes EOS."""
    a = truncate(ids, max_len)
    n = F.size(a)
    last = F.try_element_at(a, F.lit(-1))
    appended = F.when((n < max_len) & (last.isNull() | (last != eos)),
                      F.concat(a, F.array(F.lit(eos)))).otherwise(a)
    m = F.size(appended)
    return F.when(m >= max_len,
                  F.concat(F.slice(appended, 1, max_len - 1), F.array(F.lit(eos)))).otherwise(appended)


def mask_prompt(labels: Column | str, k: Column | int) -> Column:
    """the first ``k`` labels become -100, the rest are kept."""
    kk = F.lit(k) if isinstance(k, int) else k
    lab = _c(labels)
    kk = F.least(F.greatest(kk, F.lit(0)), F.size(lab))
    return F.concat(F.array_repeat(F.lit(IGNORE_INDEX), kk),
                    F.slice(lab, kk + 1, F.greatest(F.size(lab) - kk, F.lit(0))))


def pad_right(ids: Column | str, length: int | Column, pad: int) -> Column:
    """right-pad to ``length`` with ``pad`` (no-op when already longer)."""
    a = _c(ids)
    ln = F.lit(length) if isinstance(length, int) else length
    return F.concat(a, F.array_repeat(F.lit(pad), F.greatest(ln - F.size(a), F.lit(0))))


def attention_mask(ids: Column | str, length: int) -> Column:
    """ones over real ids, zeros over padding, total ``length``."""
    n = F.least(F.size(_c(ids)), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))


def pack_three(p1: Column | str, p2: Column | str, p3: Column | str, target: Column | str,
               max_len: int, eos: int) -> tuple[Column, Column]:
    """F23 (decoder form): each part cut to ``max_len // 4``; the target to
    ``max_len // 4 - 1`` plus EOS. Returns ``(input_ids, labels)`` where the
    prompt part of the labels is -100."""
    each = max_len // 4
    prompt = F.concat(truncate(p1, each), truncate(p2, each), truncate(p3, each))
    full = F.concat(prompt, F.slice(truncate(target, each), 1, each - 1), F.array(F.lit(eos)))
    return full, mask_prompt(full, F.size(prompt))


def pack_three_padded(p1: Column | str, p2: Column | str, p3: Column | str, max_len: int,
                      pad: int) -> Column:
    """F23 (encoder form): each part cut and right-padded to ``max_len // 3``."""
    each = max_len // 3
    return F.concat(*[pad_right(truncate(p, each), each, pad) for p in (p1, p2, p3)])


def ignore_to_pad(ids: Column | str, pad: int) -> Column:
    """-100 ids become the pad id."""
    return F.transform(_c(ids), lambda x: F.when(x == IGNORE_INDEX, F.lit(pad)).otherwise(x))


def rotate_pads(ids: Column | str, pad: int) -> Column:
    """move leading pad ids to the end (unchanged when all are pads)."""
    a = _c(ids)
    first = F.array_position(F.transform(a, lambda x: x != pad), True)  # 1-based, 0 if none
    k = first - 1
    return F.when(first > 0, F.concat(F.slice(a, first, F.size(a) - k),
                                      F.array_repeat(F.lit(pad), k.cast("int")))).otherwise(a)


def batch_pad(df: DataFrame, batch: str, ids: str, labels: str, pad: int,
              multiple: int = 8) -> DataFrame:
    """Pad arrays to the batch maximum rounded up to ``multiple``; labels
    are padded with -100. Adds ``padded_len``."""
    w = Window.partitionBy(batch)
    target = (F.ceil(F.max(F.size(ids)).over(w) / multiple) * multiple).cast("int")
    return (df.withColumn("padded_len", target)
            .withColumn(ids, pad_right(ids, F.col("padded_len"), pad))
            .withColumn(labels, pad_right(labels, F.col("padded_len"), IGNORE_INDEX)))


def as_text(ids: Column | str) -> Column:
    """Render an int array as ``1,2,3`` (for reports and comparisons)."""
    return F.array_join(F.transform(_c(ids), lambda x: x.cast("string")), ",")
