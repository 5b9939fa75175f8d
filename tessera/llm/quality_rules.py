"""Quality rules: line-first cleaning.

Every line is judged by itself first; failing lines are removed, and a document
that loses too much of its text is rejected. A line with a word fails if

* punctuation: it has no sentence end (``.``, ``!``, ``?``, ``:`` or ``;`` before
  white space, a closing quote or bracket, or the line's end), or as many
  ``!``/``?`` runs as 30 % of its words; short headings next to prose are
  judged like any other line;
* navigation: it has two or more menu separators (``|``, ``»``, ``›``, ``>``),
  and they are 10 % of its words or more;
* boilerplate: it has one of the fixed phrases below;
* noise: symbols ``#*$%&|<>`` are 10 % of its characters or more, or it has ten
  letters or more of which 80 % are capitals;
* stutter: three words or more repeat the word before them, and they are 30 %
  of its words or more.

Base rules on the whole text: fewer than ``min_words`` words, or more than
``max_repeat_pct`` percent of the words in 8-word windows that occur twice.

Rows: null and empty texts have no words and are rejected; texts are read
whole, a slice of a batch at a time; every row is judged by itself, so repeated
rows get the same verdict and ties do not arise; an empty table gives no rows;
extra columns are passed over unless named in ``keep`` (one that has the name of
a result column is called ``<name>_kept``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common as C

# Phrases of page furniture, matched without regard to case.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "use of cookies", "uses cookies", "enable javascript", "javascript is disabled", "lorem ipsum",
    "click here", "sign up for our newsletter", "subscribe to our newsletter", "share this page",
    "share on facebook", "log in to comment", "skip to content", "back to top", "powered by wordpress",
)
WINDOW = 8


@dataclass(frozen=True)
class LineRules:
    min_words: int = 20
    max_repeat_pct: int = 30
    max_lost_pct: int = 50
    exclaim_pct: int = 30
    separator_pct: int = 10
    symbol_pct: int = 10
    capital_pct: int = 80
    stutter_pct: int = 30


def _count(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64)


def failing_lines(lines: pa.Array, n_words: np.ndarray, rules: LineRules) -> np.ndarray:
    """Which lines fail a rule; lines without a word never do."""
    chars = pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = pc.match_substring_regex(lines, r"[.!?:;…。！？]+[\"'”’»)\]]*(?:\s|$)").to_numpy(zero_copy_only=False)
    exclaims = _count(lines, r"[!?]+")
    separators = _count(lines, r"[|»›>]")
    symbols = _count(lines, r"[#*$%&|<>]")
    capitals, small = _count(lines, r"\p{Lu}"), _count(lines, r"\p{Ll}")
    boiler = pc.match_substring_regex(lines, "|".join(BOILERPLATE), ignore_case=True).to_numpy(zero_copy_only=False)
    fails = ~ends
    fails |= (exclaims >= 3) & (100 * exclaims >= rules.exclaim_pct * n_words)
    fails |= (separators >= 2) & (100 * separators >= rules.separator_pct * n_words)
    fails |= boiler
    fails |= (symbols >= 2) & (100 * symbols >= rules.symbol_pct * chars)
    fails |= (capitals >= 10) & (100 * capitals >= rules.capital_pct * (capitals + small))
    return fails & (n_words > 0)


def repeated_words(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text: words in 8-word windows found twice or more in it."""
    n = len(codes)
    if n < WINDOW:
        return np.zeros(len(bounds) - 1, np.int64)
    weights = C.odd_constants(WINDOW, 8)
    value = C.mix(codes.astype(np.uint64) + np.uint64(1))
    window = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        window += value[k : n - WINDOW + 1 + k] * weights[k]
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = doc[: n - WINDOW + 1] == doc[WINDOW - 1 :]
    at = np.flatnonzero(inside)
    key = C.mix(C.mix(window[at]) + doc[at].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    start = at[order[twice]]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + WINDOW, -1)
    return C.sums((np.cumsum(cover[:-1]) > 0).astype(np.int64), bounds)


def repeated_lines(line_codes: np.ndarray, bounds: np.ndarray, has_word: np.ndarray) -> np.ndarray:
    """Per text: lines with a word that equal an earlier line of it."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    key = doc * (int(line_codes.max(initial=0)) + 1) + line_codes
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False
    return C.sums((again & has_word).astype(np.int64), bounds)


def clean_lines(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text",
                keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """``keep`` columns plus the counts, base_failed, n_failed_lines, lost_words and kept for every row.

    ``with_text`` adds ``clean_text``: the text without its failing lines.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = C.schema_of(docs, keep, ", ".join(f"{c} bigint" for c in counts) + ", base_failed boolean, "
                         "n_failed_lines bigint, lost_words bigint, kept boolean" + ", clean_text string" * with_text)
    names = schema.names

    def run(batches):
        for batch in C.slices(batches, text):
            texts = C.texts_of(batch, text)
            spaces = _count(texts, r"[\x20\x09-\x0D]")
            chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            lists = pc.split_pattern(texts, "\n")
            lines = lists.flatten()
            cut = lists.offsets.to_numpy().astype(np.int64)
            cut = cut - cut[0]
            codes, word_cut, _ = C.split_words(lines)
            bounds = word_cut[cut]
            n_words, line_words = np.diff(bounds), np.diff(word_cut)
            stutters = np.zeros(len(codes), np.int64)
            stutters[1:] = codes[1:] == codes[:-1]
            stutters[word_cut[:-1][line_words > 0]] = 0
            stutters = C.sums(stutters, word_cut)
            encoded = lines.dictionary_encode()
            line_codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            distinct = encoded.dictionary
            of_distinct = np.zeros(len(distinct), np.int64)
            of_distinct[line_codes] = line_words
            fails = failing_lines(distinct, of_distinct, rules)[line_codes]
            fails |= (stutters >= 3) & (100 * stutters >= rules.stutter_pct * line_words)
            repeat = repeated_words(codes, bounds)
            lost = C.sums(line_words * fails, cut)
            base_failed = (n_words < rules.min_words) | (100 * repeat > rules.max_repeat_pct * n_words)
            kept = ~base_failed & (100 * lost <= rules.max_lost_pct * n_words)
            columns = [batch.column(k) for k in keep]
            columns += [pa.array(x) for x in (
                n_words, chars - spaces, _count(texts, r"[#*$%&|<>]"),
                repeated_lines(line_codes, cut, line_words > 0), repeat, base_failed,
                C.sums(fails.astype(np.int64), cut), lost, kept)]
            if with_text:
                left = pa.array(~fails)
                bounds_left = np.concatenate([[0], np.cumsum(~fails)])[cut].astype(np.int32)
                columns.append(pc.binary_join(
                    pa.ListArray.from_arrays(pa.array(bounds_left), lines.filter(left)), "\n"))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
