"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature has a lookup table over its bins. The tables grow by cyclic
boosting: round after round, one shallow tree on one feature at a time is
fitted to what is left of the logistic loss and added, shrunk, to that
feature's table. Then the pairs of features that explain most of the rest get
a table over both their bins in the same way. A score is the sum of the table
entries of a text's bins, so scoring is a handful of vectorised additions.

Rows: null and empty texts have all features 0; equal texts get equal scores, so
ties stay ties; very long texts are read whole, a slice of a batch at a time; a
row without doc_id is scored and never learnt from; an empty table gives no
rows; extra columns are passed over unless named in ``keep`` (one called score
is ``score_kept``). Without labelled rows of both classes every score is the
share of label 1 among them (0 without).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common as C
from .labelled import training_rows
from .quality_rules import repeated_words
from .toxicity import quantile_edges, sample_features, scored, sigmoid

FEATURES = ("log_words", "mean_length", "length_spread", "distinct_share", "top_word_share", "stutter_share",
            "repeat_share", "capital_share", "capital_words", "symbol_share", "separator_share", "exclaim_share",
            "sentence_ends", "digit_share", "line_words", "ended_lines", "repeated_lines", "other_share")
PAIR_BINS = 8


def _count(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(float)


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    codes, bounds, words = C.split_words(texts)
    n = np.diff(bounds)
    n_words, docs = np.maximum(n, 1).astype(float), len(bounds) - 1
    length = np.array([len(w) for w in words] or [0], float)
    capital = np.array([len(w) > 2 and w.isupper() for w in words] or [0], float)
    doc = np.repeat(np.arange(docs), n)
    mean = C.sums(length[codes], bounds) / n_words
    spread = np.sqrt(np.maximum(C.sums(length[codes] ** 2, bounds) / n_words - mean**2, 0))
    pairs, times = np.unique(doc * max(len(words), 1) + codes, return_counts=True)
    of = pairs // max(len(words), 1)
    distinct = np.bincount(of, minlength=docs)[:docs]
    top = np.zeros(docs)
    np.maximum.at(top, of, times)
    stutter = np.zeros(len(codes))
    stutter[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    cut = lists.offsets.to_numpy().astype(np.int64)
    cut = cut - cut[0]
    full = pc.match_substring_regex(lines, r"\S").to_numpy(zero_copy_only=False)
    ended = pc.match_substring_regex(lines, r"[.!?:;…][\"'”’»)\]]*\s*$").to_numpy(zero_copy_only=False)
    line_codes = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    line_doc = np.repeat(np.arange(docs), np.diff(cut))
    again = np.ones(len(line_codes), bool)
    again[np.unique(line_doc * (int(line_codes.max(initial=0)) + 1) + line_codes, return_index=True)[1]] = False
    n_lines = np.maximum(C.sums(full.astype(float), cut), 1)
    chars = np.maximum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(float), 1)
    letters = np.maximum(_count(texts, r"\p{L}"), 1)
    symbols = _count(texts, r"[#*$%&<>]")
    return np.stack([
        np.log1p(n), mean, spread, distinct / n_words, top / n_words, C.sums(stutter, bounds) / n_words,
        repeated_words(codes, bounds) / n_words, _count(texts, r"\p{Lu}") / letters,
        C.sums(capital[codes], bounds) / n_words, symbols / chars, _count(texts, r"[|»›>]") / n_words,
        _count(texts, "[!?]") / n_words, _count(texts, r"[.!?]") / n_words, _count(texts, r"[0-9]") / chars,
        np.log1p(n_words / n_lines), C.sums((ended & full).astype(float), cut) / n_lines,
        C.sums((again & full).astype(float), cut) / n_lines, 1 - letters / chars], axis=1)


@dataclass
class Additive:
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0
    base: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]
        for b, table in zip(bins, self.tables):
            out += table[b]
        for i, j, table in self.pairs:
            out += table[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x)) if self.tables else np.full(len(x), self.base)


def _gain(g, h, penalty):
    return g * g / (h + penalty)


def shallow_tree(g: np.ndarray, h: np.ndarray, penalty: float, leaves: int = 3) -> np.ndarray:
    """A step function over ordered bins with at most ``leaves`` steps, cut greedily by gain."""
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a < 2:
                continue
            gs, hs = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            gain = (_gain(gs[:-1], hs[:-1], penalty) + _gain(gs[-1] - gs[:-1], hs[-1] - hs[:-1], penalty)
                    - _gain(gs[-1], hs[-1], penalty))
            gain[(hs[:-1] < 1) | (hs[-1] - hs[:-1] < 1)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], a + k + 1)
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts[:-1], cuts[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + penalty)
    return out


def quadrants(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """The best tree that cuts a two-way table once on each axis: its gain and its values."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    g4, h4 = [], []
    for s, four in ((gs, g4), (hs, h4)):
        a, b, c, all_ = s[:-1, :-1], s[:-1, -1:], s[-1:, :-1], s[-1, -1]
        four += [a, b - a, c - a, all_ - b - c + a]
    gain = sum(_gain(p, q, penalty) for p, q in zip(g4, h4)) - _gain(gs[-1, -1], hs[-1, -1], penalty)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    v = [p[i, j] / (q[i, j] + penalty) for p, q in zip(g4, h4)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def fit_additive(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 8,
                 rate: float = 0.1, n_bins: int = 48, penalty: float = 3.0) -> Additive:
    share = (y.sum() + 1) / (len(y) + 2)
    model = Additive(quantile_edges(x, n_bins), start=float(np.log(share / (1 - share))), base=float(y.mean()))
    n = x.shape[1]
    bins = [np.searchsorted(model.edges[k], x[:, k], side="right") for k in range(n)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.coarse = [np.arange(len(t)) * PAIR_BINS // len(t) for t in model.tables]
    score = np.full(len(y), model.start)
    for _ in range(rounds):
        for k in range(n):
            p = sigmoid(score)
            width = len(model.tables[k])
            step = rate * shallow_tree(np.bincount(bins[k], y - p, width), np.bincount(bins[k], p * (1 - p), width),
                                       penalty)
            model.tables[k] += step
            score += step[bins[k]]
    small = [c[b] for c, b in zip(model.coarse, bins)]

    def two_way(i, j):
        p = sigmoid(score)
        at = small[i] * PAIR_BINS + small[j]
        shape = (PAIR_BINS, PAIR_BINS)
        return (np.bincount(at, y - p, PAIR_BINS**2).reshape(shape),
                np.bincount(at, p * (1 - p), PAIR_BINS**2).reshape(shape))

    ranked = sorted(combinations(range(n), 2), key=lambda ij: -quadrants(*two_way(*ij), penalty)[0])[:n_pairs]
    model.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for i, j in ranked]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            step = rate * quadrants(*two_way(i, j), penalty)[1]
            table += step
            score += step[small[i], small[j]]
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, held_out: int = 0,
        fit_rows: int = 20_000) -> Additive:
    """Learn from at most about ``fit_rows`` labelled rows outside the held-out share."""
    rows = training_rows(docs, labels, label, modulus, held_out, fit_rows)
    x, y, _ = sample_features(rows, features, len(FEATURES))
    if len(set(y)) < 2:
        return Additive(base=float(y.mean()) if len(y) else 0.0)
    return fit_additive(x, y)


def quality_scores(docs: DataFrame, model: Additive, text: str = "text",
                   keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return scored(docs, lambda t: model.score(features(t)), text, keep)
