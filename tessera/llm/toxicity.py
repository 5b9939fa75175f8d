"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A bounded sample of labelled rows is halved. A lexicon (whole words and word
beginnings whose document counts lean to toxic texts, after undoing look-alike
characters) is learnt from either half and from both. Each half gets its dense
features by the other half's lexicon, so that no row sees a lexicon that it
helped to make; trees fitted on one half score the other, and these scores fit
the isotonic calibration. The trees used in the end are fitted on both halves
and read the whole lexicon. The model is small and travels to the tasks with
the scoring function; scoring reads every whole text once and shuffles nothing.

Features: densities, counts and weights of lexicon words; lexicon words near a
second-person word; capitals; punctuation; obfuscated words. Labels, lang,
source and doc_id are not among them.

Rows: null and empty texts have all features 0 and get the score of such
texts; equal texts get equal scores, so ties stay ties; very long texts are read
whole, a slice of a batch at a time; a row without doc_id is scored and never
learnt from; an empty table gives no rows; extra columns are passed over unless
named in ``keep`` (one called score is ``score_kept``). Without labelled rows of both classes every score is the
share of label 1 among them (0 without rows).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .labelled import training_rows

# Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch sie tu toi te ton ta tes vous votre vos "
    "tú ti tu tus usted ustedes vosotros vuestro".split())
# Look-alike characters and the letters they stand for.
LOOK_ALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_EDGES = ".,;:!?\"'()[]{}<>«»“”‘’*#%&|-_~+=/\\"
_INNER = re.compile(r"[^\w]|_")
PREFIXES = (3, 4, 5, 6)
NEAR = 3
FEATURES = ("hit_density", "log_hits", "log_distinct_hits", "max_weight", "weight_density", "hits_near_you",
            "you_density", "capital_rate", "capital_words", "punctuation_rate", "exclaim_rate",
            "obfuscated_rate", "obfuscated_hits", "log_words", "mean_length", "max_run_density")


def normal(word: str) -> tuple[str, bool]:
    """The word in lower case without edge punctuation, look-alikes undone; and whether any were."""
    core = word.lower().strip(_EDGES)
    if core.isalpha() or not core or core.isdigit():
        return core, False
    clean = _INNER.sub("", core.translate(LOOK_ALIKES))
    letters = sum(ch.isalpha() for ch in core)
    return clean, clean != core and 2 * letters >= len(core) and letters > 1


def terms(word: str) -> list[str]:
    """The word itself and its beginnings, as lexicon entries."""
    core, _ = normal(word)
    if len(core) < 3:
        return []
    return ["=" + core] + ["^" + core[:k] for k in PREFIXES if len(core) >= k]


@dataclass
class Tree:
    feature: list[int]
    cut: list[int]
    value: np.ndarray


@dataclass
class Boosted:
    """Depth-limited trees on binned features; a tree is a full binary tree in array order."""

    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[Tree] = field(default_factory=list)
    start: float = 0.0
    depth: int = 3

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.bins(x), np.arange(len(x))
        out = np.full(len(x), self.start)
        for tree in self.trees:
            node = np.zeros(len(x), np.int64)
            feature, cut = np.array(tree.feature), np.array(tree.cut)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += tree.value[node - (2**self.depth - 1)]
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def quantile_edges(x: np.ndarray, n: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, k], np.linspace(0, 1, n + 1)[1:-1])) for k in range(x.shape[1])]


def fit_boosted(x: np.ndarray, y: np.ndarray, n_trees: int = 120, depth: int = 3, rate: float = 0.15,
                n_bins: int = 48, penalty: float = 3.0) -> Boosted:
    """Newton boosting of the logistic loss with histogram splits."""
    model = Boosted(quantile_edges(x, n_bins), [], float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), depth)
    b = model.bins(x)
    score = np.full(len(y), model.start)
    width = n_bins + 1
    inner = 2**depth - 1
    for _ in range(n_trees):
        p = sigmoid(score)
        g, h = y - p, p * (1 - p)
        feature, cut = [0] * inner, [width] * inner
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n_nodes = 2**level - 1, 2**level
            local = node - first
            best = np.full(n_nodes, 1e-9)
            for f in range(x.shape[1]):
                at = local * width + b[:, f]
                gs = np.bincount(at, g, n_nodes * width).reshape(n_nodes, width).cumsum(1)
                hs = np.bincount(at, h, n_nodes * width).reshape(n_nodes, width).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + penalty) + (gt - gs) ** 2 / (ht - hs + penalty) - gt**2 / (ht + penalty)
                gain[(hs < 1) | (ht - hs < 1)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(n_nodes), k]
                for i in np.flatnonzero(top > best):
                    best[i], feature[first + i], cut[first + i] = top[i], f, int(k[i])
            node = 2 * node + 1 + (b[np.arange(len(y)), np.array(feature)[node]] > np.array(cut)[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + penalty)
        score += value[leaf]
        model.trees.append(Tree(feature, cut, value))
    return model


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: block centres and means, for linear interpolation between them."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, t in zip(score[order], y[order]):
        blocks.append([t, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    means = np.array([t / n for t, n, _ in blocks])
    return np.array([s / n for _, n, s in blocks]), np.clip(means, 0.001, 0.999)


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: Boosted | None
    knots: tuple[np.ndarray, np.ndarray]
    base: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.base)
        raw = self.trees.raw(x)
        # The raw score breaks ties inside a block, so that order is kept.
        return np.clip(np.interp(raw, *self.knots) + 1e-6 * np.tanh(raw / 10), 0.0, 1.0)


def features(texts: pa.Array, lexicon: dict[str, float]) -> np.ndarray:
    """One row of FEATURES per text."""
    codes, bounds, words = C.split_words(texts)
    n_words = np.diff(bounds).astype(float)
    info = np.zeros((max(len(words), 1), 6))
    for k, word in enumerate(words):
        core, obfuscated = normal(word)
        weight = max((lexicon.get(t, 0.0) for t in terms(word)), default=0.0)
        info[k] = (weight, core in SECOND_PERSON, len(word) > 2 and word.isupper(), obfuscated,
                   sum(not ch.isalnum() for ch in word) if not word.isalnum() else 0, len(word))
    weight = info[codes, 0]
    hit = weight > 0
    you = info[codes, 1] > 0
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    near = np.zeros(len(codes), bool)
    for k in range(1, NEAR + 1):
        same = doc[k:] == doc[:-k]
        near[k:] |= you[:-k] & same
        near[:-k] |= you[k:] & same
    chars = C.sums(info[codes, 5], bounds)
    pairs = np.unique(doc[hit] * (len(words) + 1) + codes[hit])
    distinct = np.bincount(pairs // (len(words) + 1), minlength=len(bounds) - 1).astype(float)
    peak = np.zeros(len(bounds) - 1)
    np.maximum.at(peak, doc, weight)
    # The densest stretch: most hits among any 20 words in a row.
    upto = np.concatenate([[0], np.cumsum(hit)])
    ahead = np.minimum(np.arange(len(codes)) + 20, bounds[1:][doc]) if len(codes) else np.empty(0, np.int64)
    dense = np.zeros(len(bounds) - 1)
    np.maximum.at(dense, doc, upto[ahead] - upto[:-1])
    capitals = pc.count_substring_regex(texts, r"\p{Lu}").to_numpy(zero_copy_only=False)
    exclaims = pc.count_substring_regex(texts, r"[!?]").to_numpy(zero_copy_only=False)
    per_word, per_char = 1.0 / np.maximum(n_words, 1), 1.0 / np.maximum(chars, 1)
    hits = C.sums(hit.astype(float), bounds)
    obfuscated = info[codes, 3]
    return np.stack([
        hits * per_word, np.log1p(hits), np.log1p(distinct), peak, C.sums(weight, bounds) * per_word,
        C.sums((hit & near).astype(float), bounds) * per_word, C.sums(you.astype(float), bounds) * per_word,
        capitals * per_char, C.sums(info[codes, 2], bounds) * per_word, C.sums(info[codes, 4], bounds) * per_char,
        exclaims * per_word, C.sums(obfuscated, bounds) * per_word, C.sums(obfuscated * hit, bounds) * per_word,
        np.log1p(n_words), chars * per_word, dense], axis=1)


def learn_lexicons(rows: DataFrame, sizes: dict[tuple[int, int], int], max_terms: int, min_score: float = 16.0,
                   min_lean: float = 2.0) -> list[dict[str, float]]:
    """Lexicons of half 0, half 1 and both: terms that stand in toxic documents far more often than chance.

    Document counts, G-squared and the log odds (the weight) decide.
    """

    def count(batches):
        for batch in C.slices(batches, "text"):
            codes, bounds, words = C.split_words(C.texts_of(batch, "text"))
            y = batch.column("y").to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(y)), np.diff(bounds))
            index: dict[str, int] = {}
            of_word = [[index.setdefault(t, len(index)) for t in terms(w)] for w in words]
            size = np.array([len(t) for t in of_word], np.int64)
            flat = np.array([t for ts in of_word for t in ts], np.int64)
            starts = np.concatenate([[0], np.cumsum(size)])[:-1].astype(np.int64)
            pairs = np.unique(doc * max(len(words), 1) + codes)
            d, c = pairs // max(len(words), 1), pairs % max(len(words), 1)
            at = flat[C.ragged(starts[c], size[c])] if len(c) else flat[:0]
            seen = np.unique(np.repeat(d, size[c]) * max(len(index), 1) + at)
            d, t = seen // max(len(index), 1), seen % max(len(index), 1)
            half = batch.column("half").to_numpy(zero_copy_only=False)
            kind = 2 * half[d] + y[d]
            counts = [pa.array(np.bincount(t[kind == k], minlength=len(index)).astype(np.int64)) for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(list(index), pa.string()), *counts],
                                             names=["term", "n00", "n01", "n10", "n11"])

    schema = "term string, n00 bigint, n01 bigint, n10 bigint, n11 bigint"
    counted = rows.select("text", "y", "half").mapInArrow(count, schema)
    counted = C.written(counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n00", "n01", "n10", "n11")]),
                        "terms")

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    lexicons = []
    for halves in ((0,), (1,), (0, 1)):
        neg, pos = (sum(F.col(f"n{h}{y}") for h in halves) for y in (0, 1))
        n_neg, n_pos = (sum(sizes[h, y] for h in halves) for y in (0, 1))
        share = n_pos / (n_pos + n_neg)
        n = pos + neg
        score = 2 * (part(pos, n * share) + part(neg, n * (1 - share)))
        lean = F.log((pos + 0.5) / n_pos) - F.log((neg + 0.5) / n_neg)
        best = (counted.select("term", lean.alias("lean"), score.alias("score"))
                .filter((F.col("lean") >= min_lean) & (F.col("score") >= min_score))
                .orderBy(F.desc("score"), "term").limit(max_terms))
        lexicons.append({r["term"]: float(r["lean"]) for r in best.select("term", "lean").collect()})
    return lexicons


def sample_features(rows: DataFrame, compute, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and parts of the bounded sample, in order of doc_id."""

    def run(batches):
        for batch in C.slices(batches, "text"):
            x = compute(C.texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), batch.column("part"),
                 pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.float64()))],
                names=["doc_id", "y", "part", "x"])

    got = rows.mapInArrow(run, "doc_id bigint, y int, part int, x array<double>").toPandas()
    got = got.sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(len(got), width)
    return x, got["y"].to_numpy().astype(float), got["part"].to_numpy()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, held_out: int = 1,
        fit_rows: int = 20_000, max_terms: int = 4_000) -> ToxicityModel:
    """Learn from at most about ``fit_rows`` labelled rows outside the held-out share."""
    rows = training_rows(docs, labels, label, modulus, held_out, fit_rows)
    rows = rows.withColumn("half", (F.col("part") >= 50).cast("int"))
    sizes = {(r["half"], r["y"]): r["n"] for r in rows.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    base = sum(n for (_, y), n in sizes.items() if y) / total if total else 0.0
    if min(sizes.get((half, y), 0) for half in (0, 1) for y in (0, 1)) < 1:
        return ToxicityModel({}, None, (np.zeros(1), np.zeros(1)), base)
    lexicons = learn_lexicons(rows, sizes, max_terms)
    folds = [sample_features(rows.filter(F.col("half") == half), lambda t, k=half: features(t, lexicons[1 - k]),
                             len(FEATURES))[:2] for half in (0, 1)]
    raw = [fit_boosted(*folds[1 - half]).raw(folds[half][0]) for half in (0, 1)]
    x, y = (np.concatenate(parts) for parts in zip(*folds))
    return ToxicityModel(lexicons[2], fit_boosted(x, y), fit_isotonic(np.concatenate(raw), y), base)


def scored(docs: DataFrame, compute, text: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns plus score, for every row; ``compute`` turns texts into scores."""
    schema = C.schema_of(docs, keep, "score double")

    def run(batches):
        for batch in C.slices(batches, text):
            score = pa.array(compute(C.texts_of(batch, text)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), score], names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def toxicity_scores(docs: DataFrame, model: ToxicityModel, text: str = "text",
                    keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return scored(docs, lambda t: model.score(features(t, model.lexicon)), text, keep)
