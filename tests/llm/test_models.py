"""The two classifiers' learning steps against plain versions, and their bounded sample."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import labelled, quality_gam, toxicity

RNG = np.random.default_rng(7)


def test_isotonic_is_the_min_max_formula():
    for n in (1, 2, 7, 60):
        score, y = RNG.normal(size=n).round(1), RNG.integers(0, 2, n).astype(float)
        at, means = toxicity.fit_isotonic(score, y)
        order = np.argsort(score, kind="stable")
        t = y[order]
        want = [max(min(t[a : b + 1].mean() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(sorted(set(np.clip(want, 0.001, 0.999).round(9))), sorted(set(means.round(9))))
        assert (np.diff(means) > -1e-12).all() and (np.diff(at) >= 0).all()


def _split_gain(g, h, left, penalty=3.0):
    if h[left].sum() < 1 or h[~left].sum() < 1:
        return 0.0
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + penalty)
    return part(left) + part(~left) - part(np.ones(len(g), bool))


def test_first_tree_takes_the_best_split():
    for _ in range(20):
        x = RNG.integers(0, 9, (120, 4)).astype(float)
        y = (RNG.random(120) < 1 / (1 + np.exp(4 - x[:, RNG.integers(4)]))).astype(float)
        model = toxicity.fit_boosted(x, y, n_trees=1, depth=1)
        b, p = model.bins(x), toxicity.sigmoid(np.full(len(y), model.start))
        g, h = y - p, p * (1 - p)
        gains = {(f, c): _split_gain(g, h, b[:, f] <= c) for f in range(4) for c in range(len(model.edges[f]) + 1)}
        tree = model.trees[0]
        chosen = gains.get((tree.feature[0], tree.cut[0]), 0.0)
        assert chosen == pytest.approx(max(gains.values()), abs=1e-9)
        left = b[:, tree.feature[0]] <= tree.cut[0]
        want = [0.15 * g[m].sum() / (h[m].sum() + 3.0) for m in (left, ~left)]
        assert np.allclose(tree.value, want)
        assert np.allclose(model.raw(x), model.start + np.where(left, *tree.value))


def test_deeper_trees_fall_through_their_nodes():
    x, y = RNG.normal(size=(300, 5)), (RNG.random(300) < 0.4).astype(float)
    model = toxicity.fit_boosted(x, y, n_trees=5)
    bins = model.bins(x)
    for row, got in zip(bins, model.raw(x)):
        total = model.start
        for tree in model.trees:
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + int(row[tree.feature[node]] > tree.cut[node])
            total += tree.value[node - 7]
        assert got == pytest.approx(total)


def test_shallow_tree_and_quadrants_are_the_best_cuts():
    for _ in range(30):
        n = int(RNG.integers(2, 12))
        g, h = RNG.normal(size=n) * 5, RNG.random(n) * 6
        step = quality_gam.shallow_tree(g, h, 3.0, leaves=2)
        gains = [_split_gain(g, h, np.arange(n) < c) for c in range(1, n)]
        cut = int(np.argmax(gains)) + 1
        parts = [slice(0, cut), slice(cut, n)] if max(gains) > 1e-9 else [slice(0, n)]
        want = np.concatenate([np.full(len(g[p]), g[p].sum() / (h[p].sum() + 3.0)) for p in parts])
        assert np.allclose(step, want)
        g, h = RNG.normal(size=(5, 6)) * 4, RNG.random((5, 6)) * 4
        gain, values = quality_gam.quadrants(g, h, 3.0)
        part = lambda a: a[0].sum() ** 2 / (a[1].sum() + 3.0)
        blocks = lambda i, j: [(s, t) for s in (slice(0, i), slice(i, None)) for t in (slice(0, j), slice(j, None))]
        all_gains = {(i, j): sum(part((g[b], h[b])) for b in blocks(i, j)) - part((g, h))
                     for i, j in itertools.product(range(1, 5), range(1, 6))}
        i, j = max(all_gains, key=all_gains.get)
        assert gain == pytest.approx(all_gains[i, j])
        for b in blocks(i, j):
            assert np.allclose(values[b], g[b].sum() / (h[b].sum() + 3.0))


def test_additive_score_is_a_sum_of_table_entries():
    x = RNG.normal(size=(400, 6)).round(1)
    y = (RNG.random(400) < 1 / (1 + np.exp(-(x[:, 0] + 2 * x[:, 1] * x[:, 2])))).astype(float)
    model = quality_gam.fit_additive(x, y, rounds=10, pair_rounds=10, n_pairs=3)
    assert (1, 2) in [(i, j) for i, j, _ in model.pairs]
    for row, got in zip(x, model.raw(x)):
        bins = [int((row[k] >= e).sum()) for k, e in enumerate(model.edges)]
        total = model.start + sum(t[b] for b, t in zip(bins, model.tables))
        for i, j, table in model.pairs:
            small = [bins[k] * quality_gam.PAIR_BINS // len(model.tables[k]) for k in (i, j)]
            total += table[small[0], small[1]]
        assert got == pytest.approx(total)


def test_features_of_odd_texts():
    texts = pa.array(["", " \n ", "you " * 5000, "日本 !!! ???", "A" * 100_000])
    for got in (toxicity.features(texts, {"=you": 2.0}), quality_gam.features(texts)):
        assert got.shape[0] == 5 and np.isfinite(got).all()


def test_sample_is_bounded_whatever_the_table(spark):
    rng = random.Random(4)
    rows = [(1, f"copy {rng.random()}") for _ in range(3000)] + [(i, f"text {i}") for i in range(2, 700)] + [(None, "none")] * 50
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(700)] + [(None, 1), (5, None), (6, 0), (6, 1)],
                                   "doc_id bigint, toxic int")
    got = labelled.training_rows(docs, labels, "toxic", 3, 1, 100).collect()
    assert 0 < len(got) <= 100 and len({r.doc_id for r in got}) == len(got)
    every = labelled.training_rows(docs, labels, "toxic", 3, 1, 10**6).collect()
    assert {r.doc_id for r in got} <= {r.doc_id for r in every} and [r.doc_id for r in every].count(1) <= 1
    assert all(r.y == 0 for r in every if r.doc_id == 6)


def test_empty_tables_and_rows_without_id(spark):
    schema = "doc_id bigint, text string, score int, y int"
    docs = spark.createDataFrame([(None, "a b", 1, 2), (1, None, 1, 2), (1, None, 1, 2)], schema)
    labels = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    for fit, scores in ((toxicity.fit, toxicity.toxicity_scores), (quality_gam.fit, quality_gam.quality_scores)):
        model = fit(docs, labels)
        rows = scores(docs, model, keep=("doc_id", "score", "y"))
        assert rows.columns == ["doc_id", "score_kept", "y", "score"]
        assert [r.score for r in rows.collect()] == [0.0] * 3
        assert scores(docs.limit(0), model).count() == 0
        assert scores(docs, fit(docs.limit(0), labels)).count() == 3
