"""Golden values from the reference's BLEU docstrings (NLTK-style corpus BLEU)."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import textmetrics as tm

hyp1 = ("It is a guide to action which ensures that the military always obeys the commands of the party")
ref1a = "It is a guide to action that ensures that the military will forever heed Party commands"
ref1b = ("It is the guiding principle which guarantees the military forces always being under the "
         "command of the Party")
ref1c = "It is the practical guide for the army always to heed the directions of the party"
hyp2 = "he read the book because he was interested in world history"
ref2a = "he was interested in world history because he read the book"


def starts(value, golden: str):
    """Doctest ``0.5920...`` semantics: the value's leading digits are ``golden``."""
    d = len(golden.split(".")[1])
    assert math.floor(value * 10 ** d + 1e-9) == int(golden.replace(".", "")), (value, golden)


def _stats(spark, rows, nrefs, max_order=4):
    cols = ["item", "hyp"] + [f"r{k}" for k in range(nrefs)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c == 'item' else 'string'}" for c in cols))
    return tm.item_stats(df, "item", "hyp", [f"r{k}" for k in range(nrefs)], max_order)


def test_corpus_bleu_two_items(spark):
    # the second item has one reference; pad the missing ones by repeating it
    st = _stats(spark, [(1, hyp1, ref1a, ref1b, ref1c), (2, hyp2, ref2a, ref2a, ref2a)], 3)
    score = tm.corpus_bleu_v2(st).first()["bleu"]
    starts(score, "0.5920")


def test_sentence_bleu_mean(spark):
    st = _stats(spark, [(1, hyp1, ref1a, ref1b, ref1c), (2, hyp2, ref2a, ref2a, ref2a)], 3)
    s = {r["item"]: r["bleu"] for r in tm.sentence_bleu_v2(st).collect()}
    starts(s[1], "0.5045")
    starts((s[1] + s[2]) / 2, "0.6223")


def test_modified_precision(spark):
    hyp = "the the the the the the the"
    st = _stats(spark, [(1, hyp, "the cat is on the mat", "there is a cat on the mat")], 2).first()
    starts(st["m1"] / 7, "0.2857")
    hyp_b = ("It is to insure the troops forever hearing the activity guidebook that party direct")
    st2 = _stats(spark, [(1, hyp1, ref1a, ref1b, ref1c), (2, hyp_b, ref1a, ref1b, ref1c)], 3)
    rows = {r["item"]: r for r in st2.collect()}
    starts(rows[1]["m1"] / 18, "0.9444")
    starts(rows[2]["m1"] / 14, "0.5714")
    assert rows[1]["m2"] / 17 == pytest.approx(0.5882352941176471, abs=1e-12)
    starts(rows[2]["m2"] / 13, "0.07692")


def test_brevity_penalty(spark):
    df = spark.createDataFrame([(13, 12), (28, 12)], "r int, c int")
    v = [r[0] for r in df.select(tm.brevity_penalty(F.col("r"), F.col("c"))).collect()]
    starts(v[0], "0.9200")
    assert v[1] == pytest.approx(0.2635971381157267, abs=1e-12)
    lens = spark.createDataFrame([([13, 11], 12)], "l array<int>, h int")
    assert lens.select(tm.closest_ref_len(F.col("l"), F.col("h"))).first()[0] == 11


def test_identical_and_disjoint(spark):
    st = _stats(spark, [(1, "a b c d e f", "a b c d e f")], 1)
    assert tm.bleu_v1(st).first()["bleu"] == 100.0
    st = _stats(spark, [(1, "a b c d e f", "u v w x y z")], 1)
    assert tm.bleu_v1(st).first()["bleu"] == 0.0
    assert tm.corpus_bleu_v2(st).first()["bleu"] == 0.0


def test_auto_reweigh(spark):
    st = _stats(spark, [(1, "a b", "a b")], 1)
    assert tm.corpus_bleu_v2(st, auto_reweigh=True).first()["bleu"] == pytest.approx(1.0)
    assert tm.corpus_bleu_v2(st).first()["bleu"] == pytest.approx(0.1 ** 0.5)
    st = _stats(spark, [(1, hyp1, ref1a)], 1)
    assert tm.corpus_bleu_v2(st, auto_reweigh=True).first()["bleu"] == tm.corpus_bleu_v2(st).first()["bleu"]


def test_weighted_recall_by_hand(spark):
    df = spark.createDataFrame([(1, "if x y", "if x z", None)], "item int, hyp string, r0 string, r1 string")
    st = tm.item_stats(df, "item", "hyp", ["r0", "r1"], 2, keywords=tm.KEYWORDS["python"]).first()
    assert (st["n1"], st["d1"]) == (pytest.approx(1.2), pytest.approx(1.4))
    assert (st["n2"], st["d2"]) == (1.0, 2.0)


def test_ngram_regex_matches_python(spark):
    toks = "x yy x zzz x yy x".split()
    df = spark.createDataFrame([(" ".join(toks),)], "s string")
    for n in range(1, 5):
        got = df.select(tm.ngrams_regex(F.col("s"), n)).first()[0]
        want = [" ".join(toks[i:i + n]) for i in range(len(toks) - n + 1)]
        assert got == want
    assert math.isfinite(1.0)
