"""Invariants of curation, splits, results and run logs on the smallest tables."""

import math
import random

from pyspark.sql import functions as F

from tessera.operators import classes, curate, runlogs, splits
from tessera.plans.bindings import V1_PARAMS, v1_corpus, v3_results, v5_curves

SF = "/root/testdata/sf0.001"


def test_funnel_partitions_total(spark):
    a = curate.annotate(v1_corpus(spark, SF), V1_PARAMS)
    f = curate.funnel(a).first().asDict()
    parts = sum(v for k, v in f.items() if k != "total_data_number")
    assert parts == f["total_data_number"] == v1_corpus(spark, SF).count()


def test_dedup_idempotent(spark):
    once = curate.dedup_keep_first(v1_corpus(spark, SF))
    twice = curate.dedup_keep_first(once)
    assert once.count() == twice.count() == once.select("src").distinct().count()


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    r = splits.hash_rank(df, "k")
    ranks = sorted(x[0] for x in r.select("rank").collect())
    assert ranks == list(range(3000))
    import hashlib
    want = sorted(range(3000), key=lambda i: (hashlib.md5(f"42|{i}".encode()).hexdigest(), str(i)))
    got = [int(x["k"]) for x in r.orderBy("rank").collect()]
    assert got == want


def test_greedy_split_matches_python_walk(spark):
    rnd = random.Random(7)
    sizes = [(f"repo{i}", rnd.randint(1, 60)) for i in range(40)]
    df = spark.createDataFrame(sizes, "repo string, n long")
    got = {r["repo"]: r["split"] for r in splits.greedy_split(df, "repo", "n").collect()}
    import hashlib
    order = sorted(sizes, key=lambda x: (hashlib.md5(f"42|{x[0]}".encode()).hexdigest(), x[0]))
    total = sum(n for _, n in sizes)
    tc, vc = round(0.8 * total), round(0.1 * total)
    t = v = 0
    want = {}
    for repo, n in order:
        if t + n <= tc:
            want[repo] = "train"; t += n
        elif v + n <= vc:
            want[repo] = "eval"; v += n
        else:
            want[repo] = "test"
    assert got == want


def test_ema_matches_python(spark):
    v5 = v5_curves(spark, SF)
    sm = runlogs.ema_smooth(v5, ["run", "metric"], "step", "value")
    rows = [r for r in sm.filter("run = 3 AND metric = 'loss'").orderBy("step").collect()]
    xs = [r["value"] for r in rows]
    w = 1.8 * (1 / (1 + math.exp(-0.05 * len(xs))) - 0.5)
    last, out = xs[0], []
    for x in xs:
        last = last * w + (1 - w) * x
        out.append(last)
    assert max(abs(a - r["smoothed"]) for a, r in zip(out, rows)) < 1e-12


def test_project_total_is_sum(spark):
    from tessera.operators.results import per_project
    from tessera.plans.bindings import PROJECTS
    p = {r["project"]: r for r in per_project(v3_results(spark, SF), PROJECTS).collect()}
    for c in ("correct", "pass", "te", "ce", "se", "total"):
        assert p["total"][c] == sum(p[x][c] for x in PROJECTS)


def test_ema_blocks_match_one_fold(spark):
    rows = [("a", i, float((i * 7) % 11)) for i in range(3, 40)] + [("b", 9, 2.5)]
    df = spark.createDataFrame(rows, "run string, step int, value double")
    got = {(r["run"], r["step"]): r["smoothed"] for r in runlogs.ema_smooth(df, ["run"], "step", "value", block=4).collect()}
    for run in ("a", "b"):
        points = [r for r in rows if r[0] == run]
        w = 1.8 * (1 / (1 + math.exp(-0.05 * len(points))) - 0.5)
        last = points[0][2]
        for _, step, x in points:
            last = last * w + (1 - w) * x
            assert math.isclose(got[run, step], last, rel_tol=1e-12)
    assert len(got) == len(rows)


def test_signatures_without_optional_parts(spark):
    none = F.array().cast("array<string>")
    row = spark.range(1).select(
        classes.signature(none, F.lit(None).cast("string"), F.lit("f"), none).alias("m"),
        classes.constructor_signature(none, F.lit("C"), none).alias("c"),
        classes.class_signature(none, F.lit("C"), F.lit(None).cast("string"), none, none).alias("k")).first()
    assert (row["m"], row["c"], row["k"]) == ("void f();", "C();", "class C {\n}")
