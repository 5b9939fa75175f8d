"""Operators whose work is dealt in blocks or levels, against plain walks."""

import itertools
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import classes as cl
from tessera.operators import flow as fl
from tessera.operators import projects as pj
from tessera.operators import runlogs as rl
from tessera.operators import splits
from tessera.operators import textmetrics as tm
from tessera.operators.curate import hash_order


def _plain_split(rows, train=0.8, valid=0.1):
    total = sum(n for _, _, n in rows)
    room = [round(train * total), round(valid * total)]
    out = {}
    for _, k, n in sorted(rows):
        at = 0 if n <= room[0] else 1 if n <= room[1] else 2
        if at < 2:
            room[at] -= n
        out[k] = ("train", "eval", "test")[at]
    return out


def test_greedy_split_equals_the_plain_walk(spark):
    cost = {}
    for n, size in ((1, "1 + id"), (300, "id % 40"), (10_000, "1 + pmod(hash(id), 300)"),
                    (10_000, "CASE WHEN id % 997 = 0 THEN 40000 ELSE 1 + pmod(hash(id), 9) END"),
                    (100_000, "1 + pmod(hash(id), 300)")):
        sizes = spark.range(n).selectExpr("concat('r', id) AS repo", f"CAST({size} AS BIGINT) AS n")
        rows = [tuple(r) for r in sizes.select(hash_order(F.col("repo"), "42"), "repo", "n").collect()]
        t = time.time()
        got = {r["repo"]: r["split"] for r in splits.greedy_split(sizes, "repo", "n").collect()}
        cost[n] = time.time() - t
        assert got == _plain_split(rows)
    # Ten times the repos cost a few times as much, not a hundred times.
    assert cost[100_000] < 10 * max(cost[10_000], 3)
    assert splits.greedy_split(spark.createDataFrame([], "repo string, n long"), "repo", "n").count() == 0


def _nodes(spark, trees):
    rows = [(item, side, p, d, label) for item, side, tree in trees for p, (d, label) in enumerate(tree)]
    return spark.createDataFrame(rows, "item long, side string, pos int, depth int, label string").repartition(3)


def test_subtrees_tell_nesting_apart(spark):
    # Equal tag:depth lists, different nesting: b hangs under the first a, or under the second.
    one, two = [(1, "r"), (2, "a"), (3, "b"), (2, "a")], [(1, "r"), (2, "a"), (2, "a"), (3, "b")]
    assert sorted(one) == sorted(two)
    got = fl.syntax_match(fl.subtrees(_nodes(spark, [(1, "ref", one), (1, "cand", two)]))).first()
    assert (got.matched, got.total) == (3, 4)  # all but the root
    rng = random.Random(6)
    trees = []
    for item in range(12):
        for side in ("ref", "cand"):
            depth, tree = 1, []
            for _ in range(rng.choice([1, 5, 60, 400])):
                tree.append((depth, rng.choice("ab")))
                depth = rng.randint(max(1, depth - rng.choice([0, 1, 4])), depth + 1)
            trees.append((item, side, tree))
    want = {}
    for item, side, tree in trees:
        for p, (d, _) in enumerate(tree):
            end = next((q for q in range(p + 1, len(tree)) if tree[q][0] <= d), len(tree))
            want[item, side, p] = tuple((x - d, label) for x, label in tree[p:end])
    rows = fl.subtrees(_nodes(spark, trees)).collect()
    got = {(r.item, r.side, r.pos): r.subtree for r in rows}
    assert len(rows) == len(want) and set(got) == set(want)
    pairs = {(got[k], want[k]) for k in want}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_classes_meet_files_by_folder(spark):
    rng = random.Random(8)
    names = ["org", "a", "b", "ab", "src", "x"]
    files = [("/".join([*rng.choices(names, k=rng.randint(0, 6)), rng.choice(["C.java", "D.java"])]),) for _ in range(300)]
    classes = [(rng.choice("CD"), ".".join(rng.choices(names, k=rng.randint(1, 5)))) for _ in range(80)] + [("C", "")]
    classes = sorted(set(classes))
    got = pj.match_classes_to_files(spark.createDataFrame(classes, "class_name string, package string"),
                                    spark.createDataFrame(files, "path string")).select("class_name", "package", "path")
    want = sorted((c, p, f) for c, p in classes for (f,) in files
                  if f.split("/")[-1] == f"{c}.java" and p.replace(".", "/") in f[: max(f.rfind("/"), 0)])
    assert sorted(tuple(r) for r in got.collect()) == want


def test_files_named_alike_do_not_meet_all_classes(spark):
    files = spark.range(100_000).selectExpr("concat('src/org/p', id % 50000, '/q', id, '/Util.java') AS path")
    classes = spark.range(20_000).selectExpr("'Util' AS class_name", "concat('org.p', id, '.q', id) AS package")
    got = pj.match_classes_to_files(classes, files)
    # By file name alone these would be 2,000,000,000 pairs.
    want = sum(str(f).startswith(str(i)) for i in range(20_000) for f in (i, i + 50_000))
    assert got.count() == want


def _plain_stop(values, patience):
    best, since = None, 0
    for i, v in enumerate(values):
        if best is None or v < best:
            best, since = v, 0
        else:
            since += 1
        if since >= patience:
            return i
    return None


def test_one_very_long_run(spark):
    """A run of a million points next to short ones: both scans equal the plain walks."""
    n = 1_000_000
    long = spark.range(n).selectExpr("0 AS run", "id AS step", "CASE WHEN id % 50 = 49 THEN 9.0 ELSE 1.0 / (id + 1) END AS v")
    rng = np.random.default_rng(3)
    short = pd.DataFrame([(run, s, float(v)) for run in range(1, 40) for s, v in enumerate(rng.integers(0, 30, rng.integers(1, 300)))],
                         columns=["run", "step", "v"])
    evals = long.unionByName(spark.createDataFrame(short).selectExpr("CAST(run AS INT) AS run", "step", "CAST(v AS DOUBLE) AS v"))
    values = {0: [9.0 if i % 50 == 49 else 1.0 / (i + 1) for i in range(n)]} | {
        r: g["v"].tolist() for r, g in short.groupby("run")}
    for patience, block in ((2, 4096), (5, 7)):
        got = {r.run: r.stop_step for r in rl.early_stop(evals, "run", "step", "v", patience, block).collect()}
        assert got == {r: _plain_stop(v, patience) for r, v in values.items()}
    assert got[0] is None
    got = rl.ema_smooth(evals, ["run"], "step", "v").filter("run = 0").select("step", "smoothed").toPandas()
    got = got.sort_values("step")["smoothed"].to_numpy()
    w = 1.8 * (1 / (1 + np.exp(-0.05 * n)) - 0.5)
    last, want = values[0][0], np.empty(n)
    for i, v in enumerate(values[0]):
        last = want[i] = last * w + (1 - w) * v
    assert len(got) == n and np.abs(got - want).max() < 1e-9


def test_scan_in_levels_equals_one_window(spark):
    blocks = spark.range(3000).selectExpr("id % 3 AS k", "id DIV 3 AS b", "pmod(hash(id), 97) AS x", "CASE WHEN id % 5 = 0 THEN id END AS y")
    values = {"x": F.min, "y": F.max}
    one, two = (sorted(map(tuple, rl.scan_before(blocks, ["k"], "b", values, fan=8, levels=n).select(
        "k", "b", "x_before", "y_before").collect())) for n in (0, 2))
    assert one == two
    short = rl.ema_smooth(blocks.select("k", "b", "x"), ["k"], "b", "x", block=4).collect()
    long = rl.ema_smooth(blocks.select("k", "b", "x"), ["k"], "b", "x", block=2000).collect()
    a, b = ({(r.k, r.b): r.smoothed for r in rows} for rows in (short, long))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_file_lines_and_inventory(spark):
    texts = ["", "a", "a\n", "a\r\nb", "a\rb\r", "a\n\nb", "\n", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h ", "é\r\n\r"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    got = {r.path: r.n for r in df.select("path", cl.file_lines(F.col("text")).alias("n")).collect()}
    assert got == {str(i): len(t.splitlines()) for i, t in enumerate(texts)}
    members = spark.createDataFrame([("p", 1, ["public"], "3"), ("p", 1, ["private"], "3"), ("p", 2, ["public", "static"], "3"),
                                     ("p", 3, [], "none"), ("q", 4, ["public"], "7")],
                                    "project string, cls int, modifiers array<string>, path string")
    got = sorted(tuple(r) for r in cl.inventory(members, df, "project", "cls", "modifiers").collect())
    assert got == [("p", 3, 2, 4), ("q", 1, 1, len(texts[7].splitlines()))]


def _plain_dataflow(rows):
    matched = total = 0
    items = defaultdict(lambda: defaultdict(list))
    for r in rows:
        items[r[0]][r[1]].append(r)
    for sides in items.values():
        forms = {}
        for side, own in sides.items():
            at, names, out = defaultdict(list), {}, []
            for r in sorted(own, key=lambda r: (r[2], r[7])):
                at[r[2]].append(r)
            parents = {q for r in own for q in r[6]}
            for p in sorted(at):
                if (any(r[6] for r in at[p]) or p in parents) and at[p][-1][3] is not None:
                    order = sorted({x for r in at[p] for x in r[5]}, key=lambda x: x.encode()) + [at[p][-1][3]]
                    out.append((at[p][-1][4], tuple(names.setdefault(x, len(names)) for x in order)))
            forms[side] = Counter(out)
        ref, cand = forms.get("ref", Counter()), forms.get("cand", Counter())
        matched, total = matched + sum((ref & cand).values()), total + sum(ref.values())
    return matched, total


def test_dataflow_match_equals_the_plain_version(spark):
    rng = random.Random(2)
    rows = []
    for item in range(150):
        for side in ("ref", "cand"):
            for o in range(rng.choice([0, 1, 4, 12, 60])):
                n = rng.choice([0, 0, 1, 2, 3])
                rows.append((item * 7, side, rng.randint(0, 9), rng.choice(["a", "b", "é", "c", None]), rng.choice("xy"),
                             rng.choices("abéz", k=n), [rng.randint(0, 12) for _ in range(n)], o))
    schema = "item long, side string, pos int, name string, rel string, parents array<string>, parent_pos array<int>, ord int"
    df = spark.createDataFrame(rows, schema).repartition(3)
    want = _plain_dataflow(rows)
    for size in (10_000, 3):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = fl.dataflow_match(df).first()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert (got.matched, got.total) == want and 0 < got.matched < got.total
    none = fl.dataflow_match(df.limit(0)).first()
    assert (none.dataflow_match, none.matched, none.total) == (0.0, 0, 0)


def _plain_grams(toks, n):
    return Counter(tuple(toks[i:i + n]) for i in range(len(toks) - n + 1))


def test_gram_table_and_item_stats_equal_the_plain_counts(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda: None if rng.random() < 0.1 else " ".join(rng.choices("if x y é ☃ the".split(), k=rng.choice([0, 1, 3, 9, 40])))
    rows = [(rng.choice([None, *range(40)]), text(), text(), text()) for _ in range(90)]  # items come twice
    df = spark.createDataFrame(rows, "item long, hyp string, r0 string, r1 string").repartition(3)
    want = defaultdict(Counter)
    for item, *texts in rows:
        for n, (c, t) in itertools.product(range(1, 5), enumerate(texts)):
            for g, k in _plain_grams((t or "").split(), n).items():
                want[item, n, g][c] += k
    table = Counter((i, n, n == 1 and g[0] == "if", *(c[k] for k in range(3))) for (i, n, g), c in want.items())
    for size, tokens in ((10_000, 1 << 18), (3, 30)):
        monkeypatch.setattr(tm, "TOKENS_AT_ONCE", tokens)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = Counter()
            for r in tm.gram_table(tm.sides_frame(df, "item", "hyp", ["r0", "r1"]), 2, 4, ["if"]).collect():
                got[r[:-1]] += r.grams
            stats = {r["item"]: r for r in tm.item_stats(df, "item", "hyp", ["r0", "r1"], keywords=["if"]).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == table
        assert len(stats) == len({r[0] for r in rows})
        for item, r in stats.items():
            if item is None:  # a null item meets no grams
                continue
            for n in range(1, 5):
                own = [(g, c) for (i, k, g), c in want.items() if (i, k) == (item, n)]
                assert r[f"m{n}"] == sum(min(c[0], max(c[1], c[2])) for _, c in own)
                weights = [0.2 if n == 1 and g[0] != "if" else 1.0 for g, _ in own]
                assert r[f"n{n}"] == pytest.approx(sum(w * (min(c[0], c[1]) + min(c[0], c[2])) for w, (_, c) in zip(weights, own)))


def test_no_n_gram_is_a_row_of_item_stats(spark):
    df = spark.createDataFrame([(1, "a b c d", "a b d")], "item int, hyp string, ref string")
    plan = tm.item_stats(df, "item", "hyp", ["ref"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan and "gram#" not in plan


def test_head_in_file_order_gives_500_rows(spark, tmp):
    from tessera.operators import predictions as pr
    from tessera.plans import q_predictions as q
    spark.range(700).selectExpr("699 - id AS doc_id", "'web' AS source", "'a b' AS text").write.parquet(f"{tmp}/documents.parquet")
    assert [r.idx for r in q.q_head_in_file_order(spark, tmp).collect()] == list(range(500))
    assert "LIMIT 500" in q.SQL["head_in_file_order"]
    df = spark.range(3)
    assert pr.head_rows(df, "id", 4, short=True).count() == 3
    with pytest.raises(ValueError):
        pr.head_rows(df, "id", 4)


def test_edges_that_lie_together_are_matched_as_others(spark):
    rng = random.Random(7)
    rows = []
    for item in range(120):
        own = [(item, side, rng.randint(0, 9), rng.choice(["a", "b", "é", None]), rng.choice("xy"), [rng.choice("abé")] * n,
                [rng.randint(0, 9)] * n, o) for side in ("ref", "cand") for o in range(rng.choice([0, 1, 5, 30])) for n in (rng.choice([0, 1]),)]
        rows += rng.sample(own, len(own))
    schema = "item long, side string, pos int, name string, rel string, parents array<string>, parent_pos array<int>, ord int"
    df = spark.createDataFrame(rows, schema).coalesce(1)
    for size in (10_000, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = fl.dataflow_match(df, together=True)
            assert tuple(got.first())[1:] == _plain_dataflow(rows)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_definitions_found_in_a_task_are_those_of_the_window(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for item in [None, *range(60)]:
        own = [(item, side, p, rng.choice(["a", "b", "é", None]), rng.choice([True, False, None]))
               for side in ("ref", "cand") for p in [None, *range(rng.choice([0, 1, 5, 40]))]]
        rows += rng.sample(own, len(own))
    df = spark.createDataFrame(rows, "item long, side string, pos int, name string, is_def boolean").coalesce(1)
    want = sorted(map(repr, fl.reaching_definitions(df).collect()))
    monkeypatch.setattr(fl, "TOKENS_AT_ONCE", 50)
    for size in (10_000, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = fl.reaching_definitions(df, together=True)
            assert sorted(map(repr, got.collect())) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_own_fields_are_those_of_the_join(spark):
    rows = [(c, n, d) for c in (None, 1, 2, 3) for n, d in ((2, "b" if c != 3 else None), (1, "a" if c == 1 else None), (3, None))]
    m = spark.createDataFrame(rows, "cls long, n long, d string")
    want = cl.with_fields(m, m.filter("d IS NOT NULL"), "cls", "d", "n").select("cls", "n", "fields")
    got = cl.with_fields(m, None, "cls", "d", "n").select("cls", "n", "fields")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_members_are_dealt_once(spark, tmp):
    from tessera.plans import q_classes as q
    spark.sql("SELECT id AS l_orderkey, id AS l_partkey, id AS l_suppkey, 1 AS l_linenumber, 1.0D AS l_quantity, 1.0D AS l_extendedprice,"
              " 'A' AS l_returnflag, 'F' AS l_linestatus, DATE'2020-01-01' AS l_shipdate FROM range(9)").write.parquet(f"{tmp}/lineitem.parquet")
    spark.sql("SELECT id AS p_partkey, 'n' AS p_name, 'b' AS p_brand, 't' AS p_type FROM range(9)").write.parquet(f"{tmp}/part.parquet")
    got = q.q_sibling_signatures(spark, tmp)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [r.n_siblings for r in got.collect()] == [0] * 9


def test_long_lines_and_texts_take_linear_time(spark):
    """Each of these took a step per n-gram, line or branch over the whole input before."""
    from tessera.operators import predictions as pr
    df = spark.createDataFrame([(["x"] * 20_000, "\n".join(["  public void t() {"] + ["    a;"] * 20_000))], "t array<string>, s string")
    t0 = time.time()
    got = df.select(F.size(tm.ngram_array(tm.pad_sequence(F.col("t"), 2, "<s>", "</s>"), 2)).alias("g"),
                    F.length(pr.line_span(F.col("s"), F.lit(1), F.lit(20_001))).alias("s")).first()
    assert (got.g, got.s) == (20_001, len("public void t() {") + 20_000 * 5)
    assert time.time() - t0 < 20


def test_class_text_steps_on_odd_texts(spark):
    from tessera.operators import predictions as pr
    df = spark.createDataFrame([("a{b}}x",), ("}{",), ("",), (None,), ("M }{ { M{x{y}z}w}",), ("a;b;c",), ("a\n\nb\n",)], "s string")
    imports = F.array(F.lit("org.junit.Test"))
    rows = df.select(pr.matching_close("s", "M"), pr.repair_truncated("s"), pr.test_class(F.lit("p"), imports, F.lit("C"), F.col("s"), ()),
                     pr.line_span(F.col("s"), F.lit(1), F.lit(0))).collect()
    assert [r[0] for r in rows] == [None, None, None, None, 16, None, None]
    assert [r[1] for r in rows] == ["a{b}}x}", "}{}", "}", None, "M }{ { M{x{y}z}w}", "a;b;}", "a\n\nb\n}"]
    head = "package p;\n\n\nimport p.*;\n\npublic class C extends TestCase {\n"
    assert [r[2] for r in rows] == [s if s is None else head + "".join(f"    {x}\n" for x in s.split("\n")) + "}\n" for (s,) in df.collect()]
    assert [r[3] for r in rows] == ["", "", "", None, "", "", ""]


def test_items_that_come_twice_stay_together_behind_a_join(spark, tmp):
    from tessera.plans import bindings, q_flow, q_metrics
    rows = [(k % 40, "web", " ".join(random.Random(k).choices("abcdef", k=k % 23))) for k in range(160)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(7).write.parquet(f"{tmp}/documents.parquet")
    for df in (bindings.v10_edges(spark, tmp), q_metrics._stats(spark, tmp, ["label"])):
        assert "hashpartitioning(xxhash64(" in df._jdf.queryExecution().executedPlan().toString()
    e = bindings.v10_edges(spark, tmp)
    parts = e.select("item", F.spark_partition_id().alias("p")).distinct().groupBy("item").count().filter("count > 1")
    assert parts.count() == 0
    grams = q_metrics.q_ngram_overlap_by_order(spark, tmp).filter("ord = 1").first()
    v2 = bindings.v2_pairs(spark, tmp, second_ref=True).collect()
    distinct = {(r.idx, w) for r in v2 for t in (r.predict, r.label, r.ref2) for w in t.split()}
    assert grams.distinct_grams == len(distinct)


def test_padded_gram_totals_equal_the_plain_counts(spark, tmp):
    from tessera.plans import q_metrics
    rng = random.Random(9)
    words = ["a", "b", "<s>", "</s>", "<s>x", "y</s>", "é☃", "x" * 70, "a b", "\x0b"]
    text = lambda: "\n".join("".join(w + rng.choice([" ", "  ", "\t", "\r"]) for w in rng.choices(words, k=rng.choice([0, 0, 1, 2, 7, 30])))
                             for _ in range(rng.choice([1, 4])))
    rows = [(rng.choice([None, *range(60)]), "web", None if rng.random() < 0.1 else text()) for _ in range(120)]  # ids come twice
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5).write.parquet(f"{tmp}/documents.parquet")
    by_id = Counter(i for i, _, _ in rows if i is not None)
    got = q_metrics.q_padded_ngrams(spark, tmp)
    want = {}
    for n in (1, 2, 3):
        grams = Counter()
        for i, _, t in rows:
            times = max(1, by_id[i - 1]) if i is not None and i % 4 == 2 else 1  # the binding's join with the document before
            for line in (t.split("\n") if t is not None else ()):
                toks = [w for w in line.replace("\t", " ").replace("\r", " ").split(" ") if w]
                for g, k in _plain_grams(["<s>"] * (n - 1) + toks + ["</s>"] * (n - 1), n).items():
                    grams[" ".join(g)] += k * times
        want[n] = (len(grams), grams.total(), sum(k for g, k in grams.items() if g.startswith("<s>")),
                   sum(k for g, k in grams.items() if g.endswith("</s>")))
    assert {r.ord: tuple(r)[1:] for r in got.collect()} == want
    # Lines are rows; grams were before, three for every token.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
    none = spark.createDataFrame([], "toks array<string>")
    make = lambda t, n: tm.ngram_array(tm.pad_sequence(t, n, "<s>", "</s>"), n)
    assert tm.gram_totals(none, "toks", (1, 2), make, "<s>", "</s>").count() == 0
    empty = spark.createDataFrame([([],), (None,)], "toks array<string>")
    assert [tuple(r) for r in tm.gram_totals(empty, "toks", (1, 2), make, "<s>", "</s>").collect()] == [(2, 1, 1, 1, 1)]


def test_grams_of_token_rows_are_those_of_arrays(spark):
    rows = [["a", "b", "a"], [], ["c"], ["<s>", "a"]]
    joined = pa.array([" ".join(r) for r in rows])
    df = spark.createDataFrame([(r,) for r in rows], "t array<string>")
    for left, right in (("<s>", "</s>"), (None, "</s>"), ("<s>", None), (None, None)):
        for n in (1, 2, 3):
            toks, at, _ = tm.ngram_array(tm.pad_sequence(tm.token_rows(joined), n, left, right), n)
            words = [w.decode() for w in toks.words.to_pylist()]
            got = [" ".join(words[c] for c in toks.codes[i:i + n]) for i in at]
            want = df.select(tm.ngram_array(tm.pad_sequence(F.col("t"), n, left, right), n)).collect()
            assert got == [g for r in want for g in r[0]]


def test_grams_of_one_digest_half_are_told_apart():
    keys = [tm._range_of(np.array([5, 0, 2], np.uint64), np.array(x, "<u2")) for x in ([1, 2, 3], [2, 1, 3])]
    assert [[x.tolist() for x in tm._halves(k)] for k in keys] == [[[5, 5, 7], [1, 2, 3]], [[5, 5, 7], [2, 1, 3]]]
    assert tm._distinct(keys) == 3
    texts = pa.array(["ab" * 5, "c", "", "d" * 40, "e"])
    assert [x.to_pylist() for x in tm._cut_at(texts, 12)] == [["ab" * 5, "c", ""], ["d" * 40, "e"]]
