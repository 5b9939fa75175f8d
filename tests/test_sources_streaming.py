"""Readers/writers and the streaming result counter on files written here."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.results import per_model
from tessera.sources import files as S
from tessera.sources.versions import Conflict, VersionedFolder
from tessera.streaming.results_stream import latest_counts, running_outcome_counts


def test_jsonl_roundtrip_and_suffix_union(spark, tmp):
    for model in ("a", "b"):
        with open(os.path.join(tmp, f"{model}_result.jsonl"), "w") as f:
            for i, r in enumerate(["PASS", "CORRECT", "TE"]):
                f.write(json.dumps({"id": i, "revision": "cli_1", "result": r}) + "\n")
    with open(os.path.join(tmp, "ignore.txt"), "w") as f:
        f.write("x\n")
    df = S.read_suffix_union(spark, tmp, "_result.jsonl", S.RESULT_SCHEMA)
    assert sorted({r["name"] for r in df.collect()}) == ["a", "b"]
    assert df.count() == 6


def test_json_documents_with_surrogate_and_broken_file(spark, tmp):
    good = [{"focal_src": "a\ud800b", "focal_tgt": "x", "test_src": "t", "test_tgt": "u"},
            {"focal_src": "only"}]
    with open(os.path.join(tmp, "a.json"), "w") as f:
        f.write(json.dumps(good))
    with open(os.path.join(tmp, "b.json"), "w") as f:
        f.write("[{broken")
    df = S.read_json_documents(spark, tmp, S.EVOLUTION_SCHEMA)
    rows = df.orderBy("file_path", "focal_src").collect()
    ok = [r for r in rows if r["_corrupt_record"] is None]
    assert {r["focal_src"] for r in ok} == {"ab", "only"}
    assert [r["focal_tgt"] for r in ok if r["focal_src"] == "only"] == [None]
    assert sum(r["_corrupt_record"] is not None for r in rows) == 1


def test_record_tree(spark, tmp):
    for repo, n in (("r1", 2), ("r2", 3)):
        d = os.path.join(tmp, "root", "group", repo)
        os.makedirs(d)
        for i in range(n):
            with open(os.path.join(d, f"{i}.json"), "w") as f:
                json.dump({"src_fm_fc_ms_ff": f"s{i}", "target": "t"}, f, indent=4)
        with open(os.path.join(d, "note.md"), "w") as f:
            f.write("skip")
    df = S.read_record_tree(spark, os.path.join(tmp, "root"))
    got = {r["repo"]: r["c"] for r in df.groupBy("repo").agg(F.count("*").alias("c")).collect()}
    assert got == {"r1": 2, "r2": 3}


def test_tsv_and_concatenated_json(spark, tmp):
    df = spark.createDataFrame([(0, "a b"), (1, "c\td")], "idx long, text string")
    S.write_tsv(df, "idx", "text", os.path.join(tmp, "tsv"), compat=True)
    back = {r["idx"]: r["text"] for r in S.read_tsv(spark, os.path.join(tmp, "tsv")).collect()}
    assert back == {0: "a b", 1: "c d"}
    objs = [{"label": "x", "predict": "y"}, {"label": "p", "predict": "q"}]
    with open(os.path.join(tmp, "pred.jsonl"), "w") as f:
        f.write("\n".join(json.dumps(o, indent=4) for o in objs) + "\n")
    c = S.read_concatenated_json(spark, os.path.join(tmp, "pred.jsonl"), "label string, predict string")
    assert sorted((r["label"], r["predict"]) for r in c.collect()) == [("p", "q"), ("x", "y")]


def test_manifest_upsert(spark):
    old = spark.createDataFrame([("a", ["1"]), ("b", ["2"])], "repo string, paths array<string>")
    new = spark.createDataFrame([("b", ["3"]), ("c", ["4"])], "repo string, paths array<string>")
    got = {r["repo"]: r["paths"] for r in S.upsert_manifest(old, new).collect()}
    assert got == {"a": ["1"], "b": ["3"], "c": ["4"]}


def test_streaming_counts_equal_batch_and_ignore_replays(spark, tmp):
    src = os.path.join(tmp, "results")
    os.makedirs(src)
    rows = [{"id": i, "revision": f"lang_{i % 3}", "result": ["PASS", "CORRECT", "SE", "TE"][i % 4]}
            for i in range(40)]
    with open(os.path.join(src, "m1_result.jsonl"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows[:25]) + "\n")
    out, ckpt = os.path.join(tmp, "out"), os.path.join(tmp, "ckpt")
    q = running_outcome_counts(spark, src, ckpt, out)
    q.awaitTermination()
    # second drop: the rest plus a replay of already-counted rows
    with open(os.path.join(src, "m1_b_result.jsonl"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows[25:]) + "\n")
    with open(os.path.join(src, "m1_c_result.jsonl"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows[:10]) + "\n")
    q = running_outcome_counts(spark, src, ckpt, out)
    q.awaitTermination()
    got = latest_counts(spark, out).collect()
    # the replay files carry other model names, so compare per model with the batch answer
    batch = S.read_suffix_union(spark, src, "_result.jsonl", S.RESULT_SCHEMA) \
        .withColumnRenamed("name", "model").dropDuplicates(["model", "id", "revision"])
    want = {r["model"]: r.asDict() for r in per_model(batch).collect()}
    assert {r["model"]: r.asDict() for r in got} == want


def test_streaming_state_stays_level(spark, tmp):
    """Batches a minute apart: keys older than the limit leave the state, replays inside it do not count."""
    src, out, ckpt = (os.path.join(tmp, x) for x in ("results", "out", "ckpt"))
    os.makedirs(src)
    n_batches, per_batch, clock = 8, 30, 1_700_000_000

    def drop(name, ids, at):
        path = os.path.join(src, name)
        with open(path, "w") as f:
            f.write("\n".join(json.dumps({"id": i, "revision": "cli_1", "result": "PASS"}) for i in ids) + "\n")
        os.utime(path, (at, at))

    held = []
    for k in range(n_batches):
        drop(f"m_{k}_result.jsonl", range(k * per_batch, (k + 1) * per_batch), clock + 60 * k)
        q = running_outcome_counts(spark, src, os.path.join(ckpt, "a"), out, remember="150 seconds",
                                   arrived=F.col("_metadata.file_modification_time"))
        q.awaitTermination()
        held.append(max(o["numRowsTotal"] for o in q.lastProgress["stateOperators"] if "edup" in o["operatorName"]))
    assert max(held) <= 5 * per_batch and held[-1] <= held[4]
    assert {r["model"]: r["pass"] for r in latest_counts(spark, out).collect()} == {
        f"m_{k}": per_batch for k in range(n_batches)}
    assert len(os.listdir(os.path.join(out, "data"))) == 3


def test_streaming_ignores_replays_inside_the_limit(spark, tmp):
    src, out, ckpt = (os.path.join(tmp, x) for x in ("results", "out", "ckpt"))
    # (arrival, ids, counted so far): replays within the hour change nothing, one a day later counts again.
    drops = [(0, (1, 2), 2), (60, (1, 2), 2), (120, (2,), 2), (100_000, (3,), 3), (100_060, (1, 2), 5)]
    for k, (at, ids, total) in enumerate(drops):
        folder = os.path.join(src, str(k))
        os.makedirs(folder)
        path = os.path.join(folder, "m_result.jsonl")
        with open(path, "w") as f:
            f.write("\n".join(json.dumps({"id": i, "revision": "r", "result": "TE"}) for i in ids) + "\n")
        os.utime(path, (1_700_000_000 + at,) * 2)
        running_outcome_counts(spark, os.path.join(src, "*"), ckpt, out, remember="1 hour",
                               arrived=F.col("_metadata.file_modification_time")).awaitTermination()
        assert [(r["model"], r["te"]) for r in latest_counts(spark, out).collect()] == [("m", total)]


def test_write_splits_loses_no_row(spark, tmp):
    lines = [json.dumps({"source": f"s{i}", "target": t, "split": s}) for i, (t, s) in enumerate(
        [("ok", "train"), ("ok", "eval"), ("bad", "train"), (None, "train"), ("ok", None), ("ok", "test")])]
    path = os.path.join(tmp, "in.jsonl")
    with open(path, "w") as f:
        f.write("\n".join([*lines[:3], "{not json", *lines[3:]]) + "\n")
    schema = "source string, target string, split string"
    rows = S.read_jsonl(spark, path, schema, corrupt="broken")
    assert S.read_jsonl(spark, path, schema).count() == 7
    out = os.path.join(tmp, "out")
    counts = S.write_splits(rows, out, valid="target = 'ok'", corrupt="broken")
    assert (counts.rows, counts.good, counts.rejected) == (7, 3, 4)
    good = S.read_routed(spark, out, "source string, target string").collect()
    assert {(r["source"], r["split"]) for r in good} == {("s0", "train"), ("s1", "eval"), ("s5", "test")}
    bad = S.read_routed(spark, out, "source string, target string, broken string", "rejected").collect()
    assert {r["source"] for r in bad} == {"s2", "s3", "s4", None}
    assert [r["broken"] for r in bad if r["source"] is None] == ["{not json"]
    assert S.write_splits(rows.filter("split IS NOT NULL"), os.path.join(tmp, "all")).rejected == 0
    with pytest.raises(ValueError):
        S.write_splits(rows.withColumn("verdict", F.lit(1)), out)


def test_leaf_folders_and_all_their_files(spark, tmp):
    root = os.path.join(tmp, "tree of files")
    tree = {"a/x": ["1.json", "2.json", "note.md"], "a": ["top.json"], "b/c/d": ["3.json", "no ext"], "b/c": [],
            "e": ["readme.txt"], "a/y z": ["4.json"]}
    for folder, names in tree.items():
        os.makedirs(os.path.join(root, folder), exist_ok=True)
        for n in names:
            with open(os.path.join(root, folder, n), "w") as f:
                json.dump({"src_fm_fc_ms_ff": n, "target": "t"}, f, indent=4)
    leaves = S.leaf_folders(spark, root).collect()
    walked = {d.split("/")[-1]: len(f) for d, below, f in os.walk(root) if not below}
    assert {r["repo"].replace("%20", " "): r["files"] for r in leaves} == walked
    assert sum(r["files"] for r in leaves) == 7
    got = sorted(r["src_fm_fc_ms_ff"] for r in S.read_record_tree(spark, root).collect())
    assert got == ["1.json", "2.json", "3.json", "4.json"]
    assert S.read_record_tree(spark, root, leaves_only=False).count() == 5


def test_one_large_file_of_records_is_read_by_many_tasks(spark, tmp):
    rng = random.Random(3)
    objs = [{"label": "x}\n{" * rng.randint(0, 30), "predict": None if k % 7 == 0 else f"y{k}", "n": {"a": [k, {}]}}
            for k in range(400)]
    objs[5] = objs[6] = objs[-1] = {}
    schema = "label string, predict string, n struct<a:array<string>>"
    for name, end in (("a", "\n"), ("b", "")):
        path = os.path.join(tmp, f"{name}.jsonl")
        with open(path, "w") as f:
            f.write("\n".join(json.dumps(o, indent=4) for o in objs) + end)
        spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        try:
            df = S.read_concatenated_json(spark, path, schema)
            assert df.rdd.getNumPartitions() > 4
            got = sorted((r["label"] or "", r["predict"] or "", r["n"]["a"][0] if r["n"] else "") for r in df.collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == sorted((o.get("label", ""), o.get("predict") or "", str(o["n"]["a"][0]) if o else "") for o in objs)


def test_manifest_is_whole_at_any_time(spark, tmp):
    root = os.path.join(tmp, "manifest")
    schema = "repo string, paths array<string>"
    assert S.read_manifest(spark, root) is None
    assert S.write_manifest(spark, root, spark.createDataFrame([("a", ["1"]), ("b", ["2"])], schema)) == 1
    before = S.read_manifest(spark, root)
    # A write that fails half way leaves the manifest as it was.
    broken = spark.range(4).select(F.lit("c").alias("repo"), F.array(F.when(
        F.col("id") < 3, F.lit("9")).otherwise(F.raise_error(F.lit("lost")).cast("string"))).alias("paths"))
    with pytest.raises(Exception, match="lost"):
        S.write_manifest(spark, root, broken)
    assert {r["repo"] for r in S.read_manifest(spark, root).collect()} == {"a", "b"}
    # The next write starts from it; a reader of the old version still has it whole.
    assert S.write_manifest(spark, root, spark.createDataFrame([("b", None), ("c", ["4"])], schema)) == 2
    assert {r["repo"]: r["paths"] for r in before.collect()} == {"a": ["1"], "b": ["2"]}
    assert {r["repo"]: r["paths"] for r in S.read_manifest(spark, root).collect()} == {"a": ["1"], "b": None, "c": ["4"]}
    for _ in range(3):
        S.write_manifest(spark, root, spark.createDataFrame([("d", ["5"])], schema))
    assert len(os.listdir(os.path.join(root, "data"))) <= 3


def test_two_writers_of_one_version(spark, tmp):
    folder = VersionedFolder(spark, os.path.join(tmp, "v"))
    one, two = (spark.createDataFrame([(x,)], "x string") for x in "ab")
    version = folder.next_version()
    folder.publish(one, version)
    with pytest.raises(Conflict):
        folder.publish(two, version)
    assert [r["x"] for r in folder.read().collect()] == ["a"]
    # A pointer without its line end: its writer is at work, later it is dead.
    pending = os.path.join(tmp, "v", "pointers", f"{2:012d}")
    with open(pending, "w") as f:
        f.write("half")
    assert folder.current()[0] == 1
    with pytest.raises(Conflict):
        folder.next_version()
    os.utime(pending, (1, 1))
    assert folder.next_version() == 3
    folder.publish(two, 3)
    folder.vacuum(1)
    assert [r["x"] for r in folder.read().collect()] == ["b"] and len(os.listdir(os.path.join(tmp, "v", "data"))) == 1


def test_splits_by_file_and_appends(spark, tmp):
    train = spark.createDataFrame([("s", "t")], S.PAIR_SCHEMA)
    for _ in range(2):
        S.append_jsonl(train, os.path.join(tmp, "train.jsonl"))
    S.append_jsonl(train, os.path.join(tmp, "test.jsonl"))
    files = {"train": "train.jsonl", "eval": "none.jsonl", "test": "test.jsonl", "more": None}
    got = S.read_splits(spark, tmp, files, S.PAIR_SCHEMA).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 2, "test": 1}
    with pytest.raises(FileNotFoundError):
        S.read_splits(spark, tmp, {"eval": "none.jsonl"}, S.PAIR_SCHEMA)


def test_legacy_charset_and_tsv_without_tab(spark, tmp):
    for name, text in (("A.java", "// ğüşİ\r\nclass A {}\n"), ("b.txt", "x")):
        with open(os.path.join(tmp, name), "wb") as f:
            f.write(text.encode("windows-1254"))
    got = S.read_charset_text(spark, tmp).collect()
    assert [r["text"] for r in got] == ["// ğüşİ\r\nclass A {}\n"]
    with open(os.path.join(tmp, "b.tsv"), "w") as f:
        f.write("1\ta\tb\nno tab\n3\t\n")
    got = {(r["idx"], r["text"]) for r in S.read_tsv(spark, os.path.join(tmp, "b.tsv")).collect()}
    assert got == {(1, "a"), (None, None), (3, "")}


def _in_name_order(folder):
    out = []
    for name in sorted(os.listdir(folder)):
        if name.startswith("part-"):
            with open(os.path.join(folder, name)) as f:
                out += [json.loads(line) for line in f]
    return out


def test_ordered_sinks(spark, tmp):
    rng = random.Random(4)
    rows = [(f"C{k % 37:02d}", rng.randint(0, 10**6), f"m{k}") for k in range(1500)]
    members = spark.createDataFrame(rows, "class_name string, start int, name string").repartition(7)
    info, flat, edges = (os.path.join(tmp, x) for x in ("info", "flat", "edges"))
    S.write_class_info(members, info)
    got = _in_name_order(info)
    assert [r["class_name"] for r in got] == sorted({r[0] for r in rows})
    assert all(r["methods"] == sorted(r["methods"], key=lambda m: (m["start"], m["name"])) for r in got)
    assert sum(len(r["methods"]) for r in got) == len(rows) and set(got[0]["methods"][0]) == {"start", "name"}
    S.write_method_list(members, flat)
    assert [(r["class_name"], r["start"]) for r in _in_name_order(flat)] == sorted(r[:2] for r in rows)
    # One hot class: its methods still come by ranges.
    hot = spark.range(5000).select(F.lit("Hot").alias("item"), (F.col("id") * 7919 % 5000).alias("pos"))
    S.write_ordered(hot.repartition(5), edges, ["item", "pos"])
    assert [r["pos"] for r in _in_name_order(edges)] == list(range(5000))


def test_returned_sequences(spark):
    from tessera.operators import predictions as pr
    from tessera.operators.projects import leaf_dir
    df = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, []), (4, None)], "id int, r array<string>")
    one, items = pr.returned("r")
    got = {r["id"]: (r["one"], r["items"], r["top"]) for r in df.select(
        "id", one.alias("one"), items.alias("items"), pr.top1("r").alias("top")).collect()}
    assert got == {1: ("a", None, "a"), 2: (None, ["a", "b"], "a"), 3: (None, [], None), 4: (None, None, None)}
    paths = spark.createDataFrame([("a/b/c",), ("c",), ("",), (None,)], "p string")
    assert [r[0] for r in paths.select(leaf_dir(F.col("p"))).collect()] == ["b", None, None, None]
