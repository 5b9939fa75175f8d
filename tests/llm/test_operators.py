"""Each operator against a brute-force version on small rows: nulls, empty and long texts, ties, repeats, odd columns."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tessera.llm import (chat, decontaminate, minhash, packing, quality_gam, quality_rules, suffix_dedup,  # noqa: E402
                         token_counts, toxicity, url_filter)
from tessera.llm import common as C  # noqa: E402
from tessera.llm.tokenizing import Encoder  # noqa: E402

BYTE_BPE, WORD_BPE = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
# Extra columns whose names operators use inside.
SCHEMA = "doc_id bigint, text string, bucket string, kept int, carried int, n_words int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = ["alpha", "Béta", "gam", "delta.", "éps", "of", "the", "zeta", "theta,", "x1"]
    texts = [None, "", " \n ", "one", "one two", "日本語 テスト", "w " * 30, "a\x1cb  c\n\nd", "<|endoftext|> it's WE'RE  \n x"]
    base = [" ".join(rng.choices(words, k=rng.randint(5, 90))) + "." for _ in range(6)]
    for _ in range(50):
        text = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 3])):
            text[rng.randrange(len(text))] = rng.choice(words) + str(rng.randint(0, 5))
        texts.append(" ".join(text) + rng.choice(["", "\nAll rights reserved", "\nHome | News | Shop", "\nMore. And more."]))
    texts += [texts[12], texts[12], "long " * 20_000 + "end."]
    out = [(i, t) for i, t in enumerate(texts)] + [(None, texts[12]), (12, texts[12])]
    return [(i, t, "b", 1, 2, 3) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_words_and_hash(rows):
    texts = pa.array([t or "" for _, t, *_ in rows], pa.string())
    codes, bounds, words = C.split_words(texts)
    got = [[words[c] for c in codes[a:b]] for a, b in zip(bounds, bounds[1:])]
    assert got == [WORD.findall(t or "") for _, t, *_ in rows]


def test_quality_rules(docs, rows):
    def base(text):
        text = text or ""
        w = WORD.findall(text)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = text.split("\n")
        dup = sum(1 for k, line in enumerate(lines) if WORD.search(line) and line in lines[:k])
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), failed

    got = quality_rules.clean_lines(docs.drop("kept", "n_words"), with_text=True).collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for i, t, *_ in rows:
        want[i].append((base(t), t))
    for r in got:
        assert tuple(r)[1:7] in [b for b, _ in want[r.doc_id]]
        assert not (r.base_failed and r.kept)
        assert "rights reserved" not in r.clean_text and "Home |" not in r.clean_text
    assert any(r.kept and r.n_failed_lines for r in got)


def test_minhash_groups(docs, rows):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (
                len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id), r


def _bent(words, start, length, tag):
    return " ".join([*words[:start], *(f"{tag}x{k}" for k in range(length)), *words[start + length :]])


def test_minhash_links_repeated_outliers_of_a_large_family(spark):
    base = [f"w{k}" for k in range(104)]
    rng = random.Random(8)
    # The hubs come first in every key, and are similar to nobody.
    rows = [(i, _bent(base, rng.randrange(84), 21, f"h{i}")) for i in range(300)]
    rows += [(1000, " ".join(base))] + [(2000, _bent(base, 50, 8, "o"))] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = Counter((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect())
    assert got == Counter([*((i, i) for i in range(300)), (1000, 1000), *[(2000, 1000)] * 3])


def test_minhash_links_texts_under_one_id_by_their_texts(spark):
    one, two = ([f"{p}{k}" for k in range(60)] for p in "ab")
    rows = [(3, _bent(two, 0, 2, "x")), (5, " ".join(one)), (5, " ".join(two)), (5, _bent(one, 58, 2, "y")),
            (7, _bent(one, 0, 2, "z"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == Counter([(3, 3, True), (5, 5, True), (5, 3, False), (5, 5, True), (7, 5, False)])


@pytest.mark.parametrize("hot_docs", [4096, 1])
def test_suffix_dedup(docs, rows, hot_docs):
    first = {}
    for i, t, *_ in rows:
        data = (t or "").encode()
        for p in range(len(data) - 49):
            if i is not None:
                first[data[p : p + 50]] = min(i, first.get(data[p : p + 50], i))
    got = suffix_dedup.remove_repeats(docs, keep=("doc_id", "text", "carried"), hot_docs=hot_docs).collect()
    assert len(got) == len(rows)
    for r in got:
        i, data = r.carried.doc_id, (r.carried.text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 49):
            if i is not None and first[data[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(data), sum(gone), spans)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_suffix_dedup_takes_shared_ranks_in_passes(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefgh ", k=700)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, "x" * 9 + t[:400] + "y" * 60) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    written = Counter()

    def counted(df, label, outside=False, write=suffix_dedup.C.written):
        written[label] += 1
        return write(df, label, outside)

    monkeypatch.setattr(suffix_dedup.C, "written", counted)
    got = {r.carried.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs).collect()}
    ys = 60  # the run of y is in the first of its documents already
    assert got == {**{i: (0, 0) for i in range(30)}, 100: (400, 1), **{100 + i: (400 + ys, 1) for i in range(1, 30)}}
    # All ranks are shared: their contexts would take more bytes than the texts.
    assert written["ranks"] == 1 and written["windows"] > 1


def test_suffix_dedup_packed_integers():
    rng = np.random.default_rng(6)
    some = [np.sort(rng.integers(0, 1 << 40, 500)), np.array([-(2**63), 2**63 - 1, 0, -1]), np.empty(0, np.int64)]
    rows = [{"x": suffix_dedup._packed(x)} for x in some]
    assert suffix_dedup._unpacked(rows, "x").tolist() == np.concatenate(some).tolist()
    assert [suffix_dedup._count(r["x"]) for r in rows] == [500, 4, 0]
    assert suffix_dedup._unpacked([], "x").tolist() == []
    assert len(suffix_dedup._packed(np.arange(10_000) // 3)) < 4_000  # a step fits a byte, most of it empty


def test_suffix_dedup_long_text_in_stretches():
    rng = random.Random(3)
    text = "".join(rng.choices("abcd ", k=9000))
    whole = [(int(a + s), int(b + s)) for _, _, _, a, b, _, s in
             [(0, 0, 0, x, y, 0, z) for _, _, _, f, la, _, sh in suffix_dedup.runs_of(pa.array([text]))
              for x, y, z in zip(f, la, sh)]]
    cut = []
    for data, starts, lengths, number, offset in suffix_dedup.stretches(pa.array([text]), 1000):
        ranks = suffix_dedup.half_ranks(data)
        t, f, la, _ = suffix_dedup.window_runs(ranks, starts, lengths)
        cut += [(int(a + s), int(b + s)) for a, b, s in zip(f, la, (offset - starts)[t])]
    covered = {p for a, b in whole for p in range(a, b + 1)}
    assert covered == {p for a, b in cut for p in range(a, b + 1)} == set(range(len(text) - 49))


def test_decontamination(spark, docs):
    items = [(1, " ".join(f"q{k}" for k in range(30))), (2, " ".join(f"z{k}" for k in range(6))), (3, None), (4, ""),
             (None, "a b c d e f"), (9, " ".join(f"q{k}" for k in range(30)))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    q = items[0][1].split()
    bent = [w if k % 9 != 4 else "other" for k, w in enumerate(q)]
    texts = [(1, "so " + " ".join(q).upper() + "."), (2, "so, " + " ".join(bent) + " on"), (3, " ".join(q[:12])),
             (4, " ".join(q[:7])), (5, "x " + items[1][1]), (6, None), (7, "")]
    more = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(more, bench).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (5, 2)}
    assert decontaminate.leaks(docs, bench).count() == 0
    # Every row comes back, repeated ones and ones without a text too, under names that clash.
    rows = more.unionByName(more).withColumns({"leaks": F.lit(1), "sha": F.lit("s"), "kept": F.lit(2), "item_id": F.lit(3)})
    marked = decontaminate.with_leaks(rows, bench, keep=("doc_id", "leaks", "sha", "kept", "text")).collect()
    assert sorted((r.doc_id, len(r.leaks)) for r in marked) == sorted([(i, int(i in (1, 2, 3, 5))) for i, _ in texts] * 2)
    assert all((r.leaks_kept, r.sha, r.kept) == (1, "s", 2) for r in marked)
    assert decontaminate.leaks(rows, bench, keep=("item_id", "doc_id")).columns[:2] == ["item_id_kept", "doc_id"]
    assert decontaminate.with_leaks(rows.limit(0), bench).count() == 0
    assert decontaminate.with_leaks(rows, bench.limit(0)).filter("size(leaks) = 0").count() == 2 * len(texts)


def test_decontamination_gives_every_passage(spark):
    item = [f"q{k}" for k in range(30)]
    text = " ".join(["a", *item, "b c", *item[:15], "d", *item[12:], "e"])
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item))], "item_id bigint, text string")
    got = decontaminate.leaks(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), bench).collect()
    assert [(r.item_id, r.n_equal, r.word_start, r.word_end) for r in got] == [(7, 30, 1, 31), (7, 15, 33, 48), (7, 18, 49, 67)]


def test_decontamination_of_repeated_words(spark):
    """A long text of one word against an item of the same word: marked diagonals, one answer, soon."""
    bench = spark.createDataFrame([(1, "same " * 400)], "item_id bigint, text string")
    doc = spark.createDataFrame([(1, "same " * 20_000), (2, "other " * 50)], "doc_id bigint, text string")
    start = time.time()
    got = decontaminate.leaks(doc, bench).collect()
    assert time.time() - start < 40
    assert len(got) == 50 and {r.n_equal for r in got} == {400} and {r.doc_id for r in got} == {1}


def test_seed_recall():
    """How often a 20-word passage with words replaced at random shares a seed with the original."""
    rng = np.random.default_rng(1)
    recall = {}
    for share in (0.7, 0.8, 0.9):
        hit = n = 0
        while n < 2000:
            equal = rng.random(20) < share
            if equal.sum() < 10 or 4 * equal.sum() < 3 * len(equal):
                continue
            n += 1
            hit += any(all(equal[p + i] for i, c in enumerate(m) if c == "1")
                       for m in decontaminate.MASKS for p in range(len(equal) - len(m) + 1))
        recall[share] = hit / n
    assert recall[0.7] > 0.93 and recall[0.8] > 0.96 and recall[0.9] > 0.99, recall


def test_decontamination_takes_the_stretch_with_most_equal_words(spark):
    item = [f"q{k}" for k in range(40)]
    pattern = "=" * 9 + "x" * 8 + "=" * 6 + "x" + "=" * 5 + "x" * 11
    text = ["so", *(w if p == "=" else "other" for w, p in zip(item, pattern))]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, " ".join(text))], "doc_id bigint, text string")
    assert [tuple(r) for r in decontaminate.leaks(docs, bench).collect()] == [(1, 1, 11, 12, 18, 30)]
    rng = np.random.default_rng(4)
    for _ in range(500):
        item = np.arange(rng.integers(5, 45), dtype=np.uint64)
        equal = rng.random(len(item)) < rng.choice([0.2, 0.5, 0.7])
        if not equal.any() or 4 * equal.sum() >= 3 * len(item):
            continue
        got = decontaminate.overlap(np.where(equal, item, 99).astype(np.uint64), item, 0)
        want = min((-equal[a:b].sum(), a, b) for a in range(len(item)) for b in range(a + 1, len(item) + 1)
                   if 4 * equal[a:b].sum() >= 3 * (b - a) and equal[a] and equal[b - 1])
        assert got == (-want[0], want[1], want[2])


def test_packing_is_best_fit_decreasing_and_gapless(docs, rows):
    library = Tokenizer.from_file(BYTE_BPE)
    got = packing.pack(docs, BYTE_BPE, 64).collect()
    want, lengths = Counter(), []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        at, piece, step = 0, 0, len(ids) % 64 or 64
        while at < len(ids):
            part = ids[at : at + step]
            want[i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
            lengths.append(len(part))
            at, piece, step = at + step, piece + 1, 64
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0
        assert sum(n for _, n in parts) <= 64
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, k) for k, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit)[1]] -= n
        else:
            rooms.append(64 - n)
    assert sorted(64 - sum(n for _, n in p) for p in bins.values()) == sorted(rooms)


def test_encoder_equals_library(rows):
    rng = random.Random(5)
    texts = [t or "" for _, t, *_ in rows]
    texts += ["".join(rng.choice([" ", " ", "\n", "a", "b1", "é", "\t", "'s", "日", " "]) for _ in range(rng.randint(0, 14)))
              for _ in range(500)]
    ids, bounds = Encoder(BYTE_BPE).encode(pa.array(texts))
    library = Tokenizer.from_file(BYTE_BPE)
    for t, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids


def test_token_counts_at_every_prefix(docs, rows):
    library = Tokenizer.from_file(WORD_BPE)

    def count(text):
        return len(library.encode(text, add_special_tokens=False).ids)

    for text in [t for _, t, *_ in rows[:16] if t] + ["it's DON'T x'rs 's '", "é İ ß", "!!'s ,,, 12 ²"]:
        text = text[:150]
        assert token_counts.prefix_counts(text, WORD_BPE).tolist() == [count(text[:k]) for k in range(len(text) + 1)]
    by_id = defaultdict(list)
    for i, t, *_ in rows:
        by_id[i].append(t or "")
    for r in token_counts.token_counts(docs, WORD_BPE, budget=20).collect():
        text = by_id[r.doc_id][0]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), count(text), count(text) > 20)
        assert count(text[: r.fit_chars]) <= 20
        assert r.fit_chars == len(text) or count(text[: r.fit_chars + 1]) > 20


def test_token_counts_inside_long_words_of_any_script(spark):
    library = Tokenizer.from_file(WORD_BPE)

    def count(text):
        return len(library.encode(text, add_special_tokens=False).ids)

    rng = random.Random(9)
    alphabets = ["日本語テスト漢字、。", "абвгдеёжзиЙ", "αβγδΣσς", "“a’s”—…x1", "e\u0301\u0323o\u0308", "ก\u0e33ข\u0e49", "กิ한글각",
                 "\u1112\u1161\u11ab\u1100", "कि\u093cख", "İéB'ſK", "😀👍🏽"]
    texts = ["".join(rng.choices(a, k=300)) for a in alphabets]
    texts += ["".join(rng.choices("".join(alphabets), k=400)), "日" * 130 + "<|endoftext|>本<|endof" + "語'll" * 40,
              "x<|startoftext|><|endoftext|>'re\u0301" * 12]
    assert min(map(len, texts)) > 256
    for text in texts:
        assert token_counts.prefix_counts(text, WORD_BPE).tolist() == [count(text[:k]) for k in range(len(text) + 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in token_counts.token_counts(docs, WORD_BPE, budget=40).collect():
        text = texts[r.doc_id]
        assert (r.n_tokens, r.over_limit) == (count(text), True)
        assert r.fit_chars == max(k for k in range(len(text) + 1) if count(text[:k]) <= 40)


def test_chat_round_trip(spark):
    rng = random.Random(2)
    parts = ["### ", "</turn>", "\\", "user: ", "é", "\n", "a b", "</tur", "#", ":"]
    turns = [(c, t, rng.choice(["user", "assistant", "a: b"]) if t else "system",
              None if rng.random() < 0.1 else "".join(rng.choices(parts, k=rng.randint(0, 30))))
             for c in (1, 2, None, -7) for t in range(rng.randint(1, 14))] + [(5, 10**12, "user", "x"), (5, 3, None, "y")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    want = defaultdict(list)
    for c, t, role, text in sorted(turns, key=lambda r: r[1]):
        want[c].append((role or "", text or ""))
    for rules in (chat.WindowRules(), chat.WindowRules(budget=60, history_tokens=40, block_turns=4)):
        windows = chat.format_windows(df, BYTE_BPE, rules).cache()
        assert all(w.n_tokens <= rules.budget or w.n_new == 1 for w in windows.collect())
        got = {r.conv_id: r for r in chat.read_back(windows).collect()}
        assert set(got) == set(want)
        for c, turns_ in want.items():
            loss = "".join(t for r, t in turns_ if r == "assistant")
            assert got[c].n_turns == len(turns_)
            assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns_).encode()).hexdigest()
            assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_history_gives_way_to_the_first_new_turn(spark):
    rng = random.Random(6)
    turns = [(c, t, ("user", "assistant")[t % 2] if t else "system", "w " * (6 if t == 0 else rng.choice([1, 9, 25, 33, 70])))
             for c in range(6) for t in range(40)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    library = Tokenizer.from_file(BYTE_BPE)

    def count(role, text):
        return len(library.encode(chat.format_turn(role, text)[0], add_special_tokens=False).ids)

    for rules in (chat.WindowRules(budget=60, history_tokens=40),
                  chat.WindowRules(budget=60, history_tokens=40, history_turns=4, block_turns=8)):
        windows = chat.format_windows(df, BYTE_BPE, rules).collect()
        assert sum(w.n_new for w in windows) == len(turns)
        over = 0
        for w in windows:
            parsed = chat.parse_turns(w.formatted)
            if w.n_tokens > rules.budget:
                assert w.n_new == 1 and len(parsed) <= 2 and sum(count(*p) for p in parsed) > rules.budget
                over += 1
        assert 0 < over < len(windows)
        assert any(w.n_repeated > 1 for w in windows)


def _plain_windows(turns, rules, count):
    """(tokens, repeated, new, formatted, loss spans) of one conversation's windows; turns are (role, text) in order."""
    system = turns[0] if turns[0][0] == "system" else None
    out, i = [], 0
    while i < len(turns):
        start = [system] if system and i else []
        history = []
        for t in reversed(turns[max(i - rules.history_turns, 1 if system else 0) : i]):
            if sum(count(*h) for h in [t, *history]) > rules.history_tokens:
                break
            history.insert(0, t)
        while history and sum(count(*h) for h in [*start, *history, turns[i]]) > rules.budget:
            history.pop(0)
        k = i + 1
        while k < len(turns) and sum(count(*t) for t in [*start, *history, *turns[i : k + 1]]) <= rules.budget:
            k += 1
        repeated, new = [*start, *history], turns[i:k]
        text, spans = "", []
        for j, (role, t) in enumerate(repeated + new):
            piece, head = chat.format_turn(role, t)
            if j >= len(repeated) and role == "assistant":
                spans.append((len(text) + head, len(text) + len(piece) - len("</turn>\n")))
            text += piece
        out.append((sum(count(*t) for t in repeated + new), len(repeated), len(new), text, spans))
        i = k
    return out


@pytest.mark.parametrize("budget", [1_000_000, 70])
def test_chat_windows_equal_the_plain_version(spark, budget):
    rng = random.Random(12)
    library = Tokenizer.from_file(BYTE_BPE)

    def count(role, text):
        return len(library.encode(chat.format_turn(role, text)[0], add_special_tokens=False).ids)

    numbers = {1: range(1020, 1030), 2: [1014, 1030], 3: [rng.randrange(10**12) for _ in range(60)], 4: range(300), 5: [7]}
    turns = []
    for c, at in numbers.items():
        for k, t in enumerate(sorted(set(at))):
            role = "system" if k == 0 and c % 2 else ("user", "assistant")[k % 2]
            turns.append((c, t, role, "w " * rng.choice([1, 5, 20, 40]) + "\\### x" * (k % 3 == 0), 9, "z"))
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string, block int, kind string").repartition(4)
    rules = chat.WindowRules(budget=budget, history_tokens=60)
    got = defaultdict(list)
    windows = chat.format_windows(df, BYTE_BPE, rules)
    for w in sorted(windows.collect(), key=lambda w: (w.conv_id, w.block, w.window)):
        got[w.conv_id].append((w.n_tokens, w.n_repeated, w.n_new, w.formatted, [tuple(s) for s in w.loss_spans]))
    for c in numbers:
        assert got[c] == _plain_windows([r[2:4] for r in turns if r[0] == c], rules, count)
    chars = {r.conv_id: r.formatted_chars for r in chat.read_back(windows).collect()}
    assert chars == {c: sum(len(w[3]) for w in ws) for c, ws in got.items()}
    # In blocks the history still crosses their edges, whatever the numbers, and every turn is new once.
    few = chat.WindowRules(budget=budget, history_tokens=60, block_turns=8)
    blocks = chat.format_windows(df, BYTE_BPE, few).collect()
    assert sum(w.n_new for w in blocks) == len(turns)
    by_conv = defaultdict(list)
    for w in sorted(blocks, key=lambda w: (w.conv_id, w.block, w.window)):
        by_conv[w.conv_id].append(w)
    for c, ws in by_conv.items():
        texts = [r[2:4] for r in turns if r[0] == c]
        seen = 0
        for w in ws:
            parsed = chat.parse_turns(w.formatted)
            assert parsed[w.n_repeated :] == texts[seen : seen + w.n_new]
            history = parsed[c % 2 if seen else 0 : w.n_repeated]
            assert history == texts[seen - len(history) : seen]
            if seen and budget > 100 and count(*texts[seen - 1]) <= 60 and (seen > 1 or c % 2 == 0):
                assert history
            seen += w.n_new


@pytest.mark.parametrize("index_bytes", [1 << 20, 0])
def test_url_rules(spark, index_bytes):
    rules = [url_filter.parse_rule(*r) for r in (("block", "net/"), ("allow", "example.net/en/"), ("block", "a.b/c+d"))]
    urls = [None, "", "x", "http://NET/", "https://m.example.net/en/1?q#f", "http://example.net/enx", "http://net",
            "ftp://q.a.b/c+d/e", "http://a.b/cd", "http://xnet/", "a://b://net/"]
    pages = spark.createDataFrame([(i, u, "h", "t") for i, u in enumerate(urls)] + [(3, urls[3], "h", "t")],
                                  "page_id bigint, url string, host string, tokens string")
    rows = url_filter.url_verdicts(pages, rules, keep=("page_id", "host"), index_bytes=index_bytes)
    assert rows.columns == ["page_id", "host_kept", "host", "path", "rule", "verdict"]
    rows = rows.collect()
    assert len(rows) == len(urls) + 1 and all(r.host_kept == "h" for r in rows)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("net", "/", "net/", "block")
    assert got[4] == ("m.example.net", "/en/1", "example.net/en/", "allow")
    assert got[5][2:] == ("net/", "block") and got[6] == ("net", "", None, "allow")
    assert got[7][2:] == ("a.b/c+d", "block") and got[8][2:] == got[9][2:] == (None, "allow")
    assert got[10][:2] == ("b:", "//net/")
    assert url_filter.url_verdicts(pages.limit(0), rules, index_bytes=index_bytes).count() == 0
    assert url_filter.url_verdicts(pages, []).filter("verdict = 'allow'").count() == len(urls) + 1


@pytest.mark.parametrize("index_bytes", [1 << 30, 0])
def test_ten_thousand_url_rules(spark, index_bytes):
    rng = random.Random(5)
    names = [f"n{k}" for k in range(400)]
    made = {(rng.choice(["block", "allow"]), ".".join(rng.sample(names, rng.randint(1, 3))) + "/" + "/".join(
        rng.sample(names, rng.randint(0, 2))) + rng.choice(["", "/"])) for _ in range(10_000)}
    rules = [url_filter.parse_rule(*r) for r in sorted(made)]
    urls = ["http://" + ".".join(rng.choices(names, k=rng.randint(1, 4))) + "/" + "/".join(
        rng.choices(names, k=rng.randint(0, 3))) + rng.choice(["", "/x"]) for _ in range(2000)]
    urls += [f"https://{rng.choice(rules).name}" for _ in range(500)]

    def want(url):
        host, slash, path = url.split("://")[1].partition("/")
        path = slash + path
        labels = host.split(".")
        fits = [r for k in range(len(labels)) for r in by_host.get(".".join(labels[k:]), ()) if path.startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.name), len(r.host), r.verdict == "block", r.name), default=None)
        return (best.name, best.verdict) if best else (None, "allow")

    by_host = defaultdict(list)
    for r in rules:
        by_host[r.host].append(r)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_verdicts(pages, rules, index_bytes=index_bytes).collect()}
    assert got == {i: want(u) for i, u in enumerate(urls)}


def test_classifiers_learn_and_score_every_row(spark, docs, rows):
    rng = random.Random(1)
    made = []
    for i in range(400):
        bad = i % 5 == 0
        text = [rng.choice(["sun", "rain", "tree", "house", "walk"]) for _ in range(40)]
        if bad:
            for _ in range(4):
                text[rng.randrange(40)] = rng.choice(["vile", "filth", "v1le"])
        made.append((1000 + i, " ".join(text) + ".", int(bad)))
    d = spark.createDataFrame([r[:2] for r in made], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1 - y, y) for i, _, y in made] + [(None, 1, 0), (5, None, None)],
                                   "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(d, labels)
    truth = {i: y for i, _, y in made}
    held = [(r.score, truth[r.doc_id]) for r in toxicity.toxicity_scores(d, model).collect()
            if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum((s >= 0.7) == bool(y) for s, y in held) >= 0.95 * len(held)
    gam = quality_gam.fit(d, labels)
    for scores in (toxicity.toxicity_scores(docs, model), quality_gam.quality_scores(docs, gam)):
        got = scores.collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    empty = labels.limit(0)
    assert toxicity.toxicity_scores(docs, toxicity.fit(d, empty)).filter("score <> 0").count() == 0
    assert quality_gam.quality_scores(docs, quality_gam.fit(d, empty)).filter("score <> 0").count() == 0


def test_empty_tables(docs, spark):
    none = docs.limit(0)
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert quality_rules.clean_lines(none.drop("kept", "n_words")).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert packing.pack(none, BYTE_BPE).count() == 0
    assert token_counts.token_counts(none, WORD_BPE).count() == 0
    assert decontaminate.leaks(docs, bench).count() == 0
    assert chat.format_windows(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"),
                               BYTE_BPE).count() == 0


def test_minhash_family_of_unlinked_outliers(spark):
    """Edited copies of one text that are similar to nobody, and two that are similar to each other."""
    base = [f"w{k}" for k in range(104)]
    rng = random.Random(9)
    rows = [(i, _bent(base, rng.randrange(84), 20, f"h{i}")) for i in range(3000)]
    rows += [(5000, _bent(base, 40, 20, "z")), (5001, _bent(base, 40, 20, "z") + " end")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i for i, _ in rows[:-1]} | {5001: 5000}


def test_minhash_pairs_by_size_lose_none(spark):
    rng = random.Random(3)
    rows = [(k % 3, i, n, int(n * rng.uniform(0.75, 1)), i % 5, b"x") for i, (k, n) in enumerate(
        (rng.randrange(3), int(10 ** rng.uniform(0, 3.5))) for _ in range(600))]
    dense = spark.createDataFrame(rows, "k long, id long, n long, common long, component long, halves binary")
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[4] != b[4]
            and 100 * min(a[2], b[2]) >= 75 * max(a[2], b[2]) and 175 * min(a[3], b[3]) >= 75 * (a[2] + b[2])}
    got = [(r.id, r.b) for r in minhash.pairs_by_size(dense, 75).collect()]
    assert sorted(got) == sorted(want)
