"""corpus_pipeline.run on small written tables against a plain-Python version of all five stages."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from tessera.llm import decontaminate, quality_rules, stages  # noqa: E402

# Columns whose names operators use inside.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept int, sha string, row int, leaks int"
WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


# -- stage 1


def line_fails(line):
    """The line rules one by one; a line without a word passes."""
    w = words(line)
    if not w:
        return False
    n = len(w)
    exclaims, separators = len(regex.findall("[!?]+", line)), len(regex.findall("[|»›>]", line))
    symbols, capitals, small = (len(regex.findall(p, line)) for p in (r"[#*$%&|<>]", r"\p{Lu}", r"\p{Ll}"))
    stutters = sum(a == b for a, b in zip(w, w[1:]))
    return (not regex.search("[.!?:;…。！？]+[\"'”’»)\\]]*(?:[\\t\\n\\f\\r ]|$)", line)
            or (exclaims >= 3 and 100 * exclaims >= 30 * n)
            or (separators >= 2 and 100 * separators >= 10 * n)
            or any(b in line.lower() for b in quality_rules.BOILERPLATE)
            or (symbols >= 2 and 100 * symbols >= 10 * len(line))
            or (capitals >= 10 and 100 * capitals >= 80 * (capitals + small))
            or (stutters >= 3 and 100 * stutters >= 30 * n))


def verdict(text):
    """(base_failed, failing lines, lost words, kept, clean text) of a text."""
    text = text or ""
    w = words(text)
    found = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {k for i in range(len(w) - 7) if found[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = text.split("\n")
    bad = [x for x in lines if line_fails(x)]
    lost = sum(len(words(x)) for x in bad)
    base = len(w) < 20 or 100 * len(cover) > 30 * len(w)
    return base, len(bad), lost, not base and 100 * lost <= 50 * len(w), "\n".join(x for x in lines if not line_fails(x))


def plain_quality(rows):
    out = []
    for r in rows:
        *_, kept, clean = verdict(r["text"])
        if kept:
            out.append({**r, "text": clean, "n_chars": len(clean)})
    return out


# -- stage 2


def shingles(text):
    w = words(regex.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}


def plain_groups(rows):
    """The row numbers of each near-duplicate group; rows without an id or a word are in none."""
    sets = [shingles(r["text"]) if r["doc_id"] is not None else set() for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    groups = defaultdict(list)
    for k, s in enumerate(sets):
        if s:
            groups[find(k)].append(k)
    return list(groups.values())


def holds_one_of_each(rows, kept):
    """Of each group one row with its smallest id is kept, and all rows that are in none."""
    key = lambda r: tuple(sorted((k, str(v)) for k, v in r.items()))
    left = Counter(map(key, kept))
    groups = plain_groups(rows)
    alone = Counter(key(r) for k, r in enumerate(rows) if k not in {x for g in groups for x in g})
    assert not alone - left
    left -= alone
    for g in groups:
        least = min(rows[k]["doc_id"] for k in g)
        standing = {key(rows[k]) for k in g if rows[k]["doc_id"] == least}
        hits = [s for s in standing if left[s]]
        assert len(hits) == 1 and left[hits[0]] == 1
        del left[hits[0]]
    assert not +left


# -- stage 3


def plain_repeats(rows):
    first = {}
    for r in rows:
        data = (r["text"] or "").encode()
        for p in range(len(data) - 49):
            if r["doc_id"] is not None:
                first[data[p : p + 50]] = min(r["doc_id"], first.get(data[p : p + 50], r["doc_id"]))
    out = []
    for r in rows:
        data = (r["text"] or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 49):
            if r["doc_id"] is not None and first[data[p : p + 50]] < r["doc_id"]:
                gone[p : p + 50] = b"\1" * 50
        text = bytes(b for b, g in zip(data, gone) if not g).decode("utf-8", "ignore") if any(gone) else r["text"]
        if not any(gone) or regex.search(r"[^ \t\n\x0b\f\r]", text):
            out.append({**r, "text": text, "n_chars": None if text is None else len(text)})
    return out


# -- stage 4


def plain_words(text):
    return [x for x in (w.lower().strip(decontaminate.EDGES) for w in words(text)) if x]


def shares_a_seed(equal, n):
    masks = decontaminate.MASKS if n >= 10 else [m for m in decontaminate.MASKS if len(m) <= n] + ["1" * n]
    return any(all(equal[p + i] for i, c in enumerate(m) if c == "1") for m in masks for p in range(len(equal) - len(m) + 1))


def is_leak(text, item):
    if len(item) < 5:
        return False
    need = min(10, -(-3 * len(item) // 5))
    for diagonal in range(-len(item) + 1, len(text)):
        low, high = max(0, -diagonal), min(len(item), len(text) - diagonal)
        equal = [text[diagonal + k] == item[k] for k in range(low, high)]
        if sum(equal) < 5 or not shares_a_seed(equal, len(item)):
            continue
        best = sum(equal) if 4 * sum(equal) >= 3 * len(item) else max(
            (sum(equal[a:b]) for a in range(len(equal)) for b in range(a + 1, len(equal) + 1)
             if 4 * sum(equal[a:b]) >= 3 * (b - a)), default=0)
        if best >= need:
            return True
    return False


def plain_decontaminated(rows, items):
    items = [plain_words(t) for i, t in items if i is not None and t]
    return [r for r in rows if not any(is_leak(plain_words(r["text"]), item) for item in items)]


# -- stage 5


def plain_pieces(rows, capacity=2048):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, lengths = Counter(), []
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        at, piece, step = 0, 0, len(ids) % capacity or capacity
        while at < len(ids):
            part = ids[at : at + step]
            out[r["doc_id"], piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
            lengths.append(len(part))
            at, piece, step = at + step, piece + 1, capacity
    rooms = []
    for n in sorted(lengths, reverse=True):  # best fit, longest first
        fit = [(room, k) for k, room in enumerate(rooms) if room >= n]
        if fit:
            rooms[min(fit)[1]] -= n
        else:
            rooms.append(capacity - n)
    return out, sorted(rooms)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(21)
    vocabulary = [a + b for a in ("ka", "lo", "mi", "né", "日") for b in ("r", "st", "ta", "vu", "x", "ze", "ö")]

    def sentence(n):
        return " ".join(rng.choices(vocabulary, k=n)).capitalize() + rng.choice([".", "!", "?”"])

    def text(k):
        return "\n".join(" ".join(sentence(rng.randint(6, 14)) for _ in range(2)) for _ in range(k))

    items = [(1, sentence(30)), (2, sentence(7)), (3, None), (4, ""), (None, sentence(20)), (6, None)]
    items[5] = (6, items[0][1])
    passage = sentence(16) + " " + sentence(14)
    rows = [(i, text(rng.randint(1, 5))) for i in range(40)]
    rows += [(40 + i, rows[i][1]) for i in range(4)] + [(50, rows[0][1].upper()), (51, rows[1][1] + " " + sentence(2))]
    rows += [(60 + i, text(2) + "\n" + passage + "\n" + text(1)) for i in range(4)] + [(66, passage)]
    rows += [(70, text(1) + " " + items[0][1]), (71, text(2) + "\n" + items[1][1] + " " + sentence(5)),
             (72, " ".join(w if k % 9 != 4 else "other" for k, w in enumerate(items[0][1].split())) + "\n" + text(1))]
    rows += [(80, text(3) + "\nHome | News | Shop\n" + sentence(8)), (81, "A short one."), (82, None), (83, ""), (84, " \n "),
             (85, "na na na na na na " * 8 + "."), (86, text(1) + "\n" + "no end of it " * 30), (87, "All rights reserved.\n" + text(2))]
    long = " ".join(f"w{k}{rng.choice(vocabulary)}" + "." * (k % 11 == 0) for k in range(6000)) + "."
    rows += [(90, long), (None, rows[5][1]), (None, rows[5][1]), (None, None)]
    # Several texts under one id, rows that repeat, and a text that only another row of the id resembles.
    a, b = text(4), text(4)
    rows += [(103, b), (105, a), (105, b), (105, a), (106, a + " " + sentence(1)), (107, a), (107, a)]
    out = [{"doc_id": i, "text": t, "lang": rng.choice(["en", None]), "source": "s", "n_chars": len(t or ""), "kept": 1,
            "sha": "x", "row": k % 3, "leaks": None} for k, (i, t) in enumerate(rows)]
    return out, items


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(3)


def write(spark, folder, rows, items):
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_line_verdicts(spark, tables):
    rng = random.Random(4)
    parts = ["Ka lo mi.", "HOME ONE TWO", "a | b", "!!", "x", "so on", "#*$", "\n", "\n", "ÉCOLE ÜBER", "la la la la", "»", ";", "“end.”",
             "Privacy Policy.", "word " * 9 + "."]
    rows = tables[0] + [{**tables[0][0], "doc_id": 1000 + i, "text": " ".join(rng.choices(parts, k=rng.randint(1, 24)))}
                        for i in range(300)]
    want = Counter((r["doc_id"], *verdict(r["text"])) for r in rows)
    got = quality_rules.clean_lines(frame(spark, rows), keep=("doc_id", "kept"), with_text=True)
    assert "kept_kept" in got.columns
    got = Counter((r.doc_id, r.base_failed, r.n_failed_lines, r.lost_words, r.kept, r.clean_text) for r in got.collect())
    assert got == want and len({k[4] for k in want}) == 2


def test_every_stage_and_the_whole(spark, tmp_path_factory, tables):
    rows, items = tables
    folder = str(tmp_path_factory.mktemp("pipeline"))
    write(spark, folder, rows, items)

    def kept(stage, rows):
        return [r.asDict() for r in stage(spark, frame(spark, rows), folder).collect()]

    def as_counts(rows):
        return Counter(tuple(r.items()) for r in rows)

    one = plain_quality(rows)
    assert as_counts(kept(stages.quality_rules, rows)) == as_counts(one)
    assert 0 < len(one) < len(rows)
    two = kept(stages.near_duplicates, one)
    holds_one_of_each(one, two)
    holds_one_of_each(rows, kept(stages.near_duplicates, rows))
    assert {r["doc_id"] for r in two if r["doc_id"] in (103, 105, 106, 107)} == {103, 105}
    three = plain_repeats(two)
    assert as_counts(kept(stages.suffix_repeats, two)) == as_counts(three) != as_counts(two)
    four = plain_decontaminated(three, items)
    assert as_counts(kept(stages.decontamination, three)) == as_counts(four) and len(four) < len(three)
    got = corpus_pipeline.run(spark, folder).collect()
    want, rooms = plain_pieces(four)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
    assert sorted(2048 - sum(n for _, n in p) for p in bins.values()) == rooms


def test_empty_tables(spark, tmp_path_factory, tables):
    folder = str(tmp_path_factory.mktemp("empty"))
    write(spark, folder, [], [])
    none = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, none, folder)
        assert left.columns == none.columns and left.count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0
    # Without items nothing leaks.
    assert stages.decontamination(spark, frame(spark, tables[0][:5]), folder).count() == 5
