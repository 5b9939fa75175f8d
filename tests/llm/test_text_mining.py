"""Personal data, source divergence and collocations against brute-force versions."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import collocations, divergence, personal_data, queries
from tessera.llm import common as C

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
SCHEMA = "doc_id bigint, text string, lang string, source string, n bigint, personal int, value int, rank string"


def _digits(s):
    return re.sub("[^0-9]", "", s)


def _luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def _base_spans(text):
    good = {"email": lambda m: True, "ip": lambda m: all(int(p) < 256 for p in m.split(".")),
            "card": lambda m: 12 <= len(_digits(m)) <= 19 and _luhn(_digits(m)), "phone": lambda m: 9 <= len(_digits(m)) <= 15}
    found = [(m.start(), list(BASE).index(k), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if good[k](m[0])]
    return sorted(found)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    out = [None, "", "@", "a@b", "a@b.c@d.e", "a@b.c_d@e.f é+12 (3) 456-78 90.", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.1",
           "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713 x", "日本 x.y%z@日本.jp a@日-b.c", "0" * 50 + ".1.1.1",
           "1" * 3000, "x" * 5000 + "@y.z", "+1" + " " * 500, "İ a@B.C"]
    for alphabet in ("a1.@-", "12. ", "0123456789 -", "+12 ().-a", "aé@.1+ -_%"):
        out += ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(150)]
    return out


def test_personal_data_finds_the_base_spans(spark, texts):
    rows = [(i, t, None, None, 1, 2, 3, "r") for i, t in enumerate(texts)] + [(None, "a@b.c", "x", "y", 1, 2, 3, "r")] * 2
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = personal_data.personal_data(docs, keep=("doc_id", "personal", "text"), with_text=True)
    assert got.columns == ["doc_id", "personal_kept", "text", "personal", "masked_text"]
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        spans = [(s.start, personal_data.KINDS.index(s.kind), s.end) for s in r.personal]
        assert [s for s in spans if s[1] < 4] == _base_spans(r.text or ""), r.text
        assert spans == sorted(spans)
        assert not (r.masked_text and re.search(BASE["email"], r.masked_text) and "@" not in (r.text or ""))


def test_personal_data_beyond_the_base():
    def kinds(text):
        return [(personal_data.KINDS[k], text[a:b]) for a, k, b in personal_data.spans_of(text.lower()) if k > 3]

    assert kinds('token = "04dbebab91ab85687d33"') == [("secret", "04dbebab91ab85687d33")]
    assert kinds("the token was given, password: secretly") == []
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 and more") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert kinds("IBAN DE88 3704 0044 0532 0130 00") == []
    assert kinds("SSN: 123-45-6789, ssn 666-45-6789, account no. 12345678.") == [
        ("account", "123-45-6789"), ("account", "12345678")]
    assert kinds("http://bob:pw@host/x ftp://host http://[2001:db8::1]/ http://[::zz]/") == [
        ("login", "bob:pw"), ("ipv6", "2001:db8::1")]
    assert kinds("jane.doe [at] example [dot] org, (at) x") == [("hidden_email", "jane.doe [at] example [dot] org")]
    assert kinds("discount 123456789 in accountable 123456") == []
    text = "Write to a@b.c or +1 (017) 555-7713."
    assert personal_data.masked(text, personal_data.spans_of(text)) == "Write to <email> or <phone>."


def test_personal_data_digest(spark, tmp):
    spark.createDataFrame([(1, "x@y.zz 1.2.3.4"), (2, None)], "doc_id bigint, text string").write.parquet(f"{tmp}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_personal_data(spark, tmp).collect()}
    assert got[1].spans == "email:0:6,ip:7:14" and got[1].base_sha256 == hashlib.sha256(b"email:0:6,ip:7:14").hexdigest()
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 0, 0)
    assert got[2].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_byte_words(texts):
    some = [t or "" for t in texts]
    array = pa.array(["skipped", *some, "skipped"]).slice(1, len(some))
    codes, words, bounds, joined = C.byte_words(array, b" ", b".+")
    words = words.to_pylist()
    got = [[words[c] for c in codes[a:b]] for a, b in zip(bounds, bounds[1:])]
    assert got == [re.findall("[^ .+]+", t) for t in some]
    pieces = [[len(p) for p in (re.findall("[^ ]+", x) for x in re.split("[.+]", t)) if p] for t in some]
    assert joined.tolist() == [k > 0 for row in pieces for n in row for k in range(n)]


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(12)
    words = ["Alpha", "beta", "GAMma", "élan", "日本", "ÉCOLE", "x", "of", "the", "zeta"]
    rows = []
    for i in range(160):
        lang, source = rng.choice(["en", "de", None, "", "und"]), rng.choice(["s0", "s0", "s1", "ß", None])
        text = rng.choice([" ", ", ", "\t", "1"]).join(rng.choices(words, weights=range(1, 11), k=rng.randint(0, 60)))
        rows.append((i if i % 9 else None, text + rng.choice([".", "\n" + text, "! the beta", "\x00of the"]), lang, source, 1, 2, 3, "r"))
    rows += [(500, None, "fr", "s9", 1, 2, 3, "r"), (501, "", "fr", None, 1, 2, 3, "r"), (502, "a b", "it", "s9", 1, 2, 3, "r")]
    rows += [rows[3]] * 3 + [(600, "the of " * 4000, "en", "s1", 1, 2, 3, "r")]
    return rows


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("block_terms", [4096, 3])
def test_source_divergence(spark, mixed, block_terms):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, t, lang, source, *_ in mixed:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", _lower(t))
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    want = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in held[lang].items() if n >= 10)
        own = sorted(s for x, s in groups if x == lang)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        p = {s: shares(counts[lang, s]) for s in own}
        q = shares(sum((counts[lang, s] for s in own), Counter()))
        for s in own:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s)
            terms = sorted((-f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:10]
            for part, ranked in (("pair", pairs), ("term", terms)):
                want |= {(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(ranked)}
    docs = spark.createDataFrame(mixed, SCHEMA).repartition(3)
    got = divergence.source_divergence(docs, block_terms=block_terms).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(r.part == "pair" and r.value == 0 for r in got) and {r.lang for r in got} >= {"", "fr", "en"}


def test_count_bitmaps_equal_plain_sums():
    rng = np.random.default_rng(5)
    for n in (1, 63, 64, 1000, 5000):
        sides = []
        for _ in range(2):
            counts = np.minimum(rng.zipf(1.3, n) - 1, 400)
            by_count = 1 + rng.integers(0, 10**9, 401)
            ids = rng.permutation(np.flatnonzero(counts))
            sides.append((divergence.CountBitmaps(ids, counts[ids], by_count[counts[ids]], int(by_count[0]), n), by_count[counts]))
        (a, p), (b, q) = sides
        assert a.differs(b) == b.differs(a) == int(((p - q) ** 2 // (p + q)).sum())


@pytest.mark.parametrize("support", [100, 9])
def test_collocations(spark, mixed, support):
    f, n = defaultdict(Counter), Counter()
    for _, t, lang, *_ in mixed:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", _lower(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang if lang is not None else "und"] += len(w)
            for k in range(1, 6):
                f[lang if lang is not None else "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    want = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        inside = defaultdict(int)
        for p, a in candidates.items():
            for i, j in itertools.combinations(range(len(p) + 1), 2):
                if 1 < j - i < len(p):
                    inside[p[i:j]] = max(inside[p[i:j]], a)
        ranked = []
        for p, a in candidates.items():
            if inside[p] < a:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(ranked)[:40], 1):
            want.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    docs = spark.createDataFrame(mixed, SCHEMA).repartition(3)
    got = [tuple(r) for r in collocations.collocations(docs, support=support, top=40).collect()]
    assert sorted(got) == sorted(want) and len(want) > 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert personal_data.personal_data(none).count() == 0
    assert divergence.source_divergence(none).count() == 0
    assert collocations.collocations(none).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, 1, 2, 3, "r")], SCHEMA)
    assert divergence.source_divergence(blank).count() == collocations.collocations(blank).count() == 0
