"""Token counts by prefix dynamic programming.

For every text the operator builds the exact number of tokens of *every*
prefix, and reads totals, truncation points and budget answers from that table
without encoding anything again.

Inside a word the table is a dynamic programme over positions. The encoding of
``w[:i]`` ends with one token t, and what stands before t is itself the
encoding of ``w[:i - len(t)]``; a pair of neighbouring tokens is possible
exactly when byte-pair merging of their joined text gives the pair back. So
count[i] = count[i - len(t)] + 1 for the one t that fits after the last token
of the shorter prefix. Vocabularies with a word-end mark need two tables: open
prefixes (no mark yet) and closed ones (the mark sits on the last character);
a closed prefix is one marked token after an open prefix. Words are visited in
sorted order, so that a word continues the table of its longest prefix shared
with the word before. Across words the table is a prefix sum; the closed
entries inside a word are read off when a cut falls there.

Rows: null and empty texts have no tokens; very long texts and words take time
in proportion to their length; repeated rows are counted alike; a text of
exactly ``budget`` tokens is within it; an empty table gives no rows; extra
columns are passed over unless named in ``keep`` (one that has the name of a
result column is called ``<name>_kept``).
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from . import common as C

# White space as the vocabulary's pattern sees it (the Unicode property), as one character class.
_SPACES = "\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Characters for which lower case and composition keep the length and no Unicode version differs.
_PLAIN = regex.compile("[\x00-\u012f\u0131-\u024f]*")
_MARKS = frozenset(".,;:!?()*#%&$\"|-")
_CACHE_PIECES = 400_000
_CACHE_PAIRS = 800_000


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as one printable character."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _seconds() -> frozenset[str]:
    """Characters that may compose with the one before."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x20000))
    marks = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<"}
    return frozenset(marks | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})


def _joins(ch: str) -> bool:
    """May normalisation change ``ch`` together with what stands before it?"""
    return unicodedata.combining(ch) > 0 or ch in _seconds() or unicodedata.category(ch) == "Cn"


class PrefixCounter:
    """Prefix token counts of words, for a byte-level BPE vocabulary file of ``tokenizers``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        by_length = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, by_length)) or "(?!)")
        self.letters = [_byte_letters()[b] for b in range(256)]
        words = list(model["vocab"])
        self.open = {t for t in words if not (self.end and t.endswith(self.end))}
        self.closed = {t[: len(t) - len(self.end)] for t in words if t.endswith(self.end)}
        self.longest = max(map(len, self.open | self.closed), default=1)
        self.open_pairs: dict[tuple[str, str], bool] = {}
        self.closed_pairs: dict[tuple[str, str], bool] = {}
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.totals: dict[str, int] = {}
        self.word, self.last, self.count = "", [""], [0]

    # -- may two tokens stand side by side? Only if merging their joined text gives them back.

    def _merge(self, symbols: list[str]) -> list[str]:
        rank = self.rank
        while len(symbols) > 1:
            best, at = None, 0
            for k in range(len(symbols) - 1):
                r = rank.get((symbols[k], symbols[k + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _fits(self, before: str, token: str, closing: bool) -> bool:
        symbols = [*before, *token]
        if closing:
            symbols[-1] += self.end
        want = [before] * bool(before) + [token + self.end * closing]
        fits = self._merge(symbols) == want
        pairs = self.closed_pairs if closing else self.open_pairs
        if len(pairs) > _CACHE_PAIRS:
            pairs.clear()
        pairs[before, token] = fits
        return fits

    # -- the dynamic programme; self.word is the text whose open table is held

    def _extend(self, word: str, upto: int) -> None:
        """Hold the open table of word[:upto], continuing that of the word before."""
        last, count, held, open_, pairs = self.last, self.count, self.word, self.open, self.open_pairs
        shared, most = 0, min(upto, len(last) - 1)
        if word[:most] == held[:most]:
            shared = most
        else:
            while word[shared] == held[shared]:
                shared += 1
        del last[shared + 1 :], count[shared + 1 :]
        for i in range(shared + 1, upto + 1):
            for j in range(max(0, i - self.longest), i):
                token = word[j:i]
                if token in open_:
                    before = last[j]
                    fits = pairs.get((before, token))
                    if fits or fits is None and self._fits(before, token, False):
                        last.append(token)
                        count.append(count[j] + 1)
                        break
            else:  # a byte that the vocabulary lacks stands alone
                last.append(word[i - 1])
                count.append(count[i - 1] + 1)
        self.word = word

    def _close(self, word: str, i: int) -> int:
        """Tokens of word[:i] as a piece of its own; the open table reaches i - 1 at least."""
        if not self.end:
            return self.count[i]
        last, closed, pairs = self.last, self.closed, self.closed_pairs
        for j in range(max(0, i - self.longest), i):
            token = word[j:i]
            if token in closed:
                before = last[j]
                fits = pairs.get((before, token))
                if fits or fits is None and self._fits(before, token, True):
                    return self.count[j] + 1
        return self.count[i - 1] + 1

    def piece_total(self, piece: str) -> int:
        self._extend(piece, len(piece) - bool(self.end))
        return self._close(piece, len(piece))

    def piece_prefixes(self, piece: str) -> list[int]:
        self._extend(piece, len(piece))
        return [self._close(piece, i) for i in range(1, len(piece) + 1)]

    # -- words: lower case, cut into pieces

    def _letters_of(self, text: str) -> str:
        return text if text.isascii() else "".join([self.letters[b] for b in text.encode("utf-8")])

    def _is_plain(self, word: str) -> bool:
        return (word.isascii() and word.isprintable() or _PLAIN.fullmatch(word) is not None) and not (
            "<|" in word and any(s in word for s in self.special))

    def _pieces(self, word: str) -> list[str]:
        """Byte-level pieces of a plain word."""
        word = word.lower()
        if word.isalpha():
            return [self._letters_of(word)]
        head, mark = word[:-1], word[-1]
        if mark in _MARKS and head.isalpha():
            return [self._letters_of(head), mark]
        out = self.split.findall(word)
        if word.isascii() and word.isprintable():
            return out
        return ["".join([self.letters[b] for b in x.encode("utf-8")]) for x in out]

    def _cut(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        """Byte-level pieces of a normalised text and where they stand in it."""
        return self.library.pre_tokenizer.pre_tokenize_str(text) if text else []

    def _odd_pieces(self, word: str) -> tuple[list[str], int]:
        """Byte-level pieces of any word, and the number of special strings between them."""
        parts = self.specials.split(word)
        normal = self.library.normalizer.normalize_str
        return [piece for part in parts if part for piece, _ in self._cut(normal(part))], len(parts) - 1

    def whole(self, words: list[str]) -> np.ndarray:
        """Token counts of distinct words; new pieces run through the programme in sorted order."""
        totals = self.totals
        if len(totals) > _CACHE_PIECES:
            totals.clear()
        odd, cut = {}, []
        for k, word in enumerate(words):
            if self._is_plain(word):
                cut.append(self._pieces(word))
            else:
                pieces, odd[k] = self._odd_pieces(word)
                cut.append(pieces)
        for piece in sorted({p for pieces in cut for p in pieces if p not in totals}):
            totals[piece] = self.piece_total(piece)
        out = np.fromiter((sum([totals[p] for p in pieces]) for pieces in cut), np.int64, len(cut))
        for k, n in odd.items():
            out[k] += n
        return out

    def prefixes(self, word: str) -> list[int]:
        """Token count of word[:1], word[:2], ..., by characters, each as the library counts it.

        A special string is one token once it is complete; until then its
        characters belong to the text before it.
        """
        out: list[int] = []
        if self._is_plain(word):
            for piece in self.split.findall(word.lower()):
                base = out[-1] if out else 0
                out += [base + n for n in self._piece_counts(piece)]
            return out
        base = at = 0
        for m in self.specials.finditer(word):
            counts = self._odd_prefixes(word[at : m.end() - 1])
            before = counts[m.start() - at - 1] if m.start() > at else 0
            out += [base + n for n in counts]
            base, at = base + before + 1, m.end()
            out.append(base)
        return out + [base + n for n in self._odd_prefixes(word[at:])]

    def _piece_counts(self, piece: str) -> list[int]:
        """Token count of every prefix of a piece, by characters."""
        counts = self.piece_prefixes("".join([self.letters[b] for b in piece.encode("utf-8")]))
        ends = np.cumsum([len(ch.encode("utf-8")) for ch in piece])
        if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():
            # A contraction cut short is an apostrophe and letters of their own.
            counts = [1, *[1 + n for n in self.piece_prefixes(piece[1:])][:-1], counts[-1]]
        return [counts[e - 1] for e in ends]

    def _odd_prefixes(self, text: str) -> list[int]:
        """Token count of every prefix of a text without special strings.

        The text is normalised in blocks that do not change each other, and the
        programme runs over the normalised text. Only a prefix that ends inside
        a composing sequence differs from it, and is cut again from its last two pieces.
        """
        normal = lru_cache(maxsize=1 << 16)(self.library.normalizer.normalize_str)
        cuts = [k for k, ch in enumerate(text) if not k or not _joins(ch)] + [len(text)]
        blocks = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        whole = "".join([normal(block) for block in blocks])
        if whole != self.library.normalizer.normalize_str(text):  # composed in a way this Python does not know
            return [len(self.library.encode(text[: k + 1], add_special_tokens=False).ids) for k in range(len(text))]
        count, first = [0], [0]  # by place in the normalised text; first: where its last piece starts
        for _, (a, b) in self._cut(whole):
            while len(count) <= a:
                first.append(len(count))
                count.append(count[-1])
            base = count[a]
            count += [base + n for n in self._piece_counts(whole[a:b])]
            first += [a] * (b - a)
        while len(count) <= len(whole):
            first.append(len(count))
            count.append(count[-1])
        out: list[int] = []
        at = 0
        for block in blocks:
            done = normal(block)
            for k in range(1, len(block)):
                part = normal(block[:k])
                if done.startswith(part):
                    out.append(count[at + len(part)])
                else:
                    p = first[first[at]]  # an apostrophe before the last piece may join it
                    out.append(count[p] + sum(self.piece_total(x) for x, _ in self._cut(whole[p:at] + part)))
            at += len(done)
            out.append(count[at])
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def split_unicode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Like common.split_words, at every Unicode white space."""
    lists = pc.split_pattern_regex(texts, f"[{_SPACES}]+")
    offsets = lists.offsets.to_numpy()
    return C.encode_flat(lists.flatten(), (offsets - offsets[0]).astype(np.int64))


def word_starts(text: str) -> np.ndarray:
    return np.array([m.start() for m in regex.finditer(f"[^{_SPACES}]+", text)], np.int64)


def prefix_counts(text: str, path: str) -> np.ndarray:
    """Token count of text[:0], text[:1], ..., text[:len(text)]."""
    codes, _, words = split_unicode(pa.array([text], pa.string()))
    tables = [counter(path).prefixes(w) for w in words]
    out = np.zeros(len(text) + 1, np.int64)
    for code, start in zip(codes, word_starts(text)):
        table = tables[code]
        out[start + 1 : start + len(table) + 1] = out[start] + np.array(table)
        out[start + len(table) + 1 :] = out[start + len(table)]
    return out


def token_counts(docs: DataFrame, path: str, budget: int = 2048, text: str = "text",
                 keep: tuple[str, ...] = ("doc_id",), table: bool = False) -> DataFrame:
    """``keep`` columns, n_bytes, n_tokens, over_limit and fit_chars for every row.

    ``fit_chars`` is the length in code points of the longest prefix within
    ``budget`` tokens; trailing white space belongs to it. With ``table`` the
    row also has ``word_ends`` and ``word_counts``: the code-point ends of the
    words and the exact token count of the text up to each.
    """
    more = "n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint"
    schema = C.schema_of(docs, keep, more + ", word_ends array<bigint>, word_counts array<bigint>" * table)

    def run(batches):
        for batch in C.slices(batches, text):
            texts = C.texts_of(batch, text)
            codes, bounds, words = split_unicode(texts)
            each = counter(path).whole(words)[codes]
            upto = np.cumsum(each)
            base = np.concatenate([[0], upto])[bounds[:-1]]
            total = C.sums(each, bounds)
            fit = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in np.flatnonzero(total > budget):
                # The first word that ends beyond the budget, and the longest prefix of it within.
                a, b = bounds[i], bounds[i + 1]
                k = a + int(np.searchsorted(upto[a:b], base[i] + budget, side="right"))
                before = int(upto[k - 1] - base[i]) if k > a else 0
                inside = np.flatnonzero(before + np.array(counter(path).prefixes(words[codes[k]])) <= budget)
                start = next(islice(regex.finditer(f"[^{_SPACES}]+", texts[int(i)].as_py()), int(k - a), None)).start()
                fit[i] = start + (int(inside[-1]) + 1 if len(inside) else 0)
            columns = [batch.column(k) for k in keep]
            columns += [pc.binary_length(texts).cast(pa.int64()), pa.array(total), pa.array(total > budget),
                        pa.array(fit)]
            if table:
                cut = pa.array(bounds.astype(np.int32))
                lengths = np.array([len(w) for w in words], np.int64)[codes]
                starts = np.concatenate([word_starts(t) for t in texts.to_pylist()])
                columns += [pa.ListArray.from_arrays(cut, pa.array(starts + lengths)),
                            pa.ListArray.from_arrays(cut, pa.array(upto - np.repeat(base, np.diff(bounds))))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
