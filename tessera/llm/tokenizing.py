"""Token ids of whole texts, a slice of texts at a time, exactly as ``tokenizers`` gives them.

For byte-level vocabularies with the usual pattern a text can be cut at every
single space without changing its ids, so a slice is cut into chunks, each
distinct chunk is encoded once, and the ids are gathered. Texts where a cut
could matter (runs of white space with two spaces or more, special strings)
and chunks with characters on which libraries' Unicode tables might differ go
to the library itself.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common as C
from .token_counts import _byte_letters

# Fixed value: the public cutting pattern of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WHITE = "\\x{1c}-\\x{1f}\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
# Chunks that are encoded one by one: empty, white space at an end, or characters beyond Latin.
_ODD = f"^$|^[{_WHITE}]|[{_WHITE}]$|[^\\x00-\\x{{24f}}]"
_TRICKY = f" [{_WHITE}]* (?:[{_WHITE}]|$)"


class Encoder:
    """Ids of texts for one ``tokenizers`` file, without added tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._fast(spec)

    def _fast(self, spec):
        """The same vocabulary for the faster library, if it is of the plain byte-level kind."""
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (model["type"] == "BPE" and not model.get("end_of_word_suffix") and not spec.get("normalizer")
                 and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space"))
        if not plain:
            return None
        import tiktoken

        byte_of = {ch: b for b, ch in _byte_letters().items()}
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        if merged != sorted(merged) or any(ch not in byte_of for t in vocab for ch in t):
            return None
        ranks = {bytes(byte_of[ch] for ch in t): i for t, i in vocab.items()}
        self.n_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.n_bytes[i] = len(token)
        return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _alone(self, text: str) -> list[int]:
        if self.fast and (text.isascii() or max(text) < "ɐ"):
            return self.fast.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of " " + chunk for each, and how many each has."""
        odd = pc.match_substring_regex(chunks, _ODD).to_numpy(zero_copy_only=False)
        plain = chunks.filter(pa.array(~odd))
        one = pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain)
        joined = " " + pc.binary_join(one, " ")[0].as_py() if len(plain) else ""
        ids = np.array(self.fast.encode_ordinary(joined), np.uint32)
        # No token spans two chunks, so each chunk ends where one of its tokens does.
        ends = np.cumsum(pc.binary_length(plain).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends)
        counts = np.zeros(len(chunks), np.int64)
        counts[~odd] = np.diff(np.concatenate([[-1], at]))
        if not odd.any():
            return ids, counts
        alone = [self._alone(" " + c) for c in chunks.filter(pa.array(odd)).to_pylist()]
        counts[odd] = [len(a) for a in alone]
        out = np.zeros(int(counts.sum()), np.uint32)
        starts = np.cumsum(counts) - counts
        out[C.ragged(starts[~odd], counts[~odd])] = ids
        out[C.ragged(starts[odd], counts[odd])] = [i for a in alone for i in a]
        return out, counts

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        encoded = lists.flatten().dictionary_encode()
        codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        chunks = encoded.dictionary
        ids, counts = self._chunks(chunks)
        # The first chunk of a text has no space before it: those are encoded as they stand.
        first, of_first = np.unique(codes[offsets[:-1]], return_inverse=True)
        alone = [self._alone(c) if c else [] for c in chunks.take(pa.array(first)).to_pylist()]
        codes[offsets[:-1]] = len(chunks) + of_first
        counts = np.concatenate([counts, np.array([len(a) for a in alone], np.int64)])
        ids = np.concatenate([ids, np.array([i for a in alone for i in a], np.uint32)])
        starts = np.cumsum(counts) - counts
        each = counts[codes]
        return ids[C.ragged(starts[codes], each)], C.sums(each, offsets)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of text i are ids[bounds[i]:bounds[i + 1]]."""
        plain = np.zeros(len(texts), bool)
        if self.fast:
            plain = ~pc.match_substring_regex(texts, _TRICKY).to_numpy(zero_copy_only=False)
            for special in self.special:
                plain &= ~pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        counts = np.zeros(len(texts), np.int64)
        parts = {}
        if plain.any():
            ids, counts[plain] = self._plain(texts.filter(pa.array(plain)))
            if plain.all():
                return ids, np.concatenate([[0], np.cumsum(counts)])
            parts["plain"] = ids
        rest = np.flatnonzero(~plain)
        got = self.library.encode_batch(texts.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)
        counts[rest] = [len(g.ids) for g in got]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(bounds[-1], np.uint32)
        if plain.any():
            out[C.ragged(bounds[:-1][plain], counts[plain])] = parts["plain"]
        for k, g in zip(rest, got):
            out[bounds[k] : bounds[k + 1]] = g.ids
        return out, bounds


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
