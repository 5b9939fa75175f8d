"""Pluggable tokenizer slot for length filters and token arrays.

The default counter (``text.token_count``) is a Catalyst expression. A real
sub-word tokenizer runs here as an Arrow-batched pandas UDF: ``factory`` is
called once per Python worker (not per row) and must return an ``encode``
function ``str -> list[int]``; batches of texts are encoded in one call.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

_CACHE: dict[int, Callable[[str], list[int]]] = {}


def _encoder(factory):
    key = id(factory)
    if key not in _CACHE:
        _CACHE[key] = factory()
    return _CACHE[key]


def pandas_token_counter(factory: Callable[[], Callable[[str], list[int]]], specials: int = 0):
    """Return ``Column -> Column`` counting tokens with the given tokenizer."""
    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        enc = _encoder(factory)
        return texts.map(lambda t: None if t is None else len(enc(t)) + specials)

    def apply(col: Column | str) -> Column:
        return count(F.col(col) if isinstance(col, str) else col)
    return apply


def pandas_token_ids(factory: Callable[[], Callable[[str], list[int]]]):
    """Return ``Column -> Column`` of token-id arrays with the given tokenizer."""
    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        enc = _encoder(factory)
        return texts.map(lambda t: None if t is None else list(enc(t)))

    def apply(col: Column | str) -> Column:
        return ids(F.col(col) if isinstance(col, str) else col)
    return apply


def whitespace_encoder() -> Callable[[str], list[int]]:
    """Stand-in encoder matching the V7 id rule: one id per whitespace token,
    ``length * 31 + code point of the first character``."""
    return lambda s: [len(t) * 31 + ord(t[0]) for t in s.split()]
