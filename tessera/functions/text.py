"""Scalar string functions as Catalyst expressions (no Python per row).

Every function takes and returns ``Column`` objects so it can be used inside
``select``/``withColumn`` and stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace used by the test bindings (ASCII only, same in DuckDB).
ASCII_WS = r"[ \t\r\n\f]+"
# Library default: Python ``str.split()`` semantics (any Unicode whitespace).
UNICODE_WS = r"(?U)\s+"


def sql_lit(value: str) -> str:
    """Quote a Python string as a Spark SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it or a lambda in
    it runs (``transform`` over an array of the value binds it)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(col: Column | str, pattern: str = UNICODE_WS) -> Column:
    """``str.split()``: split on whitespace runs, drop empty pieces."""
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(c, pattern), lambda t: t != "")


def token_count(col: Column | str, pattern: str = UNICODE_WS, specials: int = 2) -> Column:
    """Default token counter: whitespace tokens plus the model's special tokens.

    A real sub-word tokenizer can replace this through
    ``tessera.functions.tokenize.pandas_token_counter``.
    """
    return F.size(tokens(col, pattern)) + F.lit(specials)


def shape_ok(target: Column | str, prefix: str = "@Test public void test",
             open_: str = "(", close: str = ")", follow: str = "{",
             offset: int = 2) -> Column:
    """Shape predicate on a target method text.

    The text must start with ``prefix``; the first ``open_`` and the next
    ``close`` (searched from the opener) must exist, and the character
    ``offset`` places after the closer must be ``follow``. A text that ends
    before that character is rejected.
    """
    t = F.col(target) if isinstance(target, str) else target
    p1 = F.instr(t, open_)
    # position of the closer, searched from the opener (1-based, 0 = none)
    p2 = F.when(p1 > 0, _locate_from(close, t, p1)).otherwise(F.lit(0))
    ok = (
        (p1 > 0)
        & (p2 > 0)
        & (p2 + F.lit(offset) <= F.length(t))
        & (F.substring(t, p2 + F.lit(offset), F.lit(1)) == F.lit(follow))
    )
    if prefix:
        ok = t.startswith(prefix) & ok
    return F.coalesce(ok, F.lit(False))


def _locate_from(needle: str, hay: Column, start: Column) -> Column:
    """1-based position of ``needle`` in ``hay`` at or after ``start`` (0 if none)."""
    rel = F.instr(F.substring(hay, start, F.lit(2147483647)), needle)
    return F.when(rel > 0, rel + start - F.lit(1)).otherwise(F.lit(0))


# ---------------------------------------------------------------------------
# Normalisers
# ---------------------------------------------------------------------------

def normalize_source(col: Column | str) -> Column:
    """newline/tab to space, pad braces with spaces, collapse whitespace, trim."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.translate(c, "\n\t", "  ")
    c = F.replace(c, F.lit("{"), F.lit(" { "))
    c = F.replace(c, F.lit("}"), F.lit(" } "))
    # runs of whitespace that are not a single space already
    c = F.regexp_replace(c, r"(?U)[\s&&[^ ]]\s*+| \s++", " ")
    return F.trim(c)


def filter_code(col: Column | str) -> Column:
    """CR/LF/tab to space, then collapse runs of spaces only."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.translate(c, "\r\n\t", "   "), " +", " ")


# Characters below U+0100 that ``repr`` writes as \\xNN.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\xad]"


def py_literal_body(col: Column | str) -> Column:
    """the body of Python ``repr(s)``.

    Backslash doubled; CR/LF/tab become two-character escapes; the single quote
    is escaped only when the text holds both quote kinds (``repr`` then keeps
    single quotes as delimiters). Other control characters, the no-break space
    and the soft hyphen become ``\\xNN``; unprintable characters above U+00FF stay.
    """
    c = F.col(col) if isinstance(col, str) else col
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit("\n"), F.lit("\\n"))
    c = F.replace(c, F.lit("\r"), F.lit("\\r"))
    c = F.replace(c, F.lit("\t"), F.lit("\\t"))
    both = c.contains("'") & c.contains('"')
    c = F.when(both, F.replace(c, F.lit("'"), F.lit("\\'"))).otherwise(c)
    shown = F.transform(F.split(c, ""), lambda ch: F.when(ch.rlike(CONTROL), F.concat(
        F.lit("\\x"), F.lower(F.lpad(F.hex(F.ascii(ch)), 2, "0")))).otherwise(ch))
    return F.when(c.rlike(CONTROL), F.array_join(shown, "")).otherwise(c)


# The quoted brace literals of code text and the digits that stand for them.
BRACE_PLACEHOLDERS = (("'{'", "6416864816840"), ("'}'", "6416864816841"))


def escape_braces(col: Column | str) -> Column:
    """replace the character literals ``'{'`` and ``'}'``; structural braces stay
    (inverse: ``restore_braces``)."""
    c = F.col(col) if isinstance(col, str) else col
    for raw, ph in BRACE_PLACEHOLDERS:
        c = F.replace(c, F.lit(raw), F.lit(ph))
    return c


def restore_braces(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    for raw, ph in BRACE_PLACEHOLDERS:
        c = F.replace(c, F.lit(ph), F.lit(raw))
    return c
