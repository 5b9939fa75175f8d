"""Personal data: anchor expansion.

One Aho-Corasick automaton walks over a text and finds the anchors: at-signs,
schemes, digit pairs and the cue words of identifiers. Only at an anchor does a
local parser run; it expands the anchor to the left and right, up to the
boundaries that its kind has, and validates what it got.

Base kinds, leftmost and without overlaps within a kind:

* ``email``: ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``;
* ``ip``: four dotted numbers, each 255 at most;
* ``card``: digits with at most one space or hyphen between two, 12 to 19 of
  them, with a right Luhn check digit;
* ``phone``: ``+``, then digits, spaces, brackets, dots and hyphens, 9 to 15 digits.

Kinds that the anchors add:

* ``hidden_email``: a name, ``[at]`` or ``(at)`` and a host with ``.`` or ``[dot]``;
* ``login``: user name and password in front of a URL's host;
* ``ipv6``: a bracketed address behind a scheme, as ``ipaddress`` reads it;
* ``account``: behind a cue (IBAN, account, SSN, passport and the like) an IBAN
  with a right check number, an SSN of a valid area, or 6 to 20 digits;
* ``secret``: behind a cue (token, password, API key and the like) and ``=`` or
  ``:`` a value of 12 characters or more with letters and digits.

A candidate that fails its validation is dropped and not tried in parts.

Rows: null and empty texts have no spans; texts are read whole, a slice of a
batch at a time, in time linear in their length; every row is judged by itself,
so repeated rows get equal spans; spans of equal start come in the order of
``KINDS``; an empty table gives no rows; of the other columns only ``keep``
passes through, one whose name the result has too as ``<name>_kept``.
"""

from __future__ import annotations

import ipaddress
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "hidden_email", "login", "ipv6", "account", "secret")
# Words in front of account numbers and of secrets, in lower case.
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "ssn", "social security", "passport", "tax id")
SECRET_CUES = ("token", "password", "passwd", "pwd", "secret", "api_key", "api-key", "apikey", "access_key", "private_key")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")
_DIGITS = frozenset("0123456789")
# Texts are in lower case (A-Z only) when these run; every run is possessive, so none is read twice.
_DOMAIN = re.compile(r"[a-z0-9-]++(?:\.[a-z0-9-]++)++")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HIDDEN = re.compile(r" {0,2}([a-z0-9-]++(?: {0,2}(?:\.|\[dot\]|\(dot\)) {0,2}[a-z0-9-]++)++)")
_LOGIN = re.compile(r"([^\s/@:?#\[\]]++(?::[^\s/@?#\[\]]*+)?)@")
_IPV6 = re.compile(r"(?:[^\s/@?#\[\]]*+@)?\[([0-9a-f:.]{2,45})\]")
_IBAN = re.compile(r"[a-z]{2}[0-9]{2}(?: ?[a-z0-9]){11,30}")
_ACCOUNT = re.compile(r"(?:[ \t]{1,2}(?:no|nr|num|number|nummer)\b)?[ \t:#.=-]{0,4}"
                      r"([a-z]{2}[0-9]{2}(?: ?[a-z0-9]){11,30}|[0-9](?:[ -]?[0-9]){5,19}(?![0-9]))")
_SECRET = re.compile(r"[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?([a-z0-9_./+=~-]{12,}+)")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    """The check number of an IBAN: moved to its end and read as a number it leaves 1 modulo 97."""
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def ssn(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


def _plain(address: str) -> list[str]:
    return [p.lstrip("0") for p in address.split(".")]


def _left(text: str, at: int, least: int, allowed: frozenset) -> int:
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


# Each parser gets (text, start and end of the anchor, end of the kind's last candidate) and returns
# (start, end, valid) of the candidate around the anchor, or None.
def _email(text, start, end, done):
    host = _DOMAIN.match(text, end)
    first = _left(text, start, done, _LOCAL) if host else start
    return (first, host.end(), True) if first < start else None


def _ip(text, start, end, done):
    found = _IP.match(text, _left(text, start, done, _DIGITS))
    return found and (*found.span(), all(len(p) < 4 and int(p or 0) < 256 for p in _plain(found[0])))


def _card(text, start, end, done):
    found = _CARD.match(text, start)
    if len(found[0]) > 40:
        return (*found.span(), False)
    digits = found[0].replace(" ", "").replace("-", "")
    return (*found.span(), 12 <= len(digits) <= 19 and luhn(digits))


def _phone(text, start, end, done):
    found = _PHONE.match(text, start)
    return found and (*found.span(), 9 <= sum(c in _DIGITS for c in found[0]) <= 15)


def _hidden_email(text, start, end, done):
    host = _HIDDEN.match(text, end)
    stop = start - (start > done and text[start - 1] == " ")
    first = _left(text, stop, done, _LOCAL) if host else stop
    return (first, host.end(), True) if first < stop else None


def _login(text, start, end, done):
    found = _LOGIN.match(text, end) if start and text[start - 1] in _WORD else None
    return found and (*found.span(1), True)


def _ipv6(text, start, end, done):
    found = _IPV6.match(text, end)
    if not found:
        return None
    try:
        ipaddress.IPv6Address(found[1])
    except ValueError:
        return (*found.span(1), False)
    return (*found.span(1), True)


def _account(text, start, end, done):
    if start and text[start - 1] in _WORD:
        return None
    found = _ACCOUNT.match(text, end)
    if not found:
        return None
    value, (a, b) = found[1], found.span(1)
    if value[0].isalpha():
        # An IBAN may be followed by words that its pattern takes for more of it.
        while value and not iban(value):
            value = value[: value.rfind(" ")] if " " in value else ""
        return (a, a + len(value) if value else b, bool(value))
    if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", value):
        return (a, b, ssn(value))
    return (a, b, True)


def _secret(text, start, end, done):
    found = _SECRET.match(text, end)
    if not found:
        return None
    value = found[1]
    return (*found.span(1), any(c in _DIGITS for c in value) and any(c.isalpha() for c in value))


_PARSERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "hidden_email": _hidden_email,
            "login": _login, "ipv6": _ipv6, "account": _account, "secret": _secret}


@lru_cache(maxsize=1)
def anchors():
    """The automaton of all anchors; its values are (anchor's length, kinds to try)."""
    import ahocorasick

    pairs = [(a, b) for a in "0123456789" for b in "0123456789"]
    words = {"@": ("email",), "://": ("login", "ipv6"), "[at]": ("hidden_email",), "(at)": ("hidden_email",)}
    words |= {f"+{d}": ("phone",) for d in "0123456789"}
    words |= {f"{a}.{b}": ("ip",) for a, b in pairs}
    words |= {f"{a}{sep}{b}": ("card",) for a, b in pairs for sep in ("", " ", "-")}
    words |= dict.fromkeys(ACCOUNT_CUES, ("account",)) | dict.fromkeys(SECRET_CUES, ("secret",))
    automaton = ahocorasick.Automaton()
    for word, kinds in words.items():
        automaton.add_word(word, (len(word), tuple(KINDS.index(k) for k in kinds)))
    automaton.make_automaton()
    return automaton


def spans_of(lowered: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of a text whose A-Z are in lower case, in order."""
    found, done = [], [0] * len(KINDS)
    parsers = [_PARSERS[k] for k in KINDS]
    for last, (width, kinds) in anchors().iter(lowered):
        start = last + 1 - width
        for kind in kinds:
            if start >= done[kind]:
                candidate = parsers[kind](lowered, start, last + 1, done[kind])
                if candidate:
                    done[kind] = candidate[1]
                    if candidate[2]:
                        found.append((candidate[0], kind, candidate[1]))
    return sorted(found)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with ``<kind>`` in place of each span; of overlapping spans the first is named."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                  with_text: bool = False) -> DataFrame:
    """``keep`` columns plus ``personal``: (kind, start, end) in code points, end exclusive, for every row.

    ``with_text`` adds ``masked_text``: the text with ``<kind>`` in place of each span.
    """
    schema = C.schema_of(docs, keep, "personal array<struct<kind:string,start:bigint,end:bigint>>"
                         + ", masked_text string" * with_text)
    names = pa.array(KINDS)

    def run(batches):
        for batch in C.slices(batches, text):
            texts = C.texts_of(batch, text)
            spans = [spans_of(t) for t in pc.ascii_lower(texts).to_pylist()]
            flat = np.array([s for row in spans for s in row], np.int64).reshape(-1, 3)
            offsets = np.cumsum([0, *map(len, spans)]).astype(np.int32)
            values = pa.StructArray.from_arrays(
                [names.take(pa.array(flat[:, 1])), pa.array(flat[:, 0]), pa.array(flat[:, 2])], ["kind", "start", "end"])
            columns = [batch.column(k) for k in keep] + [pa.ListArray.from_arrays(pa.array(offsets), values)]
            if with_text:
                columns.append(pa.array([masked(t, s) for t, s in zip(texts.to_pylist(), spans)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def written_out(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
