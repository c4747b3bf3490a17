r"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs, digits, ``://`` and identifier cues such as
``token`` or ``iban``.  Around each anchor a local parser finds the boundaries and validates what lies between:

* ``email``  ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``, expanded to both sides of an at-sign
* ``ip``     four runs of digits joined by dots, each at most 255
* ``card``   digits with at most one blank or hyphen between two, 16 to 19 of them, passing Luhn
* ``phone``  a plus sign, then digits, blanks, brackets, dots and hyphens from digit to digit, 8 to 15 digits
* ``account``  a value of at least 8 letters, digits, ``_`` or ``-``, one of them a digit, after a cue and ``=`` or ``:``
* ``url``    a scheme and what follows ``://`` up to a blank, quote or angle bracket

The first four are the *base* kinds; their spans are what leftmost, non-overlapping matching of the pattern over the
whole text gives, less the matches that fail validation (these still use up their characters).  Spans count code
points, the end is exclusive.  Kinds may overlap.

Cases: null and empty texts have no spans; repeated rows get the same spans; columns named ``base_spans`` or ``spans``
are replaced, all others are kept.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from urbanflow.llm.common import append_columns

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "url")
CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "account", "iban", "ssn", "passport")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_DIGITS = re.compile(r"[0-9]+").match
_QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)").match
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])*").match
_DIAL = re.compile(r"\+[0-9][ ().0-9-]+").match
_VALUE = re.compile(r"""[ \t]*[=:][ \t]*["']?([A-Za-z0-9_-]{8,})""").match
_LINK = re.compile(r"""[^\s"'<>]+""").match


def _anchors():
    import ahocorasick
    automaton = ahocorasick.Automaton()
    for mark in ["@", "+", "://", *"0123456789"]:
        automaton.add_word(mark, (mark if not mark.isdigit() else "0", len(mark)))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            automaton.add_word(form, ("cue", len(form)))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def find_spans(text: str, automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, in order of their start."""
    spans: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    done = dict.fromkeys(KINDS, 0)
    for end, (mark, length) in automaton.iter(text):
        at = end - length + 1
        if mark == "0":
            if at >= done["ip"]:
                _ip(text, at, spans, done)
            if at >= done["card"]:
                _card(text, at, spans, done)
        elif mark == "@":
            _email(text, at, spans, done)
        elif mark == "+":
            if at >= done["phone"]:
                _phone(text, at, spans, done)
        elif mark == "cue":
            _account(text, at, end + 1, spans, done)
        else:
            _url(text, at, end + 1, spans, done)
    return spans


def _ip(text, at, spans, done):
    found = _QUAD(text, at)
    if found is None:
        done["ip"] = _DIGITS(text, at).end()
        return
    done["ip"] = found.end()
    # More than three digits after leading zeros are above 255, however long the run is.
    if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in found.groups()):
        spans["ip"].append(found.span())


def _card(text, at, spans, done):
    found = _CARD(text, at)
    done["card"] = found.end()
    digits = found.group().replace(" ", "").replace("-", "")
    if 16 <= len(digits) <= 19 and luhn(digits):
        spans["card"].append(found.span())


def _email(text, at, spans, done):
    start, floor = at, done["email"]
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN(text, at + 1)
    if start < at and domain is not None:
        spans["email"].append((start, domain.end()))
        done["email"] = domain.end()


def _phone(text, at, spans, done):
    found = _DIAL(text, at)
    if found is None:
        return
    kept = found.group().rstrip(" ().-")
    if len(kept) < 4:
        return
    done["phone"] = at + len(kept)
    if 8 <= sum(c.isdigit() for c in kept) <= 15:
        spans["phone"].append((at, at + len(kept)))


def _account(text, at, end, spans, done):
    if at and text[at - 1] in _WORD:
        return
    found = _VALUE(text, end)
    if found is None or found.start(1) < done["account"] or not any(c.isdigit() for c in found.group(1)):
        return
    done["account"] = found.end(1)
    spans["account"].append(found.span(1))


def _url(text, at, end, spans, done):
    start, floor = at, done["url"]
    while start > floor and text[start - 1] in _SCHEME:
        start -= 1
    found = _LINK(text, end)
    if at >= floor and start < at and found is not None:
        done["url"] = found.end()
        spans["url"].append((start, found.end()))


_MADE: list = []


def find_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``base_spans`` and ``spans``: arrays of ``kind:start:end``, by kind as listed, then by start."""

    def compute(texts: pa.Array) -> list:
        if not _MADE:
            _MADE.append(_anchors())
        base, every = [], []
        for text in texts.to_pylist():
            found = find_spans(text, _MADE[0]) if text else {}
            lines = {kind: [f"{kind}:{a}:{b}" for a, b in found.get(kind, ())] for kind in KINDS}
            base.append([line for kind in BASE for line in lines[kind]])
            every.append([line for kind in KINDS for line in lines[kind]])
        return [base, every]

    array = T.ArrayType(T.StringType())
    return append_columns(df, text_col, [("base_spans", array), ("spans", array)], compute)
