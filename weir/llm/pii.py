"""Personal data in whole texts, also where it is written in disguise.

``base_spans`` finds e-mail addresses, IP addresses, card and phone numbers as
they stand. ``Mapped`` is a text together with the source characters each of
its characters came from; the transducers rewrite a text piece by piece and
keep that origin: homoglyphs and zero-width characters, spelled digits, at and
dot in disguise. The same detectors run over the rewritten text and the spans
found are mapped back, so an offset always points into the source text.

Spans are (kind, start, end) in code points, end exclusive. A span of the
rewritten text is added if it touches no base span of its kind. A null or empty
text has no spans. Rows are handled one by one, whatever their order.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_columns

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# The contract's patterns, in forms that scan a text once.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other alphabets that look like Latin ones.
LOOKALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "ο": "o", "α": "a", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "﹫": "@", "。": ".", "․": ".", "﹒": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ", "　": " ",
}
HIDDEN = "­​‌‍⁠﻿"
# Digits as words.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

_WIDE = "！-～"
_ODD = re.compile("[" + "".join(map(re.escape, LOOKALIKE)) + HIDDEN + _WIDE + "٠-٩۰-۹०-९]")
_DIGIT_WORD = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
# Three or more spelled digits in a row; digits, dots and "dot" may stand between them.
_RUN = re.compile(rf"(?<!\w){_DIGIT_WORD}(?:[ ,.()-]{{1,2}}(?:{_DIGIT_WORD}(?!\w)|[0-9]|dot(?!\w)|point(?!\w)))" + "{2,}", re.I)
_IN_RUN = re.compile(rf"(?:{_DIGIT_WORD})(?!\w)(?:[ ,-]{{1,2}}(?={_DIGIT_WORD}(?!\w)))?|dot(?!\w)|point(?!\w)|,", re.I)
_PLUS = re.compile(r"(?<!\w)plus[ ]+(?=[0-9])", re.I)
_NEAR_DOT = re.compile(r"(?<=[0-9]) ?\. ?(?=[0-9])")
_AT = re.compile(r"[ ]*+[\[({<][ ]*(?:at|arroba|chez|@)[ ]*[\])}>][ ]*", re.I)
_DOT = re.compile(r"[ ]*+[\[({<][ ]*(?:dot|punto|punkt|point|\.)[ ]*[\])}>][ ]*", re.I)
_LABEL = "[A-Za-z0-9-]+"
_AT_WORD = re.compile(rf"(?<=[A-Za-z0-9_%+-])[ ]+at[ ]+(?={_LABEL}(?:\.{_LABEL}|[ ]+dot[ ]+{_LABEL})*[ ]+dot[ ]+[A-Za-z]{{2,}})", re.I)
_AT_DOTTED = re.compile(rf" at[ ]+(?={_LABEL}(?:\.{_LABEL})*\.[A-Za-z]{{2,}})", re.I)
_LAST_WORD = re.compile(r"[A-Za-z0-9._%+-]*$")
_DOT_WORD = re.compile(r"(?<=[A-Za-z0-9])[ ]+dot[ ]+(?=[A-Za-z0-9])", re.I)
_MAIL_TAIL = re.compile(rf"@{_LABEL}(?:(?:\.|[ ]+dot[ ]+){_LABEL})*", re.I)
_HEAD = re.compile(r"(?:[A-Za-z0-9_%+-]+[ ]+dot[ ]+)+[A-Za-z0-9_%+-]+(?=@)", re.I)


def _spelled_twice(low: str) -> bool:
    """Cheap test before ``_RUN``: a separator and a spelled digit, at least twice."""
    seen = 0
    for at, _ in _spelled_words().iter(low):
        if not low[at + 1 : at + 2].isalnum():
            seen += 1
            if seen == 2:
                return True
    return False


@functools.lru_cache(maxsize=1)
def _spelled_words():
    import ahocorasick

    words = ahocorasick.Automaton()
    for w in SPELLED:
        if w != "un":  # an article; a number has other digits too
            for separator in " -,.(":
                words.add_word(separator + w, 1)
    words.make_automaton()
    return words


def _after_name(m: re.Match) -> str:
    """In "j.doe7 at mail.net" a name with a digit, dot or underscore stands before the "at"."""
    word = _LAST_WORD.search(m.string[max(0, m.start() - 64) : m.start()].rstrip(" "))[0]
    return "@" if re.search("[0-9._]", word) else m[0]


def _signs(low: str) -> bool:
    """An at or dot in brackets, or the two as words."""
    if " dot " in low or (" at " in low and any(_after_name(m) == "@" for m in _AT_DOTTED.finditer(low))):
        return True
    return any(b in low for b in "[({<") and bool(_AT.search(low) or _DOT.search(low))


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        # What precedes a failing "@" can't be part of a later address.
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that pass its test, by start, then kind."""
    out = _emails(text)
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Mapped:
    """A rewritten text; character i stands for source characters begin[i] to end[i] (exclusive)."""

    def __init__(self, text: str):
        self.text, self.begin, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, become) -> Mapped:
        """Replace each match by ``become(match)``; its characters all stand for the whole match."""
        parts, begin, end, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            s, e = m.span()
            new = become(m)
            if e == s or new == m[0]:
                continue
            parts += [self.text[at:s], new]
            begin += self.begin[at:s] + [self.begin[s]] * len(new)
            end += self.end[at:s] + [self.end[e - 1]] * len(new)
            at = e
        if parts:
            self.text = "".join(parts) + self.text[at:]
            self.begin, self.end = begin + self.begin[at:], end + self.end[at:]
        return self

    def inside(self, pattern: re.Pattern, inner: re.Pattern, become) -> Mapped:
        """Rewrite the matches of ``inner`` that lie within a match of ``pattern``."""
        spans = [m.span() for m in pattern.finditer(self.text)]
        if not spans:
            return self
        i = 0

        def within(m):
            nonlocal i
            while i < len(spans) and spans[i][1] < m.end():
                i += 1
            return become(m) if i < len(spans) and spans[i][0] <= m.start() else m[0]

        return self.rewrite(inner, within)


def _plain(m: re.Match) -> str:
    c = m[0]
    if c in HIDDEN:
        return ""
    if c in LOOKALIKE:
        return LOOKALIKE[c]
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    return str(unicodedata.digit(c))


def _digit(m: re.Match) -> str:
    w = m[0].lower().rstrip(" ,-") or ","
    return "." if w in ("dot", "point") else " " if w == "," else SPELLED[w]


def normalised(text: str) -> Mapped | None:
    """The text with its disguises taken off, or None if it shows none."""
    low = text.lower()
    odd = None if text.isascii() else _ODD.search(text)
    spelled = _spelled_twice(low) and _RUN.search(text)
    if not (odd or spelled or _signs(low)):
        return None
    m = Mapped(text)
    if odd:
        m.rewrite(_ODD, _plain)
    m.inside(_RUN, _IN_RUN, _digit)
    if spelled or odd:
        m.rewrite(_PLUS, lambda _: "+").rewrite(_NEAR_DOT, lambda _: ".")
    m.rewrite(_AT, lambda _: "@").rewrite(_DOT, lambda _: ".")
    m.rewrite(_AT_WORD, lambda _: "@").rewrite(_AT_DOTTED, _after_name)
    m.inside(_MAIL_TAIL, _DOT_WORD, lambda _: ".").rewrite(_HEAD, lambda h: re.sub(r"[ ]+dot[ ]+", ".", h[0], flags=re.I))
    return m if m.text != text else None


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and base spans with those found behind disguises."""
    base = base_spans(text)
    m = normalised(text)
    if m is None:
        return base, base
    taken = {k: [(s, e) for kind, s, e in base if kind == k] for k in KINDS}
    added = []
    for kind, s, e in base_spans(m.text):
        start, end = m.begin[s], m.end[e - 1]
        if not any(a < end and start < b for a, b in taken[kind]):
            added.append((kind, start, end))
            taken[kind].append((start, end))
    return base, ordered(base + added)


def find(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Add a struct with ``base`` and ``spans``, arrays of (kind, start, end)."""
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

    @F.pandas_udf(T.StructType([T.StructField("base", span), T.StructField("spans", span)]))
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [all_spans(t) if t else ([], []) for t in texts]
        as_rows = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
        return pd.DataFrame({"base": [as_rows(b) for b, _ in found], "spans": [as_rows(a) for _, a in found]}, columns=["base", "spans"])

    return with_columns(df, **{out: run(F.col(text))})


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are joined."""
    out, at = [], 0
    for kind, s, e in ordered(spans):
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])
