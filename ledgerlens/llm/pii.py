"""Offset-preserving detection of personal data, disguised or not.

Base spans (email, ip, card, phone) come from plain patterns over the text as
written. For disguised ones, three transducers rewrite the text and keep, for
every rewritten stretch, where it came from:

1. look-alikes: full-width, mathematical and other compatibility forms,
   Cyrillic and Greek homoglyphs and foreign digits become their ASCII
   character, invisible format characters vanish;
2. spelled digits: runs of digit words ("four two seven", "oh", "double five")
   become digits;
3. disguised signs: "[at]", "(dot)", " at ... dot ..." and their kin become
   "@" and ".", "plus" before digits becomes "+".

The same detectors run over the rewritten text; a span that touches rewritten
characters is mapped back to the source and added unless a base span of its
kind holds it already. Base spans always stay.

Spans count code points, the end is exclusive. Defined cases: a null or empty
text has no spans; texts of any length are scanned whole in linear time; rows
are independent, so repeated rows and ties need no rule; extra columns pass
through, and a column with the output's name is replaced.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_IP_HINT = re.compile(r"\.[0-9]+\.[0-9]")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each "@" outwards."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", done)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    if not _IP_HINT.search(text):
        return []
    return [m.span() for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


DETECTORS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))

# ---------------------------------------------------------------- transducers


class Rewritten:
    """A text made from another by replacing stretches, with the way back."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]) -> None:
        """edits: (start, end, replacement), ascending and disjoint."""
        parts, at, made = [], 0, 0
        #: Per stretch of the new text: where it begins here and in the source,
        #: and whether it was rewritten.
        self.begins, self.froms, self.ends, self.edited = [], [], [], []
        for start, end, new in edits:
            if start > at:
                self._add(made, at, start, False)
                parts.append(source[at:start])
                made += start - at
            if new:
                self._add(made, start, end, True)
                parts.append(new)
                made += len(new)
            at = end
        if at < len(source):
            self._add(made, at, len(source), False)
            parts.append(source[at:])
        self.text = "".join(parts)

    def _add(self, begin: int, start: int, end: int, edited: bool) -> None:
        self.begins.append(begin)
        self.froms.append(start)
        self.ends.append(end)
        self.edited.append(edited)

    def _first(self, at: int) -> int:
        i = bisect_right(self.begins, at) - 1
        return self.froms[i] if self.edited[i] else self.froms[i] + at - self.begins[i]

    def _last(self, at: int) -> int:
        i = bisect_right(self.begins, at) - 1
        return self.ends[i] if self.edited[i] else self.froms[i] + at - self.begins[i] + 1

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a span here."""
        return self._first(start), self._last(end - 1)


#: Letters of other scripts that look like ASCII ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ɡ": "g", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k",
    "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "υ": "u", "ν": "v", "ѵ": "v", "ԝ": "w", "х": "x",
    "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ο": "o", "ρ": "p", "τ": "t", "χ": "x",
    "γ": "y", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ⅼ": "l", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".",
    "·": ".", "•": ".", "∙": ".", "＠": "@", "﹫": "@",
}

#: Digit words.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
TIMES = {"double": 2, "triple": 3}

_NON_ASCII = re.compile(r"[^\x00-\x7F]")
_INVISIBLE = frozenset("­​‌‍⁠﻿")
_SIMPLE: dict[str, str | None] = {}


def _plain(c: str) -> str | None:
    """The ASCII text that a character looks like, or None."""
    if c not in _SIMPLE:
        new = "" if c in _INVISIBLE else HOMOGLYPHS.get(c)
        if new is None and unicodedata.category(c) == "Nd":
            new = str(unicodedata.decimal(c))
        if new is None:
            folded = unicodedata.normalize("NFKC", c)
            new = folded if folded != c and folded.isascii() else None
        if len(_SIMPLE) > 100_000:
            _SIMPLE.clear()
        _SIMPLE[c] = new
    return _SIMPLE[c]


def look_alikes(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    return [(m.start(), m.end(), new) for m in _NON_ASCII.finditer(text) if (new := _plain(m[0])) is not None]


_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_ONE = re.compile(rf"(?:({'|'.join(TIMES)})[\x20-])?({_WORD})(?!\w)", re.I)
#: A run has at least so many digit words; a lone number word is left as it is.
LEAST_UNITS = 3
_DIGIT_GAP = re.compile(r"[\x20,\-]+")
_DOT_WORD = re.compile(r"[\x20]*[\[({<]?(?<!\w)(?:dot|point|punkt|punto)(?!\w)[\])}>]?[\x20]*", re.I)


#: Bytes that separate words, and ASCII lower case, for the quick tests below.
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isalpha() and b < 128 else b if b > 127 else 32 for b in range(256))
_DIGIT_BYTES = frozenset(w.encode() for w in DIGIT_WORDS)


def plain_words(text: str) -> list[bytes]:
    """Runs of letters in lower case, quickly."""
    return text.encode("utf-8").translate(_FOLD).split()


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    """Each digit word of a run of at least ``LEAST_UNITS`` becomes its digits;
    the gap between two neighbouring digit words vanishes."""
    words = plain_words(text)
    if _DIGIT_BYTES.isdisjoint(words):
        return []
    at = [i for i, w in enumerate(words) if w in _DIGIT_BYTES]
    if not any(b - a <= 2 * (LEAST_UNITS - 1) for a, b in zip(at, at[LEAST_UNITS - 1:], strict=False)):
        return []  # only digits, dot words or a "double" may stand between the words of a run
    found = [m for m in _ONE.finditer(text) if m.start() == 0 or not (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_")]
    out: list[tuple[int, int, str]] = []
    run: list[tuple[int, int, str]] = []
    units = 0

    def close() -> None:
        if units >= LEAST_UNITS:
            out.extend(run)

    last = None
    for m in found:
        digits = DIGIT_WORDS[m[2].lower()] * TIMES.get((m[1] or "").lower(), 1)
        gap = text[last:m.start()] if last is not None else None
        if gap is not None and len(gap) <= 3 and _DIGIT_GAP.fullmatch(gap):
            run.append((last, m.end(), digits))
        elif gap is not None and (re.fullmatch(r"[\x20,.()\-+0-9]{1,24}", gap) or _DOT_WORD.fullmatch(gap)):
            run.append((m.start(), m.end(), digits))
        else:
            close()
            run, units = [(m.start(), m.end(), digits)], 0
        units += 1
        last = m.end()
    close()
    return out


_AT_WORDS = r"at|arroba|arobase|chez"
_DOT_WORDS = r"dot|point|punkt|punto"
_BRACKETED = re.compile(rf"\x20?[\[({{<][\x20]*(?:({_AT_WORDS}|@)|({_DOT_WORDS}|\.))[\x20]*[\])}}>][\x20]*", re.I)
_DASHED = re.compile(rf"\x20?([-_*/|~])(?:({_AT_WORDS})|({_DOT_WORDS}))\1[\x20]*", re.I)
#: "name at host dot tld", any number of parts: at least one dot word after the
#: at. Found from the at, which has its own names before and behind it up to the
#: next at, so that long chains of dots are walked once.
_LABEL = r"[A-Za-z0-9-]+"
_NAME = r"[A-Za-z0-9._%+-]+"
_PLAIN_SIGN = re.compile(rf"(?=(\x20(?:{_AT_WORDS})\x20))|@", re.I)
_PLAIN_HOST = re.compile(
    rf"{_LABEL}(?:(?:\x20(?:{_DOT_WORDS})\x20|\x20?\.\x20?){_LABEL})*?(?:\x20(?:{_DOT_WORDS})\x20)[A-Za-z]{{2,}}(?:\x20(?:{_DOT_WORDS})\x20[A-Za-z]{{2,}})*(?!\w)", re.I
)
#: The names before the at, in a text read backwards.
_EMAN = re.compile(rf"{_NAME}(?:\x20(?:{'|'.join(w[::-1] for w in _DOT_WORDS.split('|'))})\x20{_NAME})*", re.I)
_NAME_EDGE = re.compile(r"[\w.%+-]")
#: Endings that make "name at host.tld" an address.
_COMMON_TLD = r"com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|us|ch|at|nl|it|ru|cn|jp|br|ca|au|in|test|example"
_HALF_AT = re.compile(rf"(?<![\w.%+-])[A-Za-z0-9._%+-]+(\x20(?:{_AT_WORDS})\x20){_LABEL}(?:\.{_LABEL})*\.(?:{_COMMON_TLD})(?![\w-])", re.I)
_DOT_IN = re.compile(rf"\x20(?:{_DOT_WORDS})\x20", re.I)
_AT_IN = re.compile(rf"\x20+(?:{_AT_WORDS})\x20+|\x20+@\x20*|@\x20+", re.I)
#: Spaces put around real signs of an address: "name @ host . tld".
_SPACED = re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]+(\x20?@\x20?)[A-Za-z0-9-]+(?:(?:\x20\.\x20|\.)[A-Za-z0-9-]+)+(?![\w-])")
_SPACED_SIGN = re.compile(r"\x20@\x20?|@\x20|\x20\.\x20")
#: Numbers joined by dot words.
_DOTTED_IP = re.compile(rf"(?<![\w.])[0-9]+(?:(?:\x20?(?:{_DOT_WORDS})\x20?|\x20?\.\x20?)[0-9]+){{3}}(?![\w])", re.I)
_IP_SIGN = re.compile(rf"\x20?(?:{_DOT_WORDS})\x20?|\x20\.\x20?|\.\x20", re.I)
_PLUS = re.compile(r"(?<!\w)plus[\x20]*(?=\(?[0-9])", re.I)
_AT_BYTES = frozenset(w.encode() for w in _AT_WORDS.split("|"))
_DOT_BYTES = frozenset(w.encode() for w in _DOT_WORDS.split("|"))
_TLD_HINT = re.compile(rf"\.(?:{_COMMON_TLD})(?![\w-])", re.I)
_GAP_HINT = re.compile(r"\.\x20?[0-9]")


def _plain_addresses(text: str) -> list[tuple[int, int]]:
    """Where a name, an at, and a host with a dot word stand, left to right."""
    found: list[tuple[int, int]] = []
    back, size, done = text[::-1], len(text), 0
    for m in _PLAIN_SIGN.finditer(text):
        # An at word has a blank on either side, and may have one more; an @ up to two.
        at, end, room = (m.start(), m.end(1), 1) if m[1] else (m.start(), m.end(), 2)
        at -= room - len(text[max(0, at - room):at].rstrip(" ")) if at >= room else 0
        end += room - len(text[end:end + room].lstrip(" ")) if end + room <= size else 0
        names = _EMAN.match(back, size - at)
        host = _PLAIN_HOST.match(text, end) if names else None
        if not host:
            continue
        start = size - names.end()
        # The first name must not be the end of something longer, nor of the last address.
        while start < at and (start < done or (start and _NAME_EDGE.match(text[start - 1]))):
            dot = _DOT_IN.search(text, start, at)
            start = dot.end() if dot else at
        if start < at:
            found.append((start, host.end()))
            done = host.end()
    return found


def disguised_signs(text: str) -> list[tuple[int, int, str]]:
    words = plain_words(text)
    has_at, has_dot, sign = not _AT_BYTES.isdisjoint(words), not _DOT_BYTES.isdisjoint(words), "@" in text
    edits: list[tuple[int, int, str]] = []
    if has_at or has_dot or sign:
        edits += [(m.start(), m.end(), "@" if m[1] else ".") for m in _BRACKETED.finditer(text)]
        edits += [(m.start(), m.end(), "@" if m[2] else ".") for m in _DASHED.finditer(text)]
    if has_dot and (has_at or sign):
        for start, end in _plain_addresses(text):
            edits += [(x.start(), x.end(), "@") for x in _AT_IN.finditer(text, start, end)]
            edits += [(x.start(), x.end(), ".") for x in _DOT_IN.finditer(text, start, end)]
    if has_at and _TLD_HINT.search(text):
        edits += [(*m.span(1), "@") for m in _HALF_AT.finditer(text)]
    if sign and (" @" in text or "@ " in text or " . " in text):
        for m in _SPACED.finditer(text):
            edits += [(x.start(), x.end(), x[0].strip()) for x in _SPACED_SIGN.finditer(text, m.start(), m.end())]
    if has_dot or _GAP_HINT.search(text):
        for m in _DOTTED_IP.finditer(text):
            edits += [(x.start(), x.end(), ".") for x in _IP_SIGN.finditer(text, m.start(), m.end())]
    if b"plus" in words:
        edits += [(m.start(), m.end(), "+") for m in _PLUS.finditer(text)]
    edits.sort(key=lambda e: (e[0], -e[1]))
    out: list[tuple[int, int, str]] = []
    for e in edits:
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


TRANSDUCERS = (look_alikes, spelled_digits, disguised_signs)


def scan(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of every span, by kind as listed, then start."""
    if not text:
        return []
    found = {kind: [(s, e, True) for s, e in detect(text)] for kind, detect in DETECTORS.items()}
    layers: list[Rewritten] = []
    now = text
    for step in TRANSDUCERS:
        edits = step(now)
        if edits:
            layers.append(Rewritten(now, edits))
            now = layers[-1].text
    if layers:
        for kind, detect in DETECTORS.items():
            base = [(s, e) for s, e, _ in found[kind]]
            for start, end in detect(now):
                length = end - start
                for layer in reversed(layers):
                    start, end = layer.back(start, end)
                span = text[start:end]
                if kind == "card" and not _NOT_DIGIT.sub("", span) and length < 13:
                    continue
                if not any(s <= start and end <= e for s, e in base):
                    found[kind].append((start, end, False))
    return [(kind, s, e, base) for kind in KINDS for s, e, base in sorted(found[kind])]


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def spans_column(text: Column | str) -> Column:
    """All spans of a text column (null: none)."""

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
        rows = [[{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in scan(t.as_py())] for t in texts]
        return pa.array(rows, pa.list_(kind))

    return spans(F.col(text) if isinstance(text, str) else text)


def find_pii(df: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``df`` with the spans of ``text`` in column ``into``."""
    return df.withColumn(into, spans_column(text))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
