"""Personal data with offsets, also where it is disguised.

Plain patterns run over the source text. Then transducers rewrite disguises (look-alike and full-width characters,
spelled digits, `at` and `dot` in words or brackets) and keep, for every character they write, the range of source
characters it stands for; what the patterns find in the rewritten text is mapped back to the source.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from copy import copy

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fresh, steps

#: Kinds in the order that spans of one start follow.
KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# No match can begin inside a run of digits whose start does not begin one, hence the look-behinds.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Characters that look like an ASCII letter.
LOOK_ALIKE = {
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "К": "K", "М": "M", "О": "O", "Р": "P", "Т": "T", "Х": "X",
    "ο": "o", "α": "a", "ν": "v", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
#: And the full-width forms of the ASCII characters, and the decimal digits of all scripts.
FOLD = str.maketrans(LOOK_ALIKE | {chr(c): str(unicodedata.decimal(chr(c))) for c in range(128, 0x20000) if chr(c).isdecimal()} | {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)})
FOLDED = re.compile("[" + "".join(LOOK_ALIKE) + r"！-～]|(?![0-9])\d")
INVISIBLE = re.compile("[­​-‍⁠﻿]+")
#: Spelled digits in English, German, French and Spanish.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Spelled numbers from ten on in English and German, and what says a digit more than once.
TENS = {
    "ten": "10", "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19",
    "twenty": "20", "thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90",
    "zehn": "10", "elf": "11", "zwölf": "12", "dreizehn": "13", "vierzehn": "14", "fünfzehn": "15", "sechzehn": "16", "siebzehn": "17", "achtzehn": "18", "neunzehn": "19",
    "zwanzig": "20", "dreißig": "30", "vierzig": "40", "fünfzig": "50", "sechzig": "60", "siebzig": "70", "achtzig": "80", "neunzig": "90",
}
HUNDRED, TIMES = ("hundred", "hundert"), {"double": 2, "triple": 3, "doppel": 2}
#: Words for the signs of numbers and addresses in the same languages.
PLUS, AT, DOT = ("plus", "más"), ("at", "arroba", "arobase", "klammeraffe"), ("dot", "punkt", "point", "punto")
_any = lambda words: "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"
_DIGIT, _PLUS = _any([*SPELLED, *TENS, *HUNDRED, *TIMES]), _any(PLUS)
_AT = rf"(?:\s*[\[({{]\s*(?:{_any(AT)}|@)\s*[\])}}]\s*)"
_DOT = rf"(?:\s*[\[({{]\s*(?:{_any(DOT)}|\.)\s*[\])}}]\s*)"
_NEXT = rf"[\s,-]++(?:(?:{_any(DOT)}|and|und)\s++)?"
NUMBER = re.compile(rf"\b(?:{_PLUS}\s+)?{_DIGIT}(?:{_NEXT}{_DIGIT}){{3,}}\b", re.I)
#: Runs that also hold numbers in digits, and dots in brackets; of these only runs with a word or a bracket are rewritten.
MIXED = re.compile(rf"\b(?:{_PLUS}\s+)?(?:{_DIGIT}|[0-9]++)(?:(?:\.|{_DOT}|{_NEXT})(?:{_DIGIT}|[0-9]++))+\b", re.I)
LETTER, LETTERS = re.compile(r"[^\W\d_]|[\[({]"), re.compile(r"[^\W\d_]+")
SPOKEN = frozenset([*SPELLED, *TENS, *HUNDRED, *TIMES])
#: What addresses are made of, in one pass over the text: signs in words or brackets, words, and all else.
TOKEN = re.compile(rf"(?P<at>{_AT}|\s{_any(AT)}\s|@)|(?P<dot>{_DOT}|\s{_any(DOT)}\s|\.)|(?P<word>[A-Za-z0-9_%+-]+)|(?P<other>[^A-Za-z0-9_%+@.\s(\[{{-]+|[\s\S])", re.I)
HOST = re.compile("[A-Za-z0-9-]+")
#: Words that follow `dot` in sentences and are no ending of any domain; a bare `at` is believed with other endings.
NO_ENDING = frozenset("of on or and the an that which who where when with from for but then than into onto over under was were are has had".split())
#: Words or brackets without which a text has no disguised sign.
SIGNS = re.compile(rf"{_any(DOT)}|[\[({{]\s*(?:{_any(AT)}|@|\.)", re.I)
WORDS = re.compile(rf"{_PLUS}(?=\s)|{_DIGIT}|{_any(DOT)}|\.|[0-9]+", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text: str) -> list[Span]:
    """The spans of the plain patterns, leftmost and not overlapping within a kind; matches that fail are dropped."""
    found: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            found.append((start, m.end(), "email"))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


class Rewritten:
    """A text that was rewritten, with the source range and a mark of change for each of its characters."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.ends, self.changed = text, range(len(text)), range(1, len(text) + 1), bytearray(len(text))

    def fold(self) -> None:
        for m in FOLDED.finditer(self.text):
            self.changed[m.start()] = 1
        self.text = self.text.translate(FOLD)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Each range of the text becomes its string; every character of that stands for the whole range."""
        if not edits:
            return
        text, starts, ends, changed, at = [], [], [], bytearray(), 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            text += (self.text[at:a], new)
            starts += [*self.starts[at:a], *[self.starts[a]] * len(new)] if new else self.starts[at:a]
            ends += [*self.ends[at:a], *[self.ends[b - 1]] * len(new)] if new else self.ends[at:a]
            changed += self.changed[at:a] + b"\1" * len(new)
            if not new and changed:
                changed[-1] = 1
            at = b
        self.text, self.starts, self.ends, self.changed = "".join(text), starts, ends, changed


def _address_edits(text: str) -> list[tuple[int, int, str]]:
    """Signs to write for the disguised ones of addresses: words and dots, an `at`, then words with a dot at least."""
    tokens = [(m.lastgroup, m.start(), m.end()) for m in TOKEN.finditer(text)]
    edits, last = [], 0
    for k, (kind, start, end) in enumerate(tokens):
        if kind != "at" or not last < k < len(tokens) - 1 or tokens[k - 1][0] != "word":
            continue
        first = k - 1
        while first - 2 >= last and tokens[first - 1][0] == "dot" and tokens[first - 2][0] == "word":
            first -= 2
        spelled = _spelled_out(text, tokens, first, last)
        stop, host_end = k, end  # the domain's last token, and where it ends in the text
        while stop + 1 < len(tokens) and tokens[stop + 1][0] == "word" and (stop == k or host_end == tokens[stop][1]) and (m := HOST.match(text, tokens[stop + 1][1], tokens[stop + 1][2])):
            stop, host_end = stop + 1, m.end()
            if host_end == tokens[stop][2] and stop + 2 < len(tokens) and tokens[stop + 1][0] == "dot" and tokens[stop + 2][0] == "word" and HOST.match(text, tokens[stop + 2][1]):
                stop, host_end = stop + 1, tokens[stop + 1][1]
        dots = [t for t in tokens[first : stop + 1] if t[0] == "dot"]
        if stop - k < 3:
            continue
        written = lambda t: text[t[1] : t[2]] in ("@", ".")
        ending = text[tokens[stop][1] : host_end].lower().rsplit("-", 1)[-1]
        bare = text[start:end].strip().lower() in AT
        # a bare word `at` counts only with a disguised dot and an ending of letters: "meet us at example.com" is no address
        if not bare or any(not written(t) for t in dots) and len(ending) > 1 and ending.isalpha() and ending not in NO_ENDING:
            edits += [(t[1], t[2], "@" if t[0] == "at" else ".") for t in tokens[first : stop + 1] if t[0] != "word" and not written(t)]
            edits += [(tokens[t][1], tokens[t][2], "") for t in range(spelled + 1, first, 2)]
            last = stop
    return sorted(edits)


def _spelled_out(text: str, tokens: list[tuple[str, int, int]], first: int, last: int) -> int:
    """The first token of an address whose name is spelled letter by letter (three at least) with single blanks between."""
    at = first
    one = lambda t: tokens[t][0] == "word" and tokens[t][2] - tokens[t][1] == 1
    while one(at) and at - 2 >= last and one(at - 2) and text[tokens[at - 1][1] : tokens[at - 1][2]] == " ":
        at -= 2
    return at if first - at >= 4 else first


def written(words: list[str]) -> str:
    """The digits and signs that words of a number stand for; `one hundred and ninety two` and `one ninety two` are 192."""
    out, kind, times = [], "", 1
    for w in words:
        if w in TIMES:
            kind, times = "", TIMES[w]
            continue
        if w in SPELLED:
            if kind in ("tens", "hundred") and SPELLED[w] != "0":
                out[-1], kind = out[-1][:-1] + SPELLED[w], ""
            else:
                out.append(SPELLED[w] * times)
                kind = "unit" if times == 1 else ""
        elif w in TENS:
            out[-1:] = [out[-1][:-2] + TENS[w]] if kind == "hundred" else [*out[-1:], TENS[w]]
            kind = "tens" if TENS[w] > "19" else ""
        elif w in HUNDRED:
            out[-1:] = [out[-1] + "00"] if kind == "unit" else [*out[-1:], "100"]
            kind = "hundred"
        else:
            out.append("+" if w in PLUS else "." if w == "." or w in DOT else w)
            kind = ""
        times = 1
    return "".join(out)


def _number_edits(text: str, pattern: re.Pattern = NUMBER) -> list[tuple[int, int, str]]:
    edits = []
    for m in pattern.finditer(text):
        if LETTER.search(m[0]):
            new = written([x.lower() for x in WORDS.findall(m[0])])
            if new.count(".") == 3 or sum(c.isdigit() for c in new) >= 9:
                edits.append((m.start(), m.end(), new))
    return edits


def _spoken(text: str, signed: bool) -> bool:
    """Whether a text may hold a number in words: two words of numbers with none between, or one and a digit or a sign anywhere."""
    said = [w in SPOKEN for w in LETTERS.findall(text.lower())]
    return True in said and (signed or any(a and b for a, b in zip(said, said[1:], strict=False)) or DIGIT.search(text) is not None)


def disguised(text: str, known: list[Span]) -> list[Span]:
    """Spans in the source of what only the rewritten text shows; those that overlap a known span of the kind are left.

    Numbers are read twice: as runs of words alone, then with digits among them, as digits beside a run may be no part of it."""
    strange = not text.isascii() and bool(FOLDED.search(text) or INVISIBLE.search(text))
    base = Rewritten(text)
    if strange:
        base.rewrite([(m.start(), m.end(), "") for m in INVISIBLE.finditer(base.text)])
        base.fold()
    signed = bool(SIGNS.search(base.text))
    spoken = _spoken(base.text, signed)
    if not (strange or spoken or signed):
        return []
    words = _number_edits(base.text) if spoken else []
    mixed = _number_edits(base.text, MIXED) if spoken or signed and DIGIT.search(base.text) else []
    found: list[Span] = []
    for edits in [words] if words == mixed else [words, mixed]:
        new = copy(base)
        new.rewrite(edits)
        if signed:
            new.rewrite(_address_edits(new.text))
        more = []
        for a, b, kind in plain(new.text):
            if any(new.changed[a:b]):
                start, end = new.starts[a], new.ends[b - 1]
                if not any(k == kind and s < end and start < e for s, e, k in [*known, *found]):
                    more.append((start, end, kind))
        found += more
    return found


def _order(span: tuple) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the union is replaced at once."""
    out, at = [], 0
    for start, end, kind in sorted(spans, key=_order):
        if start >= at:
            out += (text[at:start], f"[{kind.upper()}]")
        at = max(at, end)
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())]))


def find(docs: DataFrame, redact: bool = False) -> DataFrame:
    """docs and spans, a sorted array of (start, end, kind, base) in code points; with redact, text has them masked.

    base marks spans of the plain patterns. Null text has no spans and stays null. The column is named spans or, where
    docs has one, spans_; other columns pass unchanged. Each row is looked at alone, so repeated rows all stay.
    """
    name = fresh(docs, "spans")[0]
    columns = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            texts, spans = batch.column("text").to_pylist(), []
            for k, text in enumerate(texts):
                base = plain(text) if text else []
                more = disguised(text, base) if text else []
                marked = [*((*s, True) for s in base), *((*s, False) for s in more)]
                spans.append([{"start": a, "end": b, "kind": kind, "base": known} for a, b, kind, known in sorted(marked, key=_order)])
                if redact and spans[-1]:
                    texts[k] = mask(text, [*base, *more])
            arrays = [pa.array(texts, pa.string()) if redact and c == "text" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(spans, _SPANS)], [*columns, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(scan, f"{schema}, {name} array<struct<start:int,end:int,kind:string,base:boolean>>")
