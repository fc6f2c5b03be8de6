"""Offset-preserving deobfuscation and detection of personal data.

Two transducers normalise a text and keep, for every normalised character, the span of source
characters that it stands for.  The first folds one character to one (full-width and other
digits, Cyrillic and Greek lookalikes, variants of @ and the full stop).  The second rewrites
stretches: invisible characters vanish, ``(at)``, `` at `` before a domain and ``(dot)``, `` dot ``
become signs, spelled digits become digits and the blanks between them vanish.  Detectors
run on the normalised text and their spans are mapped back.

Texts are first screened by one regular expression on the whole Arrow column, which holds a
trigger for every detector and every rewriting; a text without any trigger has no finding.

Cases: a null or empty text has no findings; a null id stays null in them, and an id that is no whole number counts as null;
repeated rows are reported each; a very long text is searched whole; of overlapping detections the earlier kind of
``DETECTORS`` wins; other columns, whatever their names, are ignored; an empty table has no findings.
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from engramite.llm import textops
from engramite.llm.common import ident, spread, string

_LOOKALIKES = dict(
    zip(
        "аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅαοριτυνκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ‐‑‒–—−․。．﹒＠﹫",
        "aeopcyxijshdqwABEKMHOPCTYXIJSaopituvkABEZHIKMNOPTYX------....@@",
        strict=True,
    )
)


def _fold_table() -> dict[int, str]:
    table = {ord(a): b for a, b in _LOOKALIKES.items()}
    for code in [*range(0xFF01, 0xFF5F), *range(0x1D7CE, 0x1D800), *range(0x2460, 0x2469), *range(0x2070, 0x207A), *range(0x2080, 0x208A), *range(0xB2, 0xB4), 0xB9]:
        plain = unicodedata.normalize("NFKC", chr(code))
        if len(plain) == 1 and plain.isascii():
            table[code] = plain
    # the decimal digits of all scripts
    table |= {code: str(value) for code in range(0x80, 0x110000) if (value := unicodedata.decimal(chr(code), None)) is not None}
    return table


FOLD = _fold_table()
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9", "zéro": "0", "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9"}
_SPELLED = "(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + ")"
_OPEN, _CLOSE = r"[\(\[\{<]", r"[\)\]\}>]"
_DOT = rf"(?:[ \t]*{_OPEN}[ \t]*(?:dot|\.)[ \t]*{_CLOSE}[ \t]*|[ \t]+dot[ \t]+)"
_AT = rf"(?:[ \t]*{_OPEN}[ \t]*(?:at|@)[ \t]*{_CLOSE}[ \t]*|[ \t]+at[ \t]+|[ \t]+@[ \t]+|[ \t]+@|@[ \t]+)"
_HOST = r"(?!(?i:dot)\b)[A-Za-z0-9-]+"
#: A disguised address: an at of some kind, then host parts joined by dots of some kind.
_ADDRESS = re.compile(rf"(?i)(?<=[A-Za-z0-9])(?:@|{_AT})(?![A-Za-z0-9._%+-]*@)(?={_HOST}(?:(?:\.|{_DOT}){_HOST})+)")
_BARE_AT = re.compile(r"(?i)[ \t]+at[ \t]+")
_PLAIN_HOST = re.compile(r"[A-Za-z0-9-]+\.[A-Za-z0-9]")
#: Words that come before the preposition: "look at example.com" is no address, "jane at example.com" is one.
_BEFORE_AT = frozenset("me us him her them it you here there is are was were be been am and or not now look looks looked looking meet met see seen saw visit found find live lives online hosted available located page site website blog shop store read more out up arrive arrived stay stayed stop".split())
_LAST_WORD = re.compile(r"[A-Za-z]+$")
_DOTS = re.compile(rf"(?i)(?<=[A-Za-z0-9]){_DOT}(?=[A-Za-z0-9])")
_HOSTS = re.compile(rf"(?i){_HOST}(?:(?:\.|{_DOT}){_HOST})*")
_NAME = re.compile(r"[A-Za-z0-9._%+-]+")
_SPELLED_RUN = re.compile(rf"(?i)(?<![^\W\d_])(?:{_SPELLED}|(?<![\d])\d(?!\d))(?:[ \t,-]{{1,3}}(?:{_SPELLED}|\d(?!\d))){{6,}}(?![^\W_])")
_SPELLED_ONE = re.compile(rf"(?i){_SPELLED}|\d")

_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])")
_CARD = re.compile(r"(?<![0-9.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]|[.-][0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IP = re.compile(r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_PHONE = re.compile(r"(?<![0-9.\w])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9]|[.-][0-9])|(?<![0-9.\w])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,5}(?![0-9]|[.-][0-9])")


def _luhn(found: str) -> bool:
    digits = [int(c) for c in found if c.isdigit()]
    total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
    return 13 <= len(digits) <= 19 and total % 10 == 0 and len(set(digits)) > 1


def _iban(found: str) -> bool:
    plain = found.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _ip(found: str) -> bool:
    try:
        return bool(ipaddress.IPv4Address(found))
    except ValueError:
        return False


DETECTORS = (("email", _EMAIL, None), ("iban", _IBAN, _iban), ("card", _CARD, _luhn), ("ip", _IP, _ip), ("ssn", _SSN, None), ("phone", _PHONE, None))


def _ranges(codes: list[int]) -> str:
    """An RE2 class's inside of these characters."""
    codes, out = sorted(set(codes)), []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


#: RE2: what a text must hold for any detector or rewriting to have a say.  Digits of other scripts and
#: lookalikes are triggers of their own, since what they fold to isn't known to RE2.
_FOLDED = _ranges([*FOLD, *map(ord, _INVISIBLE)])
SCREEN = (
    rf"@|[{_FOLDED}]|\b(?i:at)\b[ \t\)\]\}}>]+[A-Za-z0-9-]+(?:\.[A-Za-z0-9]|[ \t]*[\(\[\{{<]?[ \t]*(?i:dot)\b)|{_OPEN}[ \t]*(?i:at|dot)[ \t]*{_CLOSE}"
    rf"|[0-9][ ().,\t-]{{0,3}}[0-9](?:[ ().,\t-]{{0,3}}[0-9]){{2,}}|[A-Z]{{2}}[0-9]{{2}} ?[A-Z0-9]{{4}}|(?i:{_SPELLED}[ \t,-]{{1,3}}(?:[0-9]|{_SPELLED})[ \t,-]{{1,3}}(?:[0-9]|{_SPELLED}))|(?i:[0-9][ \t,-]{{1,3}}{_SPELLED}[ \t,-]{{1,3}}(?:[0-9]|{_SPELLED}))"
)


class Mapped:
    """A text under rewriting and the source span of each of its characters."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.start = np.arange(len(text), dtype=np.int64)
        self.end = self.start + 1

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces disjoint spans in order; the new characters stand for the whole span."""
        if not edits:
            return
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts += [self.start[at:a], np.full(len(new), self.start[a] if b > a else 0)]
            ends += [self.end[at:a], np.full(len(new), self.end[b - 1] if b > a else 0)]
            at = b
        text.append(self.text[at:])
        self.text = "".join(text)
        self.start, self.end = np.concatenate([*starts, self.start[at:]]), np.concatenate([*ends, self.end[at:]])


def _disguised(m: re.Match) -> bool:
    """Whether a match of ``_ADDRESS`` has to be rewritten and isn't just the preposition."""
    if m.group() == "@":
        return False
    if _BARE_AT.fullmatch(m.group()) and _PLAIN_HOST.match(m.string, m.end()):
        before = _LAST_WORD.search(m.string[max(0, m.start() - 20) : m.start()])
        return not before or before.group().lower() not in _BEFORE_AT
    return True


def _dots(text: str) -> list[tuple[int, int, str]]:
    """The disguised dots of addresses, which extend from an at over parts joined by dots of any kind, and those close to an at."""
    found = [m.span() for m in _DOTS.finditer(text)]
    starts, chosen = [a for a, _ in found], {k for k, (a, b) in enumerate(found) if "@" in text[max(0, a - 80) : b + 80]}
    at = text.find("@") if found else -1
    while at >= 0:
        if m := _HOSTS.match(text, at + 1):
            chosen.update(range(bisect_left(starts, at), bisect_left(starts, m.end())))
        end = at
        for k in range(bisect_left(starts, at) - 1, -1, -1):
            if not _NAME.fullmatch(text, found[k][1], end):
                break
            chosen.add(k)
            end = found[k][0]
        at = text.find("@", at + 1)
    return [(*found[k], ".") for k in sorted(chosen)]


def normalised(source: str) -> Mapped:
    """The text after both transducers."""
    mapped = Mapped(source)
    if not source.isascii():
        mapped.text = source.translate(FOLD)
        mapped.rewrite([(m.start(), m.end(), "") for m in re.finditer(f"[{_INVISIBLE}]+", mapped.text)])
    mapped.rewrite([(m.start(), m.end(), "@") for m in _ADDRESS.finditer(mapped.text) if _disguised(m)])
    if "@" in mapped.text:
        mapped.rewrite(_dots(mapped.text))
    edits = []
    for m in _SPELLED_RUN.finditer(mapped.text):
        at = m.start()
        for one in _SPELLED_ONE.finditer(mapped.text, m.start(), m.end()):
            if one.start() > at:
                edits.append((at, one.start(), ""))
            edits.append((one.start(), one.end(), _DIGITS.get(one.group().lower(), one.group())))
            at = one.end()
    mapped.rewrite(edits)
    return mapped


def detect(source: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, normalised value) by source characters, in order."""
    mapped = normalised(source)
    taken: list[tuple[int, int]] = []  # disjoint, in order
    found = []
    for kind, pattern, valid in DETECTORS:
        for m in pattern.finditer(mapped.text):
            a, b = m.span()
            at = bisect_left(taken, (a, b))
            free = (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0])
            if free and (valid is None or valid(m.group())):
                taken.insert(at, (a, b))
                found.append((kind, int(mapped.start[a]), int(mapped.end[b - 1]), m.group()))
    return sorted(found, key=lambda f: (f[1], f[2]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in textops.slices(batches, "text"):
        part = part.filter(pc.fill_null(pc.match_substring_regex(part.column("text"), SCREEN), False))
        rows = [(doc, *f) for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) for f in detect(text)]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "kind", "start", "end", "value"])


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start, end, value): every identifier, by source characters, with its normalised form."""
    rows = spread(docs.select(ident(id_col).alias("doc_id"), string(text_col).alias("text")).where("text IS NOT NULL"))
    return rows.mapInArrow(_find, "doc_id long, kind string, start int, end int, value string")
