"""Personal data in whole texts, with spans in the text's own code points.

The base kinds are found by fixed expressions on the text as it stands. Then a chain of transducers rewrites disguised
text - look-alike letters and digits, spelled digits, bracketed or spaced-out "at" and "dot" - and keeps, for every
character it puts out, the source span it stands for. Identifiers found in the rewritten text are mapped back through
those spans; one that overlaps no base span is added.

Every scan is linear in the text: expressions start at the first character of a run, or are read backwards from the one
character they must hold, so a megabyte of digits, letters or blanks costs no more than prose.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.common import bounded_batches, pick

# The order of kinds, and the base expressions in a form that starts once in a run of digits. An email is
# its part before the "@", read backwards from there, and _DOMAIN after it.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Spelled digits in English, German, French and Spanish, and Cyrillic and Greek look-alikes of Latin letters.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
ALIKE = dict(zip("АВЕКМНОРСТХаеорсухіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοντυ", "ABEKMHOPCTXaeopcyxijsdhqwABEZHIKMNOPTYXovtu", strict=True))
#: A run of spelled digits this long or longer is read as digits; shorter runs are words.
LEAST_SPELLED = 7


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _before(text: str, at: int, least: int) -> int:
    """Where the run of _LOCAL characters that ends at ``at`` begins, ``least`` at the earliest."""
    while at > least and text[at - 1] in _LOCAL:
        at -= 1
    return at


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = _before(text, at, end)
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(end, at + 1))


def _byte(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def find_base(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end): leftmost non-overlapping matches per kind; a match that fails its test is dropped."""
    found = []
    if "@" in text:
        found += [(0, *span) for span in _emails(text)]
    if _DIGIT(text):
        found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(_byte, m[0].split(".")))]
        found += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


_DIGIT = re.compile("[0-9]").search


class Tape:
    """A string whose i-th character stands for source[start[i]:end[i]]."""

    def __init__(self, text: str, start: array | None = None, end: array | None = None):
        self.text = text
        self.start = array("q", range(len(text))) if start is None else start
        self.end = array("q", range(1, len(text) + 1)) if end is None else end

    def rewrite(self, matches: Iterator[re.Match], put) -> Tape:
        """Replace matches: ``put(match)`` gives the new text, or None to leave the match as it is. What replaces a match
        stands for the match's whole source span."""
        out, starts, ends, at = [], array("q"), array("q"), 0
        for m in matches:
            new = put(m)
            if new is None or new == m[0]:
                continue
            out.append(self.text[at : m.start()] + new)
            starts += self.start[at : m.start()] + array("q", [self.start[m.start()]]) * len(new)
            ends += self.end[at : m.start()] + array("q", [self.end[m.end() - 1]]) * len(new)
            at = m.end()
        return self if not out else Tape("".join(out) + self.text[at:], starts + self.start[at:], ends + self.end[at:])

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.start[start], self.end[end - 1]


def _alike(m: re.Match) -> str | None:
    c = ALIKE.get(m[0])
    if c is None:
        c = unicodedata.normalize("NFKC", m[0])
    return c if len(c) == 1 and " " <= c <= "~" else None


_name = "|".join(sorted(SPELLED, key=lambda w: (-len(w), w)))
_PARTS = re.compile(rf"\b(?:{_name})\b", re.I)
_RUN = re.compile(rf"\b(?:{_name})(?:[\s,.-]+(?:{_name}))+\b", re.I)
_ODD = re.compile("[" + "".join(ALIKE) + "！-～\U0001d400-\U0001d7ff①-⒛⁰-₉]")
# A disguise takes the blanks around it; those before it from their first on, or none if they went with another disguise.
_OPEN, _SHUT = r"(?:(?<!\s)\s*+|(?<=\s))[\[({<]\s*", r"\s*[\])}>]\s*"
_AT = re.compile(rf"{_OPEN}(?:at|@|arroba){_SHUT}", re.I)
_DOT = re.compile(rf"{_OPEN}(?:dot|\.|punkt|point|punto){_SHUT}", re.I)
# Last labels that make "a at b dot c" without brackets an address and not prose.
_LAST = "com|org|net|edu|gov|info|io|eu|de|fr|es|uk|ch|at|it|nl"
_SPACED = re.compile(rf"(?<! ) ++at ++[A-Za-z0-9-]+(?: +dot +[A-Za-z0-9-]+)* +dot +(?:{_LAST})\b", re.I)
_BARE = re.compile(r"(?<! ) ++(at|dot) ++", re.I)
_EDGE = re.compile(r"\b")
_WORDS = frozenset(SPELLED)


def _lower(text: str) -> str:
    """Lower case in which whatever re.I takes for a letter of a spelled digit is that letter."""
    return text.lower() if text.isascii() else text.lower().replace("\u017f", "s").replace("\u0131", "i").replace("i\u0307", "i")


def _may_hide(text: str) -> bool:
    """Whether any transducer could find something: a cheap test that keeps plain prose off the tapes."""
    if not text.isascii() and _ODD.search(text):
        return True
    if _BRACKETED.search(text):
        return True
    low = _lower(text)
    if " dot " in low:
        return True
    # Of a run of LEAST_SPELLED words all but the outer two stand between separators of _RUN.
    return b"\1\1\1" in bytes(map(_WORDS.__contains__, low.replace("-", " ").replace(",", " ").replace(".", " ").split()))


_BRACKETED = re.compile(r"[\[({<]\s*(?:at|@|dot|\.|arroba|punkt|point|punto)\s*[\])}>]", re.I)


def _spelled(m: re.Match) -> str | None:
    words = _PARTS.findall(m[0])
    return "".join(SPELLED[_lower(w)] for w in words) if len(words) >= LEAST_SPELLED else None


def _spaced(text: str) -> Iterator[re.Match]:
    """The bare "at" and "dot" of every address spelled with blanks."""
    end = 0
    for m in _SPACED.finditer(text):
        edge = _EDGE.search(text, _before(text, m.start(), end), m.start())
        if edge and edge.start() < m.start():
            end = m.end()
            yield from _BARE.finditer(text, m.start(), end)


def deobfuscate(text: str) -> Tape:
    """The transducers in order; a text without any disguise comes back as it is."""
    tape = Tape(text)
    tape = tape.rewrite(_ODD.finditer(tape.text), _alike)
    tape = tape.rewrite(_AT.finditer(tape.text), lambda m: "@")
    tape = tape.rewrite(_DOT.finditer(tape.text), lambda m: ".")
    tape = tape.rewrite(_spaced(tape.text), lambda m: "@" if m[1].lower() == "at" else ".")
    return tape.rewrite(_RUN.finditer(tape.text), _spelled)


def find_all(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each sorted by kind and start, in the text's own code points."""
    base = find_base(text)
    spans = list(base)
    if _may_hide(text):
        tape = deobfuscate(text)
        if tape.text != text:
            taken = bytearray(len(text))
            for _, a, b in base:
                taken[a:b] = b"\1" * (b - a)
            for kind, start, end in find_base(tape.text):
                a, b = tape.source(start, end)
                # Only disguises are new: what reads the same in the source was the base rules' to judge.
                if text[a:b] != tape.text[start:end] and taken.find(1, a, b) < 0:
                    spans.append((kind, a, b))
                    taken[a:b] = b"\1" * (b - a)
    return sorted(base), sorted(spans)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long, n_found long"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _SCHEMA.split(", ")]
    for b in batches:
        rows = []
        for text in b.column("text").to_pylist():
            base, spans = find_all(text or "")
            counts = [sum(k == kind for k, _, _ in base) for kind in range(4)]
            rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans) - len(base), len(spans)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names)


def find_pii(documents: DataFrame) -> DataFrame:
    """One row per input row: doc_id, base matches per kind, base_sha256, spans (base and added), n_disguised (added),
    n_found (all).

    Null text counts as empty. Repeated rows give repeated results; an empty table an empty one. Columns besides doc_id
    and text are not read.
    """
    bounded_batches(documents.sparkSession)
    return pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(_find, _SCHEMA)
