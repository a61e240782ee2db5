"""Personal data in text, plain or disguised, with spans in the characters of the source.

Plain identifiers are found by four detectors. For disguised ones a chain of transducers rewrites the text
(look-alike characters, spelled digits, written-out "at" and "dot") and records every rewrite, so that what the
detectors find in the rewritten text maps back to code points of the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame

from cohort.llm.batches import over_batches, texts_of

KINDS = ("email", "ip", "card", "phone")
ORDER = {kind: n for n, kind in enumerate(KINDS)}

# An address is looked for from its @, whose left side is one run of characters; that keeps the search linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Characters that look like Latin letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H",
    "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "α": "a", "ο": "o", "ν": "v",
    "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɑ": "a", "ɡ": "g",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "·": ".",
}

# Digits in words, and words for signs, in English, German, French and Spanish.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
SIGNS = {"plus": "+", "dot": ".", "point": ".", "punkt": ".", "punto": ".", "dash": "-", "hyphen": "-"}

_WORD = "|".join(sorted([*SPELLED, *SIGNS], key=len, reverse=True))
# A run of at least four spelled digits or signs; single digits may stand among them.
_RUN = re.compile(rf"(?<!\w)(?:(?:{_WORD}|[0-9]{{1,4}})[ ,-]{{1,2}}){{3,}}(?:{_WORD}|[0-9]{{1,4}})(?!\w)", re.IGNORECASE)
_SPOKEN = frozenset([*SPELLED, *SIGNS])
_PART = re.compile(r"\w+|[^\w]+")
_BRACKETED = re.compile(r"[(\[{<][ ]{0,2}(at|@|arroba|chez|dot|punkt|punto|point|\.)[ ]{0,2}[)\]}>][ ]{0,2}", re.IGNORECASE)
# Unbracketed words count only as a whole address: a name, "at", a host, and "dot" with the rest of the domain.
_WORDY = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}( at )[A-Za-z0-9-]{1,63}((?: dot [A-Za-z0-9-]{1,63}){1,4})", re.IGNORECASE)
_DOT = re.compile(r" dot ", re.IGNORECASE)
# What the last part of a domain in words may be.
ENDINGS = frozenset("com net org edu gov mil int info biz io ai app dev co uk us eu de fr es it nl ch at be pl se no dk fi pt ie ca au nz in jp cn br mx ru".split())


def _plain_forms() -> dict[int, str | None]:
    """Characters whose compatibility form is one ASCII character, and characters of no width (dropped)."""
    table: dict[int, str | None] = {ord(k): v for k, v in LOOK_ALIKES.items()}
    for lo, hi in ((0x660, 0x670), (0x6F0, 0x6FA), (0x966, 0x970), (0x2070, 0x20A0), (0x2100, 0x2190), (0x2460, 0x2500), (0xFE50, 0xFE70), (0xFF01, 0xFF5F), (0x1D400, 0x1D800)):
        for code in range(lo, hi):
            digit = unicodedata.decimal(chr(code), None)
            form = str(digit) if digit is not None else unicodedata.normalize("NFKC", chr(code))
            if len(form) == 1 and form.isascii():
                table.setdefault(code, form)
    return table | {code: None for code in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)}


PLAIN_FORMS = _plain_forms()
_ODD = frozenset(map(chr, PLAIN_FORMS))

Span = tuple[int, int, str]


def _luhn(digits: str) -> bool:
    doubled = [int(d) * 2 if n % 2 else int(d) for n, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def detect(text: str) -> list[Span]:
    """Plain identifiers, leftmost and non-overlapping within each kind, by start and then kind."""
    found: list[Span] = []
    end = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                end = m.end()
                found.append((start, end, "email"))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m.group())) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]], s[1]))


class Rewrite:
    """A text, its rewritten form, and the way back from places in the form to places in the text."""

    def __init__(self, text: str) -> None:
        self.text, self.form = text, text
        self._maps: list[tuple[list[int], list[tuple[int, int, int]]]] = []

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace stretches of the current form; edits are in order and do not overlap."""
        if not edits:
            return
        out, starts, pieces, at, size = [], [], [], 0, 0
        for start, end, new in edits:
            out += [self.form[at:start], new]
            size += start - at
            starts.append(size)
            pieces.append((start, end, len(new)))
            size += len(new)
            at = end
        out.append(self.form[at:])
        self.form = "".join(out)
        self._maps.append((starts, pieces))

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The stretch of the source that a stretch of the form comes from."""
        for starts, pieces in reversed(self._maps):
            start, end = self._back(starts, pieces, start, False), self._back(starts, pieces, end, True)
        return start, end

    @staticmethod
    def _back(starts: list[int], pieces: list[tuple[int, int, int]], at: int, is_end: bool) -> int:
        n = bisect_right(starts, at - 1 if is_end else at) - 1
        if n < 0:
            return at
        start, end, size = pieces[n]
        inside = at - starts[n]
        if inside < size or (is_end and inside == size):
            return end if is_end else start
        return end + inside - size


def _plain_edits(text: str) -> list[tuple[int, int, str]]:
    if _ODD.isdisjoint(set(text)):
        return []
    return [(n, n + 1, PLAIN_FORMS[ord(c)] or "") for n, c in enumerate(text) if c in _ODD]


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _RUN.finditer(text):
        parts, out, words = _PART.findall(m.group()), [], 0
        for n, part in enumerate(parts):
            low = part.lower()
            if low in SPELLED or low in SIGNS:
                words += low in SPELLED
                out.append(SPELLED.get(low) or SIGNS[low])
            elif part.isdigit():
                out.append(part)
            elif not (_joins(parts, n - 1) and _joins(parts, n + 1)):
                out.append(part)
        if words >= 4:
            edits.append((m.start(), m.end(), "".join(out)))
    return edits


def _joins(parts: list[str], n: int) -> bool:
    """A spelled digit or sign draws its neighbours close: the separator between two of them goes."""
    return parts[n].lower() in SPELLED or parts[n].lower() in SIGNS


def _sign_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _BRACKETED.finditer(text):
        start = m.start() - min(2, len(text[max(0, m.start() - 2) : m.start()]) - len(text[max(0, m.start() - 2) : m.start()].rstrip(" ")))
        edits.append((start, m.end(), "@" if m.group(1).lower() in ("at", "@", "arroba", "chez") else "."))
    for m in _WORDY.finditer(text) if " at " in text.lower() and " dot " in text.lower() else ():
        if _DOT.split(m.group(2))[-1].lower() not in ENDINGS:
            continue
        edits.append((m.start(1), m.end(1), "@"))
        edits += [(m.start(2) + d.start(), m.start(2) + d.end(), ".") for d in _DOT.finditer(m.group(2))]
    edits.sort()
    return [e for n, e in enumerate(edits) if n == 0 or e[0] >= edits[n - 1][1]]


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Identifiers that only show, or only show whole, once disguises are undone; none inside a plain one of its kind."""
    rewrite = Rewrite(text)
    if not text.isascii():
        rewrite.apply(_plain_edits(rewrite.form))
    low = rewrite.form.lower()
    words = low.replace(",", " ").replace("-", " ").split()
    spoken = list(map(_SPOKEN.__contains__, words))
    if sum(spoken) >= 4 and any(map(and_, spoken, spoken[1:])):
        rewrite.apply(_spelled_edits(rewrite.form))
    if " dot " in low or any(c in low for c in "([{<"):
        rewrite.apply(_sign_edits(rewrite.form))
    if rewrite.form == text:
        return []
    added = []
    for start, end, kind in detect(rewrite.form):
        a, b = rewrite.source(start, end)
        if text[a:b] != rewrite.form[start:end] and not any(k == kind and s <= a and b <= e for s, e, k in base):
            added.append((a, b, kind))
    return added


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


SCHEMA = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_disguised", pa.int64())])


def _scan(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in SCHEMA}
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            text = text or ""
            base = detect(text)
            added = disguised(text, base)
            every = sorted(base + added, key=lambda s: (s[0], ORDER[s[2]], s[1])) if added else base
            out["doc_id"].append(doc_id)
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(k == kind for _, _, k in base))
            out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out["spans"].append(_joined(every))
            out["n_disguised"].append(len(added))
        yield out


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts of plain identifiers, a digest of their spans, and all spans.

    A null or empty text has no spans. Rows are independent: repeated ids or texts give a row each, in one pass
    without a shuffle. Spans are code points of the source, end exclusive.
    """
    return over_batches(texts_of(docs), _scan, SCHEMA)
