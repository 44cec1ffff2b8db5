"""Personal data in whole texts: plain identifiers, and disguised ones found after normalising.

Transducers rewrite a text step by step: look-alike characters to ASCII, invisible ones to nothing, runs of
spelled digits to digits, disguised `at` and `dot` to the signs. Each step keeps its edits, so a span in
the rewritten text maps back to the characters of the source, edit by edit. Spans that need an edit are
added to the plain ones; a plain span is never changed. An added span overlaps plain ones of its kind only where
it is larger: a disguise within an identifier often leaves a part of it that looks plain by itself.

Per kind, plain spans are leftmost and do not overlap; a match that fails its check (octets up to 255, 16 to
19 digits with a right Luhn sum, 8 to 15 digits of a phone number) is dropped without another try.

Defined cases: a null text counts as empty and has no spans. A spelled digit counts only in a run of three
or more, plain digits beside it included. A spaced `@` counts before any host with a disguised dot or an ending that
begins with a letter; `at` between blanks only before a disguised dot, or before such an ending if the word in
front ends in a part after one of `._%+-` or has a digit after a letter, or follows a word of `_CUE` (`look at example.com` is no address). Positions are code points, the
end exclusive. Repeated rows and null ids are answered row by row; an empty table gives an empty result;
other columns are not read. No step's time grows with the square of a text's length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.common import map_rows, plain_columns

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A number of an address cannot begin inside a run of digits, so each run is tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            done = host.end()
            yield start, done
        else:
            done = at + 1  # no local part reaches over this sign
        at = text.find("@", max(done, at + 1))


def _ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(int((part.lstrip("0") or "0")[:4]) <= 255 for part in m[0].split(".")):
            yield m.span()


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def detect(text: str) -> dict[str, list[Span]]:
    """Plain spans by kind."""
    digits = _DIGIT.search(text) is not None
    return {
        "email": list(_emails(text)) if "@" in text else [],
        "ip": list(_ips(text)) if digits else [],
        "card": list(_cards(text)) if digits else [],
        "phone": list(_phones(text)) if digits and "+" in text else [],
    }


class Rewritten:
    """A text after some edits, which remembers where each part came from."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        parts, at, size = [], 0, 0
        self.starts, self.ends, self.sources = [], [], []
        for start, end, new in edits:
            parts += [source[at:start], new]
            size += start - at
            self.starts.append(size)
            size += len(new)
            self.ends.append(size)
            self.sources.append((start, end))
            at = end
        self.text = "".join([*parts, source[at:]])

    def back(self, span: Span) -> Span:
        return self._source(span[0])[0], self._source(span[1] - 1)[1]

    def _source(self, at: int) -> Span:
        k = bisect_right(self.starts, at) - 1  # of edits at one place, the last one holds a character
        if k < 0:
            return at, at + 1
        if at < self.ends[k]:
            return self.sources[k]
        shift = self.sources[k][1] - self.ends[k]
        return at + shift, at + shift + 1

    def touched(self, span: Span) -> bool:
        """Whether an edit lies within the span (a deletion at its edge does not count)."""
        k = bisect_left(self.ends, span[0] + 1)
        return k < len(self.starts) and self.starts[k] < span[1]


# Characters that look like ASCII ones, from the Unicode confusables, in code point order.
_LOOKALIKES = dict(
    zip(
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχЅІЈАВЕКМНОРСТХаеорсухѕіјԁԛԝ",
        "ABEZHIKMNOPTYXaiknopuxSIJABEKMHOPCTXaeopcyxsijdqw",
        strict=True,
    )
)
_LOOKALIKES |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_LOOKALIKES |= {" ": " ", " ": " ", " ": " ", "　": " ", "․": ".", "。": ".", "｡": ".", "﹒": ".", "﹫": "@"}
_LOOKALIKES |= dict.fromkeys("‐‑‒–—−", "-")
_LOOKALIKES |= dict.fromkeys("­​‌‍‎‏⁠﻿", "")
_LOOKALIKES |= {chr(zero + d): str(d) for zero in (0x660, 0x6F0, 0x966, 0x9E6, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
_LOOKALIKE = re.compile("[" + re.escape("".join(_LOOKALIKES)) + "]")

_NUMBERS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_NUMBER = "(?:" + "|".join(_NUMBERS) + ")"
_SPELLED = re.compile(rf"(?i)(?<![a-z])(?:plus[ -])?{_NUMBER}(?:[ ,-]{{1,2}}{_NUMBER}|[ ,-]{{1,2}}dot[ ,-]{{1,2}}{_NUMBER})*(?![a-z])")
_BESIDE = 24  # characters before and after a spelled run in which plain digits beside it count
_DIGITS_BEFORE = re.compile(r"[0-9][0-9 ,().-]*[ ,-]$")
_DIGITS_AFTER = re.compile(r"[ ,-]{1,2}[0-9][0-9 ,().-]*")
_SPELLED_PART = re.compile(rf"(?i)plus[ -]|{_NUMBER}|[ ,-]+dot[ ,-]+|[ ,-]+")
_BRACKETED = re.compile(r"(?i)\s{0,3}(?:\[\s?(at|dot|@|\.)\s?\]|\(\s?(at|dot|@|\.)\s?\)|\{\s?(at|dot|@|\.)\s?\}|<\s?(at|dot|@|\.)\s?>)\s{0,3}")
_BARE = re.compile(r"(?i)(?<=[A-Za-z0-9._%+-])(\s{1,3}at\s{1,3}|\s{0,3}@\s{0,3})(?=[A-Za-z0-9])[A-Za-z0-9-]++(?:(?:\.|\s{1,3}dot\s{1,3})[A-Za-z0-9-]++)+")
_DOT = re.compile(r"(?i)\s{1,3}dot\s{1,3}")
_ENDING = re.compile(r"\.[A-Za-z][A-Za-z0-9-]+\Z")
_CUE = re.compile(r"(?i)\b(?:e-?mail|mailto|mail to|write to|contact|address is)(?:\s{0,3}:)?\s{1,3}(?!(?:us|me|him|her|them)\Z)[a-z0-9._%+-]{1,64}\Z")
_NAME = re.compile(r"(?:[A-Za-z0-9][._%+-]+[A-Za-z0-9]+|[A-Za-z][0-9]+[A-Za-z]*)\Z")
_LOCAL_DOT = re.compile(r"(?i)(?<=[a-z0-9])\s{1,3}dot\s{1,3}(?=[a-z0-9._%+-]{1,64}@)")
_SIGN = {"at": "@", "@": "@", "dot": ".", ".": "."}


def _lookalikes(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _LOOKALIKE.finditer(text):
        yield m.start(), m.end(), _LOOKALIKES[m[0]]


def _spelled(text: str) -> Iterator[tuple[int, int, str]]:
    for run in _SPELLED.finditer(text):
        parts = [(m.start(), m.end(), m[0].lower()) for m in _SPELLED_PART.finditer(text, run.start(), run.end())]
        before = _DIGITS_BEFORE.search(text[max(0, run.start() - _BESIDE) : run.start()])
        after = _DIGITS_AFTER.match(text[run.end() : run.end() + _BESIDE])
        beside = sum(len(_NO_DIGIT.sub("", m[0])) for m in (before, after) if m)
        if beside + sum(p[2] in _NUMBERS for p in parts) >= 3:
            for start, end, part in parts:
                yield start, end, _NUMBERS.get(part) or ("+" if "plus" in part else "." if "dot" in part else "")


def _bracketed(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _BRACKETED.finditer(text):
        yield m.start(), m.end(), _SIGN[m[m.lastindex].lower()]


def _bare(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _BARE.finditer(text):
        dots = list(_DOT.finditer(text, m.end(1), m.end()))
        sign = m[1].lower()
        spaced = sign != "@" and _ENDING.search(m[0]) is not None
        if dots or spaced and ("@" in sign or _names(text, m.start(1))):
            yield m.start(1), m.end(1), "@"
            yield from ((d.start(), d.end(), ".") for d in dots)


def _names(text: str, end: int) -> bool:
    """Whether the word that ends here looks like the local part of an address."""
    near = text[max(0, end - 96) : end]
    return _NAME.search(near) is not None or _CUE.search(near) is not None


def _local_dots(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _LOCAL_DOT.finditer(text):
        yield m.start(), m.end(), "."


TRANSDUCERS: tuple[Callable[[str], Iterator[tuple[int, int, str]]], ...] = (_lookalikes, _spelled, _bracketed, _bare, _local_dots)

#: What a text must contain for any transducer to act; checked by a linear-time matcher on whole batches.
_HINT = (
    r"[\x{a0}\x{ad}\x{370}-\x{10ffff}]"  # not under (?i), which would add letters that fold into it
    r"|(?i:[\[({<]\s?(?:at|dot|@|\.)\s?[\])}>]|\sdot\s|\s@|@\s|[a-z0-9._%+-]\s{1,3}at\s{1,3}[a-z0-9-]+\."
    rf"|[0-9][ ,().-]*[ ,-](?:plus[ -])?{_NUMBER}|{_NUMBER}[ ,-]{{1,2}}[0-9]"
    rf"|{_NUMBER}[ ,-]{{1,2}}(?:dot[ ,-]{{1,2}})?{_NUMBER}[ ,-]{{1,2}}(?:dot[ ,-]{{1,2}})?{_NUMBER})"
)


def disguised(text: str, plain: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """The spans of `hidden` that overlap no plain span of their kind."""
    return {kind: [s for s in spans if not _overlapped(plain[kind], s)] for kind, spans in hidden(text, plain).items()}


def _overlapped(spans: list[Span], span: Span) -> list[Span]:
    """Those of the sorted, disjoint spans that overlap the span."""
    low = bisect_left(spans, span[0] + 1, key=lambda s: s[1])
    return spans[low : bisect_left(spans, span[1], key=lambda s: s[0])]


def hidden(text: str, plain: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans by kind that only the rewritten text shows; each is larger than every plain span of its kind that it overlaps."""
    steps: list[Rewritten] = []
    now = text
    for transducer in TRANSDUCERS:
        edits = list(transducer(now))
        if edits:
            steps.append(Rewritten(now, edits))
            now = steps[-1].text
    found: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    if not steps:
        return found
    for kind, spans in detect(now).items():
        for span in spans:
            edited = False
            for step in reversed(steps):
                edited = edited or step.touched(span)
                span = step.back(span)
            size = span[1] - span[0]
            if edited and all(end - start < size for start, end in _overlapped(plain[kind], span)):
                found[kind].append(span)
    return found


def _line(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind in KINDS for start, end in sorted(spans[kind]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.fill_null(batch["text"], "")
        hints = pc.match_substring_regex(texts, _HINT).to_pylist()
        counts: dict[str, list[int]] = {kind: [] for kind in KINDS}
        digests, lines, added = [], [], []
        for text, hint in zip(texts, hints, strict=True):
            text = text.as_py()
            plain = detect(text)
            more = hidden(text, plain) if hint else dict.fromkeys(KINDS, [])
            for kind in KINDS:
                counts[kind].append(len(plain[kind]))
            digests.append(hashlib.sha256(_line(plain).encode()).hexdigest())
            lines.append(_line({kind: plain[kind] + more[kind] for kind in KINDS}))
            added.append(sum(map(len, more.values())))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(digests, pa.string()), pa.array(lines, pa.string()), pa.array(added, pa.int64())],
            ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"],
        )


def find_pii(docs: DataFrame) -> DataFrame:
    """Per document: n_email, n_ip, n_card, n_phone and base_sha256 of the plain spans, all spans, number added."""
    rows = plain_columns(docs, "doc_id", "text")
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(_find, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {counts}, base_sha256 string, spans string, n_added long")


def _mask(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column(place).to_pylist():
            plain = detect(text or "")
            more = hidden(text or "", plain)
            spans = sorted((*span, kind) for kind in KINDS for span in plain[kind] + more[kind])
            parts, at = [], 0
            for start, end, kind in spans:  # where kinds overlap, the earlier one names the part
                if end > at:
                    parts += [(text or "")[at : max(at, start)], f"[{kind}]" if start >= at else ""]
                    at = end
            out.append(None if text is None else "".join([*parts, text[at:]]))
        yield pa.RecordBatch.from_arrays([pa.array(out, c.type) if i == place else c for i, c in enumerate(batch.columns)], batch.schema.names)


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets; all columns stay."""
    place = docs.columns.index("text")
    return map_rows(docs, lambda batches: _mask(batches, place))
