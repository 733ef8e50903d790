"""Personal data: exact detectors, and offset-preserving deobfuscation.

`base_spans` finds e-mail addresses, IPv4 addresses, payment cards and phone numbers in the text as it is.
The deobfuscator runs the text through three transducers, each of which rewrites it and keeps for every character
of its output the source range it came from:

1. glyphs: look-alike letters and digits become ASCII, invisible characters vanish, and O, o, l, I in a group that is mostly digits become 0 and 1;
2. spelled digits: a run of number words ("four one one one", "plus one five ...") becomes digits;
3. at/dot: "[at]", "(dot)", "name at host dot tld", "name @ host" become the plain signs.

The detectors run again on the rewritten text, and what they find there is mapped back to the source.  A mapped span is
added unless it touches a base span that it doesn't strictly contain.  Base spans always stay.

Defined results: null or empty text has no spans (counts 0, `spans` empty, hash of the empty string); each
repeated row gets its own equal result; an empty table gives an empty result; other columns are ignored.  Overlaps between
kinds are all kept.  Offsets are code points, end exclusive.  A text is handled whole; every pattern is anchored at a sign, bracket or word and
walks outwards, so the time is linear in the length.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import BLANK_WORDS, LOWER, Words, as_table, flat, slices, span_hashes

KINDS = ("email", "ip", "card", "phone")

_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A failing start inside a run of digits fails at each later start of the run, so only run starts are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each '@' outwards."""
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            floor = m.end()
            yield start, floor
        at = text.find("@", max(at + 1, floor))


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All base spans, in the order of KINDS, then of their start."""
    out = [("email", s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


#: Letters of other scripts that look like ASCII ones, as "look-alikes:letters".
LOOKALIKES = {
    **dict(zip("авекмнорстухіјѕԁԛԝһɡ", "abekmhopctyxijsdqwhg")),
    **dict(zip("АВЕКМНОРСТУХІЈЅԌԚԜ", "ABEKMHOPCTYXIJSGQW")),
    **dict(zip("αβεικνορτυχ", "abeiknoptux")),
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX")),
    **dict(zip("ıⅼ․‐‑‒–﹒。", "il.----..")),
}
INVISIBLE = frozenset("­​‌‍⁠﻿᠎")
#: Number words by language; position in a row is the digit.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
DIGIT_OF = {w: str(k) for row in NUMBER_WORDS for k, w in enumerate(row.split())} | {"oh": "0"}

_word = "(?:" + "|".join(sorted(DIGIT_OF, key=len, reverse=True)) + ")"
_points = ("dot", "point", "punkt", "punto")
_NUMBER = re.compile(rf"(?<!\w){_word}(?!\w)", re.I)
#: What may stand between two number words of a run; with `point`, a sign for it.
_GAP = re.compile(rf"[\s,\-()]+|\s*(?P<point>\.|(?<!\w)(?:{'|'.join(_points)})(?!\w))\s*", re.I)
_open, _close = r"[\[({<]", r"[\])}>]"
_AT = re.compile(rf"{_open}\s*(?:at|@|arroba)\s*{_close}", re.I)
_DOT = re.compile(rf"{_open}\s*(?:{'|'.join(_points)}|\.)\s*{_close}", re.I)
_label = r"[A-Za-z0-9-]+"
#: The sign that a spoken or spaced address is found from; names to its left, read backwards; and hosts to its right.
_SIGN = re.compile(r"(?<=\s)at(?=\s)|@", re.I)
_SPOKEN_DOT = re.compile(r"\s+dot\s+", re.I)
_NAMES_BACK = re.compile(r"[A-Za-z0-9._%+-]+(?:\s+tod\s+[A-Za-z0-9._%+-]+)*", re.I)
_SPOKEN_HOST = re.compile(rf"{_label}(?:\.{_label})*(?:\s+dot\s+{_label}(?:\.{_label})*)+", re.I)
_PLAIN_HOST = re.compile(rf"{_label}(?:\.{_label})*\.[a-z]{{2,6}}(?![\w-])", re.I)
_SPACED = re.compile(rf"(?<=[A-Za-z0-9])(?:[ \t]+@[ \t]*|[ \t]*@[ \t]+)(?={_label}(?:\.{_label})+)")


class Mapped:
    """A rewritten text, and for each of its characters the source range it stands for."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text = text
        self.start = np.arange(len(text)) if start is None else start
        self.end = np.arange(1, len(text) + 1) if end is None else end

    def rewrite(self, edits: list[tuple[int, int, str]]) -> "Mapped":
        """Replaces the ranges (from, to, by), in order and disjoint; each new character stands for its whole range."""
        if not edits:
            return self
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += [self.start[at:a], np.full(len(new), self.start[a])]
            end += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            at = b
        return Mapped("".join([*text, self.text[at:]]), np.concatenate([*start, self.start[at:]]), np.concatenate([*end, self.end[at:]]))


def _plain(c: str) -> str:
    """What a character looks like in ASCII; itself, if nothing."""
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    d = unicodedata.digit(c, None)
    if d is not None:
        return str(d)
    k = unicodedata.normalize("NFKC", c)
    return k if len(k) == 1 and " " < k <= "~" else c


_NON_ASCII = re.compile(r"[^\x00-\x7f\xa0\xae-\xff]")


def glyphs(m: Mapped) -> Mapped:
    if not _NON_ASCII.search(m.text):
        return m
    codes = np.frombuffer(m.text.encode("utf-32-le"), np.uint32)
    seen, index = np.unique(codes, return_inverse=True)
    plain = [_plain(chr(c)) if _NON_ASCII.match(chr(c)) else chr(c) for c in seen.tolist()]
    stays = np.array([bool(x) for x in plain], dtype=bool)[index]
    text = np.array([ord(x) if x else 0 for x in plain], np.uint32)[index][stays].tobytes().decode("utf-32-le")
    return Mapped(text, m.start[stays], m.end[stays])


#: Letters in the place of digits, in groups that are mostly digits.
_MIXED = re.compile(r"(?<![A-Za-z0-9@_%-])\+?[0-9OolI](?:[ .()-]{0,3}[0-9OolI]){5,}(?![A-Za-z0-9@_%])")
_AS_DIGIT = {"O": "0", "o": "0", "l": "1", "I": "1"}


def look_alike_digits(m: Mapped) -> Mapped:
    edits = []
    for x in _MIXED.finditer(m.text):
        digits, letters = sum("0" <= c <= "9" for c in x[0]), sum(c in _AS_DIGIT for c in x[0])
        if letters and digits >= 2 * letters:
            edits += [(k, k + 1, _AS_DIGIT[m.text[k]]) for k in range(x.start(), x.end()) if m.text[k] in _AS_DIGIT]
    return m.rewrite(edits)


def spelled(m: Mapped) -> Mapped:
    """Runs of number words become digits; what parts two words goes, but for a point, and a plus before the run becomes a sign."""
    words = list(_NUMBER.finditer(m.text))
    gaps = [_GAP.fullmatch(m.text, x.end(), y.start()) for x, y in zip(words, words[1:])]
    edits, ends = [], []
    for k, word in enumerate(words):
        before, after = k > 0 and gaps[k - 1], k < len(gaps) and gaps[k]
        if not before and not after:
            continue
        if not before and (plus := _plus_before(m.text, word.start())) is not None:
            edits.append((plus, word.start(), "+"))
            ends.append(word.start())
        digit = DIGIT_OF[word[0].lower()]
        edits.append((word.start(), words[k + 1].start() if after else word.end(), digit + "." * bool(after and after["point"])))
        ends.append(word.end())
    out = m.rewrite(edits)
    at = shift = 0
    for (a, b, new), end in zip(edits, ends):  # the separator that went with a word is no part of that word's source range
        at = a + shift
        out.end[at] = m.end[end - 1]
        shift += len(new) - (b - a)
    return out


def _plus_before(text: str, at: int) -> int | None:
    """Where a plus, as a sign or a word, stands before a place, with nothing but white space between."""
    k = at
    while k and text[k - 1].isspace():
        k -= 1
    if k and text[k - 1] == "+":
        return k - 1
    if k < at and k >= 4 and text[k - 4 : k].lower() == "plus" and not (k > 4 and (text[k - 5].isalnum() or text[k - 5] == "_")):
        return k - 4
    return None


def _around(text: str, start: int, end: int, floor: int) -> tuple[int, int]:
    """A range, with the white space around it."""
    while start > floor and text[start - 1].isspace():
        start -= 1
    while end < len(text) and text[end].isspace():
        end += 1
    return start, end


def bracketed(m: Mapped) -> Mapped:
    """ "[at]", "(dot)" and the like, found from their brackets."""
    for pattern, new in ((_AT, "@"), (_DOT, ".")):
        edits, floor = [], 0
        for x in pattern.finditer(m.text):
            a, b = _around(m.text, *x.span(), floor)
            if a and b < len(m.text):
                edits.append((a, b, new))
            floor = b
        m = m.rewrite(edits)
    return m


def _addresses(m: Mapped, host: re.Pattern, spoken: bool) -> Mapped:
    """Addresses with a sign that is a word or stands apart, found from the sign outwards: names to the left, a host to the right.  Spoken
    ones have their dots as words; others need a name with a digit, dot or underscore."""
    text, n, floor, edits = m.text, len(m.text), 0, []
    back = None
    for sign in _SIGN.finditer(text):
        if sign.start() < floor or not spoken and sign[0] == "@":
            continue
        a, b = _around(text, *sign.span(), floor)
        right = host.match(text, b)
        if not right:
            continue
        back = text[::-1] if back is None else back
        left = _NAMES_BACK.match(back, n - a, n - floor)
        if not left:
            continue
        start = n - left.end()
        dots = list(_SPOKEN_DOT.finditer(text, start, a))
        if not spoken and dots:
            start = dots[-1].end()
        elif start and text[start - 1] in "@" and dots:
            start = dots.pop(0).end()
        if start and (text[start - 1] in _LOCAL or text[start - 1] == "@") or not spoken and not any(c in "0123456789._" for c in text[start:a]):
            continue
        if spoken:
            edits += [(x.start(), x.end(), ".") for x in dots]
        edits.append((a, b, "@"))
        if spoken:
            edits += [(x.start(), x.end(), ".") for x in _SPOKEN_DOT.finditer(text, right.start(), right.end())]
            floor = right.end()
        else:
            floor = b
    return m.rewrite(edits)


def signs(m: Mapped) -> Mapped:
    m = _addresses(bracketed(m), _SPOKEN_HOST, True)
    m = _addresses(m, _PLAIN_HOST, False)
    return m.rewrite([(x.start(), x.end(), "@") for x in _SPACED.finditer(m.text)])


def hidden_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans that show only after deobfuscation, in source offsets."""
    m = signs(spelled(look_alike_digits(glyphs(Mapped(text)))))
    if m.text == text:
        return []
    had, out = set(base), []
    starts, ends, ranges = sorted(x for _, x, _ in base), sorted(y for _, _, y in base), {(x, y) for _, x, y in base}
    crossed = lambda p: bisect_left(starts, p) > bisect_right(ends, p)  # noqa: E731  (a base span begins before p and ends after it)
    for kind, s, e in base_spans(m.text):
        a, b = int(m.start[s]), int(m.end[e - 1])
        if (kind, a, b) not in had and (a, b) not in ranges and not crossed(a) and not crossed(b) and text[a:b] != m.text[s:e]:
            had.add((kind, a, b))
            out.append((kind, a, b))
    return out


#: White space of patterns on text, as far as it is ASCII.
_blank = rb"[\s\x1c-\x1f]"
_TRIGGERS = [
    re.compile(x.replace(b"~", _blank), re.I)
    for x in (
        rb"[\[({<]~*(?:at|@|arroba|" + "|".join(_points).encode() + rb"|\.)~*[\])}>]",
        rb"~dot~",
        rb"~at~+[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2}",
        rb"[ \t]@|@[ \t]",
    )
]
_IN_WORD = LOWER.copy()
_IN_WORD[[*range(0, 48), *range(58, 65), *range(91, 95), 96, *range(123, 128)]] = 32


def _hash_of(words) -> np.ndarray:
    raw = [w.encode() for w in words]
    end = np.cumsum([len(w) for w in raw])
    return span_hashes(np.frombuffer(b"".join(raw), np.uint8), end - [len(w) for w in raw], end)


_NUMBER_HASHES, _POINT_HASHES = _hash_of(DIGIT_OF), _hash_of(_points)


def _candidates(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents that may hold base spans, and documents that one of the transducers may change.

    Each condition is implied by what it stands for: a character that has a plain form is none of ASCII or common Latin-1; letters count as
    digits only in a group that has both, so one of each with at most 3 separators between; two number words follow each other, at
    most with a word for a point between; and the signs' patterns without their surroundings.
    """
    def has(mask):
        c = np.concatenate([[0], np.cumsum(mask)])
        return c[offs[1:]] > c[offs[:-1]]

    digit = (buf >= 48) & (buf <= 57)
    plain = has(digit | (buf == 64))
    # U+0080 to U+00BF and all from U+0100 on; and the two signs among the letters of Latin-1, beside which words begin
    first = buf == 0xC3
    second = np.concatenate([[False], first[:-1]]) if len(buf) else first
    odd = (buf == 0xC2) | (buf >= 0xC4) | second & ((buf == 0x97) | (buf == 0xB7))
    alike = (buf == 79) | (buf == 111) | (buf == 108) | (buf == 73)
    between = (buf == 32) | (buf == 40) | (buf == 41) | (buf == 45) | (buf == 46)
    gap = np.ones(len(buf), dtype=bool)
    for step in range(1, 5):
        a, b = slice(0, max(0, len(buf) - step)), slice(step, None)
        odd[b] |= gap[b] & (digit[a] & alike[b] | alike[a] & digit[b])
        gap[1:] = gap[:-1] & between[:-1]  # the `step` characters before are separators
    odd = has(odd)
    low = _IN_WORD[buf]
    low[second & (buf >= 0x80) & (buf <= 0x9E)] += 32
    words = Words(low, offs, BLANK_WORDS)
    h, doc = words.hashes(), words.of()
    number, point = np.isin(h, _NUMBER_HASHES), np.isin(h, _POINT_HASHES)
    for step in (1, 2):
        k = np.flatnonzero(number[:-step] & number[step:] & (doc[:-step] == doc[step:])) if len(h) > step else np.zeros(0, np.int64)
        odd[doc[k if step == 1 else k[point[k + 1]]]] = True
    raw = buf.tobytes()
    for pattern in _TRIGGERS:
        for x in pattern.finditer(raw):
            odd[int(np.searchsorted(offs, x.start(), "right")) - 1] = True
    return plain, odd


EMPTY = hashlib.sha256(b"").hexdigest()


def _line(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id and, as arrays of (kind, start, end), the base spans and the added ones; with counts and digests."""
    schema = pa.schema([("doc_id", docs.select("doc_id").schema.fields[0].dataType.simpleString() == "string" and pa.string() or pa.int64())] + [(f"n_{k}", pa.int64()) for k in KINDS] + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                column = batch.column("text")
                buf, offs = flat(column)
                plain, odd = _candidates(buf, offs)
                n = batch.num_rows
                counts = np.zeros((n, 4), np.int64)
                digest, line, added = [EMPTY] * n, [""] * n, np.zeros(n, np.int64)
                for i in np.flatnonzero(plain | odd):
                    text = column[i].as_py() or ""
                    base = base_spans(text) if plain[i] else []
                    more = hidden_spans(text, base) if odd[i] else []
                    if base:
                        digest[i] = hashlib.sha256(_line(base).encode()).hexdigest()
                    if base or more:
                        every = sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
                        line[i] = _line(every)
                        added[i] = len(more)
                        for k, _, _ in every:
                            counts[i, KINDS.index(k)] += 1
                yield as_table(schema, doc_id=batch.column("doc_id"), base_sha256=digest, spans=line, n_added=added, **{f"n_{k}": counts[:, j] for j, k in enumerate(KINDS)})

    kind = docs.select("doc_id").schema.fields[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {'string' if kind == 'string' else 'bigint'}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_added bigint")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document; see the module for cases."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable] = {"op5_pii": op5_pii}
