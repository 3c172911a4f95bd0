"""Personal data: plain patterns, and disguised identifiers found in a normalised text and mapped back."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftlab.llm.words import LOWER, as_texts, bounded, range_sums, slices, text_bytes

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# The base patterns, with possessive runs where nothing could be given back.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """From each ``@``: the local part is the longest run before it that no earlier match holds."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            done = domain.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[Span]:
    """Each four parts in turn of a run of dotted numbers."""
    for run in _DOTTED.finditer(text):
        parts = run[0].split(".")
        at = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield "ip", at, end
            at = end + 1


def cards(text: str) -> Iterator[Span]:
    for run in _CARD.finditer(text):
        digits = _digits(run[0])
        if 12 <= len(digits) <= 19 and _luhn(digits):
            yield "card", run.start(), run.end()


def phones(text: str) -> Iterator[Span]:
    for run in _PHONE.finditer(text):
        if 9 <= len(_digits(run[0])) <= 15:
            yield "phone", run.start(), run.end()


def base_spans(text: str) -> list[Span]:
    """All plain spans by start, then kind."""
    found: list[Span] = []
    if "@" in text:
        found += emails(text)
    found += addresses(text)
    found += cards(text)
    if "+" in text:
        found += phones(text)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# Letters that look like others (Cyrillic, Greek), and characters without width.
_LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", " ": " ",
}
_WIDTHLESS = "​‌‍⁠﻿­"
# Spelled digits and signs.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}

_MAPPED = dict(_LOOKALIKES) | {c: "" for c in _WIDTHLESS}
_MAPPED |= {chr(0xFEE0 + k): chr(k) for k in range(0x21, 0x7F)}  # full-width forms
_MAPPED |= {chr(base + d): str(d) for base in (0x660, 0x6F0, 0x966) for d in range(10)}  # other decimal digits
_DISGUISED_CHAR = re.compile("[" + re.escape("".join(_MAPPED)) + "]")
_NUMBER = "(?:" + "|".join(_SPELLED) + ")"
_SPELLED_RUN = re.compile(rf"(?<![A-Za-z0-9])(?:{_NUMBER}|[0-9])(?:(?:[\s,-]{{1,3}}|[\s,-]{{0,3}}(?:dot|point)[\s,-]{{1,3}})(?:{_NUMBER}|[0-9]))++(?![A-Za-z0-9])", re.I)
_SPELLED_PART = re.compile(rf"{_NUMBER}|dot|point|[0-9]", re.I)
_PLUS_BEFORE = re.compile(r"(?<![A-Za-z0-9])plus\s+$", re.I)
_BRACKETED = re.compile(r"\s{0,3}[\[({<]\s{0,3}(?:(at)|(dot)|[@]|[.])\s{0,3}[\])}>]\s{0,3}", re.I)
_SPOKEN_MAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9_%+-]*+(?:(?:\.|\s{1,3}dot\s{1,3})[A-Za-z0-9_%+-]++)*+(\s{1,3}at\s{1,3})[A-Za-z0-9-]++"
    r"(?:\s{1,3}dot\s{1,3}[A-Za-z0-9-]++)*?\s{1,3}dot\s{1,3}(?:com|net|org|edu|gov|info|io|co|uk|eu|de|fr|es|us)(?![A-Za-z0-9-])",
    re.I,
)
_DOT_WORD = re.compile(r"\s{1,3}dot\s{1,3}", re.I)

# Bytes of opening brackets, and first bytes of characters other than U+00C0 to U+00FF.
_BRACKET_OR_ODD = np.zeros(256, bool)
_BRACKET_OR_ODD[[40, 91, 123, 60, 0xC2, *range(0xC4, 0x100)]] = True

Replacement = tuple[int, int, str]


class _Rewrite:
    """A rewritten text and the way back: only the edits are kept, the stretches between them are shifts."""

    def __init__(self, text: str, edits: list[Replacement]):
        out: list[str] = []
        self.new_start: list[int] = []
        self.new_end: list[int] = []
        self.old: list[tuple[int, int]] = []
        at = length = 0
        for start, end, new in sorted(edits):
            if start < at:
                continue
            out += (text[at:start], new)
            length += start - at
            self.new_start.append(length)
            length += len(new)
            self.new_end.append(length)
            self.old.append((start, end))
            at = end
        out.append(text[at:])
        self.text = "".join(out)

    def _back(self, i: int) -> tuple[int, int]:
        """Range before the rewriting that the character at ``i`` stands for."""
        k = bisect_right(self.new_start, i) - 1
        if k < 0:
            return i, i + 1
        if i < self.new_end[k]:
            return self.old[k]
        source = self.old[k][1] + i - self.new_end[k]
        return source, source + 1

    def back(self, start: int, end: int) -> tuple[int, int]:
        return self._back(start)[0], self._back(end - 1)[1]


def _char_edits(text: str) -> list[Replacement]:
    return [(m.start(), m.end(), _MAPPED[m[0]]) for m in _DISGUISED_CHAR.finditer(text)]


def _digit_edits(text: str) -> list[Replacement]:
    """Runs of at least four spelled digits, mixed with written ones, become the digits."""
    edits = []
    for run in _SPELLED_RUN.finditer(text):
        parts = list(_SPELLED_PART.finditer(run[0]))
        if sum(p[0].lower() in _SPELLED for p in parts) < 4:
            continue
        plus = _PLUS_BEFORE.search(text, max(0, run.start() - 12), run.start())
        if plus:
            edits.append((plus.start(), run.start(), "+"))
        base, gap = run.start(), run.start()
        for p in parts:
            edits.append((gap, base + p.end(), _SPELLED.get(p[0].lower(), "." if p[0][0].isalpha() else p[0])))
            gap = base + p.end()
    return edits


def _bracket_edits(text: str) -> list[Replacement]:
    return [(m.start(), m.end(), "@" if m[1] or "@" in m[0] else ".") for m in _BRACKETED.finditer(text)]


# Words that stand before "at" in running text and are no mailbox.
_NOT_MAILBOXES = frozenset((
    "look", "looking", "looked", "is", "are", "was", "were", "be", "it", "me", "us", "them", "him", "her", "you", "find", "found", "visit",
    "available", "hosted", "here", "there", "read", "see", "shop", "buy", "sold", "live", "work", "working", "works", "online", "site", "page",
    "website", "store", "more", "details", "arrive", "arrived", "meet", "stay", "start", "and", "or", "published", "posted", "located",
))


def _spoken_edits(text: str) -> list[Replacement]:
    edits = []
    for m in _SPOKEN_MAIL.finditer(text):
        if text[m.start() : m.start(1)].lower() in _NOT_MAILBOXES:
            continue
        edits.append((m.start(1), m.end(1), "@"))
        edits += [(d.start(), d.end(), ".") for d in _DOT_WORD.finditer(text, m.start(), m.end())]
    return edits


def _dot_edits(text: str) -> list[Replacement]:
    """``name@host dot com``: dots spelled behind an at sign."""
    edits = []
    for m in re.finditer(r"@[A-Za-z0-9-]++(?:\s{1,3}dot\s{1,3}[A-Za-z0-9-]++)++", text, re.I):
        edits += [(d.start(), d.end(), ".") for d in _DOT_WORD.finditer(text, m.start(), m.end())]
    return edits


_NEEDLES = tuple(f" {w} ".encode() for w in _SPELLED)
_SEPARATED = LOWER.copy()
_SEPARATED[[9, 10, 11, 12, 13, 44, 45]] = 32


def may_hide(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that can hold a disguise: a spelled dot, an opening bracket, an odd character, or
    two spelled digits between separators (every run of four has them)."""
    found = range_sums(_BRACKET_OR_ODD[data].astype(np.int64), offsets) > 0
    raw = _SEPARATED[data].tobytes()

    def count(needle: bytes) -> np.ndarray:
        places, at = [], raw.find(needle)
        while at >= 0:
            places.append(at)
            at = raw.find(needle, at + 1)
        return np.bincount(np.searchsorted(offsets, places, side="right") - 1, minlength=len(found))[: len(found)]

    return found | (count(b"dot") > 0) | (sum(count(w) for w in _NEEDLES) >= 2)


def hidden_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans of disguised identifiers in source positions, without those that a base span of the kind meets.

    Spans of one kind come in order on both sides, so each is held against its neighbour among the
    base spans and the last one added: n log n in their number, and memory for the edits only.
    """
    seen, steps = text, []
    for step in (_char_edits, _bracket_edits, _digit_edits, _spoken_edits, _dot_edits):
        edits = step(seen)
        if edits:
            steps.append(_Rewrite(seen, edits))
            seen = steps[-1].text
    if not steps:
        return []
    taken = {k: [(s, e) for kind, s, e in base if kind == k] for k in KINDS}
    last = dict.fromkeys(KINDS, 0)
    added = []
    for kind, start, end in base_spans(seen):
        for step in reversed(steps):
            start, end = step.back(start, end)
        held = taken[kind]
        k = bisect_left(held, (end,)) - 1  # the last base span that begins before the end
        if start >= last[kind] and (k < 0 or held[k][1] <= start):
            added.append((kind, start, end))
            last[kind] = end
    return added


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_OF_INTEREST = np.zeros(256, bool)
_OF_INTEREST[[64, *range(48, 58)]] = True  # @ and digits
_EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, n_hidden, base_sha256, spans) per row, over whole texts.

    The counts and the digest are of the plain patterns; ``spans`` also lists the disguised
    identifiers, ``n_hidden`` of them: look-alike and full-width characters, at/dot disguises and
    runs of spelled digits are rewritten by finite-state steps that keep for every character the
    source range it stands for, so spans are positions in the given text. Offsets are code
    points. The work is row-local. A null text is empty and has no spans; repeated rows give
    repeated results; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            texts = as_texts(piece.column("text"))
            data, offsets = text_bytes(texts)
            plain = range_sums(_OF_INTEREST[data].astype(np.int64), offsets) > 0
            odd = may_hide(data, offsets)
            counts = {k: np.zeros(len(texts), np.int64) for k in KINDS}
            hidden = np.zeros(len(texts), np.int64)
            digests, listed = [_EMPTY_DIGEST] * len(texts), [""] * len(texts)
            for i in np.flatnonzero(plain | odd).tolist():
                text = texts[i].as_py()
                base = base_spans(text) if plain[i] else []
                extra = hidden_spans(text, base) if odd[i] else []
                if not base and not extra:
                    continue
                for k, _, _ in base:
                    counts[k][i] += 1
                hidden[i] = len(extra)
                if base:
                    digests[i] = hashlib.sha256(_listed(base).encode()).hexdigest()
                listed[i] = _listed(sorted(base + extra, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), *(pa.array(counts[k]) for k in KINDS), pa.array(hidden), pa.array(digests, pa.string()), pa.array(listed, pa.string())],
                names=["id", "n_email", "n_ip", "n_card", "n_phone", "n_hidden", "base_sha256", "spans"],
            )

    schema = f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, n_hidden long, base_sha256 string, spans string"
    return bounded(rows).mapInArrow(run, schema).withColumnRenamed("id", id_col)
