"""Unicode compatibility composition (NFKC) and full case folding as column expressions.

All tables are made from the character database of the running Python and sent as literals; the
work is done by built-in expressions. Most characters are inert: nothing happens to them, and
nothing composes with a character before them. Only the stretches of other characters, each with
the character before it, are taken apart, put in canonical order and composed; the text between
them is kept as it is.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from siftlab.functions.text import as_col, let, squeeze, text_or_empty

# A non-character: never part of a table entry.
_BREAK = "￿"
_PAGE = 256


def _characters():
    return (chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)


@lru_cache(maxsize=1)
def _pairs() -> dict[tuple[str, str], str]:
    """Pairs of characters that compose."""
    found = {}
    for ch in _characters():
        apart = unicodedata.normalize("NFD", ch)
        if len(apart) > 1 and unicodedata.normalize("NFC", ch) == ch:
            found[unicodedata.normalize("NFC", apart[:-1]), apart[-1]] = ch
    return found


@lru_cache(maxsize=1)
def _active() -> str:
    """Character class of everything that is not inert."""
    second = {b for _, b in _pairs()}
    codes = [ord(ch) for ch in _characters() if ch in second or unicodedata.combining(ch) or unicodedata.normalize("NFKC", ch) != ch]
    return _char_class(codes)


def _char_class(codes: list[int]) -> str:
    """A class of many spans; what lies below all of them is told by one comparison."""
    spans: list[list[int]] = []
    for c in sorted(codes):
        if spans and c == spans[-1][1] + 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    listed = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans)
    return rf"[\x{{{spans[0][0]:X}}}-\x{{10FFFF}}&&[{listed}]]"


class _Table:
    """Text by code point, as two literal arrays: the page of a code point, and all entries of the pages in use."""

    def __init__(self, entries: dict[str, str]):
        used = sorted({ord(ch) // _PAGE for ch in entries})
        place = {page: i + 1 for i, page in enumerate(used)}
        self.pages = ",".join(str(place.get(p, 0)) for p in range(used[-1] + 1))
        self.n_pages = used[-1] + 1
        cells = [""] * _PAGE  # page 0: no entries
        for page in used:
            cells += [entries.get(chr(c), "") if not 0xD800 <= c < 0xE000 else "" for c in range(page * _PAGE, (page + 1) * _PAGE)]
        self.cells = _BREAK.join(cells)

    def get(self, code: Column) -> Column:
        """Entry of a code point; empty where it has none."""
        # Both are folded to literal arrays once by the optimizer.
        pages = F.split(F.lit(self.pages), ",").cast("array<int>")
        cells = F.split(F.lit(self.cells), _BREAK)
        page = F.when(code < self.n_pages * _PAGE, F.get(pages, F.floor(code / _PAGE).cast("int"))).otherwise(0)
        return F.get(cells, page * _PAGE + code % _PAGE)


@lru_cache(maxsize=1)
def _tables() -> tuple[_Table, _Table, _Table, str]:
    """Full compatibility decompositions, combining classes, per first character its (second, composite) list, all marks."""
    apart, classes, rows = {}, {}, {}
    for ch in _characters():
        whole = unicodedata.normalize("NFKD", ch)
        if whole != ch:
            apart[ch] = whole
        if unicodedata.combining(ch):
            classes[ch] = str(unicodedata.combining(ch))
    for (first, second), whole in _pairs().items():
        rows[first] = rows.get(first, "") + second + whole
    if {b for _, b in _pairs()} & set(_pairs().values()):
        raise ValueError("a composite is the second part of a pair")
    return _Table(apart), _Table(classes), _Table(rows), _char_class([ord(ch) for ch in classes])


def _normal_stretch(text: Column) -> Column:
    """NFKC of a stretch: an optional inert character and active ones."""
    apart, classes, rows, marks = _tables()

    def taken_apart(ch: Column) -> Column:
        return let(lambda t: F.when(t == "", ch).otherwise(t), apart.get(F.ascii(ch)))

    def ordered(run: Column) -> Column:
        """A character and its marks, the marks by class and then as they came."""
        kind = lambda ch: F.coalesce(F.nullif(classes.get(F.ascii(ch)), F.lit("")).cast("int"), F.lit(0))
        return F.array_sort(F.transform(F.split(run, ""), lambda ch, i: F.struct(kind(ch).alias("kind"), i.alias("at"), ch.alias("ch"))))

    def step(acc: Column, x: Column) -> Column:
        done, base, rest = acc["done"], acc["base"], acc["rest"]
        free = (base != "") & F.when(x["kind"] > 0, acc["last"] < x["kind"]).otherwise(rest == "")
        row = F.when(free, rows.get(F.ascii(base))).otherwise("")
        whole = let(lambda r: let(lambda p: F.when(p > 0, F.substring(r, p + 1, F.lit(1))).otherwise(""), F.instr(r, x["ch"])), row)
        state = lambda *v: F.struct(*[F.coalesce(c, F.lit("")).alias(n) for n, c in zip(("done", "base", "rest"), v)], v[3].alias("last"))
        return let(
            lambda w: F.when(w != "", state(done, w, rest, acc["last"]))
            .when(x["kind"] > 0, state(done, base, F.concat(rest, x["ch"]), x["kind"]))
            .otherwise(state(F.concat(done, base, rest), x["ch"], F.lit(""), F.lit(0))),
            whole,
        )

    whole = F.array_join(F.transform(F.split(text, ""), taken_apart), "")
    runs = F.regexp_extract_all(whole, F.lit(rf"[\s\S]{marks}*"), F.lit(0))
    start = F.struct(*[F.lit("").alias(n) for n in ("done", "base", "rest")], F.lit(0).alias("last"))
    return F.aggregate(F.flatten(F.transform(runs, ordered)), start, step, lambda acc: F.concat(acc["done"], acc["base"], acc["rest"]))


def _between(text: Column, pattern: str, change) -> Column:
    """The text with every match of the pattern changed; what lies between is kept."""
    kept = F.split(text, pattern, -1)
    changed = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change)
    # The last kept part has no match behind it.
    return F.array_join(F.flatten(F.transform(F.arrays_zip(kept.alias("k"), changed.alias("c")), lambda z: F.array(z["k"], F.coalesce(z["c"], F.lit(""))))), "")


def nfkc(c) -> Column:
    """Compatibility composition of a text, equal to Python's ``unicodedata.normalize("NFKC", text)``; null stays null."""
    stretch = rf"[\s\S]?{_active()}+"
    plain = lambda t: t.rlike(r"^\p{ASCII}*$") | ~t.rlike(_active())
    return let(lambda t: F.when(plain(t), t).otherwise(_between(t, stretch, _normal_stretch)), as_col(c))


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, _Table, str]:
    one, many = {}, {}
    for ch in _characters():
        folded = ch.casefold()
        if folded != ch:
            (one if len(folded) == 1 else many)[ch] = folded
    return "".join(one), "".join(one.values()), _Table(many), _char_class([ord(ch) for ch in many])


def casefold(c) -> Column:
    """Full case folding, equal to Python's ``str.casefold``; null stays null."""
    source, target, many, these = _folds()

    def fold(text: Column) -> Column:
        single = let(
            lambda t: F.when(~t.rlike(these), t).otherwise(_between(t, these, lambda ch: many.get(F.ascii(ch)))), F.translate(text, source, target)
        )
        return F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(single)

    return let(fold, as_col(c))


def canonical_text(c) -> Column:
    """Compatibility- and case-folded text with single blanks; null becomes empty."""
    return squeeze(casefold(nfkc(text_or_empty(c))))
