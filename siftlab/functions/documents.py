"""Cleaning and identification of long texts."""

from __future__ import annotations

import html

from pyspark.sql import Column, functions as F, types as T

from siftlab.functions import fixed as K
from siftlab.functions.ids import canonical_doi
from siftlab.functions.text import all_matches, as_col, let, squeeze, strip, text_or_empty


@F.udf(T.StringType(), useArrow=True)
def _decoded(text):
    return html.unescape(text)


def unescape(c) -> Column:
    """Named and numeric character references resolved; only texts with an ampersand leave the JVM."""
    text = as_col(c)
    return F.when(F.instr(text, F.lit("&")) > 0, _decoded(text)).otherwise(text)


def clean_markup(c) -> Column:
    """Entities resolved, tags removed, whitespace squeezed."""
    return squeeze(F.regexp_replace(unescape(text_or_empty(c)), r"<[^>]+>", " "))


def _is_reference_line(line: Column) -> Column:
    # Digits of a phone number with its international prefix are no year.
    dated = F.regexp_replace(line, r"\+\d(?:[ ().-]{0,2}\d){8,14}(?!\d)", "+").rlike(r"\b(19|20)\d{2}[a-z]?\b")
    commas = F.length(line) - F.length(F.replace(line, F.lit(","), F.lit("")))
    dots = F.length(line) - F.length(F.replace(line, F.lit("."), F.lit("")))
    return (
        line.rlike(r"^\[\d+\]\s+\S")
        | line.rlike(r"^\d{1,3}[.)]\s+\S")
        | line.rlike(r"(?i)\bdoi\b")
        | (dated & ((commas >= 2) | (dots >= 2)))
    )


def drop_references(c) -> Column:
    """Cut at the acknowledgement or reference heading, else at the last block of references.

    A block is a run of reference-like lines (blank lines allowed) with at least three of them;
    it is dropped together with whatever follows it.
    """
    text = F.regexp_replace(text_or_empty(c), r"(?is)(##?\s*)?Acknowledgements?.*$", "")
    text = F.regexp_replace(text, r"(?is)(##?\s*)?References?.*$", "")
    return let(lambda t: let(_drop_block, t, F.split(t, r"\r\n|\r|\n")), text)


def _line_kind(line: Column) -> Column:
    """One letter per line: r reference, b blank, t text."""
    return F.when(line == "", "b").when(_is_reference_line(line), "r").otherwise("t")


def _drop_block(text: Column, lines: Column) -> Column:
    """The lines before the last run of references."""
    kinds = F.transform(lines, lambda s: let(_line_kind, strip(s)))
    block = r"^(.*t|)(?:b*r){3}[rb]*(?:t.*)?$"

    def cut(letters: Column) -> Column:
        keep = F.length(F.regexp_extract(letters, block, 1))
        kept = F.rtrim(F.array_join(F.slice(lines, F.lit(1), keep), "\n"), F.lit(" \t\r\n"))
        return F.when((F.size(lines) > 1) & letters.rlike(block), kept).otherwise(text)

    return let(cut, F.array_join(kinds, ""))


def document_doi(c, near: int | None = None, far: int | None = None) -> Column:
    """First valid id of the cleaned text: link, label or bare id, then link or label further down.

    The whole text is read. ``near`` and ``far`` limit the two steps to so many characters, for
    texts in which ids further down belong to cited papers.
    """
    return let(lambda text: _first_doi(text, near, far), drop_references(c))


def _first_doi(text: Column, near: int | None, far: int | None) -> Column:
    def first(window: Column, pattern: str) -> Column:
        ids = F.transform(all_matches(window, pattern, 1), lambda d: canonical_doi(d, "document"))
        return F.try_element_at(F.array_compact(ids), F.lit(1))

    head, wide = (text if n is None else F.substring(text, 1, n) for n in (near, far))
    return F.coalesce(
        first(head, K.DOI_URL),
        first(head, K.DOI_LABEL),
        first(head, K.DOI_BARE),
        first(wide, K.DOI_URL),
        first(wide, K.DOI_LABEL),
    )


def title_key(c) -> Column:
    """Folded title for matching: tags and emphasis gone, ASCII and CJK words only."""
    text = F.regexp_replace(F.lower(strip(text_or_empty(c))), r"<[^>]+>", "")
    return F.btrim(F.regexp_replace(text, r"[^0-9a-z\x{4E00}-\x{9FFF}]+", " "))


def _plain_title(c: Column) -> Column:
    text = F.regexp_replace(strip(c), r"^\*+|\*+$", "")
    text = F.replace(strip(text), F.lit("`"), F.lit(""))
    text = F.regexp_replace(text, r"\*\*([^*]+)\*\*", "$1")
    return strip(F.regexp_replace(text, r"_([^_]+)_", "$1"))


def _is_noise(plain: Column) -> Column:
    return let(_noise, plain, title_key(plain), F.regexp_replace(plain, "[^A-Za-z]+", ""))


def _noise(plain: Column, key: Column, letters: Column) -> Column:
    shout = (
        (letters != "")
        & (letters == F.upper(letters))
        & (F.size(F.split(squeeze(plain), " ")) <= 4)
        & (F.length(plain) <= 40)
    )
    return (
        (plain == "") | (key == "") | key.isin(*K.TITLE_NOISE) | plain.rlike(K.TITLE_NOISE_PATTERN)
        | key.rlike(K.TITLE_NOISE_PATTERN) | shout
    )


def title_candidates(c, max_lines: int | None = None, max_titles: int | None = None) -> Column:
    """Likely titles in order: ``Title:`` lines, headings by level, one bold line as last resort.

    All lines are read and all titles given unless ``max_lines`` or ``max_titles`` say otherwise.
    """
    lines = F.split(text_or_empty(c), r"\r\n|\r|\n")
    head = lines if max_lines is None else F.slice(lines, 1, max_lines)
    return let(lambda rows: _titles(rows, max_titles), F.transform(head, strip))


def _titles(lines: Column, max_titles: int | None) -> Column:
    def pick(pattern: str, group: int, rank: int) -> Column:
        hits = F.filter(lines, lambda s: s.rlike(pattern))
        return F.transform(
            hits, lambda s: F.struct(F.lit(rank).alias("rank"), _plain_title(F.regexp_extract(s, pattern, group)).alias("title"))
        )

    labelled = pick(r"(?i)^title\s*[:：]\s*(.+)$", 1, 0)
    headings = [pick(rf"^(#{{{level}}})\s+(.*)$", 2, level) for level in range(1, 7)]
    found = F.transform(
        F.filter(F.concat(labelled, *headings), lambda t: ~_is_noise(t["title"])), lambda t: t["title"]
    )
    bold = F.filter(
        F.transform(F.filter(lines, lambda s: s.rlike(r"^\*\*.+\*\*$")), _plain_title),
        lambda t: (F.length(t) >= 15) & ~_is_noise(t),
    )
    titles = F.concat(F.array_distinct(found), F.slice(bold, 1, 1))
    return titles if max_titles is None else F.slice(titles, 1, max_titles)


def title_variants(c) -> Column:
    """The title, then its part before a colon or a spaced dash."""
    return let(_variants, strip(text_or_empty(c)))


def _variants(text: Column) -> Column:
    seps = (":", " - ", " – ", " — ")
    cuts = [F.when(text.contains(s), strip(F.substring_index(text, s, 1))) for s in seps]
    return F.filter(F.array_distinct(F.array_compact(F.array(text, *cuts))), lambda t: t != "")


def has_metric_number(c) -> Column:
    """A decimal, a half-wave token, or a number with a unit; digits in formulas do not count."""
    return let(_metric_number, text_or_empty(c))


def _metric_number(text: Column) -> Column:
    unit = r"(?:V|mV|mA|A|%|rpm|cm\s*(?:-2|\^-2)|A\s*g\s*(?:-1|\^-1)|mA\s*cm\s*(?:-2|\^-2))"
    return (
        text.rlike(r"\b\d+\.\d+\b")
        | text.rlike(r"(?i)\bE\s*(?:_\{)?\s*1\s*/\s*2\s*(?:\})?")
        | text.rlike(rf"(?i)\b\d+(?:\.\d+)?\s*{unit}\b")
    )


def chunk_quality(c, min_chars: int = 80, keep_if_number: bool = True) -> Column:
    """``hard`` junk, ``soft`` junk or ``keep``."""
    return let(
        lambda t: let(lambda text, number: _quality(text, number, min_chars, keep_if_number), t, has_metric_number(t)),
        strip(text_or_empty(c)),
    )


def _quality(text: Column, number: Column, min_chars: int, keep_if_number: bool) -> Column:
    first = strip(F.regexp_extract(text, r"^[^\r\n]*", 0))
    heading = ~text.rlike(r"[\r\n]") & text.rlike(r"^#{1,6}\s+\S.*$")
    short = F.length(text) < min_chars
    saved = number if keep_if_number else F.lit(False)
    return (
        F.when(text == "", "hard")
        .when(first.rlike(r"(?i)^(?:#{1,6}\s*)?keywords?\b"), "hard")
        .when(heading & ~number, "hard")
        .when(short & ~saved, "soft")
        .otherwise("keep")
    )
