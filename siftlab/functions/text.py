"""Text folding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Whitespace in the Unicode sense; Java's \\s alone is ASCII only.
WS = r"(?U)\s"
WS_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
DASHES = "−–‑—"


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(body, *values) -> Column:
    """``body(*values)`` with every value computed once per row.

    A column used several times in an expression is several copies of its expression, which
    multiplies along nested functions. Binding goes through a one-element array and a lambda.
    """
    if len(values) == 1:
        return F.element_at(F.transform(F.array(as_col(values[0])), body), 1)
    packed = F.struct(*[as_col(v).alias(f"v{i}") for i, v in enumerate(values)])
    unpacked = lambda s: body(*[s[f"v{i}"] for i in range(len(values))])
    return F.element_at(F.transform(F.array(packed), unpacked), 1)


def strip(c) -> Column:
    return F.btrim(as_col(c), F.lit(WS_CHARS))


def blank_to_null(c) -> Column:
    """Null for null, empty or blank text, the trimmed text otherwise."""
    return let(lambda t: F.when(t != "", t), strip(c))


def text_or_empty(c) -> Column:
    return F.coalesce(as_col(c).cast("string"), F.lit(""))


def squeeze(c) -> Column:
    """Runs of whitespace become one blank; ends are trimmed."""
    return F.btrim(F.regexp_replace(as_col(c), rf"{WS}+", " "))


def fold_dashes(c, extra: str = "") -> Column:
    chars = DASHES + extra
    return F.translate(as_col(c), chars, "-" * len(chars))


def first_match(c, pattern: str, group: int = 1) -> Column:
    """First match or null (``regexp_extract`` alone gives an empty string)."""
    return let(lambda t: F.when(t.rlike(pattern), F.regexp_extract(t, pattern, group)), c)


def all_matches(c, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(as_col(c), F.lit(pattern), F.lit(group))


def last_match(c, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(all_matches(c, pattern, group), F.lit(-1))


def non_blank_lines(c) -> Column:
    return F.filter(F.transform(F.split(as_col(c), r"\r\n|\r|\n"), strip), lambda x: x != "")


def lookup(c, table: dict, default=None) -> Column:
    """Value of a fixed table, as a literal map inside the projection (no join)."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), as_col(c))
    return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def contains_any(c, words) -> Column:
    """True when any of the plain words occurs."""
    hit = F.lit(False)
    for word in words:
        hit = hit | as_col(c).contains(word)
    return hit


def keyword_tokens(c, stopwords) -> Column:
    """Lower-case ASCII tokens without stop words, pure digits and single characters, in order."""
    words = F.split(F.lower(text_or_empty(c)), "[^a-z0-9]+")
    return F.filter(words, lambda t: (F.length(t) >= 2) & t.rlike("[a-z]") & ~t.isin(*stopwords))
