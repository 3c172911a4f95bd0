"""Material names: comparison keys and review flags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siftlab.functions import fixed as K
from siftlab.functions.folding import canonical_text, casefold, nfkc
from siftlab.functions.text import as_col, let, strip, text_or_empty


def name_key(c) -> Column:
    """Folded name with separators removed; keeps digits, Latin and Greek letters and CJK."""
    text = casefold(nfkc(text_or_empty(c)))
    return F.regexp_replace(text, r"[^0-9a-zα-ω\x{4E00}-\x{9FFF}]+", "")


def identity_key(name, index) -> Column:
    """Name key, or a placeholder naming the position when no name is left."""
    place = F.coalesce(as_col(index).cast("string"), F.lit("unknown"))
    missing = F.concat(F.lit("<missing-material-"), place, F.lit(">"))
    return let(lambda key: F.when(key != "", key).otherwise(missing), name_key(name))


def is_generic_name(c) -> Column:
    return let(
        lambda text: text.isin(*K.GENERIC_NAMES) | text.rlike(K.GENERIC_NAME_PATTERN), canonical_text(c)
    )


def vague_name_reasons(name, evidence=None) -> Column:
    """Sorted review flags of names that stand for a series, a group or an anonymous sample."""
    raw = strip(nfkc(text_or_empty(name)))
    said = nfkc(text_or_empty(evidence)) if evidence is not None else F.lit("")
    return let(_vague_flags, raw, strip(F.concat_ws(" ", raw, said)))


def _vague_flags(raw: Column, joined: Column) -> Column:
    flags = F.array(
        F.when((raw != "") & raw.rlike(K.ANONYMOUS_NAME_PATTERN), "anonymous_sample_code"),
        F.when(raw.rlike(K.COLLECTIVE_PATTERN), "collective_or_variable_scope"),
        F.when(raw.rlike(K.GROUP_PATTERN), "group_level_descriptor"),
        F.when(raw.rlike(K.UNSPECIFIED_PATTERN), "unspecified_constituent"),
        F.when(
            raw.rlike(K.VARIABLE_FORMULA_PATTERN) & joined.rlike(K.VARIABLE_SCOPE_PATTERN),
            "variable_composition_range",
        ),
    )
    return F.array_compact(flags)
