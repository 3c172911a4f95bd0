"""Elements, compositions and products."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siftlab.functions import fixed as K
from siftlab.functions.folding import casefold
from siftlab.functions.text import all_matches, as_col, let, lookup, squeeze, strip, text_or_empty


def _symbols(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def elements_of(text, explicit=None) -> Column:
    """Sorted element symbols from formulas, spelled-out names and an explicit list."""
    given = F.coalesce(as_col(explicit), F.array().cast("array<string>")) if explicit is not None else None
    return let(lambda body: _elements(body, given), text_or_empty(text))


def _elements(body: Column, given: Column | None) -> Column:
    formula = all_matches(body, r"(?<![a-z])([A-Z][a-z]?)(?![a-z])", 1)
    words = F.split(casefold(body), r"[^\p{L}\p{N}_]+")
    named = F.transform(
        F.array_intersect(words, _symbols(K.ELEMENT_NAMES)), lambda w: lookup(w, K.ELEMENT_NAMES)
    )
    found = F.array_union(formula, named)
    if given is not None:
        found = F.array_union(found, F.transform(given, strip))
    return F.array_sort(F.array_intersect(found, _symbols(K.ELEMENTS)))


def formula_elements(c) -> Column:
    """Elements of multi-element strings only (formula blocks and dashed, slashed or comma lists)."""
    return let(_formula_elements, text_or_empty(c))


def _formula_elements(body: Column) -> Column:
    blocks = F.concat(
        all_matches(body, r"(?<![a-z])(?:[A-Z][a-z]?\d*){2,}"),
        all_matches(body, r"(?:[A-Z][a-z]?\s*[-/]\s*)+[A-Z][a-z]?"),
        all_matches(body, r"(?:[A-Z][a-z]?\s*,\s*)+[A-Z][a-z]?"),
    )
    split = F.transform(
        blocks,
        lambda b: F.filter(all_matches(b, "[A-Z][a-z]?"), lambda s: F.array_contains(_symbols(K.ELEMENTS), s)),
    )
    return F.array_sort(F.array_distinct(F.flatten(F.filter(split, lambda s: F.size(s) >= 2))))


def metal_symbol(c) -> Column:
    return let(
        lambda text: F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substring(text, F.lit(2), F.length(text)))), strip(c)
    )


def sorted_symbols(c) -> Column:
    return F.sort_array(F.array_distinct(F.filter(F.transform(as_col(c), metal_symbol), lambda s: s != "")))


def parse_composition(c) -> Column:
    """``struct<metals array, percent map>`` of text such as ``Co(57%),Ni(23%)``."""
    parts = F.filter(F.transform(F.split(text_or_empty(c), r"[,+;，；/|]+"), strip), lambda p: p != "")
    return let(_composition, parts)


def _composition(parts: Column) -> Column:
    head = r"^\s*([A-Za-z]{1,2})\b"
    lead = lambda p: F.when(p.rlike(head), metal_symbol(F.regexp_extract(p, head, 1))).otherwise(
        F.regexp_extract(p, "[A-Z][a-z]?", 0)
    )
    symbols = F.flatten(
        F.transform(
            parts,
            lambda p: F.when(p.rlike(head), F.array(lead(p))).otherwise(all_matches(p, "[A-Z][a-z]?")),
        )
    )
    share = r"(\d+(?:\.\d+)?)\s*%"
    shares = F.filter(
        F.transform(parts, lambda p: F.struct(lead(p).alias("k"), F.regexp_extract(p, share, 1).try_cast("double").alias("v"))),
        lambda s: (s["k"] != "") & s["v"].isNotNull(),
    )

    def last_wins(pairs: Column) -> Column:
        """A symbol named twice keeps its last share."""
        return F.filter(
            pairs, lambda s, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda t: t["k"] == s["k"])
        )

    percent = F.map_from_entries(let(last_wins, shares))
    return F.struct(sorted_symbols(symbols).alias("metals"), percent.alias("percent"))


def exact_percentages(weights, decimals: int = 2, minimum: float = 0.0) -> Column:
    """Shares of an array of weights that add to 100 exactly (largest remainder, index ties)."""
    scale = 10**decimals
    total, each = 100 * scale, int(round(minimum * scale))
    def total_of(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def spread(w: Column, s: Column) -> Column:
        """Unrounded shares in units of the last decimal; equal shares when all weights are zero."""
        room = F.lit(total) - F.size(w) * each
        return F.transform(w, lambda x: F.when(s > 0, x / s).otherwise(1.0 / F.size(w)) * room)

    def allot(raw: Column) -> Column:
        low = F.transform(raw, lambda x: F.floor(x))
        rest = F.lit(total) - F.size(raw) * each - total_of(F.transform(low, lambda x: x.cast("double")))
        order = F.array_sort(F.transform(raw, lambda x, i: F.struct((F.floor(x) - x).alias("f"), i.alias("i"))))
        lucky = F.transform(F.slice(order, F.lit(1), F.greatest(rest, F.lit(0.0)).cast("int")), lambda t: t["i"])
        return let(
            lambda lows, winners: F.transform(
                lows,
                lambda x, i: (x + each + F.when(F.array_contains(winners, i), 1).otherwise(0)) / F.lit(float(scale)),
            ),
            low,
            lucky,
        )

    w = F.transform(as_col(weights), lambda x: F.greatest(F.lit(0.0), x.cast("double")))
    return let(allot, let(lambda v: let(spread, v, total_of(v)), w))


def product_label(c) -> Column:
    """Canonical product label, the squeezed text when unknown."""
    return let(lambda text: lookup(F.lower(text), K.PRODUCT_ALIASES, text), squeeze(text_or_empty(c)))


def product_in_text(*texts) -> Column:
    """First product named, trying the texts in order and the labels in fixed order."""
    options = []
    for text in texts:
        body = text_or_empty(text)
        options += [F.when(body.rlike(pattern), label) for label, pattern in K.PRODUCT_PATTERNS]
    return F.coalesce(*options)
