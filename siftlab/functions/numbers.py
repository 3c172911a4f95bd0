"""Numbers, comparators and unit suffixes inside free text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siftlab.functions import fixed as K
from siftlab.functions.folding import casefold, nfkc
from siftlab.functions.text import as_col, blank_to_null, let, squeeze, strip, text_or_empty

_LEAD = rf"^\s*({K.COMPARATOR})?\s*({K.NUMBER})"
# Wide enough for every value met, narrow enough that a product with a unit factor stays exact.
DECIMAL = "decimal(30,12)"


def finite(c) -> Column:
    """The double, or null when it is not finite."""
    return let(lambda v: F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v), c)


def stated(c, kind: str) -> Column:
    """``try_cast`` of a text that may be empty. A failing cast throws and catches inside, at many times its cost."""
    return let(lambda t: F.when(t != "", t.try_cast(kind)), c)


def parse_double(c) -> Column:
    return finite(stated(as_col(c), "double"))


def leading_number(c) -> Column:
    """Number at the start of the text, after an optional comparator."""
    return parse_double(F.regexp_extract(as_col(c), _LEAD, 2))


def leading_comparator(c) -> Column:
    return F.regexp_extract(as_col(c), _LEAD, 1)


def numeric_struct(c) -> Column:
    """``struct<value, comparator, raw>``, null when no finite number leads the text."""
    return let(
        lambda raw, value: F.when(
            value.isNotNull(),
            F.struct(value.alias("value"), leading_comparator(raw).alias("comparator"), raw.alias("raw")),
        ),
        strip(c),
        leading_number(strip(c)),
    )


def unit_suffix(c) -> Column:
    """Text after the leading number with single blanks; empty when there is no number."""
    return squeeze(F.regexp_extract(as_col(c), rf"^\s*(?:{K.COMPARATOR})?\s*{K.NUMBER}\s*(.*)$", 1))


def truth_unit_contract(task, metric, value, declared=None) -> Column:
    """canonical / declared / missing / noncanonical_or_missing / noncanonical_or_relative."""
    said = squeeze(text_or_empty(declared)) if declared is not None else F.lit("")
    suffix = F.coalesce(F.nullif(said, F.lit("")), unit_suffix(text_or_empty(value)))
    compact = F.replace(casefold(nfkc(suffix)), F.lit(" "), F.lit(""))
    return let(_contract, task, metric, suffix, compact)


def _contract(task: Column, metric: Column, suffix: Column, compact: Column) -> Column:
    accepted = F.lit(False)
    for name, units in K.TRUTH_UNITS.items():
        accepted = accepted | ((task == name) & compact.isin(*units))
    return (
        F.when(
            (task == "HOR") & (metric == "exchange_current_density"),
            F.when(compact.isin("macm-2", "macm−2"), "canonical").otherwise("noncanonical_or_relative"),
        )
        .when(
            task.isin(*K.TRUTH_UNITS),
            F.when(accepted, "canonical").otherwise("noncanonical_or_missing"),
        )
        .when((suffix != "") | metric.isin(*K.UNITLESS_METRICS), "declared")
        .otherwise("missing")
    )


def decimal_text(c) -> Column:
    """Plain decimal text without exponent and without trailing zeros."""
    text = as_col(c).cast(DECIMAL).cast("string")
    text = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.regexp_replace(text, "^-0$", "0")


def short_number(c) -> Column:
    """Six decimals at most, trailing zeros dropped."""
    return decimal_text(F.round(as_col(c).cast(DECIMAL), 6))


def is_plain_number(c) -> Column:
    return strip(c).rlike(rf"^{K.NUMBER}$")


def stitch_value_unit(value, unit) -> Column:
    """Append the unit column only when the value cell is a bare number; ``%`` without a blank."""
    return let(
        lambda v, u: F.when(v.isNull() | (u == "") | ~is_plain_number(v), v)
        .when(u.isin("%", "％"), F.concat(v, F.lit("%")))
        .otherwise(F.concat_ws(" ", v, u)),
        blank_to_null(value),
        squeeze(F.translate(text_or_empty(unit), "−–‑—", "----")),
    )


def comparator_is_bound(c) -> Column:
    return as_col(c).isin(*K.BOUND_COMPARATORS)


