"""Unit conversion to one canonical unit per metric, with null for text that cannot be converted."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

from siftlab.functions import fixed as K
from siftlab.functions.numbers import DECIMAL, decimal_text, finite, parse_double, short_number, stated
from siftlab.functions.text import as_col, let, squeeze, strip, text_or_empty

_PREFIX = rf"^\s*({K.NUMBER})"


def _number_text(c: Column) -> Column:
    return F.regexp_extract(c, _PREFIX, 1)


def _rest(c: Column) -> Column:
    """Unit text after the number: one kind of dash, single blanks."""
    return squeeze(F.translate(F.regexp_replace(c, _PREFIX, ""), "−–‑—", "----"))


def _area(unit: Column) -> Column:
    """Lower-case spelling of a current-density unit with ``cm-2`` as its second word."""
    u = F.lower(F.translate(unit, "·⋅•/²", "    2"))
    u = F.regexp_replace(u, r"cm\s*\^?\s*-?\s*2", "cm-2")
    return squeeze(F.regexp_replace(u, r"^(ma|a)(?=cm)", "$1 "))


def metric_key(key, reaction) -> Column:
    """Canonical metric key of a raw column name under a reaction."""
    return let(_metric_key, strip(F.translate(text_or_empty(key), "−–‑", "---")), F.upper(as_col(reaction)))


def _metric_key(k: Column, r: Column) -> Column:
    return (
        F.when((r == "O5H") & (F.lower(k) == "faradaic_efficiency"), "faradaic_efficiency")
        .when(
            (r == "UOR")
            & k.isin("potential", "overpotential", "potential_10mAcm-2", "overpotential_10mAcm-2"),
            "potential_10mAcm-2",
        )
        .when(r.isin("HER", "OER", "HZOR") & (k == "overpotential"), "overpotential_10mAcm-2")
        .otherwise(k)
    )


def normalize_metric(value, key) -> Column:
    """``struct<value, unit, number>`` with exact decimal text, or null when it must be rejected.

    Percent becomes a fraction; overpotentials become mV, potentials V, exchange and partial
    currents mA cm-2, mass activity A. A missing unit counts as canonical for potentials and
    partial currents; an unknown unit of a current density is rejected.
    """


    def parts(text: Column, k: Column) -> Column:
        number = let(lambda raw: F.when(raw != "", F.coalesce(raw.try_cast(DECIMAL), raw.try_cast("double").cast(DECIMAL))), _number_text(text))
        return let(_convert_metric, number, _rest(text), k)

    return let(parts, text_or_empty(value), key)


def _convert_metric(num: Column, rest: Column, k: Column) -> Column:
    head = F.lower(F.substring_index(rest, " ", 1))
    area = _area(rest)
    area_unit = F.substring_index(area, " ", 1)
    is_area = area.rlike(r"^m?a (cm-2|cm2-1)")
    thousand = F.lit(Decimal("1000"))
    milli = F.lit(Decimal("0.001"))

    def out(number: Column, unit: Column) -> Column:
        n = number.cast(DECIMAL)
        return F.struct(
            decimal_text(n).alias("number"),
            unit.alias("unit"),
        )

    over = k.contains("overpotential")
    potential = k.contains("potential") & ~over
    current = k.isin("exchange_current_density", "partial_current_density")
    tail = F.regexp_replace(rest, r"^\S+\s*", "")
    return F.when(
        num.isNotNull(),
        F.when(rest.contains("%"), out(num * F.lit(Decimal("0.01")), F.lit("fraction_0_to_1")))
        .when(over, out(F.when(head == "v", num * thousand).otherwise(num), F.lit("mV")))
        .when(potential, out(F.when(head == "mv", num * milli).otherwise(num), F.lit("V")))
        .when((k == "partial_current_density") & (rest == ""), out(num, F.lit("mA cm-2")))
        .when(
            current,
            F.when(
                is_area, out(F.when(area_unit == "a", num * thousand).otherwise(num), F.lit("mA cm-2"))
            ),
        )
        .when(
            (k == "mass_activity") & (head == "ma"),
            out(num * milli, strip(F.concat(F.lit("A "), tail))),
        )
        .otherwise(out(num, F.nullif(rest, F.lit("")))),
    )


def metric_text(normalized: Column) -> Column:
    """Number and unit as one string; fractions stay bare."""
    return let(
        lambda m: F.when(m["unit"].isNull() | (m["unit"] == "fraction_0_to_1"), m["number"]).otherwise(
            F.concat_ws(" ", m["number"], m["unit"])
        ),
        normalized,
    )


def current_density_ma(c) -> Column:
    """Current density in mA cm-2 as a decimal; null without an area unit."""
    text = F.regexp_replace(F.translate(text_or_empty(c), "·⋅•", "   "), r"^[\s~≈≃∼<>≤≥=]+", "")
    text = F.regexp_replace(text, r"(?<=\d),(?=\d)", "")

    def convert(num: Column, area: Column) -> Column:
        return F.when(area.rlike(r"^ma\b.*cm-2"), num).when(
            area.rlike(r"^a\b.*cm-2"), (num * F.lit(Decimal("1000"))).cast(DECIMAL)
        )

    return let(lambda t: let(convert, stated(_number_text(t), DECIMAL), _area(_rest(t))), text)


def percent_fraction(c) -> Column:
    """Percent text such as ``~94.2%`` as a fraction."""
    text = F.regexp_replace(text_or_empty(c), r"^[\s~≈≃∼<>≤≥=]+", "")
    text = F.regexp_replace(text, r"(?<=\d),(?=\d)", "")
    return (stated(_number_text(text), DECIMAL) * F.lit(Decimal("0.01"))).cast(DECIMAL)


def condition_status(c) -> Column:
    """``ok`` at 10 mA cm-2, ``mismatch`` at another density, ``unknown`` otherwise."""
    return let(
        lambda density: F.when(density.isNull(), "unknown").when(density == 10, "ok").otherwise("mismatch"),
        current_density_ma(c),
    )


_CONDUCTIVITY = (
    (r"ms/cm|ms cm\^?-1|\bms\s*cm-?1\b", 0.1),
    (r"s/cm|s cm\^?-1|\bs\s*cm-?1\b", 100.0),
    (r"ms/m|ms m\^?-1|\bms\s*m-?1\b", 1.0e-3),
    (r"s/m|s m\^?-1|\bs\s*m-?1\b", 1.0),
)


def _by_pattern(text: Column, number: Column, rules) -> Column:
    out = None
    for pattern, factor in rules:
        hit = text.rlike(pattern)
        out = F.when(hit, number * factor) if out is None else out.when(hit, number * factor)
    return out


def property_value(prop, raw) -> Column:
    """Property value in its canonical unit; null when the unit does not belong to the property."""


    def parts(p: Column, text: Column) -> Column:
        return let(_property_value, p, F.lower(text), parse_double(_number_text(text)), F.lower(_rest(text)))

    return let(parts, prop, text_or_empty(raw))


def _property_value(p: Column, low: Column, value: Column, unit: Column) -> Column:
    micro = F.translate(low, "μµ", "uu")
    percent = F.when(~unit.contains("%") & value.between(0.0, 1.0), value * 100.0).otherwise(value)
    ppm = (low == "") | micro.rlike(r"ppm|ug/ml|ug ml|mg/l|mg l")
    bare = low.rlike(rf"^\s*{K.NUMBER}\s*$")
    return (
        F.when(
            p.isin("photothermal_conversion_efficiency", "photocatalytic_h2o2", "furfural_hydrogenation"),
            percent,
        )
        .when(p == "conductivity", _by_pattern(low, value, _CONDUCTIVITY))
        .when(
            (p == "thermal_conductivity") & unit.contains("w") & unit.rlike(r"m-1|mk|m k"), value
        )
        .when(
            p.isin("ferromagnetism", "ferrimagnetism")
            & (unit.contains("emu") | (unit.contains("a") & unit.contains("m2") & unit.contains("kg"))),
            value,
        )
        .when((p == "antiferromagnetism") & unit.rlike(r"\bk\b"), value)
        .when((p == "antibacterial") & ppm, value)
        .when((p == "thermoelectric") & (bare | low.rlike("zt|dimensionless|unitless")), value)
    )


_FORMS = (
    ("percent", r"\s*%", " %"),
    ("percent", r"\s*(?:percent|percentage)", " %"),
    ("percent", r"", " %"),
    ("conductivity", r"\s*mS\s*/\s*m", " mS/m"),
    ("conductivity", r"\s*S\s*/\s*m", " S/m"),
    ("conductivity", r"\s*mS\s*/\s*cm", " mS/cm"),
    ("conductivity", r"\s*S\s*/\s*cm", " S/cm"),
    ("conductivity", r"\s*mS\s*m-1", " mS m-1"),
    ("conductivity", r"\s*S\s*m-1", " S m-1"),
    ("conductivity", r"\s*mS\s*cm-1", " mS cm-1"),
    ("conductivity", r"\s*S\s*cm-1", " S cm-1"),
    ("thermal", r"\s*W\s*(?:m-1\s*K-1|/\s*\(\s*m\s*K\s*\)|/\s*m\s*K)", " W m-1 K-1"),
    ("magnetization", r"\s*emu\s*(?:/\s*g|g-1)", " emu/g"),
    ("magnetization", r"", " emu/g"),
    ("temperature", r"\s*(?:K|Kelvin)", " K"),
    ("temperature", r"", " K"),
)
_FORM_OF = {
    "photothermal_conversion_efficiency": "percent",
    "conductivity": "conductivity",
    "thermal_conductivity": "thermal",
    "ferromagnetism": "magnetization",
    "ferrimagnetism": "magnetization",
    "antiferromagnetism": "temperature",
}


def strict_property_text(prop, raw) -> Column:
    """Number and unit of a value that consists of nothing else; null otherwise."""
    text = F.translate(text_or_empty(raw), "−–—‑⁃⁻·⋅× ", "------  x ")
    text = squeeze(F.replace(F.regexp_replace(text, r"(cm|m|K)\^-1", "$1-1"), F.lit("&nbsp;"), F.lit(" ")))

    def check(p: Column, t: Column) -> Column:
        number = short_number(parse_double(F.regexp_extract(t, rf"^({K.PLAIN_NUMBER})", 1)))
        label = F.lit(None).cast("string")
        for name, form in reversed(list(_FORM_OF.items())):
            of_form = F.lit(None).cast("string")
            for kind, unit, spelled in reversed(_FORMS):
                if kind == form:
                    hit = t.rlike(rf"(?i)^{K.PLAIN_NUMBER}{unit}$")
                    of_form = F.when(hit, F.lit(spelled)).otherwise(of_form)
            label = F.when(p == name, of_form).otherwise(label)
        return F.concat(number, label)

    return let(check, prop, text)


def coerce_prediction(value, expected_unit) -> Column:
    """Prediction text as a number in the expected unit; null marks a parse failure.

    Bare numbers pass. Text with a unit is accepted only when a unit is expected and it can be
    converted to it. Percent predictions between 0 and 1 are read as fractions.
    """


    def parts(text: Column, unit: Column) -> Column:
        rest = F.lower(_rest(F.regexp_replace(F.translate(text, "·⋅•/", "    "), r"\^", "")))
        return let(_coerce, text, unit, parse_double(_number_text(text)), rest)

    return let(parts, strip(value), expected_unit)


def _coerce(text: Column, unit: Column, num: Column, rest: Column) -> Column:
    given = rest != ""
    first = F.substring_index(rest, " ", 1)
    word = rest.rlike("fraction|unitless|dimensionless|ratio")
    scaled = F.when(num.between(0.0, 1.0), num * 100.0).otherwise(num)
    converted = (
        F.when(unit == "fraction_0_to_1", F.when(rest.contains("%"), num / 100.0).when(~given | word, num))
        .when(unit == "%", F.when(~given | word, scaled).when(rest.contains("%"), scaled))
        .when(~given, num)
        .when(unit == "mV", F.when(first == "mv", num).when(first == "v", num * 1000.0))
        .when(unit == "V", F.when(first == "v", num).when(first == "mv", num / 1000.0))
        .when(unit == "mA cm-2", F.when(rest.rlike("^ma cm-?2"), num).when(rest.rlike("^a cm-?2"), num * 1000.0))
        .when(
            unit == "S/m",
            F.when(rest.rlike("^m?s c?m-?1?$"), num)
            * F.when(first == "ms", 1.0e-3).otherwise(1.0)
            * F.when(rest.rlike(" cm"), 100.0).otherwise(1.0),
        )
        .when(unit == "W m-1 K-1", F.when(rest.rlike(r"^w (m-1 k-1|mk-1|m k-1|\(mk\)|m k|mk)$"), num))
        .when(unit == "emu/g", F.when(rest.rlike("^emu g(-1)?$|^a m2 kg(-1)?$"), num))
        .when(unit == "K", F.when(first == "k", num))
        .when(
            unit.isin("A mg^-1", "A mg-1"),
            F.when(rest.rlike("^a mg(-1)?"), num).when(rest.rlike("^ma mg(-1)?"), num / 1000.0),
        )
        .when(
            unit.isin("A g^-1", "A g-1"),
            F.when(rest.rlike("^a g(-1)?"), num).when(rest.rlike("^ma g(-1)?"), num / 1000.0),
        )
    )
    plain = F.when(unit == "%", scaled).otherwise(num)
    return finite(F.when(text.rlike(rf"^{K.NUMBER}$"), plain).when(unit.isNotNull(), converted))


