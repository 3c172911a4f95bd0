"""Error metrics and rewards."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siftlab.functions import fixed as K
from siftlab.functions.numbers import finite
from siftlab.functions.text import as_col, let, lookup


def error_floor(unit, profile: str) -> Column:
    return lookup(unit, K.ERROR_FLOORS[profile], 0.0)


def relative_error(predicted, actual, unit=None, profile: str = "analytics") -> Column:
    """|p - a| / (|a| + floor); a zero denominator counts as 1; null unless both are finite."""
    floor = F.coalesce(error_floor(unit, profile), F.lit(0.0)) if unit is not None else F.lit(0.0)

    def error(p: Column, a: Column, f: Column) -> Column:
        denominator = F.abs(a) + f
        return F.abs(p - a) / F.when(denominator <= 0, F.lit(1.0)).otherwise(denominator)

    return let(error, finite(predicted), finite(actual), floor)


def decay_score(error) -> Column:
    return F.exp(-as_col(error))


def feedback_reward(error) -> Column:
    """1 up to 2 % error, else the decay score kept inside [0.05, 0.95]."""
    return let(
        lambda e: F.when(e <= 0.02, F.lit(1.0)).otherwise(
            F.greatest(F.lit(0.05), F.least(F.lit(0.95), decay_score(e)))
        ),
        F.coalesce(as_col(error), F.lit(0.0)),
    )


def metric_reward(truth: Column, predicted: Column, units: Column) -> Column:
    """Mean decay score over the truth's metrics; a missing key scores 0, an extra key voids the row."""
    return let(_metric_reward, truth, predicted, units)


def _metric_reward(truth: Column, predicted: Column, units: Column) -> Column:
    scores = F.map_zip_with(
        truth,
        predicted,
        lambda k, t, p: F.coalesce(
            decay_score(relative_error(p, t, F.try_element_at(units, k), "reward")), F.lit(0.0)
        ),
    )
    extra = F.size(F.array_except(F.map_keys(predicted), F.map_keys(truth)))
    total = F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, x: a + x)
    mean = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / F.size(truth)))
    return F.when((F.size(truth) == 0) | (extra > 0), F.lit(0.0)).otherwise(mean)
