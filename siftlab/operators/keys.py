"""Joins in which null keys match null keys, as dictionary keys do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on equal or both-null keys; the result has the left keys once, as a ``using`` join does."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    renamed = right.select(*[F.col(k).alias(f"_right_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    matched = reduce(lambda a, b: a & b, [left[k].eqNullSafe(F.col(f"_right_{i}")) for i, k in enumerate(keys)])
    return left.join(renamed, matched, how).drop(*[f"_right_{i}" for i in range(len(keys))])
