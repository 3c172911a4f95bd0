"""Registries that choose a scorer or a report by the value of a column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


class ScorerRegistry:
    """Named reward expressions; a scorer gets the frame and returns a column.

    The column may be built-in expressions or a pandas UDF, so a scorer stays one projection.
    """

    def __init__(self, default: Callable[[DataFrame], Column]):
        self._default, self._scorers = default, {}

    def register(self, name: str, scorer: Callable[[DataFrame], Column]) -> None:
        self._scorers[name.lower()] = scorer

    def score(self, df: DataFrame, name_col: str, out: str = "reward") -> DataFrame:
        """Each row is scored by the scorer its name column asks for, else by the default."""
        name = F.lower(F.col(name_col))
        reward = self._default(df)
        for key, scorer in self._scorers.items():
            reward = F.when(name == key, scorer(df)).otherwise(reward)
        return df.withColumn(out, reward)


class ProcessorRegistry:
    """Reports chosen by predicate: the first matching report takes the row."""

    def __init__(self):
        self._rules: list[tuple[str, Column, Callable[[DataFrame], DataFrame]]] = []

    def register(self, metric: str, applies: Column, report: Callable[[DataFrame], DataFrame]) -> None:
        self._rules.append((metric, applies, report))

    def run(self, df: DataFrame) -> DataFrame:
        taken, parts = F.lit(False), []
        for metric, applies, report in self._rules:
            hit = F.coalesce(applies, F.lit(False))
            parts.append(report(df.where(hit & ~taken)).withColumn("metric", F.lit(metric)))
            taken = taken | hit
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out
