"""Grouped aggregation with the surface's labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dataset import Dataset, name_of

AGGREGATES: dict[str, Callable[[str], Column]] = {
    "SUM": F.sum, "MAX": F.max, "MIN": F.min, "AVG": F.avg, "COUNT": F.count,
}


class GroupBy:
    """``GroupBy(dataset, *columns)``; '*' alone is one group, absent if there are no rows."""

    def __init__(self, dataset: Dataset, *columns: str):
        self.dataset, self.columns = dataset, [c for c in columns if c != "*"]

    def aggregate(self, pairs: list[tuple[str, str]]) -> Dataset:
        """[(FUNCTION, column)], labelled ``FUNCTION(column)``, then the group's columns."""
        aggs = []
        for f, c in pairs:
            if f.upper() not in AGGREGATES:
                raise ValueError(f"unknown aggregate {f!r}; known: {', '.join(AGGREGATES)}")
            aggs.append(AGGREGATES[f.upper()](name_of(c)).alias(f"{f.upper()}({c})"))
        df = self.dataset.df
        if self.columns:
            keys = [name_of(c) for c in self.columns]
            out = df.groupBy(*keys).agg(*aggs).select(*[name_of(f"{f.upper()}({c})") for f, c in pairs], *keys)
        else:
            out = df.groupBy(F.lit(1).alias("_one")).agg(*aggs).drop("_one")
        return self.dataset._new(out)

    def _all(self, f: str, columns: tuple[str, ...]) -> Dataset:
        return self.aggregate([(f, c) for c in columns])

    def max(self, *columns: str) -> Dataset:
        return self._all("MAX", columns)

    def min(self, *columns: str) -> Dataset:
        return self._all("MIN", columns)

    def sum(self, *columns: str) -> Dataset:
        return self._all("SUM", columns)

    def average(self, *columns: str) -> Dataset:
        return self._all("AVG", columns)

    def count(self, *columns: str) -> Dataset:
        return self._all("COUNT", columns or ("*",))

    def groups(self) -> Dataset:
        """The distinct keys."""
        return self.dataset._new(self.dataset.df.select(*map(name_of, self.columns)).distinct())
