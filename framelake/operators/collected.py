"""A dataset seen as a map from key to records."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dataset import Dataset, name_of


class CollectedSet:
    def __init__(self, df: DataFrame, key: str, dedupe: bool = False):
        self.df, self.key = (df.distinct() if dedupe else df), key

    def count(self) -> Dataset:
        """(key, count)."""
        return Dataset(self.df.groupBy(name_of(self.key)).agg(F.count("*").alias("count")))

    def aggregate(self, column: str, f: str | Callable[[list], Any], returns: str = "double", merge: Callable[[list], Any] | None = None) -> Dataset:
        """One value a key: 'max', 'min', 'sum', 'len', 'avg' in Spark, or a function of the
        list of values, run beside the data.  With ``merge`` the function is taken over parts
        of a key's values in each task and ``merge`` over the parts' results, so a key of any
        size is spread; without it a key's values must fit a worker."""
        native = {"max": F.max, "min": F.min, "sum": F.sum, "len": F.count, "count": F.count, "avg": F.avg}
        for fn, name in ((max, "max"), (min, "min"), (sum, "sum"), (len, "len")):
            f = name if f is fn else f
        if isinstance(f, str):
            return Dataset(self.df.groupBy(name_of(self.key)).agg(native[f](name_of(column)).alias(column)))
        rows, last = self.df.select(name_of(self.key), name_of(column)), merge or f
        if merge is not None:
            key = rows.schema[self.key].dataType.simpleString()

            def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    for k, v in b.groupby(b.columns[0], dropna=False)[b.columns[1]]:
                        yield pd.DataFrame({"k": pd.Series([None if pd.isna(k) else k], dtype=object), "v": [f(list(v))]})

            rows = rows.mapInPandas(parts, f"k {key}, v {returns}").toDF(self.key, column)
        run = F.pandas_udf(lambda s: s.map(lambda v: last(list(v))), returns)
        return Dataset(rows.groupBy(name_of(self.key)).agg(F.collect_list(name_of(column)).alias("_v")).select(name_of(self.key), run("_v").alias(column)))

    def apply(self, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Dataset:
        """A function of each key's records."""
        return Dataset(self.df.groupBy(name_of(self.key)).applyInPandas(f, schema))

    def __len__(self) -> int:
        return self.df.select(name_of(self.key)).distinct().count()

    def __contains__(self, value: Any) -> bool:
        return not self.df.where(name_of(self.key).eqNullSafe(value)).isEmpty()

    def __getitem__(self, value: Any) -> Dataset:
        return Dataset(self.df.where(name_of(self.key).eqNullSafe(value)))

    def items(self) -> Iterator[tuple[Any, Dataset]]:
        for r in self.df.select(name_of(self.key)).distinct().toLocalIterator():
            yield r[0], self[r[0]]
