"""Mergeable sketches: distinct counts and quantiles of a table's parts, stored and united later.

A part, such as a day's frame, is summed up in a row a key that holds a HyperLogLog sketch of each
counted column and a KLL sketch of each ranked one.  Rows of many parts unite into one without
their tables being read again, so a month is the union of its days.  Sketches are built before the
shuffle and united after it: a hot key sends a few kilobytes a task, whatever its rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dataset import name_of

_ROWS, _DISTINCT, _RANKS = "rows", "_distinct", "_ranks"
_HASHED = (T.IntegerType, T.LongType, T.StringType, T.BinaryType)


def sketch(df: DataFrame, keys: list[str], distinct: Iterable[str] = (), ranks: Iterable[str] = (), precision: int = 12, k: int = 400) -> DataFrame:
    """One row a key: the keys, ``rows``, and ``<column>_distinct`` and ``<column>_ranks`` in binary.

    A distinct count errs by 1.04 / sqrt(2 ** ``precision``) in the standard deviation (1.6 % at
    12); a quantile's rank is off by less than 1 % in 99 of 100 cases at ``k`` 400.  Nulls are in ``rows``
    alone.  No keys make one row, of an empty table too.
    """
    out = [F.count(F.lit(1)).alias(_ROWS)]
    for c in distinct:
        kind = df.select(name_of(c)).schema[0].dataType
        value = name_of(c) if isinstance(kind, _HASHED) else name_of(c).cast("string")
        out.append(F.hll_sketch_agg(value, F.lit(precision)).alias(c + _DISTINCT))
    for c in ranks:
        out.append(F.kll_sketch_agg_double(name_of(c).cast("double"), F.lit(k)).alias(c + _RANKS))
    return df.groupBy(*map(name_of, keys)).agg(*out)


def unite(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``sketch``, or of an earlier union, of many parts as one row for each of fewer keys."""
    out = [F.coalesce(F.sum(_ROWS), F.lit(0)).alias(_ROWS)]
    for c in sketches.columns:
        if c.endswith(_DISTINCT) and c not in keys:
            out.append(F.hll_union_agg(name_of(c), F.lit(True)).alias(c))
        elif c.endswith(_RANKS) and c not in keys:
            out.append(F.kll_merge_agg_double(name_of(c)).alias(c))
    return sketches.groupBy(*map(name_of, keys)).agg(*out)


def n_distinct(column: str) -> Column:
    """The estimated count of a column's distinct values, from its sketch."""
    return F.hll_sketch_estimate(name_of(column + _DISTINCT))


def n_ranked(column: str) -> Column:
    """How many values a column's quantiles rest on; exact."""
    return F.kll_sketch_get_n_double(name_of(column + _RANKS))


def quantile(column: str, share: float) -> Column:
    """The value below which ``share`` of a column's values lie; null where there are none."""
    return F.when(n_ranked(column) > 0, F.kll_sketch_get_quantile_double(name_of(column + _RANKS), F.lit(float(share))))


def rank(column: str, value: Column | float) -> Column:
    """The share of a column's values up to ``value``; null where there are none."""
    at = value if isinstance(value, Column) else F.lit(float(value))
    return F.when(n_ranked(column) > 0, F.kll_sketch_get_rank_double(name_of(column + _RANKS), at))
