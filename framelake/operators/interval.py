"""Interval joins: pairs of rows whose closed intervals meet, by equal bins of their own size.

An interval's level is the least power of two that its length stays below, so it lies in one or two
bins of that width.  Two intervals meet in a bin of the longer one's level, and there in the bin that holds
the later start, once.  A row is copied to its own level and to the longer ones that the other table
has, two bins each at most: long intervals are not cut into many short bins, and short ones
do not crowd in long bins unless a long interval is there.  The join is an equality on keys, level
and bin, so a hot key spreads over its bins and adaptive execution splits a hot bin; nothing is broadcast by force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .asof import _free
from .dataset import name_of

_STEP = 2


def _whole(df: DataFrame, c: str) -> Column:
    """A value as a long that never reverses order; bins need no more."""
    kind = df.select(name_of(c)).schema[0].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(name_of(c).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(name_of(c)).cast("bigint")
    return F.floor(name_of(c)).cast("bigint")


def _level(start: Column, end: Column) -> Column:
    length = F.try_subtract(end, start)
    bits = F.when(length == 0, F.lit(0)).otherwise(F.length(F.bin(length)))
    up = (F.floor((F.coalesce(bits, F.lit(63)) + (_STEP - 1)) / _STEP) * _STEP).cast("int")
    return F.least(up, F.lit(63))


def _bin(x: Column, level: Column) -> Column:
    return F.call_function("shiftright", x, level)


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], span: tuple[str, str], right_span: tuple[str, str] | None = None) -> DataFrame:
    """Every pair of rows with equal ``keys`` of which the intervals ``span`` and ``right_span``, (start,
    end) columns that may be one column, have a point in common; ends count.

    Bounds are numbers, dates or timestamps.  A row with a null key or bound, or an end before
    its start, meets nothing; repeated rows make pairs each.  Columns of both sides keep the left's name,
    the right's other than keys get ``right_`` before it.
    """
    right_span = right_span or span
    taken = [*left.columns, *right.columns]
    s, e, own, level, at, row = (_free(taken, f"_{x}") for x in ("start", "end", "own", "level", "bin", "row"))
    held = [_free(taken, f"_k{i}") for i in range(len(keys))]

    def rows(df: DataFrame, ends: tuple[str, str], kept: list[str]) -> DataFrame:
        low, high = (_whole(df, c) for c in ends)
        known = name_of(ends[0]) <= name_of(ends[1])
        for k in keys:
            known = known & name_of(k).isNotNull()
        out = df.where(known).select(*[name_of(k).alias(h) for k, h in zip(keys, held)], low.alias(s), high.alias(e), F.struct(name_of(ends[0]).alias("s"), name_of(ends[1]).alias("e"), F.struct(*map(name_of, kept)).alias("r")).alias(row))
        return out.withColumn(own, _level(F.col(s), F.col(e)))

    rest = [c for c in right.columns if c not in keys]
    sides = rows(left, span, left.columns), rows(right, right_span, rest or keys)
    # At most 33 levels a side, known from one aggregate each.
    levels = [sorted(x[0] for x in df.select(own).distinct().collect()) for df in sides]
    if not all(levels):
        levels = [[63], [63]]

    def placed(df: DataFrame, mine: list[int], theirs: list[int]) -> DataFrame:
        here = F.array(*[F.lit(x) for x in sorted({*mine, *theirs})])
        met = F.filter(here, lambda x: ((x == F.col(own)) & (F.col(own) >= theirs[0])) | ((x > F.col(own)) & x.isin(theirs)))
        out = df.withColumn(level, F.explode(met))
        return out.withColumn(at, F.explode(F.sequence(_bin(F.col(s), F.col(level)), _bin(F.col(e), F.col(level)))))

    a = placed(sides[0], *levels).alias("a")
    b = placed(sides[1], *reversed(levels)).alias("b")
    of = lambda t, c: F.col(f"{t}.{c}")
    same = [of("a", c) == of("b", c) for c in (*held, level, at)]
    once = (F.greatest(of("a", own), of("b", own)) == of("a", level)) & (_bin(F.greatest(of("a", s), of("b", s)), of("a", level)) == of("a", at))
    meet = (of("a", f"{row}.s") <= of("b", f"{row}.e")) & (of("b", f"{row}.s") <= of("a", f"{row}.e"))
    on = once & meet
    for x in same:
        on = on & x
    names = {c: f"right_{c}" if c in left.columns else c for c in rest}
    mine, theirs = of("a", row)["r"], of("b", row)["r"]
    return a.join(b, on).select(*[mine.getField(c).alias(c) for c in left.columns], *[theirs.getField(c).alias(names[c]) for c in rest])
