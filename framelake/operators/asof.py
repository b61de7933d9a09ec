"""As-of joins: to each row the latest row of another table at or before its time.

Both sides are cut into ranges of (key, time) of about equal size, so a key with many rows
spreads over ranges.  Within a range a window finds the latest row; what a range takes over
from those before it is one row a key and range, found in a table that small.  No pair of rows is
made that is no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .dataset import name_of


def _free(taken: list[str], name: str) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, right_time: str | None = None, ranges: int | None = None) -> DataFrame:
    """Every row of ``left``, with ``right``'s other columns of the row of equal ``keys`` that has the latest
    ``right_time`` not after ``time``; nulls where there is none.

    Of several right rows at one time the greatest by their other columns, in order, counts.  Rows
    whose keys or times are null meet nothing; columns of both sides keep the left's name, the
    right's get ``right_`` before it.
    """
    right_time = right_time or time
    spark = left.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    taken = [*left.columns, *right.columns]
    side, at, mine, theirs, part = (_free(taken, f"_{x}") for x in ("side", "at", "mine", "theirs", "part"))
    held = [_free(taken, f"_k{i}") for i in range(len(keys))]
    rest = [c for c in right.columns if c not in keys]

    def rows(df: DataFrame, when: str, which: int) -> DataFrame:
        own = F.struct(*map(name_of, df.columns))
        return df.select(
            *[name_of(k).alias(h) for k, h in zip(keys, held)],
            name_of(when).alias(at),
            F.lit(which).alias(side),
            (own if which else F.lit(None).cast(left.schema)).alias(mine),
            (F.lit(None).cast(_struct(right, rest)) if which else F.struct(*map(name_of, rest))).alias(theirs),
        )

    def known(df: DataFrame, when: str) -> Column:
        out = name_of(when).isNotNull()
        for k in keys:
            out = out & name_of(k).isNotNull()
        return out

    # The greatest of the right rows at one time, by a combinable maximum.
    few = rows(right.where(known(right, right_time)), right_time, 0).groupBy(*held, at).agg(F.max(theirs).alias(theirs))
    few = few.select(*held, at, F.lit(0).alias(side), F.lit(None).cast(left.schema).alias(mine), theirs)
    both = few.unionByName(rows(left.where(known(left, time)), time, 1))
    # Written once: ranges are cut by a sample, and both uses must see the same ones.
    path = scratch_path(spark, "ranges")
    both.repartitionByRange(n, *held, at).withColumn(part, F.spark_partition_id()).write.parquet(path)
    cut = spark.read.parquet(path)

    # Right rows come first at one time, so a left row sees them.
    inside = Window.partitionBy(*held, part).orderBy(at, side).rowsBetween(Window.unboundedPreceding, 0)
    seen = cut.withColumn(theirs, F.last(theirs, ignorenulls=True).over(inside))
    last = cut.groupBy(*held, part).agg(F.max_by(theirs, F.when(F.col(side) == 0, F.col(at))).alias(theirs))
    before = Window.partitionBy(*held).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = _free(taken, "_carried")
    last = last.withColumn(carried, F.last(theirs, ignorenulls=True).over(before)).where(F.col(carried).isNotNull()).drop(theirs)
    met = seen.where(F.col(side) == 1).join(last, [*held, part], "left")
    found = met.select(mine, F.coalesce(theirs, carried).alias(theirs))
    lone = left.where(~F.coalesce(known(left, time), F.lit(False))).select(F.struct(*map(name_of, left.columns)).alias(mine), F.lit(None).cast(_struct(right, rest)).alias(theirs))
    names = {c: f"right_{c}" if c in left.columns else c for c in rest}
    return found.unionByName(lone).select(
        *[F.col(mine).getField(c).alias(c) for c in left.columns],
        *[F.col(theirs).getField(c).alias(names[c]) for c in rest],
    )


def _struct(df: DataFrame, names: list[str]):
    return df.select(*map(name_of, names)).schema
