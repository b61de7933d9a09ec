"""Resumable reads: files in order, and a row offset in the one that was open.

``batch`` gives the next rows as a Dataset.  Files are counted in groups, in tasks; files that a batch
holds whole are read as they are, and of the first and the last the rows are numbered, by the
rows of each partition and the place in it.  What reaches the driver is a number a file and
one a partition of those two; files that are done are never opened again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.dataset import Dataset
from . import formats, unite

_GROUP = 32  # files counted by one job
_PLACE = (1 << 33) - 1


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Adds each row's number in the order of partitions, from 0."""
    sizes = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().orderBy("p").collect()  # a row a partition
    starts, before = [], 0
    for p, n in sizes:
        starts.append((p, before))
        before += n
    held = df.sparkSession.createDataFrame(starts, "_part int, _before long")
    placed = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33).cast("int"))
    row = F.col("_before") + F.col("_at").bitwiseAND(F.lit(_PLACE))
    return placed.join(F.broadcast(held), "_part").withColumn(name, row).drop("_part", "_before", "_at")


class CursorRead:
    """The rows of ``files`` from ``cursor`` on, in batches or one by one; ``cursor`` after a batch or
    a row resumes behind it.  ``chosen`` filters and selects, and offsets count what it lets
    through."""

    def __init__(self, spark: SparkSession, files: list[str], cursor: dict | str | None = None, schema: StructType | None = None, format: str | None = None, chosen: Callable[[DataFrame], DataFrame] | None = None):
        state = json.loads(cursor) if isinstance(cursor, str) else dict(cursor or {})
        self.spark, self.files, self.schema, self.format, self.chosen = spark, sorted(files), schema, format, chosen
        self.done, self.file, self.row = set(state.get("done", [])), state.get("file"), state.get("row", 0)

    @property
    def cursor(self) -> dict:
        return {"done": sorted(self.done), "file": self.file, "row": self.row}

    def _read(self, f: str) -> DataFrame | None:
        df = formats.read_files(self.spark, [f], self.schema, self.format)
        return df if df is None or self.chosen is None else self.chosen(df)

    def _left(self) -> list[str]:
        left = [f for f in self.files if f not in self.done]
        return sorted(left, key=lambda f: (f != self.file, f))  # the open file first

    def _sized(self) -> Iterator[tuple[str, DataFrame, int]]:
        """Files that are left, their rows and the number of those."""
        left = self._left()
        for at in range(0, len(left), _GROUP):
            frames = [(f, df) for f in left[at : at + _GROUP] if (df := self._read(f)) is not None]
            if frames:
                each = reduce(DataFrame.union, [df.select(F.lit(i).alias("i")) for i, (_, df) in enumerate(frames)])
                sizes = {r["i"]: r["count"] for r in each.groupBy("i").count().collect()}
                yield from ((f, df, sizes.get(i, 0)) for i, (f, df) in enumerate(frames))

    def batch(self, rows: int | None = None) -> Dataset | None:
        """The next ``rows`` rows, or all that are left; None if there are none."""
        wanted, out = rows, []
        for f, df, n in self._sized():
            skip = self.row if f == self.file else 0
            take = n - skip if wanted is None else min(n - skip, wanted)
            if take > 0:
                part = df
                if skip or take < n - skip:
                    at = "_row"
                    while at in df.columns:
                        at += "_"
                    part = numbered(df, at).where((F.col(at) >= skip) & (F.col(at) < skip + take)).drop(at)
                out.append(part)
            if skip + take < n:
                self.file, self.row = f, skip + take
            else:
                self.done.add(f)
                self.file, self.row = None, 0
            if wanted is not None:
                wanted -= max(take, 0)
                if wanted <= 0:
                    break
        found = unite.united(out)
        return None if found is None else Dataset(found)

    def __iter__(self) -> Iterator[dict]:
        """One by one, through the driver, for callers that need each row there."""
        for f in self._left():
            skip = self.row if f == self.file else 0
            self.file, self.row = f, skip
            df = self._read(f)
            if df is not None:
                for i, r in enumerate(df.coalesce(1).offset(skip).toLocalIterator(), skip):
                    self.row = i + 1
                    yield r.asDict(True)
            self.done.add(f)
            self.file, self.row = None, 0
