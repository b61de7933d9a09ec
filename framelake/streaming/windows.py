"""Windows of event time over a stream, with late rows set aside instead of lost.

A batch's rows are summed up by key and window before they are shuffled, then united with the
windows that earlier batches left open; windows behind the watermark are given out, once, by the
batch that closes them.  What a batch leaves open is a table in the stream's checkpoint folder, a
row a key and window, so a stream goes on from it, and a batch that runs twice reads the table of
the one before and writes the same.

The watermark of a batch is the greatest time of all batches before it less ``delay``.  A row
is late if its window is closed by then: such rows, and rows without a time, go to BACKOUT whole.
All others count, so what is given out is what one GROUP BY over the rows that are not late gives.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.dataset import name_of
from ..sources import storage, writers
from . import sink

_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
_START, _END = "window_start", "window_end"


def _micros(span: datetime.timedelta) -> int:
    return span // datetime.timedelta(microseconds=1)


class EventWindows:
    """Windows over the column ``time``: of a fixed ``length`` from the epoch, or sessions, which rows of a
    key not more than ``gap`` apart form.

    ``aggs`` names (kind, column) pairs, kind one of count, sum, min, max and avg; column None counts
    rows.  Results have the keys, window_start, window_end (a session's: its last row's time and ``gap``) and
    the aggregates.  Null keys are a key.
    """

    def __init__(self, time: str, keys: list[str], aggs: dict[str, tuple[str, str | None]], length: datetime.timedelta | None = None, gap: datetime.timedelta | None = None, delay: datetime.timedelta = datetime.timedelta(0)):
        if (length is None) == (gap is None):
            raise ValueError("either a length or a gap")
        span = _micros(length if gap is None else gap)
        if span <= 0 or _micros(delay) < 0:
            raise ValueError("a length or gap above zero and a delay not below")
        if unknown := {kind for kind, _ in aggs.values()} - {*_MERGE, "avg"}:
            raise ValueError(f"no such aggregate: {', '.join(sorted(unknown))}")
        if taken := {_START, _END, *aggs} & {*keys}:
            raise ValueError(f"keys and results of one name: {', '.join(sorted(taken))}")
        self.time, self.keys, self.aggs = time, keys, aggs
        self.span, self.sessions, self.delay = span, gap is not None, _micros(delay)
        self.held = [f"_k{i}" for i in range(len(keys))]
        # An average is held as a sum and a count.
        self.parts = [p for kind, c in aggs.values() for p in ([("sum", c), ("count", c)] if kind == "avg" else [(kind, c)])]

    def _at(self, df: DataFrame) -> Column:
        """The time in microseconds from the epoch."""
        if isinstance(df.select(name_of(self.time)).schema[0].dataType, T.TimestampType):
            return F.unix_micros(name_of(self.time))
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), name_of(self.time).cast("timestamp_ntz"))

    def late(self, df: DataFrame, mark: int | None) -> Column:
        at = self._at(df)
        if mark is None:
            return at.isNull()
        over = at < mark if self.sessions else at - F.pmod(at, F.lit(self.span)) + self.span <= mark
        return at.isNull() | over

    def closed(self, mark: int | None) -> Column:
        """Whether no row that is not late can change a window any more."""
        if mark is None:
            return F.lit(False)
        return F.col(_END) < mark if self.sessions else F.col(_END) <= mark

    def partial(self, df: DataFrame) -> DataFrame:
        """Rows by key and window.  Rows of a session are summed up by slices as long as the gap
        first: rows of a slice are in one session, so a key with many rows sends a few."""
        value = lambda kind, c: getattr(F, kind)(F.lit(1) if c is None else name_of(c))
        out = [value(*p).alias(f"_p{i}") for i, p in enumerate(self.parts)]
        at = self._at(df)
        first = F.min(at) if self.sessions else F.min(at - F.pmod(at, F.lit(self.span)))
        last = F.max(at) + self.span if self.sessions else first + self.span
        slices = (at - F.pmod(at, F.lit(self.span))).alias("_slice")
        found = df.groupBy(*[name_of(k).alias(h) for k, h in zip(self.keys, self.held)], slices)
        return found.agg(first.alias(_START), last.alias(_END), *out).drop("_slice")

    def united(self, parts: DataFrame) -> DataFrame:
        """Windows of one key that are the same, or meet if they are sessions, as one."""
        merged = [_MERGE[kind](f"_p{i}").alias(f"_p{i}") for i, (kind, _) in enumerate(self.parts)]
        if not self.sessions:
            return parts.groupBy(*self.held, _START, _END).agg(*merged)
        order = Window.partitionBy(*self.held).orderBy(_START, _END)
        before = F.max(_END).over(order.rowsBetween(Window.unboundedPreceding, -1))
        opens = parts.withColumn("_new", F.coalesce((F.col(_START) > before).cast("int"), F.lit(1)))
        named = opens.withColumn("_session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return named.groupBy(*self.held, "_session").agg(F.min(_START).alias(_START), F.max(_END).alias(_END), *merged).drop("_session")

    def results(self, windows: DataFrame, zoned: bool) -> DataFrame:
        epoch = F.lit("1970-01-01").cast("timestamp_ntz")
        when = lambda c: F.timestamp_micros(c) if zoned else F.timestamp_add("MICROSECOND", F.col(c), epoch)
        out, i = [], 0
        for name, (kind, _) in self.aggs.items():
            if kind == "avg":
                out.append((F.col(f"_p{i}") / F.col(f"_p{i + 1}")).alias(name))
            else:
                out.append(F.col(f"_p{i}").alias(name))
            i += 2 if kind == "avg" else 1
        keys = [F.col(h).alias(k) for k, h in zip(self.keys, self.held)]
        return windows.select(*keys, when(_START).alias(_START), when(_END).alias(_END), *out)


def _mark(spark: SparkSession, state: str, batch_id: int) -> tuple[int | None, bool]:
    """The watermark that a batch left, and whether its times have a zone."""
    path = f"{state}/mark-{batch_id}"
    if not storage.exists(spark, path):
        raise ValueError(f"no state of batch {batch_id} in {state}")
    mark, zoned = storage.read_text(spark, path).split()
    return (None if mark == "none" else int(mark)), zoned == "zoned"


def write_batch(df: DataFrame, batch_id: int, windows: EventWindows, template: str, state: str, at: datetime.datetime | None = None, format: str = "jsonl") -> None:
    """One micro-batch: closed windows go to ``template``, as in the sink, late rows to BACKOUT beside it."""
    spark = df.sparkSession
    mark = _mark(spark, state, batch_id - 1)[0] if batch_id else None
    zoned = isinstance(df.select(name_of(windows.time)).schema[0].dataType, T.TimestampType)
    late = F.coalesce(windows.late(df, mark), F.lit(True))
    df.persist()
    try:
        last, n_late = df.agg(F.max(windows._at(df)), F.count(F.when(late, 1))).first()
        parts = windows.partial(df.where(~late))
        if batch_id:
            before = spark.read.schema(parts.schema).parquet(f"{state}/windows-{batch_id - 1}")
            parts = parts.unionByName(before.where(~windows.closed(mark)))
        path = f"{state}/windows-{batch_id}"
        windows.united(parts).write.mode("overwrite").parquet(path)
        if n_late:
            writers.write_files(df.where(late), sink.backout(spark, template, batch_id), format)
    finally:
        df.unpersist()
    after = max((x for x in (mark, None if last is None else last - windows.delay) if x is not None), default=None)
    done = spark.read.schema(parts.schema).parquet(path).where(windows.closed(after))
    sink.write_batch(windows.results(done, zoned), batch_id, template, at=at, format=format)
    storage.write_text(spark, f"{state}/mark-{batch_id}", f"{'none' if after is None else after} {'zoned' if zoned else 'plain'}")
    # The batch before may run again only until this one is committed.
    storage.delete(spark, f"{state}/windows-{batch_id - 2}")


def start(stream: DataFrame, windows: EventWindows, template: str, checkpoint: str, clock=None, trigger: dict | None = None, format: str = "jsonl") -> StreamingQuery:
    """Starts the windows over a stream; ``trigger`` is passed on, availableNow by default."""
    state = f"{checkpoint}/event-windows"
    run = lambda df, i: write_batch(df, i, windows, template, state, clock() if clock else None, format)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def open_windows(spark: SparkSession, windows: EventWindows, checkpoint: str) -> DataFrame:
    """The windows that the last batch of a stream left open, as they stand."""
    state = f"{checkpoint}/event-windows"
    ids = [int(f.rsplit("/mark-", 1)[1]) for f in storage.files(spark, state) if "/mark-" in f]
    if not ids:
        raise ValueError(f"no batch has run in {checkpoint}")
    mark, zoned = _mark(spark, state, max(ids))
    return windows.results(spark.read.parquet(f"{state}/windows-{max(ids)}").where(~windows.closed(mark)), zoned)
