"""Streaming sink: rows routed to paths made of their own values, bad rows set aside.

Each micro-batch is one write to folders named by its batch id, so a batch that runs twice
writes the same files; the stream's checkpoint makes reads resumable.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, StructType

from ..sources import writers
from ..sources.paths import fill
from ..sources.schema import conform

_PLACE = re.compile(r"\{(\w+)\}")
_DATES = {"yyyy", "mm", "dd", "HH", "MM", "SS", "date"}


def routed(df: DataFrame, template: str) -> DataFrame:
    """Adds ``_path``: the template with each {column} filled by the row's value.  A list
    fans out: one copy of the row for each combination of distinct list items."""
    path, out = [], df
    names = [n for n in _PLACE.findall(template) if n not in _DATES]
    for i, name in enumerate(dict.fromkeys(names)):
        c = F.col(name) if name in df.columns else F.lit(None).cast("string")
        if name in df.columns and isinstance(df.schema[name].dataType, ArrayType):
            out = out.withColumn(f"_v{i}", F.explode_outer(F.array_distinct(c.cast("array<string>"))))
        else:
            out = out.withColumn(f"_v{i}", c.cast("string"))
    order = {n: i for i, n in enumerate(dict.fromkeys(names))}
    for k, part in enumerate(_PLACE.split(template)):
        if k % 2 == 0:
            path.append(F.lit(part))
        elif part in order:
            path.append(F.regexp_replace(F.coalesce(F.col(f"_v{order[part]}"), F.lit("null")), "[^A-Za-z0-9_.@-]", "_"))
        else:
            path.append(F.lit("{" + part + "}"))
    return out.withColumn("_path", F.concat(*path)).drop(*[f"_v{i}" for i in order.values()])


def _root(template: str) -> str:
    return template.split("{")[0].rsplit("/", 1)[0]


def _batch(spark: SparkSession, batch_id: int) -> str:
    stream = (spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream")[:8]
    return f"batch-{stream}-{batch_id:012d}"


def backout(spark: SparkSession, template: str, batch_id: int) -> str:
    """The folder of a batch's rows that are set aside."""
    return f"{_root(template)}/BACKOUT/{_batch(spark, batch_id)}"


def write_batch(df: DataFrame, batch_id: int, template: str, schema: StructType | None = None, at: datetime.datetime | None = None, format: str = "jsonl") -> None:
    """One micro-batch.  ``template`` is a path with date places, filled from the clock, and
    {column} places; rows that do not fit ``schema`` go to a BACKOUT folder beside it.  Its
    files lie in a folder of the stream's and the batch's name, beside those of other batches:
    a reader sees all of them, and a batch that runs twice replaces its own."""
    spark = df.sparkSession
    root = _root(template)
    rest = fill(template, at or datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None))[len(root) + 1 :]
    name = _batch(spark, batch_id)
    df.persist()
    try:
        good = df
        if schema is not None:
            typed, valid = conform(df, schema)
            bad = typed.where(~valid).drop("_typed")
            if not bad.isEmpty():
                writers.write_files(bad, backout(spark, template, batch_id), format)
            good = typed.where(valid).select("_typed.*")
        rows = routed(good, rest)
        writers.write_routed(rows.withColumn("_path", F.concat("_path", F.lit(f"/{name}"))), root, format)
    finally:
        df.unpersist()


def start(stream: DataFrame, template: str, checkpoint: str, schema: StructType | None = None, clock: Callable[[], datetime.datetime] | None = None, trigger: dict | None = None, format: str = "jsonl") -> StreamingQuery:
    """Starts the sink; ``trigger`` is passed on, availableNow by default."""
    run = lambda df, i: write_batch(df, i, template, schema, clock() if clock else None, format)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
