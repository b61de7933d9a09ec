"""Sinks: framed batches, plain formats and database tables."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import direct, frames, storage
from .direct import FILE_BYTES, Made
from .paths import DAY_TEMPLATE, as_datetime, fill
from .schema import Report, declared, examine, expect
from .unite import name_of

FORMATS = direct.FORMATS


def check_name(dataset: str) -> str:
    if re.search(r"(^|/)BACKOUT(/|$)|[{}%]", dataset) or dataset.endswith("/"):
        raise ValueError(f"not a dataset name: {dataset!r}")
    return dataset


def write_files(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite", file_bytes: int = FILE_BYTES, schema: StructType | None = None) -> None:
    """A folder of files of one of ``FORMATS``, cut at ``file_bytes``.  Its manifest is the commit; what
    ``overwrite`` replaces is deleted after it, and what ``append`` finds is named in it too."""
    if mode not in ("overwrite", "append"):
        raise ValueError("mode is overwrite or append")
    spark = df.sparkSession
    df = declared(df, schema) if schema is not None else df
    before = _present(spark, path) if mode == "append" else []
    made = before + direct.write(df, path, format, file_bytes=file_bytes)
    manifest = direct.commit(spark, path, made)
    direct.supersede(spark, path, manifest, made)


def _present(spark: SparkSession, path: str) -> list[Made]:
    """The data files that a read of a folder would see."""
    root = storage.qualified(spark, path)
    found = frames.resolve(storage.files(spark, path), None, lambda m: direct.listed(spark, m))
    return [Made("", f.removeprefix(f"{root}/"), 0, 0) for f in found]


def frame_name() -> str:
    """Of now, to the microsecond: two batches in one second are two frames."""
    return f"as_at_{datetime.datetime.now(datetime.timezone.utc):%Y%m%d-%H%M%S-%f}"


def write_batch(
    df: DataFrame,
    dataset: str,
    date=None,
    template: str = DAY_TEMPLATE,
    format: str = "parquet",
    schema: StructType | None = None,
    expectations: list[dict] | None = None,
    frame_id: str | None = None,
    partition_by: list[str] | None = None,
    always_complete: bool = False,
    file_bytes: int = FILE_BYTES,
    report: Report | None = None,
) -> str | None:
    """Writes a frame, its manifest and ``frame.complete``.  A failure before both stand leaves the
    frame unseen or, if it had been written before, as it was.  An empty batch writes no frame unless
    ``always_complete``.

    ``partition_by`` writes one alternative partitioning, ``by_<column>``, a column: each in
    one job, whose manifest commits the frames of all values at once.

    Without a ``report`` the first row that fails an expectation stops the write.  With one, all rows
    are examined; those that fail are written, by the same job, with the labels of what they
    failed in ``_failed``, to the dataset's BACKOUT folder, and the report has the counts.
    """
    spark = df.sparkSession
    day = as_datetime(date) if date is not None else datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    folder = f"{check_name(dataset)}/{fill(template, day)}"
    frame = frame_id or frame_name()
    if schema is not None:
        df = declared(df, schema)
    if expectations and report is None:
        df = expect(df, expectations)
    elif expectations:
        if partition_by:
            raise ValueError("a report of expectations goes with one frame, not with partitions")
        return _write_examined(examine(df, expectations, FAILED, report), dataset, fill(template, day), frame, format, file_bytes, always_complete)
    if not always_complete and df.isEmpty():
        return None
    if not partition_by:
        root = f"{folder}/{frame}"
        made = direct.write(df, root, format, file_bytes=file_bytes)
        made = made or direct.write_empty(df, root, format)
        manifest = direct.commit(spark, root, made)
        storage.touch(spark, f"{root}/frame.complete")
        direct.supersede(spark, root, manifest, made)
        return root
    for column in partition_by:
        routed = df.withColumn("_path", F.concat(F.lit(f"{column}="), _safe(name_of(column)), F.lit(f"/{frame}")))
        root = f"{folder}/by_{column}"
        made = direct.write(routed, root, format, by="_path", file_bytes=file_bytes)
        manifest = direct.commit(spark, root, made, frame)
        below = {m.folder for m in made}
        _each(below, lambda x: storage.touch(spark, f"{root}/{x}/frame.complete"))
        direct.supersede(spark, root, manifest, made, below)
    return folder


FAILED = "_failed"


def _write_examined(df: DataFrame, dataset: str, day: str, frame: str, format: str, file_bytes: int, always_complete: bool) -> str | None:
    """Rows without failures to their frame, the others to BACKOUT, in one job."""
    spark, place, out = df.sparkSession, f"{day}/{frame}", f"BACKOUT/{day}/{frame}"
    routed = df.withColumn("_path", F.when(F.col(FAILED).isNull(), F.lit(place)).otherwise(F.lit(out)))
    made = direct.write(routed, dataset, format, by="_path", file_bytes=file_bytes, aside=(FAILED, "BACKOUT"))
    bad, good = ([m._replace(folder="") for m in made if m.folder == x] for x in (out, place))
    if bad:
        direct.supersede(spark, f"{dataset}/{out}", direct.commit(spark, f"{dataset}/{out}", bad), bad)
    if not good and not always_complete:
        return None
    root = f"{dataset}/{place}"
    good = good or direct.write_empty(df.drop(FAILED), root, format)
    manifest = direct.commit(spark, root, good)
    storage.touch(spark, f"{root}/frame.complete")
    direct.supersede(spark, root, manifest, good)
    return root


def _safe(c):
    return F.coalesce(F.regexp_replace(c.cast("string"), "[^A-Za-z0-9_.@-]", "_"), F.lit("null"))


def _each(names: set[str], f: Callable[[str], None]) -> None:
    """Small files, a few at a time."""
    with ThreadPoolExecutor(16) as pool:
        list(pool.map(f, sorted(names)))


def write_routed(routed: DataFrame, root: str, format: str, file_bytes: int = FILE_BYTES) -> list[str]:
    """Rows into the folders below ``root`` that their ``_path`` names, whose former rows they
    replace: one job writes all files in place, then each folder gets its manifest."""
    spark = routed.sparkSession
    by: dict[str, list[Made]] = {}
    for m in direct.write(routed, root, format, by="_path", file_bytes=file_bytes):
        by.setdefault(m.folder, []).append(m._replace(folder=""))

    def replace(folder: str) -> None:
        path = f"{root}/{folder}"
        direct.supersede(spark, path, direct.commit(spark, path, by[folder]), by[folder])

    _each(set(by), replace)
    return sorted(f"{root}/{folder}" for folder in by)


def write_database(df: DataFrame, commit: Callable[[pd.DataFrame], None], finalizer: Callable[[int], None] | None = None, batch_rows: int = 100) -> int:
    """Hands ``commit`` batches of rows beside the data, then calls ``finalizer`` on the
    driver with the row count.  For JDBC tables ``df.write.jdbc`` is the shorter way."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for b in batches:
            for i in range(0, len(b), batch_rows):
                commit(b.iloc[i : i + batch_rows])
            n += len(b)
        yield pd.DataFrame({"n": [n]})

    total = df.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if finalizer:
        finalizer(total)
    return total
