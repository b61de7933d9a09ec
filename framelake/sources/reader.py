"""Reader: a dataset's dated, framed files as a Dataset."""

from __future__ import annotations

import datetime
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, StructType

from ..operators import dialect
from ..operators.dataset import Dataset, Storage
from . import direct, formats, frames, storage
from .cursor import CursorRead
from .paths import DAY_TEMPLATE, as_datetime, date_paths, parse_delta


class DataNotFoundError(Exception):
    """No readable data file in the range."""


class AccessDenied(Exception):
    """The dataset is outside the allowed prefixes."""


class InvalidReaderConfigError(ValueError):
    """Parameters that do not go together."""


def data_files(
    spark: SparkSession,
    dataset: str,
    start_date=None,
    end_date=None,
    template: str = DAY_TEMPLATE,
    partition_filter: tuple[str, str, str] | None = None,
    freshness_limit: str | None = None,
    raw_path: bool = False,
) -> list[str]:
    """The files that a read of these dates sees.  ``freshness_limit`` steps back a day at
    a time, when start and end are one day, until data is found or the limit is past."""
    listed = lambda manifests: direct.listed(spark, manifests)
    if raw_path:
        return frames.resolve(storage.files(spark, dataset), partition_filter, listed)
    today = datetime.date.today()
    start, end = start_date or today, end_date or start_date or today

    def found(a, b) -> list[str]:
        paths = date_paths(f"{dataset.rstrip('/')}/{template}", a, b)
        return sorted({f for p in paths for f in frames.resolve(storage.files(spark, p), partition_filter, listed)})

    out = found(start, end)
    if not out and freshness_limit:
        if as_datetime(start).date() != as_datetime(end).date():
            raise InvalidReaderConfigError("freshness_limit needs start_date and end_date to be one day")
        day = as_datetime(start)
        for _ in range(parse_delta(freshness_limit) // datetime.timedelta(days=1)):  # whole days that the limit holds
            day -= datetime.timedelta(days=1)
            if out := found(day.date(), day.date()):
                break
    return out


def reader(
    spark: SparkSession,
    dataset: str,
    select: list[str] | None = None,
    filters=None,
    start_date=None,
    end_date=None,
    template: str = DAY_TEMPLATE,
    partition_filter: tuple[str, str, str] | None = None,
    freshness_limit: str | None = None,
    raw_path: bool = False,
    override_format: str | None = None,
    schema: StructType | None = None,
    persistence: Storage = Storage.NONE,
    valid_dataset_prefixes: list[str] | None = None,
    cursor: dict | str | None = None,
    rejects: formats.Rejects | None = None,
) -> Dataset | CursorRead:
    """Selects after filtering, so filters may use columns that are not selected; Spark
    pushes both to the scan.  Blobs and lines that cannot be read are left out and told to
    ``rejects``.  With a ``cursor``, {} for the first read, rows come one by one
    from a resumable ``CursorRead`` instead."""
    if valid_dataset_prefixes and not any(dataset.startswith(p) for p in valid_dataset_prefixes):
        raise AccessDenied(f"{dataset} is outside the allowed prefixes")
    paths = data_files(spark, dataset, start_date, end_date, template, partition_filter, freshness_limit, raw_path)

    def chosen(df: DataFrame) -> DataFrame:
        out = Dataset(df) if filters is None else Dataset(df).filter(filters)
        return (out.select(*select) if select else out).df

    if cursor is not None:
        return CursorRead(spark, paths, cursor, schema, override_format, chosen)
    df = formats.read_files(spark, paths, schema, override_format, rejects)
    if df is None:
        raise DataNotFoundError(f"no data in {dataset}")
    return Dataset(chosen(df), persistence)


def sql(spark: SparkSession, statement: str, root: str = "", reader_options: dict | None = None, **datasets: Dataset | DataFrame) -> Dataset:
    """Spark SQL over datasets.  A name after FROM is, in this order, that of a subquery in WITH, one of
    ``datasets``, a view or table of the session, or, with dots for slashes, a dataset's path below
    ``root``, read with ``reader_options`` (dates, filters and so on).  Operators, function
    names and labels are those of ``dialect``.  The session's views stay as they are."""
    known = {k: v.df if isinstance(v, Dataset) else v for k, v in datasets.items()}
    tokens, names = dialect.tokens(statement), {}
    try:
        for i in dialect.dataset_places(tokens):
            name = tokens[i]
            if name not in known and _is_table(spark, name):
                continue
            if name not in names:
                dialect.check_dataset(name)
                path = name.replace(".", "/")
                if name not in known:
                    known[name] = reader(spark, f"{root.rstrip('/')}/{path}" if root else path, **(reader_options or {})).df
                names[name] = f"_dataset_{uuid.uuid4().hex}"
                known[name].createOrReplaceTempView(names[name])
            tokens[i] = f"{names[name]} AS {name}" if name.isidentifier() and not dialect.has_alias(tokens, i) else names[name]
        lists = {f.name.lower() for df in known.values() for f in df.schema.fields if isinstance(f.dataType, ArrayType)}
        return Dataset(spark.sql(dialect.lowered(dialect.labelled(dialect.aliased(tokens)), lists)))
    finally:
        for view in names.values():  # the frame is analyzed by now
            spark.catalog.dropTempView(view)


def _is_table(spark: SparkSession, name: str) -> bool:
    return re.fullmatch(r"\w+(\.\w+)?", name) is not None and spark.catalog.tableExists(name)
