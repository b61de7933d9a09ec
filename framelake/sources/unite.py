"""One schema over files that differ.

What a file says of its columns (a CSV header, a Parquet or ORC footer) is read in tasks; files of
one header are one scan, and the scans' columns meet in a lattice of types: nothing at the
bottom, text on top.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    ByteType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    NullType,
    ShortType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
    VariantType,
)

from ..operators.dataset import name_of
from . import storage
from .frames import is_data
from .paths import bare

_WHOLE = [ByteType(), ShortType(), IntegerType(), LongType()]
_DIGITS = {ByteType(): 3, ShortType(): 5, IntegerType(): 10, LongType(): 19}
_TIMES = [DateType(), TimestampNTZType(), TimestampType()]


def wider(a: DataType, b: DataType, value: str | None = None) -> DataType:
    """The least type that holds values of both.  ``value``: the field that holds a plain value
    where the other is a struct; without one such a column is text, as are all that do not meet
    elsewhere."""
    if a == b or isinstance(b, NullType):
        return a
    if isinstance(a, NullType):
        return b
    if isinstance(a, ArrayType) and isinstance(b, ArrayType):
        return ArrayType(wider(a.elementType, b.elementType, value))
    if isinstance(a, MapType) and isinstance(b, MapType):
        return MapType(wider(a.keyType, b.keyType, value), wider(a.valueType, b.valueType, value))
    if value is not None and (isinstance(a, ArrayType) or isinstance(b, ArrayType)):
        x, y = (t.elementType if isinstance(t, ArrayType) else t for t in (a, b))
        return ArrayType(wider(x, y, value))
    if isinstance(a, StructType) and isinstance(b, StructType):
        return unite([a, b], value)
    if value is not None and (isinstance(a, StructType) or isinstance(b, StructType)):
        return unite([t if isinstance(t, StructType) else StructType([StructField(value, t)]) for t in (a, b)], value)
    if a in _WHOLE and b in _WHOLE:
        return _WHOLE[max(_WHOLE.index(a), _WHOLE.index(b))]
    if a in _TIMES and b in _TIMES:
        return _TIMES[max(_TIMES.index(a), _TIMES.index(b))]
    exact = [DecimalType(_DIGITS[t], 0) if t in _WHOLE else t for t in (a, b)]
    if all(isinstance(t, DecimalType) for t in exact):
        scale = max(t.scale for t in exact)
        digits = max(t.precision - t.scale for t in exact) + scale
        return DecimalType(digits, scale) if digits <= 38 else DoubleType()
    if all(t in _WHOLE or isinstance(t, (FloatType, DoubleType, DecimalType)) for t in (a, b)):
        return DoubleType()
    return StringType()


def unite(schemas: list[StructType], value: str | None = None) -> StructType:
    """All fields, in the order in which they are met; names that differ in case alone are one."""
    names: dict[str, str] = {}
    kinds: dict[str, DataType] = {}
    for s in schemas:
        for f in s:
            key = f.name.lower()
            names.setdefault(key, f.name)
            kinds[key] = wider(kinds[key], f.dataType, value) if key in kinds else f.dataType
    return StructType([StructField(names[k], t) for k, t in kinds.items()])


def _to(c: Column, have: DataType, want: DataType) -> Column:
    """A value in a wider type."""
    if have == want:
        return c
    if isinstance(want, StructType) and isinstance(have, StructType):
        at = {f.name.lower(): f for f in have}
        fields = [_to(c.getField(at[f.name.lower()].name), at[f.name.lower()].dataType, f.dataType) if f.name.lower() in at else F.lit(None).cast(f.dataType) for f in want]
        return F.when(c.isNotNull(), F.struct(*[x.alias(f.name) for x, f in zip(fields, want)]))
    if isinstance(want, ArrayType) and isinstance(have, ArrayType):
        return F.transform(c, lambda x: _to(x, have.elementType, want.elementType))
    if isinstance(want, MapType) and isinstance(have, MapType):
        keys = F.transform_keys(c, lambda k, _: _to(k, have.keyType, want.keyType))
        return F.transform_values(keys, lambda _, v: _to(v, have.valueType, want.valueType))
    if isinstance(want, StringType) and isinstance(have, (StructType, ArrayType, MapType, VariantType)):
        return F.to_json(c)
    return c.cast(want)


def as_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns, by name; those that ``df`` lacks are null."""
    have = {f.name.lower(): f for f in df.schema}
    columns = [_to(name_of(have[f.name.lower()].name), have[f.name.lower()].dataType, f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType) for f in schema]
    return df.select(*[c.alias(f.name) for c, f in zip(columns, schema)])


def united(frames: list[DataFrame]) -> DataFrame | None:
    """All rows of frames whose columns may differ in number, order and type; None of none."""
    frames = [f for f in frames if f.columns] or frames[:1]
    if len(frames) < 2:
        return frames[0] if frames else None
    schema = unite([f.schema for f in frames])
    return reduce(DataFrame.union, [as_schema(f, schema) for f in frames])


def arrow_file(uri: str):
    """(file system, path) of a file's URI, for tasks."""
    from pyarrow import fs

    if uri.startswith(("file:", "/")):
        return fs.LocalFileSystem(), bare(uri)
    return fs.FileSystem.from_uri(quote(re.sub("^s3[an]:", "s3:", uri), safe="/:@=+$,;~%"))


# What a file, opened by Arrow, says of its columns, as text; files of equal texts are read together.
def csv_header(f) -> str:
    return json.dumps(next(csv.reader(io.TextIOWrapper(f, encoding="utf-8-sig", errors="replace", newline="")), []))


def parquet_footer(f) -> str:
    import pyarrow.parquet as pq

    return _text(pq.read_schema(f))


def orc_footer(f) -> str:
    import pyarrow.orc as orc

    return _text(orc.ORCFile(f).schema)


def _text(schema) -> str:
    return schema.remove_metadata().to_string(show_field_metadata=False)


def _said(header: Callable, f) -> str:
    try:
        return header(f)
    except Exception as e:  # whatever a reader says of a broken file
        return f"!{type(e).__name__}: {e}"


def _opened(header: Callable) -> Callable:
    """In tasks, by Arrow's file systems: the head or foot of a file is all that is read.  A file
    that cannot be opened fails the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        def of(uri: str) -> str:
            where, path = arrow_file(uri)
            if where.get_file_info(path).type == fs.FileType.Directory:
                return "/"
            with where.open_input_file(path) as f:
                return _said(header, f)

        for b in batches:
            yield pd.DataFrame({"path": b["path"], "header": list(map(of, b["path"]))})

    return run


def _whole(header: Callable) -> Callable:
    """The same of files as Spark reads them, for stores that Arrow does not know."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        for b in batches:
            yield pd.DataFrame({"path": b["path"], "header": [_said(header, pa.BufferReader(c)) for c in b["content"]]})

    return run


_ONE_JOB = re.compile(r"^(.*)/part-\d{5}(?:-\d+)?-([0-9a-f]{8}-[0-9a-f-]{27})[^/]*$")


def by_header(spark: SparkSession, paths: list[str], header: Callable) -> list[tuple[str, list[str]]]:
    """(header, files), in the files' order; a folder stands for its data files.  Files that one
    Spark job wrote to one folder have one header, so one of them is opened.  Of a file that
    cannot be read the header is ! and why."""
    job = {p: (m.group(1, 2) if (m := _ONE_JOB.match(p)) else p) for p in paths}
    looked = {j: p for p, j in reversed(job.items())}
    try:
        arrow_file(paths[0])
    except (ValueError, NotImplementedError, OSError):
        files = spark.read.format("binaryFile").load(list(looked.values())).select("path", "content").mapInPandas(_whole(header), "path string, header string")
    else:
        files = spark.createDataFrame([(p,) for p in looked.values()], "path string").repartition(min(len(looked), 4 * spark.sparkContext.defaultParallelism))
        files = files.mapInPandas(_opened(header), "path string, header string")
    found = {bare(r["path"]): r["header"] for r in files.collect()}  # a row a listed file
    out: dict[str, list[str]] = {}
    for p in paths:
        said = found[bare(looked[job[p]])]
        inside = [f for f in storage.files(spark, p) if is_data(f)] if said == "/" else []
        for h, files in by_header(spark, inside, header) if inside else [] if said == "/" else [(said, [p])]:
            out.setdefault(h, []).extend(files)
    return list(out.items())


def fold_types(types: DataFrame, value: str | None = None, fan: int = 32) -> DataType | None:
    """The least type above all that ``types`` holds as JSON in its one column, by a tree: each
    task folds its own into one, then groups of ``fan`` tasks' results are folded, until few
    are left.  Null if there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind: DataType = NullType()
        seen: set[str] = set()
        for b in batches:
            for t in b.iloc[:, 0].dropna().unique():
                if t not in seen:
                    if len(seen) > 10_000:
                        seen.clear()
                    seen.add(t)
                    kind = wider(kind, of_json(t), value)
        yield pd.DataFrame({"type": [] if isinstance(kind, NullType) else [kind.json()]}, dtype=object)

    folded, parts = types.mapInPandas(run, "type string"), types.rdd.getNumPartitions()
    while parts > fan:
        parts = -(-parts // fan)
        folded = folded.repartition(parts).mapInPandas(run, "type string")
    kinds = sorted(r[0] for r in folded.collect())  # ``fan`` rows at most
    return reduce(lambda a, b: wider(a, b, value), map(of_json, kinds)) if kinds else None


def of_json(text: str) -> DataType:
    return StructType.fromJson({"fields": [{"name": "x", "type": json.loads(text), "nullable": True, "metadata": {}}]})[0].dataType
