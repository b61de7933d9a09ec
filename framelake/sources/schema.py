"""Declared schemas, row validity and expectations, as Columns."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .unite import name_of

TYPES = {
    "VARCHAR": "string", "INTEGER": "bigint", "DOUBLE": "double", "NUMERIC": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp",
    "DATE": "date", "TIME": "string", "LIST": "array<string>", "ARRAY": "array<string>", "STRUCT": "map<string,string>", "BLOB": "binary",
}


class SchemaError(ValueError):
    pass


def load_schema(source) -> StructType | None:
    """A StructType from a path, JSON text, dict (columns or fields), list of names or of
    column dicts; False for none at all."""
    if source is False:
        return None
    if source is None:
        raise ValueError("a schema is needed; False says that there is none")
    if isinstance(source, StructType):
        return source
    if isinstance(source, (str, Path)):
        text = str(source)
        return load_schema(json.loads(text if text.lstrip()[:1] in "[{" else Path(text).read_text()))
    columns = source if isinstance(source, list) else source.get("columns", source.get("fields"))
    fields = []
    for c in columns or []:
        name, kind = (c, "VARCHAR") if isinstance(c, str) else (c["name"], c.get("type", "VARCHAR"))
        if str(kind).upper() not in TYPES:
            raise ValueError(f"unknown type {kind!r} of {name!r}")
        fields.append(StructField(name, StructType.fromDDL(f"x {TYPES[str(kind).upper()]}")[0].dataType, True))
    return StructType(fields)


def check_columns(df: DataFrame, schema: StructType) -> None:
    """Raises if columns are missing, in excess or of another type; nothing is coerced."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in schema}
    wrong = [n for n in want if n in have and have[n] != want[n]]
    if have.keys() != want.keys() or wrong:
        raise SchemaError(f"missing {sorted(want.keys() - have.keys())}, excess {sorted(have.keys() - want.keys())}, of another type {wrong}")


_WIDER = {"void": None, "tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double", "timestamp_ntz": "timestamp"}


def declared(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns in its order and types: nulls without a type and narrower numbers
    are cast, anything else that differs raises."""
    want = {f.name: f.dataType for f in schema}
    cast = {f.name: F.col(f"`{f.name}`").cast(want[f.name]) for f in df.schema if f.name in want and _WIDER.get(f.dataType.simpleString(), "") in (None, want[f.name].simpleString())}
    df = df.withColumns(cast) if cast else df
    check_columns(df, schema)
    return df.select(*[F.col(f"`{f.name}`") for f in schema])


def conform(df: DataFrame, schema: StructType) -> tuple[DataFrame, Column]:
    """(rows with a ``_typed`` struct of the schema's types, validity of a row): text that
    does not read as its column's type makes the row invalid; nulls are valid."""
    typed = [name_of(f.name).try_cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    present = all(f.name in df.columns for f in schema)
    out = df.withColumn("_typed", F.struct(*typed))
    fine = [name_of(f.name).isNull() | F.col("_typed").getField(f.name).isNotNull() for f in schema if f.name in df.columns]
    return out, reduce(lambda a, b: a & b, fine, F.lit(present))


#: Expectations: name -> predicate of a row.
EXPECTATIONS: dict[str, Callable[..., Column]] = {
    "expect_column_values_to_not_be_null": lambda column: name_of(column).isNotNull(),
    "expect_column_values_to_be_in_set": lambda column, symbols: name_of(column).isNull() | name_of(column).isin(list(symbols)),
    "expect_column_values_to_be_between": lambda column, minimum, maximum: name_of(column).isNull() | name_of(column).between(minimum, maximum),
    "expect_column_values_to_match_regex": lambda column, regex: name_of(column).isNull() | name_of(column).rlike(regex),
    "expect_column_values_length_to_be_between": lambda column, minimum, maximum: name_of(column).isNull() | F.length(column).between(minimum, maximum),
}


class Report:
    """What expectations found: ``counts()`` are the rows that fail each one, by its label, and all
    ``rows``, observed while the rows were written, so known after that."""

    def __init__(self) -> None:
        self._seen: list[tuple[Observation, list[str]]] = []

    def watch(self, df: DataFrame, failed: str, labels: list[str]) -> DataFrame:
        seen = Observation()
        self._seen.append((seen, labels))
        each = [F.count(F.when(F.array_contains(failed, x), 1)).alias(f"n{i}") for i, x in enumerate(labels)]
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *each)

    def counts(self) -> dict[str, int]:
        out: dict[str, int] = {"rows": 0}
        for seen, labels in self._seen:
            got = seen.get
            out["rows"] += got["rows"]
            for i, x in enumerate(labels):
                out[x] = out.get(x, 0) + got[f"n{i}"]
        return out


def label(expectation: dict) -> str:
    """expectation(column), with the other arguments, so that two of a kind are told apart."""
    args = [f"{v}" if k == "column" else f"{k}={v}" for k, v in expectation.items() if k != "expectation"]
    return f"{expectation['expectation']}({', '.join(args)})"


def examine(df: DataFrame, expectations: list[dict], failed: str, report: Report | None = None) -> DataFrame:
    """Adds ``failed``: the labels of the expectations that a row does not meet, null if it meets
    all.  Every expectation is held against every row, in one pass."""
    labels, tests = [], []
    for e in expectations:
        args = {k: v for k, v in e.items() if k != "expectation"}
        if e["expectation"] == "expect_column_to_exist":
            ok = F.lit(args["column"] in df.columns)
        elif args.get("column") not in df.columns:
            ok = F.lit(False)
        else:
            ok = F.coalesce(EXPECTATIONS[e["expectation"]](**args), F.lit(False))
        labels.append(label(e))
        tests.append(F.when(~ok, F.lit(labels[-1])))
    found = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    out = df.withColumn(failed, F.when(F.size(found) > 0, found))
    return report.watch(out, failed, labels) if report else out


def expect(df: DataFrame, expectations: list[dict]) -> DataFrame:
    """Rows pass through; the first row that fails an expectation stops the job."""
    for e in expectations:
        args = {k: v for k, v in e.items() if k != "expectation"}
        if e["expectation"] == "expect_column_to_exist":
            if args["column"] not in df.columns:
                raise SchemaError(f"no column {args['column']!r}")
            continue
        ok = EXPECTATIONS[e["expectation"]](**args)
        df = df.where(F.when(ok, True).otherwise(F.raise_error(F.lit(f"failed {e}"))))
    return df
