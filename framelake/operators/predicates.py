"""Predicates of the three filter styles, lowered to Columns that Spark can push down.

Comparison helpers keep two-valued logic: ``ne`` and negated tests are true for null
operands.  They stay bare comparisons (``<=>`` under a NOT) wherever that gives the same
rows, because a wrapped comparison never reaches the Parquet scan.  DNF filters follow
their own rule: a null field fails every test.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from . import dialect


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def eq(a, b) -> Column:
    return _c(a).eqNullSafe(b)


def ne(a, b) -> Column:
    return ~_c(a).eqNullSafe(b)


def negate(p: Column) -> Column:
    """NOT with null as false inside."""
    return ~F.coalesce(p, F.lit(False))


def like(a, pattern: str) -> Column:
    """Case-insensitive, % and _."""
    return _c(a).cast("string").ilike(pattern)


def not_like(a, pattern: str) -> Column:
    return negate(like(a, pattern))


def matches(a, pattern: str) -> Column:
    """Unanchored regular expression."""
    return _c(a).cast("string").rlike(pattern)


def contains(df: DataFrame, name: str, value: Any) -> Column:
    """Substring of a string, or item of a list."""
    if isinstance(df.schema[name].dataType, ArrayType):
        return F.array_contains(F.col(name), value)
    return F.col(name).contains(value)


def is_in(a, values: Sequence) -> Column:
    return _c(a).isin(list(values))


def not_in(a, values: Sequence) -> Column:
    return negate(is_in(a, values))


_DNF: dict[str, Callable[[DataFrame, str, Any], Column]] = {
    "=": lambda d, f, v: F.col(f) == v,
    "==": lambda d, f, v: F.col(f) == v,
    "is": lambda d, f, v: F.col(f).eqNullSafe(v) if v is None else F.col(f) == v,
    "!=": lambda d, f, v: F.col(f) != v,
    "<>": lambda d, f, v: F.col(f) != v,
    "<": lambda d, f, v: F.col(f) < v,
    ">": lambda d, f, v: F.col(f) > v,
    "<=": lambda d, f, v: F.col(f) <= v,
    ">=": lambda d, f, v: F.col(f) >= v,
    "is not": lambda d, f, v: ~F.col(f).eqNullSafe(v),
    "like": lambda d, f, v: like(f, v),
    "not like": lambda d, f, v: ~like(f, v),
    "matches": lambda d, f, v: matches(f, v),
    "~": lambda d, f, v: matches(f, v),
    "in": lambda d, f, v: F.col(f).isin(list(v)),
    "not in": lambda d, f, v: ~F.col(f).isin(list(v)),
    "!in": lambda d, f, v: ~F.col(f).isin(list(v)),
    "contains": lambda d, f, v: contains(d, f, v),
    "!contains": lambda d, f, v: ~contains(d, f, v),
}


def dnf(df: DataFrame, filters) -> Column:
    """A tuple (field, op, value) is a test; a list of tuples all hold; a list of lists any
    holds; None holds always."""
    if filters is None:
        return F.lit(True)
    if isinstance(filters, tuple):
        if len(filters) == 2 and str(filters[0]).upper() == "NOT":
            return negate(dnf(df, filters[1]))
        field, op, value = filters
        if op.lower() not in _DNF:
            raise ValueError(f"unknown operator {op!r}")
        return F.lit(False) if field not in df.columns else _DNF[op.lower()](df, field, value)
    if isinstance(filters, list):
        if all(isinstance(f, tuple) for f in filters):
            return reduce(lambda a, b: a & b, [dnf(df, f) for f in filters], F.lit(True))
        if all(isinstance(f, list) for f in filters):
            return reduce(lambda a, b: a | b, [dnf(df, f) for f in filters])
    raise ValueError("filters are a tuple, a list of tuples or a list of lists of tuples")


def to_dnf(text: str):
    """A condition without parentheses as the tuples and lists that ``dnf`` takes."""
    found = dialect.tokens(text)

    def split(part: list[str], word: str) -> list[list[str]]:
        out: list[list[str]] = [[]]
        for t in part:
            if t.upper() == word:
                out.append([])
            else:
                out[-1].append(t)
        return out

    def value(t: str):
        named = {"TRUE": True, "FALSE": False, "NONE": None, "NULL": None}
        if t[:1] in "'\"":
            return t[1:-1]
        return named[t.upper()] if t.upper() in named else float(t) if "." in t else int(t)

    def test(part: list[str]):
        words = [t for t in part if t != " "]
        if words[0].upper() == "NOT":
            return ("NOT", test(words[1:]))
        at = next(i for i, t in enumerate(words) if t.upper() in _DNF_WORDS or t in _DNF_MARKS)
        name, rest = "".join(words[:at]).strip("`"), words[at:]
        n = 2 if rest[0].upper() in ("NOT", "IS") and rest[1].upper() in ("LIKE", "IN", "CONTAINS", "NOT") else 1
        op, right = " ".join(rest[:n]).lower(), rest[n:]
        if right[0] == "(":
            return (name, op, [value(t) for t in right[1:-1] if t != ","])
        return (name, op, value("".join(right)))

    parts = [[test(c) for c in split(p, "AND")] for p in split(found, "OR")]
    return parts if len(parts) > 1 else parts[0] if len(parts[0]) > 1 else parts[0][0]


_DNF_WORDS = frozenset("IS IN LIKE MATCHES CONTAINS NOT".split())
_DNF_MARKS = frozenset("= == != <> < > <= >= <=>".split())


def filter_rows(df: DataFrame, f: Callable[[dict], Any]) -> DataFrame:
    """Rows of which a Python function is true, in Arrow batches beside the data; Columns and
    strings are faster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([bool(f(r)) for r in b.to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def to_predicate(df: DataFrame, f) -> Column:
    """Column of a string in the dialect, a DNF, a Column or a function of the DataFrame that
    gives a Column; for functions of rows there is ``filter_rows``."""
    if isinstance(f, Column):
        return f
    if isinstance(f, str):
        return F.expr(dialect.lowered(f, {c.name.lower() for c in df.schema if isinstance(c.dataType, ArrayType)}))
    if f is None or isinstance(f, (tuple, list)):
        return dnf(df, f)
    if callable(f):
        p = f(df)
        if isinstance(p, Column):
            return p
        raise TypeError("a filter's function gives a Column; for functions of rows there is filter_rows")
    raise TypeError("a filter is a string, a DNF, a Column or a function")
