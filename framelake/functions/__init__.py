"""The scalar functions of the query surface, each a Column built from Spark's own.

All are null-safe and never raise on bad values: a value that cannot be read gives null.
Date functions take dates, timestamps, epoch seconds or ISO strings.  ``REGISTRY`` maps
the upper-case names to builders, ``SQL_NAMES`` to the same in Spark SQL, by which ``sql()``
and string expressions are lowered, so Catalyst sees through them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

_ISO = r"^\d{4}[-:]\d{2}[-:]\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def iso_timestamp(x) -> Column:
    """Timestamp of an ISO string, to the second; offsets are ignored; else null.

    The pattern guards the cast: Spark alone would read words such as 'tomorrow'.
    """
    s = F.split_part(F.regexp_replace(_col(x).cast("string"), "Z$", ""), F.lit("+"), F.lit(1))
    fixed = F.concat(F.translate(F.substring(s, 1, 10), ":", "-"), F.substring(s, 11, 30))
    return F.when(s.rlike(_ISO) & F.length(s).between(10, 33), F.date_trunc("second", fixed.try_cast("timestamp")))


def ts(x) -> Column:
    """Timestamp of a date, timestamp, epoch second or ISO string."""
    c = _col(x)
    kind = F.typeof(c)  # foldable: only the branch for the column's type survives
    return (
        F.when(kind.isin("timestamp", "timestamp_ntz", "date"), c.cast("string").try_cast("timestamp"))
        .when(kind.isin("int", "bigint", "double", "float"), F.timestamp_seconds(c.cast("string").try_cast("double")))
        .otherwise(iso_timestamp(c))
    )


def year(x) -> Column:
    return F.year(ts(x))


def month(x) -> Column:
    return F.month(ts(x))


def day(x) -> Column:
    return F.dayofmonth(ts(x))


def date(x) -> Column:
    return F.to_date(ts(x))


def time(x) -> Column:
    return F.date_format(ts(x), "HH:mm:ss")


def quarter(x) -> Column:
    return F.quarter(ts(x))


def hour(x) -> Column:
    return F.hour(ts(x))


def minute(x) -> Column:
    return F.minute(ts(x))


def second(x) -> Column:
    return F.second(ts(x))


def week(x) -> Column:
    """ISO-8601 week."""
    return F.weekofyear(ts(x))


def now() -> Column:
    return F.current_timestamp()


def add_days(x, n) -> Column:
    """Keeps the time of day."""
    return ts(x) + F.make_dt_interval(_num(n).cast("int"))


def days_diff(a, b) -> Column:
    """Whole days from a to b, rounded down."""
    return F.floor((F.unix_micros(ts(b)) - F.unix_micros(ts(a))) / F.lit(86_400_000_000)).cast("bigint")


def upper(x) -> Column:
    return F.upper(_col(x).cast("string"))


def lower(x) -> Column:
    return F.lower(_col(x).cast("string"))


def trim(x) -> Column:
    """White space of any kind, both ends."""
    return F.regexp_replace(_col(x).cast("string"), r"^\s+|\s+$", "")


def length(x, dtype: DataType | None = None) -> Column:
    """Characters of a string or, if ``dtype`` is an array, items of a list."""
    return F.size(_col(x)) if isinstance(dtype, (ArrayType, MapType)) else F.length(_col(x).cast("string"))


def string(x, dtype: DataType | None = None) -> Column:
    if isinstance(dtype, ArrayType):
        return F.array_join(_col(x).cast("array<string>"), ", ")
    return F.to_json(_col(x)) if isinstance(dtype, (StructType, MapType)) else _col(x).cast("string")


def left(x, n) -> Column:
    """First n characters; a negative n drops that many from the end."""
    s, n = _col(x).cast("string"), _num(n)
    return F.substring(s, F.lit(1), F.when(n >= 0, n).otherwise(F.greatest(F.length(s) + n, F.lit(0))))


def right(x, n) -> Column:
    """Last n characters; 0 gives the whole string, a negative n drops from the start."""
    s, n = _col(x).cast("string"), _num(n)
    return F.when(n > 0, F.substring(s, F.greatest(F.length(s) - n + 1, F.lit(1)), n)).otherwise(F.substring(s, 1 - n, F.length(s)))


def mid(x, start, n) -> Column:
    """n characters from a zero-based start."""
    return F.substring(_col(x).cast("string"), _num(start) + 1, _num(n))


def concat(*xs, dtype: DataType | None = None) -> Column:
    """Joined strings; a single list is joined by ', '."""
    if len(xs) == 1 and isinstance(dtype, ArrayType):
        return string(xs[0], dtype)
    return F.concat(*[_col(x).cast("string") for x in xs])


def round_(x, digits: int = 0) -> Column:
    """Banker's rounding."""
    return F.bround(_col(x).cast("double"), digits)


def trunc(x) -> Column:
    """Toward zero, to a whole number."""
    return _col(x).cast("string").try_cast("double").try_cast("bigint")


def integer(x) -> Column:
    return trunc(x)


def double(x) -> Column:
    return _col(x).try_cast("double")


def boolean(x) -> Column:
    """Anything but 'false' is true, null too."""
    return F.coalesce(F.upper(_col(x).cast("string")) != "FALSE", F.lit(True))


def is_none(x) -> Column:
    return F.isnull(_col(x))


def hash_(x) -> Column:
    """64-bit hash in upper hex; opaque."""
    return F.hex(F.xxhash64(_col(x).cast("string")))


def md5(x) -> Column:
    return F.md5(_col(x).cast("string"))


def random(seed: int | None = None) -> Column:
    """0.000 to 0.999 in steps of 0.001."""
    return F.floor((F.rand() if seed is None else F.rand(seed)) * 1000) / 1000


def between(x, low, high) -> Column:
    """Both ends excluded."""
    return (_col(x) > _num(low)) & (_col(x) < _num(high))


def sort(x) -> Column:
    return F.array_sort(_col(x))


def tokenize(x) -> Column:
    """Lower-case words of letters and digits; other signs but white space are dropped."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(_col(x)), r"[^a-z0-9\s]", ""), r"\s+"), "")


REGISTRY: dict[str, Callable[..., Column]] = {
    "YEAR": year, "MONTH": month, "DAY": day, "DATE": date, "TIME": time, "QUARTER": quarter, "HOUR": hour, "MINUTE": minute,
    "SECOND": second, "WEEK": week, "NOW": now, "ADDDAYS": add_days, "DAYSDIFF": days_diff, "UPPER": upper, "UCASE": upper,
    "LOWER": lower, "LCASE": lower, "TRIM": trim, "LEN": length, "STRING": string, "LEFT": left, "RIGHT": right, "MID": mid,
    "CONCAT": concat, "ROUND": round_, "TRUNC": trunc, "INTEGER": integer, "DOUBLE": double, "BOOLEAN": boolean,
    "ISNONE": is_none, "HASH": hash_, "MD5": md5, "RANDOM": random, "BETWEEN": between, "SORT": sort,
}

_ISO_SQL = (
    "CASE WHEN split_part(regexp_replace({0}, 'Z$', ''), '+', 1) RLIKE '^[0-9]{{4}}[-:][0-9]{{2}}[-:][0-9]{{2}}([T ][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]+)?)?)?$'"
    " THEN date_trunc('second', try_cast(concat(translate(substring({0}, 1, 10), ':', '-'), substring(split_part(regexp_replace({0}, 'Z$', ''), '+', 1), 11, 30)) AS TIMESTAMP)) END"
)


def _ts_sql(x: str) -> str:
    s = f"CAST({x} AS STRING)"
    return f"(CASE WHEN typeof({x}) IN ('timestamp', 'timestamp_ntz', 'date') THEN try_cast({s} AS TIMESTAMP) WHEN typeof({x}) IN ('int', 'bigint', 'double', 'float') THEN timestamp_seconds(try_cast({s} AS DOUBLE)) ELSE {_ISO_SQL.format(s)} END)"


def _of_time(template: str) -> Callable:
    return lambda a, *_: template.format(_ts_sql(a[0]))


def _of_text(template: str) -> Callable:
    return lambda a, *_: template.format(f"CAST({a[0]} AS STRING)", *a[1:])


def _plain(template: str) -> Callable:
    return lambda a, *_: template.format(*a)


def _is_list(raw: list, lists) -> bool:
    name = "".join(raw[0]).strip().strip("`").lower()
    return name in lists or name.startswith(("array(", "sort(", "split("))


def _listed(of_list: str, of_text: str) -> Callable:
    """Type-directed: lists are known by the names of array columns and by array functions."""
    return lambda a, raw, lists: (of_list if _is_list(raw, lists) else of_text).format(a[0])


def _concat_sql(a: list[str], raw: list, lists) -> str:
    if len(a) == 1 and _is_list(raw, lists):
        return f"array_join(CAST({a[0]} AS ARRAY<STRING>), ', ')"
    return "concat(" + ", ".join(f"CAST({x} AS STRING)" for x in a) + ")"


_LEFT_SQL = "substring({0}, 1, CASE WHEN {1} >= 0 THEN {1} ELSE greatest(length({0}) + {1}, 0) END)"
_RIGHT_SQL = "(CASE WHEN {1} > 0 THEN substring({0}, greatest(length({0}) - {1} + 1, 1), {1}) ELSE substring({0}, 1 - {1}, length({0})) END)"
_WHOLE_SQL = "try_cast(try_cast({0} AS DOUBLE) AS BIGINT)"

#: The functions by name in SQL texts and expressions: (arguments, their tokens, names of array
#: columns) to Spark SQL that means the same as the Columns of ``REGISTRY``.
SQL_NAMES: dict[str, Callable[[list[str], list, frozenset], str]] = {
    "YEAR": _of_time("year({0})"), "MONTH": _of_time("month({0})"), "DAY": _of_time("dayofmonth({0})"), "DATE": _of_time("to_date({0})"),
    "TIME": _of_time("date_format({0}, 'HH:mm:ss')"), "QUARTER": _of_time("quarter({0})"), "HOUR": _of_time("hour({0})"),
    "MINUTE": _of_time("minute({0})"), "SECOND": _of_time("second({0})"), "WEEK": _of_time("weekofyear({0})"),
    "NOW": lambda *_: "current_timestamp()",
    "ADDDAYS": lambda a, *_: f"({_ts_sql(a[0])} + make_dt_interval(CAST({a[1]} AS INT)))",
    "DAYSDIFF": lambda a, *_: f"CAST(floor((unix_micros({_ts_sql(a[1])}) - unix_micros({_ts_sql(a[0])})) / 86400000000) AS BIGINT)",
    "UPPER": _of_text("upper({0})"), "UCASE": _of_text("upper({0})"), "LOWER": _of_text("lower({0})"), "LCASE": _of_text("lower({0})"),
    "TRIM": _of_text(r"regexp_replace({0}, r'^\s+|\s+$', '')"), "LEN": _listed("size({0})", "length(CAST({0} AS STRING))"),
    "STRING": _listed("array_join(CAST({0} AS ARRAY<STRING>), ', ')", "CAST({0} AS STRING)"), "LEFT": _of_text(_LEFT_SQL), "RIGHT": _of_text(_RIGHT_SQL),
    "MID": _of_text("substring({0}, ({1}) + 1, {2})"), "CONCAT": _concat_sql,
    "ROUND": lambda a, *_: f"bround(CAST({a[0]} AS DOUBLE), {a[1] if len(a) > 1 else 0})", "TRUNC": _of_text(_WHOLE_SQL), "INTEGER": _of_text(_WHOLE_SQL),
    "DOUBLE": _plain("try_cast({0} AS DOUBLE)"), "BOOLEAN": _of_text("coalesce(upper({0}) <> 'FALSE', true)"), "ISNONE": _plain("({0} IS NULL)"),
    "HASH": _of_text("hex(xxhash64({0}))"), "MD5": _of_text("md5({0})"), "RANDOM": lambda *_: "(floor(rand() * 1000) / 1000)",
    "BETWEEN": _plain("({0} > {1} AND {0} < {2})"), "SORT": _plain("array_sort({0})"),
}
