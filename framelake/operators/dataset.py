"""Dataset: relational methods over a DataFrame, each a lazy plan until it must return."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from enum import Enum
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, NumericType, StructType, VariantType

from . import dialect, display, predicates


def name_of(name: str) -> Column:
    """A column by its whole name, which may have dots; '*' is all."""
    return F.col(name if name == "*" else "`" + name.replace("`", "``") + "`")


def _ordered(t: DataType) -> bool:
    """Whether values of a type can be compared."""
    if isinstance(t, StructType):
        return all(_ordered(f.dataType) for f in t)
    return _ordered(t.elementType) if isinstance(t, ArrayType) else not isinstance(t, (MapType, VariantType))


class Storage(Enum):
    """How a Dataset's rows are kept once computed."""

    NONE = None
    MEMORY = StorageLevel.MEMORY_ONLY
    DISK = StorageLevel.DISK_ONLY
    COMPRESSED_MEMORY = StorageLevel.MEMORY_AND_DISK


class Dataset:
    def __init__(self, df: DataFrame, storage: Storage = Storage.NONE):
        self.df = df if storage is Storage.NONE else df.persist(storage.value)
        self.storage = storage

    @classmethod
    def of(cls, spark: SparkSession, rows: Iterable[dict], schema: StructType | str | None = None, storage: Storage = Storage.NONE) -> Dataset:
        """From literal records; keys may differ from row to row, pydantic models are taken apart."""
        rows = [r.model_dump() if hasattr(r, "model_dump") else r.dict() if hasattr(r, "dict") else dict(r) for r in rows]
        if schema is None:
            names = list(dict.fromkeys(k for r in rows for k in r))
            if not rows or not names:
                return cls(spark.createDataFrame([], StructType()), storage)
            full = [{k: float(v) if isinstance(v, int) and not isinstance(v, bool) and any(isinstance(q.get(k), float) for q in rows) else v for k in names for v in [r.get(k)]} for r in rows]
            void = [k for k in names if all(r[k] is None for r in full)]
            known = [k for k in names if k not in void]
            if not known:
                return cls(spark.range(len(full)).select(*[F.lit(None).cast("string").alias(k) for k in void]), storage)
            df = spark.createDataFrame([tuple(r[k] for k in known) for r in full], known)
            return cls(df.select(*[F.lit(None).cast("string").alias(k) if k in void else F.col(f"`{k}`") for k in names]), storage)
        return cls(spark.createDataFrame(rows, schema), storage)

    def _new(self, df: DataFrame) -> Dataset:
        return Dataset(df, self.storage)

    # projection
    def select(self, *columns: str | Column) -> Dataset:
        """Columns by name ('*' for all), expression or Column; a missing name is null, and a
        function without a name is labelled FUNCTION(a,b)."""
        if len(columns) == 1 and isinstance(columns[0], (list, tuple)):
            columns = tuple(columns[0])
        out, lists = [], {f.name.lower() for f in self.df.schema if isinstance(f.dataType, ArrayType)}
        for c in columns:
            if isinstance(c, Column):
                out.append(c)
            elif c == "*":
                out.append(F.col("*"))
            elif c in self.df.columns:
                out.append(F.col(f"`{c}`"))
            elif c.replace("_", "").isalnum():
                out.append(F.lit(None).cast("string").alias(c))
            else:
                found = dialect.labelled(dialect.tokens(f"SELECT {c}"))[1:]
                out += [F.expr(dialect.lowered(x, lists).strip()) for x in dialect._arguments(found)]
        return self._new(self.df.select(*out))

    project = select

    def __getitem__(self, columns) -> Dataset:
        return self.select(*([columns] if isinstance(columns, str) else columns))

    def rename(self, names: dict[str, str]) -> Dataset:
        return self._new(self.df.withColumnsRenamed(names))

    def set_value(self, name: str, value: Any) -> Dataset:
        """A column from a constant, a Column or a function of the DataFrame."""
        return self._new(self.df.withColumn(name, value if isinstance(value, Column) else value(self.df) if callable(value) else F.lit(value)))

    def order_columns(self) -> Dataset:
        return self._new(self.df.select(*[f"`{c}`" for c in sorted(self.df.columns)]))

    def flatten(self, items: int = 0) -> Dataset:
        """Structs become dotted columns; with ``items``, so many items of each list too."""

        def leaves(path: Column, name: str, t: DataType):
            if isinstance(t, StructType):
                for f in t.fields:
                    yield from leaves(path.getField(f.name), f"{name}.{f.name}", f.dataType)
            elif isinstance(t, ArrayType) and items:
                for i in range(items):
                    yield from leaves(F.get(path, i), f"{name}.{i}", t.elementType)
            else:
                yield path.alias(name)

        return self._new(self.df.select(*[c for f in self.df.schema.fields for c in leaves(F.col(f"`{f.name}`"), f.name, f.dataType)]))

    # filters
    def filter_rows(self, f: Callable[[dict], Any]) -> Dataset:
        """Rows of which a Python function is true."""
        return self._new(predicates.filter_rows(self.df, f))

    def filter(self, predicate) -> Dataset:
        return self._new(self.df.filter(predicates.to_predicate(self.df, predicate)))

    def distinct(self, *columns: str) -> Dataset:
        """Distinct rows, or the first row by all columns of each key."""
        if not columns:
            return self._new(self.df.distinct())
        # A minimum over a struct combines before the shuffle; a window would not.
        keys, rest = [name_of(c) for c in columns], [name_of(c) for c in self.df.columns if c not in columns]
        if not rest:
            return self._new(self.df.select(*keys).distinct())
        row = F.struct(*rest)
        first = F.min(row) if all(_ordered(f.dataType) for f in self.df.schema if f.name not in columns) else F.min_by(row, F.to_json(row))
        kept = self.df.groupBy(*keys).agg(first.alias("_first"))
        return self._new(kept.select(*keys, "_first.*").select(*map(name_of, self.df.columns)))

    def sample(self, fraction: float, seed: int | None = None) -> Dataset:
        return self._new(self.df.sample(fraction, seed))

    # order
    def sort_and_take(self, column: str, take: int = 5000, descending: bool = False) -> Dataset:
        """Top rows; nulls first ascending, last descending; equal ones by the other columns."""
        c = name_of(column)
        rest = [name_of(f.name) if _ordered(f.dataType) else F.to_json(name_of(f.name)) for f in self.df.schema if f.name != column]
        return self._new(self.df.orderBy(c.desc() if descending else c.asc(), *rest).limit(take))

    def take(self, n: int) -> Dataset:
        return self._new(self.df.limit(n))

    def itake(self, n: int) -> Iterator[dict]:
        return (r.asDict(True) for r in self.df.limit(n).toLocalIterator())

    def first(self) -> dict | None:
        r = self.df.first()
        return None if r is None else r.asDict(True)

    def get_items(self, *positions: int, order: list[str] | None = None) -> list[dict]:
        """Rows by position in the order of ``order``, all columns by default.  A row count for
        each partition tells where a position lies; only the rows asked for are collected."""
        sorted_ = self.df.orderBy(*(order or self.df.columns)).withColumn("_id", F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
        try:
            sizes = sorted_.groupBy(F.shiftright("_id", 33).alias("part")).count().orderBy("part").collect()  # one row a partition
            ids, before = {}, 0
            for part, n in sizes:
                ids |= {(part << 33) + p - before: p for p in positions if before <= p < before + n}
                before += n
            rows = {ids[r["_id"]]: r for r in sorted_.where(F.col("_id").isin(list(ids))).collect()} if ids else {}
            return [{k: v for k, v in rows[p].asDict(True).items() if k != "_id"} for p in positions if p in rows]
        finally:
            sorted_.unpersist()

    # aggregation
    def group_by(self, *columns: str):
        from .grouping import GroupBy

        return GroupBy(self, *(columns[0] if len(columns) == 1 and isinstance(columns[0], (list, tuple)) else columns))

    def _one(self, *aggregates: Column):
        r = self.df.agg(*aggregates).first()
        return r[0] if len(aggregates) == 1 else tuple(r)

    def min(self, c: str):
        return self._one(F.min(name_of(c)))

    def max(self, c: str):
        return self._one(F.max(name_of(c)))

    def sum(self, c: str):
        return self._one(F.sum(name_of(c)))

    def min_max(self, c: str):
        return self._one(F.min(name_of(c)), F.max(name_of(c)))

    def mean(self, c: str):
        return self._one(F.avg(name_of(c)))

    def variance(self, c: str):
        """Of a sample."""
        return self._one(F.var_samp(name_of(c)))

    def standard_deviation(self, c: str):
        return self._one(F.stddev_samp(name_of(c)))

    def count(self) -> int:
        return self.df.count()

    def collect_list(self, column: str) -> list:
        return [r[0] for r in self.df.select(name_of(column)).collect()]

    def collect_set(self, column: str, dedupe: bool = False):
        from .collected import CollectedSet

        return CollectedSet(self.df, column, dedupe)

    def histogram(self, column: str, bins: int = 10) -> Dataset:
        """(bin, n): rows by equal width from least to greatest value."""
        low, high = self.min_max(column)
        if low is None:
            return self._new(self.df.select(F.lit(0).alias("bin"), F.lit(0).cast("bigint").alias("n")).limit(0))
        width = (1 + high - low) / max(bins - 1, 1)
        b = F.floor((name_of(column) - F.lit(low)) / F.lit(float(width))).cast("int")
        return self._new(self.df.where(name_of(column).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n")))

    def set_hash(self) -> int:
        """64 bits that do not depend on the order of rows or columns, but on every row and how often
        it is there: sums of two hashes of each row, and the number of rows."""
        row = F.to_json(F.struct(*map(name_of, sorted(self.df.columns))))
        sums = [F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("string") for h in (F.xxhash64(row), F.xxhash64(F.lit("2"), row))]
        return self.df.agg(F.xxhash64(*sums, F.count("*"))).first()[0]

    # schema and display
    def keys(self) -> list[str]:
        return self.df.columns

    def types(self) -> dict[str, str]:
        """Column types; whole and floating numbers are both 'numeric'."""
        name = lambda t: "boolean" if isinstance(t, BooleanType) else "numeric" if isinstance(t, NumericType) else t.simpleString()
        return {f.name: name(f.dataType) for f in self.df.schema.fields}

    def __iter__(self) -> Iterator[dict]:
        return (r.asDict(True) for r in self.df.toLocalIterator())

    def __enter__(self) -> Dataset:
        return self

    def __exit__(self, *_: Any) -> None:
        if self.storage is not Storage.NONE:
            self.df.unpersist()

    def to_pandas(self):
        return self.df.toPandas()

    def to_ascii_table(self, limit: int = 5) -> str:
        return display.ascii_table(self.df, limit)

    def to_html_table(self, limit: int = 5) -> str:
        return display.html_table(self.df, limit)

    _repr_html_ = to_html_table

    def asof_join(self, other: Dataset, keys: list[str], time: str, other_time: str | None = None) -> Dataset:
        """Each row with the latest row of ``other`` of equal keys at or before its time."""
        from .asof import asof_join

        return self._new(asof_join(self.df, other.df, keys, time, other_time))

    def interval_join(self, other: Dataset, keys: list[str], span: tuple[str, str], other_span: tuple[str, str] | None = None) -> Dataset:
        """Every pair of rows with equal keys whose (start, end) intervals have a point in common."""
        from .interval import interval_join

        return self._new(interval_join(self.df, other.df, keys, span, other_span))

    def sketch(self, keys: list[str], distinct=(), ranks=(), **bounds) -> Dataset:
        """Mergeable distinct counts and quantiles a key, to be stored a frame."""
        from .sketches import sketch

        return self._new(sketch(self.df, keys, distinct, ranks, **bounds))

    def unite_sketches(self, keys: list[str]) -> Dataset:
        """Sketches of many frames or keys as one row for each of ``keys``."""
        from .sketches import unite

        return self._new(unite(self.df, keys))

    def apply(self, f: Callable[[DataFrame], DataFrame]) -> Dataset:
        """Any DataFrame function: joins, windows, set operations."""
        return self._new(f(self.df))


def row_numbers(df: DataFrame, key: str, *order: str) -> DataFrame:
    """``row`` numbers within each key."""
    return df.withColumn("row", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
