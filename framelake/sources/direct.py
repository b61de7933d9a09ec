"""Files that tasks write where they stay, and the manifest that makes them count.

Each attempt of a task writes under names of its own and reports them; what a failed attempt
leaves is in no manifest.  A manifest, written last, names the files of one write below its folder and
ends with their number, so that one which was cut off is known as such.  It is the only
step that a reader sees: until it is whole the folder's former manifest counts.  Nothing is
renamed, and nothing old is deleted before the new stands.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dataset import Dataset
from . import storage
from .paths import bare
from .unite import arrow_file, name_of

FORMATS = ("jsonl", "zstd", "lzma", "parquet", "text", "flat")
FILE_BYTES = 62 << 20
_EXTENSIONS = {"flat": "jsonl", "text": "txt"}
_ROW_GROUP = 8 << 20  # bytes in memory
_MADE = "folder string, name string, rows long, bytes long"


class Made(NamedTuple):
    """A file of a write: its folder below the root, its name, its rows and bytes."""

    folder: str
    name: str
    rows: int
    bytes: int


def _lzma(most: int) -> dict:
    """LZMA at its usual preset, with a dictionary no larger than a file: the tables for a larger one are
    made anew for each file and find nothing more."""
    return {"id": 0x21, "preset": 6, "dict_size": min(8 << 20, max(4096, most))}  # lzma.FILTER_LZMA2


class _LineFile:
    """Lines, whose bytes count before compression."""

    def __init__(self, stream, format: str, most: int = FILE_BYTES):
        import lzma

        import zstandard

        self.stream, self.size, self.rows = stream, 0, 0
        self.out = zstandard.ZstdCompressor().stream_writer(stream, closefd=False) if format == "zstd" else lzma.LZMAFile(stream, "wb", filters=[_lzma(most)]) if format == "lzma" else stream

    def write(self, batch: pa.RecordBatch, most: int) -> int:
        """Writes rows up to ``most`` bytes a file, one at least; gives their number."""
        lines = batch.column(0).cast(pa.binary())
        sizes = np.cumsum(np.asarray(pa.compute.binary_length(lines).fill_null(0)).astype(np.int64) + 1)
        n = max(int(np.searchsorted(sizes, most - self.size, side="right")), 1 if not self.rows else 0)
        if n:
            self.out.write(b"\n".join(x or b"" for x in lines.slice(0, n).to_pylist()) + b"\n")
            self.size, self.rows = self.size + int(sizes[n - 1]), self.rows + n
        return n

    def full(self, most: int) -> bool:
        return self.size >= most

    def close(self) -> None:
        if self.out is not self.stream:
            self.out.close()
        self.stream.close()


class _ParquetFile:
    """Row groups of a few megabytes, whose bytes count as they are in the file."""

    def __init__(self, stream, schema: pa.Schema):
        import pyarrow.parquet as pq

        self.stream, self.size, self.rows, self.held = stream, 0, 0, []
        self.out = pq.ParquetWriter(stream, schema, compression="zstd")

    def write(self, batch: pa.RecordBatch, most: int) -> int:
        per_row = max(1, batch.nbytes // max(1, batch.num_rows))
        part = batch.slice(0, max(1, min(batch.num_rows, _ROW_GROUP // per_row)))
        self.held.append(part)
        self.rows += part.num_rows
        if sum(x.nbytes for x in self.held) >= min(_ROW_GROUP, most):
            self._flush()
        return part.num_rows

    def _flush(self) -> None:
        if self.held:
            self.out.write_table(pa.Table.from_batches(self.held))
            self.held, self.size = [], self.stream.tell()

    def full(self, most: int) -> bool:
        return self.size >= most

    def close(self) -> None:
        self._flush()
        self.out.close()
        self.size = self.stream.tell()
        self.stream.close()


def _lines(df: DataFrame, format: str, by: str | None) -> DataFrame:
    """(value, by): the rows as the lines of a format."""
    if format == "flat":
        df = Dataset(df).flatten().df
    rest = [name_of(c) for c in df.columns if c != by]
    value = F.concat_ws("\t", *[c.cast("string") for c in rest]) if format == "text" else F.to_json(F.struct(*rest))
    return df.select(value.alias("value"), *([name_of(by)] if by else []))


def write(df: DataFrame, root: str, format: str = "parquet", by: str | None = None, file_bytes: int = FILE_BYTES, aside: tuple[str, str] | None = None) -> list[Made]:
    """Writes rows below ``root``, in the folder that column ``by`` names; a file is cut where its next row
    would take it beyond ``file_bytes`` (a Parquet file: at the row group that reaches them).
    Rows are sorted by folder within their partition, so that a task holds one file open.
    ``aside``: (column, folder): a column that only files below that folder have."""
    if format not in FORMATS:
        raise ValueError(f"format is one of {', '.join(FORMATS)}")
    spark, target = df.sparkSession, storage.qualified(df.sparkSession, root)
    rows = df if format == "parquet" else _lines(df, format, by)
    if by:
        rows = rows.sortWithinPartitions(name_of(by))
    ext, columns = _EXTENSIONS.get(format, format), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401
        from pyspark import TaskContext

        task, made, out, folder = TaskContext.get(), [], None, None

        def start(value: str, schema: pa.Schema):
            where, path = arrow_file(f"{target}/{value}" if value else target)
            where.create_dir(path)
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(made):04d}.{ext}"
            made.append([value, name, 0, 0])
            stream = where.open_output_stream(f"{path}/{name}")
            return _ParquetFile(stream, schema) if format == "parquet" else _LineFile(stream, format, file_bytes)

        def end() -> None:
            if out is not None:
                out.close()
                made[-1][2:] = out.rows, out.size

        for b in batches:
            b = b.rename_columns(columns)
            names = b.column(by).to_pylist() if by else [""] * b.num_rows
            part = b.drop_columns([by]) if by else b
            at = 0
            for value, run_ in groupby(names):
                n = sum(1 for _ in run_)
                rest, at = part.slice(at, n), at + n
                if aside and aside[0] in rest.schema.names and not (value or "").startswith(f"{aside[1]}/"):
                    rest = rest.drop_columns([aside[0]])
                while rest.num_rows:
                    if out is None or value != folder or out.full(file_bytes):
                        end()
                        out, folder = start(value or "", rest.schema), value
                    taken = out.write(rest, file_bytes)
                    if not taken:  # the next row goes to the next file
                        end()
                        out = None
                    rest = rest.slice(taken)
        end()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["folder", "name", "rows", "bytes"])

    plain = rows.toDF(*[f"_{i}" for i in range(len(columns))])  # mapInArrow takes no names with dots
    return [Made(*r) for r in plain.mapInArrow(run, _MADE).collect()]  # a row a file


def write_empty(df: DataFrame, root: str, format: str) -> list[Made]:
    """A file without rows: of Parquet with the frame's columns."""
    spark, name = df.sparkSession, f"empty-{uuid.uuid4().hex[:8]}"
    if format == "parquet":
        df.limit(0).coalesce(1).write.parquet(f"{root}/{name}")
        return [Made(name, f.rsplit("/", 1)[-1], 0, 0) for f in storage.files(spark, f"{root}/{name}") if f.endswith(".parquet")]
    storage.touch(spark, f"{root}/{name}.{_EXTENSIONS.get(format, format)}")
    return [Made("", f"{name}.{_EXTENSIONS.get(format, format)}", 0, 0)]


def commit(spark: SparkSession, folder: str, made: list[Made], name: str = "frame") -> str:
    """The manifest of files below ``folder``; those of one name are told apart by their time."""
    now = f"{datetime.datetime.now(datetime.timezone.utc):%Y%m%d%H%M%S%f}"
    path = f"{folder}/_{name}.{now}-{uuid.uuid4().hex[:8]}.manifest"  # Spark's readers pass over such names
    lines = [json.dumps({"file": f"{m.folder}/{m.name}".lstrip("/"), "rows": m.rows, "bytes": m.bytes}) for m in made]
    storage.write_text(spark, path, "\n".join([*lines, json.dumps({"files": len(made)})]))
    return path


def listed(spark: SparkSession, manifests: list[str]) -> dict[str, list[str]]:
    """The files that each whole manifest names."""

    def names(path: str) -> list[str] | None:
        try:
            *files, end = map(json.loads, storage.read_text(spark, path).split("\n"))
            return [f["file"] for f in files] if end.get("files") == len(files) else None
        except ValueError:
            return None

    with ThreadPoolExecutor(16) as pool:
        found = zip(manifests, pool.map(names, manifests))
        return {bare(m): n for m, n in found if n is not None}


def supersede(spark: SparkSession, folder: str, manifest: str, made: list[Made], below: set[str] | None = None) -> None:
    """Deletes what a committed write replaces in its folders: other data files, be they an earlier
    write's or a failed attempt's, and earlier manifests beside it."""
    # A path may begin with a scheme, whose slashes stay.
    kept = {"/".join(p for p in (folder.rstrip("/"), m.folder.strip("/"), m.name) if p) for m in made} | {manifest}
    kept = {bare(storage.qualified(spark, k)) for k in kept}
    for sub in below if below is not None else {""}:
        for f in storage.files(spark, f"{folder}/{sub}".rstrip("/")):
            name = f.rsplit("/", 1)[-1]
            if bare(f) not in kept and name not in ("frame.complete", "frame.ignore"):
                storage.delete(spark, f)
