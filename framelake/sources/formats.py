"""File formats by extension.  Spark reads what it can; archives go through one
``mapInPandas`` that yields JSON lines, which Spark then parses.

Files whose columns differ are one frame of all columns (``unite``).  An archive that cannot be
unpacked, a line that is no JSON object, a document that is none and a file without a
footer are left out, and told to ``Rejects``; the rest is read.
"""

from __future__ import annotations

import io
import json
import lzma
import re
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, NullType, StringType, StructField, StructType

from ..session import scratch_path
from . import storage, unite

_BAD = "_bad_record"
_BLOCK = 1 << 20


class Rejects:
    """What a read leaves out.  ``rows()`` are its records as (path, record, why), to be looked at or
    written aside; ``count()`` is their number, observed while the frame's rows were
    computed, so it is known after the first action."""

    def __init__(self) -> None:
        self._rows: list[DataFrame] = []
        self._seen: list[Observation] = []

    def watch(self, df: DataFrame, why: Column) -> DataFrame:
        """The rows of (value, path) that have no ``why``; the others are counted."""
        seen = Observation()
        self._seen.append(seen)
        self._rows.append(df.where(why.isNotNull()).select("path", F.col("value").alias("record"), why.alias("why")))
        return df.observe(seen, F.count(why).alias("n")).where(why.isNull())

    def add(self, spark: SparkSession, found: list[tuple[str, str]]) -> None:
        """Files by (path, why)."""
        if found:
            self.watch(spark.createDataFrame([(None, p, w) for p, w in found], "value string, path string, why string"), F.col("why")).count()

    def count(self) -> int:
        return sum(o.get["n"] for o in self._seen)

    def rows(self) -> DataFrame | None:
        return unite.united(self._rows)


def _archive(spark: SparkSession, paths: list[str], unpack: Callable[[bytes], Iterator[str]], schema: StructType | None, rejects: Rejects) -> DataFrame:
    """An archive is unpacked twice, a block at a time: to see whether all of it can be, and for its
    lines.  Those are written once to the shared folder, so that Spark infers over all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                try:
                    for _ in unpack(content):
                        pass
                except Exception as e:  # whatever an unpacker says of a broken blob
                    yield pd.DataFrame({"value": [json.dumps({"path": path, "why": f"{type(e).__name__}: {e}"})], "bad": [True]})
                    continue
                part, size = [], 0
                for x in unpack(content):
                    if x.strip():
                        part.append(x)
                        size += len(x)
                    if size > _BLOCK:
                        yield pd.DataFrame({"value": part, "bad": False})
                        part, size = [], 0
                if part:
                    yield pd.DataFrame({"value": part, "bad": False})

    lines = spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "value string, bad boolean")
    path = scratch_path(spark, "lines")
    lines.write.partitionBy("bad").text(path)
    made = {f.rsplit("=", 1)[1]: f for f in storage.folders(spark, path, "bad=")}
    if "true" in made:
        bad = spark.read.text(made["true"]).select(F.from_json("value", "path string, why string").alias("r")).select("r.*")
        rejects.add(spark, [tuple(r) for r in bad.collect()])  # one row a broken file
    if "false" not in made:
        return spark.createDataFrame([], schema or StructType())
    if schema is None:
        schema = _inferred(spark.read.option("columnNameOfCorruptRecord", _BAD).json(made["false"]).schema)
    return _of_lines(spark.read.text(made["false"]).select("value", F.lit(None).cast("string").alias("path")), schema, rejects)


def _inferred(schema: StructType) -> StructType:
    return StructType([f for f in schema if f.name != _BAD])


def _of_lines(lines: DataFrame, schema: StructType, rejects: Rejects) -> DataFrame:
    """Records of (value, path); a line that is no JSON object is none."""
    why = F.when(F.json_object_keys("value").isNull(), F.lit("no JSON object"))
    good = rejects.watch(lines.where(F.trim("value") != ""), why)
    return good.select(F.from_json("value", schema).alias("r")).select("r.*") if schema.fields else good.select()


def _split(blocks: Iterator[bytes]) -> Iterator[str]:
    """Lines end at line feeds alone: other separators of Unicode may be in a value."""
    rest: list[bytes] = []
    for block in blocks:
        first, *more = block.split(b"\n")
        rest.append(first)
        for line in more:
            yield b"".join(rest).decode().removesuffix("\r")
            rest = [line]
    if rest:
        yield b"".join(rest).decode().removesuffix("\r")


def _lines(raw: bytes) -> Iterator[str]:
    return _split(iter([raw]))


def _unxz(content: bytes) -> Iterator[str]:
    if not content:
        return
    with lzma.open(io.BytesIO(content)) as f:
        yield from _split(iter(lambda: f.read(_BLOCK), b""))


def _unzstd(content: bytes) -> Iterator[str]:
    """All frames of a file; one that ends too early is an error."""
    import zstandard

    def blocks() -> Iterator[bytes]:
        at = 0
        while at < len(content):
            frame = zstandard.ZstdDecompressor().decompressobj()
            while at < len(content) and not frame.eof:
                yield frame.decompress(content[at : at + (1 << 16)])
                at += 1 << 16
            if not frame.eof:
                raise EOFError("the last frame is cut off")
            at = min(at, len(content)) - len(frame.unused_data)

    yield from _split(blocks())


def _table(rows: list[dict]) -> Iterator[str]:
    return (json.dumps(r, default=str) for r in rows)


def _parquet_member(content: bytes) -> Iterator[str]:
    import pyarrow.parquet

    return _table(pyarrow.parquet.read_table(io.BytesIO(content)).to_pylist())


def _orc_member(content: bytes) -> Iterator[str]:
    import pyarrow.orc

    return _table(pyarrow.orc.read_table(io.BytesIO(content)).to_pylist())


def _csv_member(content: bytes) -> Iterator[str]:
    import csv

    return _table(list(csv.DictReader(io.StringIO(content.decode()))))


def _xml_record(text: str | bytes):
    """An XML document as a record: attributes @name, text #text, repeats as lists."""
    from xml.etree import ElementTree

    def of(e):
        out = {"@" + k.split("}")[-1]: v for k, v in e.attrib.items()}
        for c in e:
            name = c.tag.split("}")[-1]
            out[name] = [*(out[name] if isinstance(out[name], list) else [out[name]]), of(c)] if name in out else of(c)
        own = (e.text or "").strip()
        return {**out, "#text": own} if out and own else out or own or None

    return of(ElementTree.fromstring(text))


#: Members of a zip file, by their own extensions.
_MEMBERS: dict[str, Callable[[bytes], Iterator[str]]] = {
    "zip": lambda raw: _unzip(raw),
    "lzma": _unxz,
    "zstd": _unzstd,
    "zst": _unzstd,
    "jsonl": _lines,
    "json": lambda raw: iter([json.dumps(json.loads(raw))]),
    "csv": _csv_member,
    "parquet": _parquet_member,
    "orc": _orc_member,
    "txt": lambda raw: iter([json.dumps({"value": raw.decode()})]),
    "xml": lambda raw: iter([json.dumps(_xml_record(raw))]),
    "lxml": lambda raw: (json.dumps(_xml_record(x)) for x in _lines(raw) if x.strip()),
}


def _unzip(content: bytes) -> Iterator[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted(z.namelist()):
            unpack = _MEMBERS.get(name.rsplit(".", 1)[-1].lower())
            if unpack:
                yield from unpack(z.read(name))


_ROOT = r"<([A-Za-z_][\w.-]*(?::[\w.-]+)?)[\s/>]"


def _xml_lines(spark: SparkSession, paths: list[str], schema: StructType | None, rejects: Rejects) -> DataFrame:
    lines = spark.read.text(paths).where(F.trim("value") != "")
    if schema is None:
        kind = unite.fold_types(_line_types(lines), "_VALUE")
        if not isinstance(kind, StructType):
            return spark.createDataFrame([], StructType())
        schema = _filled(kind)
    return lines.select(F.from_xml("value", schema).alias("r")).select("r.*")


def _line_types(lines: DataFrame) -> DataFrame:
    """The type of each line, as JSON; every line is looked at, in tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shapes = {json.dumps(_shape(v)) for v in b["value"]}
            kinds = {t.json() for t in map(_typed, map(json.loads, sorted(shapes))) if isinstance(t, StructType)}
            yield pd.DataFrame({"type": sorted(kinds)}, dtype=object)

    return lines.select("value").mapInPandas(run, "type string")


def _kind(text: str) -> str:
    t = text.strip()
    if re.fullmatch(r"[+-]?\d{1,18}", t):
        return "long"
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", t):
        return "double"
    return "boolean" if t.lower() in ("true", "false") else "string" if t else "null"


def _shape(text: str):
    """Names and kinds of a record's attributes and elements, its root's first; null where
    the line is no XML, which from_xml gives as nulls."""
    from xml.etree import ElementTree

    def of(e, root: bool = False):
        fields: list = [["_" + k.split("}")[-1], _kind(v)] for k, v in e.attrib.items()]
        kids: dict[str, list] = {}
        for c in e:
            kids.setdefault(c.tag.split("}")[-1], []).append(of(c))
        fields += [[name, found if len(found) > 1 else found[0]] for name, found in kids.items()]
        if not fields and not root:
            return _kind(e.text or "")
        own = "".join([e.text or "", *[c.tail or "" for c in e]])
        if own.strip():
            fields.append(["_VALUE", _kind(own)])
        return {"fields": sorted(fields, key=lambda x: x[0])}

    try:
        return of(ElementTree.fromstring(text), True)
    except ElementTree.ParseError:
        return None


def _typed(shape) -> DataType:
    if isinstance(shape, dict):
        return StructType([StructField(n, _typed(x)) for n, x in shape["fields"]])
    if isinstance(shape, list):
        kind: DataType = NullType()
        for x in shape:
            kind = unite.wider(kind, _typed(x), "_VALUE")
        return ArrayType(kind)
    return {"long": LongType(), "double": DoubleType(), "boolean": BooleanType(), "string": StringType()}.get(shape, NullType())


def _filled(kind: DataType) -> DataType:
    """Elements that are empty in every record are text."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _filled(f.dataType)) for f in kind])
    if isinstance(kind, ArrayType):
        return ArrayType(_filled(kind.elementType))
    return StringType() if isinstance(kind, NullType) else kind


def _xml(spark: SparkSession, paths: list[str], schema: StructType | None, rejects: Rejects) -> DataFrame:
    """Files grouped by their own root tag, each group read with it; files are matched by
    the paths given."""
    found = spark.read.text(paths, wholetext=True).select(F.regexp_extract("value", _ROOT, 1).alias("root"), F.col("_metadata.file_path").alias("path"))
    by: dict[str, list[str]] = {}
    for r in found.where("root <> ''").orderBy("root", "path").toLocalIterator():
        by.setdefault(r["root"], []).append(unquote(r["path"]))
    frames = []
    for root, files in by.items():
        r = spark.read.option("rowTag", root).option("attributePrefix", "@").option("valueTag", "#text").option("ignoreNamespace", True)
        frames.append((r.schema(schema) if schema else r).xml(files))
    return unite.united(frames) if frames else spark.createDataFrame([], schema or StructType())


def _json_lines(spark: SparkSession, paths: list[str], schema: StructType | None, rejects: Rejects) -> DataFrame:
    if schema is None:
        df = spark.read.option("columnNameOfCorruptRecord", _BAD).json(paths)
        if _BAD not in df.columns:
            return df
        schema = _inferred(df.schema)
    return _of_lines(spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path")), schema, rejects)


def _json_document(spark: SparkSession, paths: list[str], schema: StructType | None, rejects: Rejects) -> DataFrame:
    if schema is None:
        df = spark.read.option("columnNameOfCorruptRecord", _BAD).json(paths, multiLine=True)
        if _BAD not in df.columns:
            return df
    good, bad = [], []
    fine = F.json_object_keys("value").isNotNull() | F.json_array_length("value").isNotNull()
    for path, ok in spark.read.text(paths, wholetext=True).select("_metadata.file_path", fine).toLocalIterator():
        (good if ok else bad).append(unquote(path))
    rejects.add(spark, [(p, "no JSON document") for p in bad])
    if not good:
        return spark.createDataFrame([], schema or StructType())
    return (spark.read.schema(schema) if schema else spark.read).json(good, multiLine=True)


def _headed(spark: SparkSession, paths: list[str], header: Callable, rejects: Rejects) -> list[tuple[str, list[str]]]:
    groups = unite.by_header(spark, paths, header)
    rejects.add(spark, [(p, h[1:]) for h, files in groups if h.startswith("!") for p in files])
    return [(h, files) for h, files in groups if not h.startswith("!")]


def _columnar(format: str, footer: Callable) -> Callable:
    """Parquet and ORC: files that merely lack columns are one scan, others are cast to what all
    of them can be."""

    def read(spark: SparkSession, paths: list[str], schema: StructType | None, rejects: Rejects) -> DataFrame:
        load = lambda files, kind=None: (spark.read.schema(kind) if kind else spark.read).format(format).load(files)
        groups = [files for _, files in _headed(spark, paths, footer, rejects)]
        if not groups:
            return spark.createDataFrame([], schema or StructType())
        kinds = [load(files[:1]).schema for files in groups]
        every = schema or unite.unite(kinds)
        types = {f.name.lower(): f.dataType for f in every}
        same = [all(types.get(f.name.lower(), f.dataType) == f.dataType for f in k) for k in kinds]
        frames = [load([p for files, ok in zip(groups, same) if ok for p in files], every)] if any(same) else []
        frames += [unite.as_schema(load(files), every) for files, ok in zip(groups, same) if not ok]
        return unite.united(frames)

    return read


def _csv(spark: SparkSession, paths: list[str], schema: StructType | None, rejects: Rejects) -> DataFrame:
    """Each file by its own header; of columns of one name the last counts.  Values are text, or
    what of it reads as the type in ``schema``.  Quotes are doubled in values, which may hold
    line feeds, so a file is not split."""
    frames = []
    for header, files in _headed(spark, paths, unite.csv_header, rejects):
        names = {n.lower() or f"_c{i}": (n or f"_c{i}", i) for i, n in enumerate(json.loads(header))}
        held = StructType([StructField(f"_{i}", StringType()) for i in range(len(json.loads(header)))])
        if names:
            df = spark.read.schema(held).csv(files, header=True, multiLine=True, escape='"')
            frames.append(df.select(*[F.col(f"_{i}").alias(n) for n, i in names.values()]))
    df = unite.united(frames)
    if df is None or schema is None:
        return spark.createDataFrame([], schema or StructType()) if df is None else df
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(unite.name_of(have[f.name.lower()]).try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


READERS: dict[str, Callable[[SparkSession, list[str], StructType | None, Rejects], DataFrame]] = {
    "jsonl": _json_lines,
    "json": _json_document,
    "zstd": lambda s, p, k, r: _archive(s, p, _unzstd, k, r),
    "zst": lambda s, p, k, r: _archive(s, p, _unzstd, k, r),
    "lzma": lambda s, p, k, r: _archive(s, p, _unxz, k, r),
    "zip": lambda s, p, k, r: _archive(s, p, _unzip, k, r),
    "parquet": _columnar("parquet", unite.parquet_footer),
    "orc": _columnar("orc", unite.orc_footer),
    "csv": _csv,
    "xml": _xml,
    "lxml": _xml_lines,
    "txt": lambda s, p, k, r: s.read.text(p, wholetext=True),
}


#: Spark's own writer names its JSON-lines files so; any other .json file is one document.
_SPARK_JSON = re.compile(r"/part-\d{5}-[0-9a-f-]{36}[^/]*\.json$")


def extension(path: str) -> str:
    return "jsonl" if _SPARK_JSON.search(path) else path.rsplit(".", 1)[-1].lower()


def read_files(spark: SparkSession, paths: list[str], schema: StructType | None = None, format: str | None = None, rejects: Rejects | None = None) -> DataFrame | None:
    """One frame of all files, by extension or one ``format`` for all; files of unknown
    extensions are left out, and None is returned when nothing remains."""
    by: dict[str, list[str]] = {}
    for p in paths:
        by.setdefault(format.lower().lstrip(".") if format else extension(p), []).append(p)
    return unite.united([READERS[ext](spark, by[ext], schema, rejects or Rejects()) for ext in sorted(by) if ext in READERS])
