"""Token-id output: concatenated ids with Elias-Fano document boundaries.

File format.  A token file is a Parquet folder with one row a segment: ``part`` (range
partition, in document order), ``segment`` (order within it), ``before`` (ids of the part's
earlier segments), ``n_docs``, ``n_ids``, ``width`` (bytes of an id), ``ids`` (little-endian,
``width`` bytes each), ``first_id`` and ``last_id`` (document ids), and two sequences in
Elias-Fano code: ``ends``, the documents' ends within the segment, and ``names``, their ids
less ``first_id``.  Each is a struct of ``low_bits``, ``low``, ``high`` and ``ones``: an item's
``low_bits`` lower bits are packed in ``low``; ``high`` is a bitmap with a one at
(item >> low_bits) + k for the k-th item; ``ones`` is the select structure, the ones before
each 512 bits of ``high`` in four bytes.  Selecting the k-th one gives an item back without
decoding the others, so offsets cost about 2 + log2(ids per document) bits and no 64-bit table
is stored.  Parquet is the container because Spark's own writer commits it safely on any
shared store; segments are bounded, so no task holds a whole partition.

Defined cases: a null text is empty and holds the end id alone; repeated rows are
separate documents, ordered by text; a null doc_id sorts first; extra columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parallelism
from .encode import encoder

_CODE = "struct<low_bits:int,low:binary,high:binary,ones:binary>"
_FILE = f"part int, segment int, before long, n_docs long, n_ids long, width int, first_id long, last_id long, names {_CODE}, ends {_CODE}, ids binary"
_DOCS = "doc_id long, start long, n_tokens long, ids binary"
_NULL_ID = -(1 << 63)
_SMALL_PARTS = 100_000
_ALL = (1 << 64) - 1


def elias_fano(items: np.ndarray) -> dict:
    """Code of a non-decreasing sequence of unsigned numbers."""
    items = items.astype(np.uint64)
    n, top = len(items), int(items[-1]) if len(items) else 0
    bits = max(0, (top // n).bit_length() - 1) if n else 0
    low = (items[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
    high = np.zeros((top >> bits) + n + 1, dtype=np.uint8)
    high[(items >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
    high = np.packbits(high, bitorder="little")
    ones = np.bitwise_count(np.pad(high, (0, -len(high) % 64))).reshape(-1, 64).sum(axis=1)
    before = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
    return {"low_bits": bits, "low": np.packbits(low.ravel(), bitorder="little").tobytes(), "high": high.tobytes(), "ones": before.tobytes()}


class Items:
    """Select over Elias-Fano code."""

    def __init__(self, n: int, code: dict):
        self.n, self.bits = n, code["low_bits"]
        self.low, self.high, self.ones = np.frombuffer(code["low"], dtype=np.uint8), np.frombuffer(code["high"], dtype=np.uint8), np.frombuffer(code["ones"], dtype="<u4")

    def select(self, k: np.ndarray) -> np.ndarray:
        """The k-th items, for ascending k: only the blocks that hold their ones are read."""
        k = np.asarray(k, dtype=np.int64)
        blocks = np.searchsorted(self.ones, k, side="right") - 1
        used, row = np.unique(blocks, return_inverse=True)
        at = used[:, None] * 64 + np.arange(64)
        bytes_ = np.where(at < len(self.high), self.high[np.minimum(at, len(self.high) - 1)], 0).astype(np.uint8)
        where = np.flatnonzero(np.unpackbits(bytes_.ravel(), bitorder="little"))  # ones of the used blocks in turn
        counts = np.bitwise_count(bytes_).sum(axis=1, dtype=np.int64)
        first = np.cumsum(counts) - counts
        spot = where[first[row] + k - self.ones[blocks]]
        tops = used[row] * 512 + spot % 512 - k
        if not self.bits:
            return tops
        start = (k * self.bits)[:, None] + np.arange(self.bits)
        low = (self.low[start >> 3] >> (start & 7).astype(np.uint8) & 1).astype(np.uint64)
        return ((tops.astype(np.uint64) << np.uint64(self.bits)) | (low << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)).astype(np.int64)

    def item(self, k: int) -> int:
        return int(self.select(np.array([k]))[0])

    def find(self, value: int) -> tuple[int, int]:
        """Places from which and before which items equal ``value``, by binary search."""

        def least(above: bool) -> int:
            low, high = 0, self.n
            while low < high:
                mid = (low + high) // 2
                x = self.item(mid) & _ALL
                low, high = (mid + 1, high) if x < value or (above and x == value) else (low, mid)
            return low

        return least(False), least(True)


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, segment_ids: int = 4_000_000, text: str = "text") -> None:
    """Encodes every whole text, appends ``end_id`` and writes ascending doc_id order.
    The texts are range-partitioned once; ids are never shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, segment = encoder(tokenizer), TaskContext.get().partitionId(), 0
        tail = b"" if end_id is None else np.array([end_id], dtype=enc.dtype).tobytes()
        names, ids, ends, total, before = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            first = np.array(names, dtype=np.int64).view(np.uint64)
            row = {"part": [part], "segment": [segment], "before": [before], "n_docs": [len(ends)], "n_ids": [total], "width": [enc.dtype.itemsize], "first_id": [names[0]], "last_id": [names[-1]], "names": [elias_fano(first - first[0])], "ends": [elias_fano(np.array(ends))], "ids": [b"".join(ids)]}
            code = pa.struct([("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("ones", pa.binary())])
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), code, code, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types)], names=list(row))

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), enc.encode(t.as_py() for t in b.column(1))):
                names.append(i)
                ids.append(x + tail)
                total += (len(x) + len(tail)) // enc.dtype.itemsize
                ends.append(total)
                if total >= segment_ids:
                    yield flush()
                    segment, before = segment + 1, before + total
                    names, ids, ends, total = [], [], [], 0
        if names:
            yield flush()

    n = parallelism(docs.sparkSession)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL_ID)).alias("d"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("x"))
    keyed.repartitionByRange(n, "d").sortWithinPartitions("d", "x").mapInArrow(run, _FILE).write.option("compression", "zstd").parquet(path)


def read_token_file(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian unsigned 32-bit integers, start
    the ids of all documents before; with ``doc_ids`` of those documents alone, found by
    select in the segments whose range holds one.  Segments stay where they are: a part's
    total is one row, and the totals are broadcast once they have been counted."""
    rows = spark.read.schema(_FILE).parquet(path)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    small = rows.select("part").distinct().limit(_SMALL_PARTS + 1).count() <= _SMALL_PARTS
    wanted = None if doc_ids is None else sorted(set(doc_ids))
    if wanted is not None:
        rows = rows.where(F.exists(F.array(*map(F.lit, wanted)).cast("array<bigint>"), lambda i: (F.col("first_id") <= i) & (i <= F.col("last_id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ends, names, first = Items(r["n_docs"], r["ends"]), Items(r["n_docs"], r["names"]), r["first_id"]
                ids = np.frombuffer(r["ids"], dtype=f"<u{r['width']}")
                if wanted is None:
                    spans = [(at, min(at + 500, r["n_docs"])) for at in range(0, r["n_docs"], 500)]
                else:
                    spans = [names.find(i - first) for i in wanted if first <= i <= r["last_id"]]
                for low, high in spans:
                    if low == high:
                        continue
                    edges = ends.select(np.arange(max(low - 1, 0), high))
                    edges = edges if low else np.concatenate([[0], edges])
                    found = [first + (x & _ALL) for x in names.select(np.arange(low, high)).tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([None if v == _NULL_ID else v for v in found], pa.int64()),
                            pa.array(edges[:-1] + r["before"] + r["base"]),
                            pa.array(np.diff(edges)),
                            pa.array([ids[s:e].astype("<u4").tobytes() for s, e in zip(edges[:-1], edges[1:])], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return rows.join(F.broadcast(bases) if small else bases, "part").drop("part").mapInArrow(run, _DOCS)


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
