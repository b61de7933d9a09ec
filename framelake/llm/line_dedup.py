"""Line dedup by range-partitioned hashes.

Lines become (128-bit key hash, document, position) rows, range-partitioned by hash
and document and sorted by document and position.  Each task streams its runs, holds
at most the lines of the first ``min_docs - 1`` documents of one run, and names the
lines to drop.  Since the document is part of the range key, a line that a third of
all documents share is spread over many tasks; the runs that meet at partition borders
are settled by a table of two rows a partition.  What comes out is a compressed keep
bitmap per document, never text.

Defined cases: a null or empty text is one empty line, whose empty key is never
dropped.  A document is a (doc_id, text hash) pair, so repeated rows count once and
lose the same lines; a null doc_id is an id like any other; columns of any name pass through,
but for one that has the bitmap's own name, which it replaces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, columns, fresh, materialize, parallelism

_SPACES = SPACE_CHARS.encode()
_LINES = "h1 long, h2 long, d long, t long, p int"
_FOUND = "kind string, part int, h1 long, h2 long, d long, t long, p int, n long"
_NULL_ID = -(1 << 63)


def _doc_columns(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL_ID)).alias("d"), F.xxhash64(text).alias("t"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("x"))


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, docs, counts, places = [], [], [], []
            for i, x in enumerate(b.column(2)):
                n = len(digests)
                for p, line in enumerate(x.as_py().lower().split(b"\n")):  # bytes.lower(): A-Z alone
                    key = line.strip(_SPACES)
                    if key and (min_chars < 2 or len(key.decode("utf-8", "replace")) >= min_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        places.append(p)
                docs.append(i)
                counts.append(len(digests) - n)
            h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            at = np.repeat(np.array(docs, dtype=np.int64), counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(np.array(places, dtype=np.int32))],
                names=["h1", "h2", "d", "t", "p"],
            )

    return run


def _find(min_docs: int, keep_first: bool):
    """Rows of kind drop: the line goes.  maybe: it goes if its key's run, which touches
    the partition's border, reaches min_docs in all.  head: a border run's first line.
    count: documents of a border run in this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def out(kind: str, rows: np.ndarray, n: np.ndarray | int = 0) -> pa.RecordBatch:
            k = len(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * k, pa.string()), pa.array(np.full(k, part, np.int32)), *(pa.array(rows[:, c]) for c in range(4)), pa.array(rows[:, 4].astype(np.int32)), pa.array(np.broadcast_to(np.asarray(n, np.int64), k))],
                names=["kind", "part", "h1", "h2", "d", "t", "p", "n"],
            )

        held = np.empty((0, 5), dtype=np.int64)  # the open run's undecided lines
        key = None  # of the open run
        seen, last = 0, None  # documents of the open run that are no longer held, and the last of them
        first = True  # the open run is the partition's first
        for b in batches:
            new = np.column_stack([c.to_numpy().astype(np.int64) for c in b.columns])
            if not len(new):
                continue
            a = np.concatenate([held, new])
            starts = np.flatnonzero(np.r_[True, np.any(a[1:, :2] != a[:-1, :2], axis=1)])
            turns = np.r_[True, np.any(a[1:, :4] != a[:-1, :4], axis=1)]
            if key is not None and last is not None and tuple(a[0, :2]) == key and tuple(a[0, 2:4]) == last:
                turns[0] = False
            docs = np.add.reduceat(turns.astype(np.int64), starts)
            ends = np.r_[starts[1:], len(a)]
            for_open = key is not None and tuple(a[0, :2]) == key
            if key is not None and not for_open:  # the open run, all of it emitted before, has ended
                if first:
                    yield out("count", np.array([[*key, 0, 0, 0]]), seen)
                    first = False
                seen, last = 0, None
            total = docs.copy()
            if for_open:
                total[0] += seen
            closed = len(starts) - 1  # runs before the one still open
            lo = 0
            if closed and first:  # the partition's first run is complete
                rows = a[: ends[0]]
                yield from border(out, rows, int(total[0]), seen > 0)
                first, lo = False, 1
            elif closed and for_open and seen:  # what is left of a run that was decided before
                yield out("drop", a[: ends[0]])
                lo = 1
            if closed > lo:
                hot = np.flatnonzero(total[lo:closed] >= min_docs) + lo
                if len(hot):
                    which = np.zeros(len(a) + 1, dtype=np.int64)
                    np.add.at(which, starts[hot] + keep_first, 1)
                    np.add.at(which, ends[hot], -1)
                    yield out("drop", a[np.cumsum(which)[:-1] > 0])
            tail = a[starts[-1] :]
            if closed:
                seen, last = 0, None
            key = tuple(int(v) for v in tail[0, :2])
            if seen + int(docs[-1]) >= min_docs:  # decided: nothing more needs to be held
                head = seen == 0 and keep_first
                if head:
                    yield out("head", tail[:1])
                yield out("drop", tail[int(head) :])
                seen, last, held = seen + int(docs[-1]), tuple(tail[-1, 2:4]), tail[:0]
            else:
                held = tail
        if key is not None:
            if len(held):
                turns = np.r_[True, np.any(held[1:, 2:4] != held[:-1, 2:4], axis=1)]
                yield from border(out, held, int(turns.sum()), False)
            else:
                yield out("count", np.array([[*key, 0, 0, 0]]), seen)

    def border(out, rows, n, headed):
        yield out("count", rows[:1], n)
        decided = n >= min_docs
        if not headed and (keep_first or not decided):
            yield out("head", rows[:1])
            rows = rows[1:]
        if len(rows):
            yield out("drop" if decided else "maybe", rows)

    return run


def dropped_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep: str = "first", text: str = "text") -> DataFrame:
    """(d, t, p): the lines to drop.  keep: "first" spares a key's first line by document
    and position, "none" drops every line of a key found in ``min_docs`` documents."""
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    n = parallelism(docs.sparkSession)
    lines = materialize(_doc_columns(docs, text).mapInArrow(_hash_lines(min_chars), _LINES), "lines")
    ranged = lines.repartitionByRange(n, "h1", "h2", "d", "t").sortWithinPartitions("h1", "h2", "d", "t", "p")
    found = materialize(ranged.mapInArrow(_find(min_docs, keep == "first"), _FOUND), "found")
    border = found.where("kind = 'count'").groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)
    heads = found.where("kind = 'head'").groupBy("h1", "h2").agg(F.min(F.struct("d", "t", "p")).alias("first"))
    open_lines = found.where("kind IN ('maybe', 'head')").join(border, ["h1", "h2"], "left_semi")
    if keep == "first":
        open_lines = open_lines.join(heads, ["h1", "h2"]).where(F.struct("d", "t", "p") != F.col("first"))
    return found.where("kind = 'drop'").select("d", "t", "p").unionByName(open_lines.select("d", "t", "p"))


def _bitmap(positions: np.ndarray) -> bytes:
    drop = np.zeros(int(positions.max()) // 8 * 8 + 8, dtype=bool)
    drop[positions] = True
    return zlib.compress(np.packbits(~drop).tobytes(), 1)


def dropped_positions(bitmap: bytes) -> np.ndarray:
    """Line numbers that a keep bitmap drops; lines beyond it stay."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8)) == 0)


def keep_bitmaps(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep: str = "first", text: str = "text") -> DataFrame:
    """(d, t, keep_bitmap) of the documents that lose a line: zlib of one bit a line, 1 to
    keep, up to the last dropped line and padded with ones."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = [_bitmap(np.asarray(p.values)) for p in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(maps, pa.binary())], names=["d", "t", "keep_bitmap"])

    gone = dropped_lines(docs, min_docs, min_chars, keep, text)
    return gone.groupBy("d", "t").agg(F.collect_list("p").alias("p")).mapInArrow(pack, "d long, t long, keep_bitmap binary")


def line_dedup(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep: str = "first", text: str = "text", bitmap: str = "keep_bitmap") -> DataFrame:
    """Every row of ``docs`` with the column ``bitmap`` (null: all lines stay)."""
    maps = keep_bitmaps(docs, min_docs, min_chars, keep, text)
    own_d, own_t, map_d, map_t = (fresh(docs, x) for x in ("own_d", "own_t", "map_d", "map_t"))
    maps = maps.select(F.col("d").alias(map_d), F.col("t").alias(map_t), F.col("keep_bitmap").alias(bitmap))
    docs = docs.drop(bitmap)
    keyed = docs.withColumns({own_d: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL_ID)), own_t: F.xxhash64(text)})
    return keyed.join(maps, (F.col(own_d) == F.col(map_d)) & (F.col(own_t) == F.col(map_t)), "left").select(*columns(docs), bitmap)


def kept_text(text: str | None, bitmap: bytes | None) -> tuple[int, int, str]:
    """(lines, dropped lines, the other lines joined) of one text."""
    lines = (text or "").split("\n")
    if bitmap is None:
        return len(lines), 0, text or ""
    drop = dropped_positions(bitmap)
    drop = drop[drop < len(lines)].tolist()
    for p in reversed(drop):
        del lines[p]
    return len(lines) + len(drop), len(drop), "\n".join(lines)


def drop_lines(deduped: DataFrame, text: str = "text", bitmap: str = "keep_bitmap") -> DataFrame:
    """Applies ``bitmap``: the same columns, without it, and the text that stays.
    A null text stays null; rows that keep all lines never leave the JVM's columns."""
    names = [c for c in deduped.columns if c != bitmap]
    numbered = deduped.select(*columns(deduped.drop(bitmap)), bitmap).toDF(*[f"c{i}" for i in range(len(names))], "bitmap")  # mapInArrow takes no dots in names
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.as_py() if not m.is_valid else kept_text(x.as_py(), m.as_py())[2] for x, m in zip(b.column(at), b.column("bitmap"))]
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

    return numbered.mapInArrow(run, numbered.drop("bitmap").schema).toDF(*names)
