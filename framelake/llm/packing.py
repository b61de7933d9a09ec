"""Packing documents into fixed-length sequences by order-preserving dynamic programming.

The documents of a range partition form one stream of ids.  Over the places where a
window may end (document ends, sentence ends, and, where neither serves, any place),
the least cost of packing everything before a place follows from the places at most
``length`` ids earlier: padding is linear in the window's start, so a monotone queue
gives the best start in constant time, and the few starts a power of two away, which
need no padding, are looked up besides.  Each window costs ``_WINDOW`` ids, so that a short one
is taken only where it saves that much padding.  Work is done in blocks of ``block`` windows; a
block's last windows are packed again with what follows, so memory is bounded.

Defined cases: a null text is empty and holds the end id alone; an empty table gives no
rows; repeated rows are packed separately and told apart by ``copy``; a null doc_id
sorts first; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism
from .encode import encoder

_PIECES = "doc_id long, copy int, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NULL_ID = -(1 << 63)


def best_cuts(ends: np.ndarray, penalties: np.ndarray, total: int, length: int, final: bool) -> list[int]:
    """Ends of the windows that pack ``total`` ids at the least padding plus penalties and
    windows' costs.

    ends: places where a window may end at a penalty, ascending; any other place within
    a gap wider than ``length`` is made up for by cuts at full windows.  Unless
    ``final``, the last windows are left out, since what follows may change them.
    """
    places, cost = _places(ends, penalties, total, length)
    n = len(places)
    # Starts that make a window of a power of two, which takes no padding, by end and size.
    index = np.full(total + 1, -1)
    index[places] = np.arange(n)
    ones = []
    for w in (1 << k for k in range(length.bit_length()) if 64 <= 1 << k <= length):
        skip = int(np.searchsorted(places, w))
        start = index[places[skip:] - w]
        found = np.flatnonzero(start >= 0)
        ones.append(np.stack([found + skip, start[found]]))
    exact = np.concatenate(ones, axis=1) if ones else np.empty((2, 0), dtype=np.int64)
    exact = exact[:, np.argsort(exact[0], kind="stable")]
    exact_end, exact_start = np.append(exact[0], n).tolist(), exact[1].tolist()
    low = np.searchsorted(places, places - length).tolist()  # the first start in reach
    at, fixed = places.tolist(), (cost + _WINDOW).tolist()
    best, back = [0.0] * n, [0] * n
    queue, head = [0], 0  # starts by best + place, ascending, from head on
    keys = [0.0] * n
    turn = 0  # in exact
    for i in range(1, n):
        e, first = at[i], low[i]
        while queue[head] < first:
            head += 1
        j = queue[head]
        value = keys[j] + length - e
        while exact_end[turn] == i:
            k = exact_start[turn]
            turn += 1
            if best[k] <= value:
                value, j = best[k], k
        value += fixed[i]
        best[i], back[i] = value, j
        key = keys[i] = value + e
        while len(queue) > head and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(i)
    cuts, i = [], n - 1
    while i:
        cuts.append(at[i])
        i = back[i]
    cuts.reverse()
    return cuts if final else cuts[: max(0, len(cuts) - 4)]


def _places(ends: np.ndarray, penalties: np.ndarray, total: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where windows may end, from 0 to ``total``, and their costs; a gap wider than
    ``length`` is cut at full windows."""
    places, cost = np.asarray(ends, dtype=np.int64), np.asarray(penalties, dtype=np.float64)
    places, cost = np.r_[0, places[places > 0]], np.r_[0.0, cost[places > 0]]
    if places[-1] < total:
        places, cost = np.r_[places, total], np.r_[cost, 0.0]
    wide = np.flatnonzero(np.diff(places) > length)
    more = [np.arange(places[i] + length, places[i + 1], length) for i in wide]  # cuts inside a sentence
    if more:
        at = np.repeat(wide + 1, [len(m) for m in more])
        places, cost = np.insert(places, at, np.concatenate(more)), np.insert(cost, at, _HARD)
    return places, cost


_SENTENCE, _HARD, _WINDOW = 2.0, 24.0, 64.0


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, block: int = 128, text: str = "text") -> DataFrame:
    """One row a piece: doc_id, copy (0 but for repeated ids), start, length, ids_crc32,
    doc_tokens, sequence_id, offset.  Texts are range-partitioned by doc_id once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        vocab = enc.tokenizer.get_vocab()
        stops = np.zeros(1 << 16 if enc.dtype.itemsize == 2 else len(vocab) + 1, dtype=bool)
        for token, i in vocab.items():
            stops[i] = token.removesuffix("</w>")[-1:] in (".", "!", "?", "Ċ")
        base = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []  # (doc_id, copy, ids, ids before in the document)
        size, sequence = 0, 0
        last, copy = object(), 0

        def emit(final: bool) -> pa.RecordBatch | None:
            nonlocal waiting, size, sequence
            if not size:
                return None
            stream = np.concatenate([w[2] for w in waiting])
            borders = np.cumsum([len(w[2]) for w in waiting])
            may = np.concatenate([[False], stops[stream]])
            may[borders] = True
            ends = np.flatnonzero(may)
            document = np.zeros(len(may), dtype=bool)
            document[borders] = True
            penalties = np.where(document[ends], 0.0, _SENTENCE)
            cuts = best_cuts(ends, penalties, size, length, final)
            rows: list[tuple] = []
            done, at, inside = 0, 0, 0  # ids packed; document in turn; its ids packed here
            for cut in cuts:
                offset = 0
                while done < cut:
                    doc, k, ids, before, total = waiting[at]
                    take = min(cut - done, len(ids) - inside)
                    piece = ids[inside : inside + take]
                    rows.append((doc, k, before + inside, take, zlib.crc32(piece.astype("<u4").tobytes()), total, base + sequence, offset))
                    done, offset, inside = done + take, offset + take, inside + take
                    if inside == len(ids):
                        at, inside = at + 1, 0
                sequence += 1
            waiting = waiting[at:]
            if inside:
                doc, k, ids, before, total = waiting[0]
                waiting[0] = (doc, k, ids[inside:], before + inside, total)
            size -= done
            cols = list(zip(*rows)) if rows else [[]] * 8
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=_NAMES)

        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), enc.encode(t.as_py() for t in b.column(1))):
                copy = copy + 1 if i == last else 0
                last = i
                ids = np.concatenate([np.frombuffer(raw, dtype=enc.dtype), np.array([end_id], dtype=enc.dtype)])
                waiting.append((None if i == _NULL_ID else i, copy, ids, 0, len(ids)))
                size += len(ids)
                if size >= block * length:
                    yield emit(False)
        if (rest := emit(True)) is not None:
            yield rest

    n = parallelism(docs.sparkSession)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL_ID)).alias("d"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("x"))
    return keyed.repartitionByRange(n, "d").sortWithinPartitions("d", "x").mapInArrow(run, _PIECES)


_NAMES = [x.split()[0] for x in _PIECES.split(", ")]
