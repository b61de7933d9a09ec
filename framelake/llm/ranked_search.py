"""Ranked lexical search: the highest-scoring documents of each query text.

Documents are cut into terms once, in tasks; what is kept of each are its length and the
counts of the terms that some query has.  Statistics are sums over that table.  Then each
task takes its documents in shards, and over every shard builds a tree for each term: at
the leaves a document's share of the score, above them the greatest share in ranges of 32 documents,
of 1,024 and so on, as sorted arrays of (term, range).  A query goes down best first: it opens the range
whose terms' greatest shares add up to most, and stops where no unopened range reaches its tenth
score; ranges that just reach it are opened, since an equal score of a smaller doc_id wins.
The tenth score is kept from shard to shard.  Tasks send on their best of each query.

Queries are taken in blocks of bounded bytes, each against all documents.

Defined cases: a document or query without a term (null and empty texts too) is not found and
finds nothing; repeated documents are ranked one by one, as are rows with a null doc_id, which
come last among equals; repeated queries are answered each; a text of any length is cut whole;
empty tables give no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")  # after A-Z are lower-cased
_FAN = 5  # a range holds 2 ** _FAN of the next level's
_SHARD_DOCS = 1 << 15
_SHARD_POSTINGS = 3 << 20
_FOUND = "query long, item_id long, doc_id long, score long"
_NO_ID = np.iinfo(np.int64).max


def terms(text: bytes | None) -> list[bytes]:
    return _TERM.findall(text.lower()) if text else []


def blocks(items: DataFrame, most: int, text: str = "text") -> Iterator[list[tuple[int, list[bytes]]]]:
    """Queries as (item_id, terms), in blocks of at most ``most`` bytes of text, streamed; a
    longer query is a block of its own."""
    out, size = [], 0
    for item_id, raw in items.select(F.col("item_id").cast("bigint"), F.col(text).cast("binary")).toLocalIterator():
        if out and size + len(raw or b"") > most:
            yield out
            out, size = [], 0
        out.append((item_id, terms(raw)))
        size += len(raw or b"")
    if out:
        yield out


def postings(docs: DataFrame, vocabulary: dict[bytes, int], text: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts): of each document its number of terms and, as bytes of 32-bit
    numbers, the vocabulary's terms in it and their counts."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)  # terms of one block of queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held.value.get
        for b in batches:
            n, which, counts = [], [], []
            for t in b.column(1).cast(pa.binary()):
                found = terms(t.as_py())
                n.append(len(found))
                met, times = np.unique(np.array([k for k in map(number, found) if k is not None], dtype="<i4"), return_counts=True)
                which.append(met.tobytes())
                counts.append(times.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(which, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col(text)).mapInArrow(run, "doc_id long, n long, terms binary, counts binary")


def document_counts(index: DataFrame, size: int) -> np.ndarray:
    """Of each term of the vocabulary the number of documents that hold it; a task ships one row
    a term at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size, dtype=np.int64)
        for b in batches:
            for t in b.column(0):
                out[np.frombuffer(t.as_py(), dtype="<i4")] += 1
        met = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(out[met])], names=["term", "n"])

    out = np.zeros(size, dtype=np.int64)
    for r in index.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        out[r[0]] = r[1]
    return out


class MaxTrees:
    """The trees of all terms over one shard: per level the sorted keys term * width + range and
    the greatest share of each; level 0 are the documents."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, share: np.ndarray, docs: int):
        order = np.argsort(term * docs + doc)
        key, value, width = (term * docs + doc)[order], share[order], docs
        self.levels = [(key, value, width)]
        while width > 1:
            up = -(-width >> _FAN)
            key = key // width * up + (key % width >> _FAN)
            first = np.flatnonzero(np.diff(key, prepend=-1))
            key, value, width = key[first], np.maximum.reduceat(value, first) if len(first) else value, up
            self.levels.append((key, value, width))

    def open(self, level: int, node: int, term: np.ndarray, weight: np.ndarray) -> tuple[int, np.ndarray]:
        """(first range, weighted sums) of the next level's ranges below a range."""
        key, value, width = self.levels[level - 1]
        first = node << _FAN
        last = min(first + (1 << _FAN), width)
        low, high = np.searchsorted(key, term * width + first), np.searchsorted(key, term * width + last)
        size = high - low
        at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        sums = np.zeros(last - first, dtype=np.int64)
        np.add.at(sums, key[at] - np.repeat(term * width + first, size), value[at] * np.repeat(weight, size))
        return first, sums

    def search(self, term: np.ndarray, weight: np.ndarray, ids: np.ndarray, best: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """The ``k`` best of ``best`` and the shard's documents, as (-score, doc_id)."""
        top = len(self.levels) - 1
        key, value, _ = self.levels[top]
        at = np.minimum(np.searchsorted(key, term), max(0, len(key) - 1))
        bound = int((value[at] * weight)[key[at] == term].sum()) if len(key) else 0
        heap = [(-bound, top, 0)] if bound > 0 else []
        while heap:
            bound, level, node = heapq.heappop(heap)
            least = -best[-1][0] if len(best) == k else 1
            if -bound < least:
                break
            if level == 0:  # a shard of one document
                best = sorted([*best, (bound, int(ids[node]))])[:k]
                continue
            first, sums = self.open(level, node, term, weight)
            near = np.flatnonzero(sums >= least)
            if level > 1:
                for i, s in zip((near + first).tolist(), sums[near].tolist()):
                    heapq.heappush(heap, (-s, level - 1, i))
            elif len(near):
                best = sorted([*best, *zip((-sums[near]).tolist(), ids[near + first].tolist())])[:k]
        return best


def best_of_tasks(index: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, item_id, doc_id, score): of each task the ``k`` best documents of each query, given
    as (item_id, terms, weights)."""
    held = index.sparkSession.sparkContext.broadcast(queries)  # one block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held.value
        best: list[list[tuple[int, int]]] = [[] for _ in asked]
        shard: list[tuple] = []

        def look() -> None:
            doc = np.repeat(np.arange(len(shard)), [len(s[2]) for s in shard])
            term = np.concatenate([s[2] for s in shard]).astype(np.int64)
            count = np.concatenate([s[3] for s in shard]).astype(np.int64)
            m = np.array([25 + 75 * s[1] * n_docs // n_terms for s in shard], dtype=np.int64)
            trees = MaxTrees(term, doc, 1_000_000_000 * count // (1_000 * count + 8 * m[doc]), len(shard))
            ids = np.array([s[0] for s in shard], dtype=np.int64)
            for q, (_, t, w) in enumerate(asked):
                best[q] = trees.search(t, w, ids, best[q], k)

        held_postings = 0
        for b in batches:
            for doc_id, n, t, c in zip(*(x.to_pylist() for x in b.columns)):
                if not t:
                    continue
                shard.append((_NO_ID if doc_id is None else doc_id, n, np.frombuffer(t, dtype="<i4"), np.frombuffer(c, dtype="<i4")))
                held_postings += len(shard[-1][2])
                if len(shard) >= _SHARD_DOCS or held_postings >= _SHARD_POSTINGS:
                    look()
                    shard, held_postings = [], 0
        if shard:
            look()
        for at in range(0, len(asked), 1_000):
            rows = [(q, asked[q][0], None if d == _NO_ID else d, -s) for q in range(at, min(at + 1_000, len(asked))) for s, d in best[q]]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4, names=["query", "item_id", "doc_id", "score"])

    return index.mapInArrow(run, _FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = 8 << 20, text: str = "text", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the ``k`` documents of highest score above 0,
    equal scores by ascending doc_id.

    Two passes a block of queries: over the texts, and over the much smaller table of counts.
    Only each task's best are shuffled.
    """
    spark = docs.sparkSession
    out = None
    for block in blocks(items, block_bytes, item_text):
        number = {t: i for i, t in enumerate(dict.fromkeys(t for _, found in block for t in found))}
        index = materialize(postings(docs, number, text), "postings")
        n_docs, n_terms = index.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = document_counts(index, len(number)).tolist()
        queries = []
        for item_id, found in block:
            times = Counter(number[t] for t in found if df[number[t]])
            term = np.array(sorted(times), dtype=np.int64)
            weight = [times[t] * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in term.tolist()]
            queries.append((item_id, term, np.array(weight, dtype=np.int64)))
        found = best_of_tasks(index, queries, n_docs, max(n_terms, 1), k)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ranked = found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        ranked = materialize(ranked, "found")
        out = ranked if out is None else out.unionByName(ranked)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
