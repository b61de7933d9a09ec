"""Importance resampling towards a target text set, by hashed runs of one to three words.

Each task keeps a trie of the words of the documents at hand.  Its nodes stand for runs of one,
two and three words and hold a count and the CRC-32 of the run's text; a child's CRC follows
from its parent's and its word's, so no run is ever written out.  Counts are added up by bucket
in the task, and only bucket totals leave it.  To score, the trie's nodes get their
buckets' gains, and a document's weight is the sum along the paths of its words.

Defined cases: a null text, or one without a word, has no features and weight 0; a null doc_id
counts as the text 'null' in the draw's hash and comes last among equal scores; repeated rows are
scored alike and drawn one by one; a text of any length is taken whole, in parts that share two words;
with no target text every gain comes from the corpus alone; an empty table gives no rows;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # after A-Z are lower-cased
_NO_WORD = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]")
_PART = 1 << 21  # bytes of text in one trie
_KNOWN_WORDS = 500_000
_SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


@lru_cache(4096)
def _shift(n: int) -> np.ndarray:
    """Four tables of 256: what ``n`` bytes more do to a CRC-32, by each of its bytes."""
    if n == 0:
        return (np.arange(256, dtype=np.uint32) << np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None]).astype(np.uint32)
    if n == 1:
        one = np.array([zlib.crc32(bytes([i])) for i in range(256)], dtype=np.uint32) ^ np.uint32(zlib.crc32(b"\0"))
        x = _shift(0)
        return one[x & 255] ^ (x >> 8)
    half = _shift(n // 2)
    twice = _apply(half[None], np.zeros(1, dtype=np.int64), half)
    return twice if n % 2 == 0 else _apply(_shift(1)[None], np.zeros(1, dtype=np.int64), twice)


def _apply(tables: np.ndarray, which: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = tables[which, 0, crc & 255]
    for k in range(1, 4):
        out = out ^ tables[which, k, (crc >> np.uint32(8 * k)) & 255]
    return out


class Words(dict):
    """Numbers of the words met by a task, with the CRC of each and of a blank and it."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []
        self.size, self.crc, self.joined = (np.zeros(0, dtype=t) for t in (np.int64, np.uint32, np.uint32))

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = out = len(self)
        return out

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self) > _KNOWN_WORDS:
            self.clear()
            self.__init__()
        out = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        self.size = np.append(self.size, [len(w) + 1 for w in self.new]).astype(np.int64)
        self.crc = np.append(self.crc, np.array([zlib.crc32(w) for w in self.new], dtype=np.uint32))
        self.joined = np.append(self.joined, np.array([zlib.crc32(b" " + w) for w in self.new], dtype=np.uint32))
        self.new = []
        return out


class Trie:
    """Nodes by depth: ``crc`` and ``count`` a node, and ``paths``: for each depth the node of
    every run and the place of its last word."""

    def __init__(self, known: Words, words: list[bytes], doc: np.ndarray, new: np.ndarray):
        number = known.numbers(words)
        used, at = np.unique(number, return_inverse=True)
        size, joined = known.size[used], known.joined[used]
        lengths, which = np.unique(size, return_inverse=True)
        tables = np.stack([_shift(int(n)) for n in lengths]) if len(lengths) else np.zeros((0, 4, 256), dtype=np.uint32)
        self.crc, self.count, self.paths = [], [], []
        nodes, ends = at, np.arange(len(words))
        self._add(known.crc[used], nodes, ends, new)
        for depth in (2, 3):
            # A run goes on by the next word, if all its words are of one document.
            fits = ends + 1 < len(words)
            nodes, ends = nodes[fits], ends[fits] + 1
            fits = doc[ends] == doc[ends - depth + 1]
            nodes, ends = nodes[fits], ends[fits]
            keys, nodes = np.unique(nodes * max(1, len(used)) + at[ends], return_inverse=True)
            parent, word = keys // max(1, len(used)), keys % max(1, len(used))
            self._add(_apply(tables, which[word], self.crc[-1][parent]) ^ joined[word], nodes, ends, new)

    def _add(self, crc: np.ndarray, nodes: np.ndarray, ends: np.ndarray, new: np.ndarray) -> None:
        counted = new[ends]
        self.crc.append(crc)
        self.count.append(np.bincount(nodes[counted], minlength=len(crc)))
        self.paths.append((nodes[counted], ends[counted]))

    def totals(self, buckets: int) -> np.ndarray:
        """Counts of runs by bucket."""
        out = np.zeros(buckets, dtype=np.int64)
        for crc, count in zip(self.crc, self.count):
            np.add.at(out, crc % buckets, count)
        return out

    def weigh(self, gains: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> None:
        """Adds the gains on every path to its document's weight."""
        for crc, (nodes, ends) in zip(self.crc, self.paths):
            gain = gains[crc % len(gains)]
            np.add.at(weight, doc[ends], gain[nodes])


def _segments(text: bytes, most: int) -> Iterator[bytes]:
    """Parts of a text that end where no word is cut."""
    at = 0
    while len(text) - at > most:
        cut = _NO_WORD.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _tries(texts: list[bytes], known: Words, most: int = _PART) -> Iterator[tuple[Trie, np.ndarray, np.ndarray]]:
    """(trie, document of each word, whether the word is new) over all texts, about ``most`` bytes
    of text at a time; parts of one text share the two words before the cut, which are not new."""
    words: list[bytes] = []
    doc: list[np.ndarray] = []
    new: list[np.ndarray] = []
    held = 0

    def trie():
        d, n = np.concatenate(doc), np.concatenate(new)
        return Trie(known, words, d, n), d, n

    for k, text in enumerate(texts):
        before: list[bytes] = []
        for part in _segments(text.lower(), most):
            found = _WORD.findall(part)
            words += before + found
            doc.append(np.full(len(before) + len(found), k))
            new.append(np.arange(len(before) + len(found)) >= len(before))
            before = (before + found)[-2:]
            held += len(part)
            if held >= most:
                yield trie()
                words, doc, new, held = [], [], [], 0
    if doc:
        yield trie()


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def bucket_totals(texts: DataFrame, text: str = "text", buckets: int = 10_000) -> DataFrame:
    """(bucket, n): runs of one to three words by CRC-32 bucket.  A task ships ``buckets`` rows
    at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, known = np.zeros(buckets, dtype=np.int64), Words()
        for b in batches:
            for trie, _, _ in _tries(_bytes(b.column(0)), known):
                out += trie.totals(buckets)
        met = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(out[met])], names=["bucket", "n"])

    return texts.select(F.col(text)).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the corpus, from
    two results of ``bucket_totals``: at most ``buckets`` rows each."""

    def filled(df: DataFrame) -> list[int]:
        out = [0] * buckets
        for r in df.collect():
            out[r["bucket"]] = r["n"]
        return out

    s, t = filled(corpus), filled(target)
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t)], dtype=np.int64)


def draw_noise(doc_id: int | None, seed: int = 42) -> int:
    """floor(1000 Gumbel) of a document, by the hash of its id."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = 42, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            weight, n = np.zeros(b.num_rows, dtype=np.int64), np.zeros(b.num_rows, dtype=np.int64)
            for trie, doc, new in _tries(_bytes(b.column(1)), known):
                trie.weigh(gain, doc, weight)
                n += np.bincount(doc[new], minlength=b.num_rows)
            noise = np.array([draw_noise(i, seed) for i in b.column(0).to_pylist()], dtype=np.int64)
            features = n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (n, features, weight, weight + noise))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col(text)).mapInArrow(run, _SCORED)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, buckets: int = 10_000, seed: int = 42, text: str = "text", target_text: str = "text") -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank; the ``percent`` highest scores
    of those with ``min_words`` words are drawn and ranked, the rest have no rank.

    Two passes over the texts, which are never shuffled.  Ranks come from a sort by range of rows
    of five numbers; each partition's size, a row a partition, tells where its ranks start.
    """
    gain = gains(bucket_totals(docs, text, buckets), bucket_totals(target, target_text, buckets), buckets)
    rows = materialize(scored(docs, gain, seed, text), "scored")
    eligible = F.col("n_words") >= min_words
    n = rows.where(eligible).count()
    # The place of a row in its file tells repeated rows apart, so that they spread over ranges too.
    place = rows.select("*", eligible.alias("e"), F.xxhash64("_metadata.file_path", F.col("_metadata.row_index")).alias("u"))
    order = [F.desc("e"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("u")]
    sorted_ = materialize(place.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one row a partition
    starts, before = [], 0
    for p, size in sizes:
        starts.append((p, before))
        before += size
    held = sorted_.sparkSession.createDataFrame(starts, "part long, before long")
    ranked = sorted_.withColumn("part", part).join(F.broadcast(held), "part").withColumn("r", F.col("before") + within + 1)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("e") & (F.col("r") <= percent * n // 100), F.col("r")).alias("rank"))
