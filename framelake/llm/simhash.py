"""SimHash near-dedup over a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits share at least 5 of their 8
positional bytes, so at least ``depth`` of the first ``depth + 3``.  The index has one list
for every choice of ``depth`` of those positions and the bytes there.  In each list the
shared positional bytes of every pair are tallied, pairs whose tally reaches the guaranteed
minimum are retained, and only they are verified by their differing bits.  Each task streams
lists in key order and emits a forest, so edges stay linear in a list's size.  A list of more
than ``block`` fingerprints is not compared in one place: its members go to another round
under four narrower keys, an exact split, since three differing bits leave at least one of
four bit groups equal.

``similar_components`` serves another contract: it joins all texts that share ``least`` of their
distinct five-word shingles, and loses no pair.  Sets of n shingles that do so share one at least of
the first n - ceil(least * n) + 1 in any order that is one for all sets, so each set is listed
under those of its shingles, rare ones first; the order decides how long lists get, never
which pairs meet.  Members also carry the parities of their shingles' numbers in 256 buckets: as
many buckets as these differ in, so many shingles at least are in one set alone, which rules pairs
out without a doubt.  A forest of the others, the least differing first, is counted exactly and
gives first components.  Then every pair of a list that is in two components and not ruled out
is counted from the sets themselves, in cells of ``block`` by ``block`` members; only links
between components leave a cell.  A list of over ``block`` members, mostly one group of near
copies, begins with a few leaders instead of a forest.

Defined cases: a text without words has fingerprint 0, linked like any other; repeated rows
share a fingerprint; a null doc_id gets its group's component, and never names one; columns
of any name pass through ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, parallelism
from .graph import components

_ALL = (1 << 64) - 1
_FAR = np.uint16(65_535)
_LONG = ["f0", "f1", "f2", "f3"]  # the words of a set's parities
_BYTES = 8 * len(_LONG)
_SETS = ", ".join(f"{x} long" for x in ["n", *_LONG])
#: Shingles that the order puts last, 4 bytes of each: the most frequent ones.
_FREQUENT = 1 << 20
_HELD = 1 << 22  # hashes that a task holds before it deals them out
_SMALL_KEYS = 200_000
_SMALL_IDS = 200_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _shingles(text: bytes, k: int, seed: int) -> np.ndarray:
    w = text.lower().split()  # of bytes: A-Z alone, ASCII white space alone
    if not w:
        return np.empty(0, dtype=np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(k)))) if len(w) >= k else [b" ".join(w)]
    return np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), dtype=np.uint64)


def _majority(h: np.ndarray) -> np.ndarray:
    """Of rows of uint64 words, at least one, the bits that are set in over half."""
    raw = np.ascontiguousarray(h.astype(">u8")).view(np.uint8).reshape(len(h), -1)
    ones = np.zeros(8 * raw.shape[1], dtype=np.int64)
    for at in range(0, len(h), 255):  # so many bits fit a byte
        ones += np.unpackbits(raw[at : at + 255], axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h)).view(">i8").astype(np.int64)


def _bits(h: np.ndarray) -> int:
    return int(_majority(h.reshape(-1, 1))[0]) if len(h) else 0


def fingerprints(docs: DataFrame, k: int = 3, seed: int = 42, text: str = "text") -> DataFrame:
    """(doc_id, fp): bit i is set where it is in over half the k-word shingles' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((_bits(_shingles(x.as_py(), k, seed)) for x in b.column(1)), dtype=np.int64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("x")).mapInArrow(run, "doc_id long, fp long")


def _postings(fps: DataFrame, masks: Column) -> DataFrame:
    return fps.select("fp", F.explode(masks).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def _byte_masks(depth: int, bits: int) -> list[int]:
    """Masks of the lists: of the first ``depth + bits`` positions, every ``depth``."""
    return [_signed(sum(255 << 8 * p for p in c)) for c in combinations(range(min(8, depth + bits)), depth)]


def _narrower(mask: int, parts: int) -> list[int]:
    """Masks that each also fix one part of the bits that ``mask`` leaves open: of one part
    more than bits may differ, one at least is equal."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [_signed((mask & _ALL) | sum(1 << i for i in free[q::parts])) for q in range(parts)]


def tally(x: np.ndarray) -> np.ndarray:
    """Shared positional bytes, of the last axis' XORed words: its zero bytes."""
    y = x | x >> np.uint64(4)
    y |= y >> np.uint64(2)
    y |= y >> np.uint64(1)
    differ = np.bitwise_count(y & np.uint64(0x0101010101010101)).sum(axis=-1, dtype=np.uint8)
    return np.uint8(8 * x.shape[-1]) - differ


def retained(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, XORed words) of the pairs i < j whose tally reaches ``least``."""
    found = []
    step = max(1, 262_144 // max(1, len(words)))
    for at in range(0, len(words), step):
        x = words[at : at + step, None, :] ^ words[None, at:, :]
        i, j = np.nonzero(tally(x) >= least)
        up = i < j
        found.append((i[up] + at, j[up] + at, x[i[up], j[up]]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _tree(words: np.ndarray, least: int, bits: int) -> list[tuple[int, int]]:
    """Edges of a forest over the verified pairs, the least differing bits first; it joins
    the members that such pairs connect."""
    i, j, x = retained(words, least)
    apart = np.bitwise_count(x).sum(axis=-1, dtype=np.uint16)
    near = apart <= bits
    return _spanning(len(words), i[near], j[near], apart[near])


def _spanning(n: int, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a forest over the pairs, the least apart first."""
    edges = []
    if not len(i):
        return edges
    far = np.full((n, n), _FAR, dtype=np.uint16)
    far[i, j] = far[j, i] = apart
    left = np.zeros(n, dtype=bool)
    left[i] = left[j] = True
    best, source = np.full(n, _FAR, dtype=np.uint16), np.zeros(n, dtype=np.int64)
    for _ in range(int(left.sum())):
        v = int(np.where(left, best, _FAR).argmin())
        if not left[v] or best[v] == _FAR:
            v = int(left.argmax())  # the next part of the forest
        else:
            edges.append((int(source[v]), v))
        left[v] = False
        closer = left & (far[v] < best)
        best[closer], source[closer] = far[v][closer], v
    return edges


def _crowded(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int, bits: int) -> np.ndarray:
    """Which lists of two or more hold a pair that the tally retains and the bits verify;
    many small lists are compared at once, and large ones are taken to hold one."""
    sizes = ends - starts
    out = sizes > 32
    for n in np.unique(sizes[(sizes > 1) & ~out]):
        at = np.flatnonzero(sizes == n)
        for part in np.array_split(at, len(at) * n * n * words.shape[1] // 2_000_000 + 1):
            m = words[starts[part][:, None] + np.arange(n)]
            x = m[:, :, None, :] ^ m[:, None, :, :]
            a, i, j = np.nonzero(tally(x) >= least)
            up = i < j
            a, i, j = a[up], i[up], j[up]
            near = np.bitwise_count(x[a, i, j]).sum(axis=-1, dtype=np.uint16) <= bits
            out[part[np.unique(a[near])]] = True
    return out


def _linker(least: int, bits: int, block: int):
    schema = ["a", "b", "mask"]  # mask not null: a goes on under narrower keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, mask) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(mask, pa.int64())], names=schema)

        def linked(rows: np.ndarray) -> list[tuple[int, int]]:
            return [(rows[i, 2], rows[j, 2]) for i, j in _tree(np.ascontiguousarray(rows[:, 2:]).view(np.uint64), least, bits)]

        held, key, over = None, None, False
        for b in batches:
            new = np.column_stack([c.to_numpy() for c in b.columns])
            if not len(new):
                continue
            a = new if held is None else np.concatenate([held, new])
            if over and tuple(a[0, :2]) != key:
                over = False
            starts = np.flatnonzero(np.r_[True, np.any(a[1:, :2] != a[:-1, :2], axis=1)])
            ends = np.r_[starts[1:], len(a)]
            pairs: list[tuple[int, int]] = []
            taken = _crowded(np.ascontiguousarray(a[:, 2:]).view(np.uint64), starts[:-1], ends[:-1], least, bits)
            taken[:1] |= over
            for s, e in zip(starts[:-1][taken].tolist(), ends[:-1][taken].tolist()):
                if over and s == 0:
                    yield out(a[s:e, 2], [None] * (e - s), a[s:e, 0])
                    over = False
                elif e - s > block:
                    yield out(a[s:e, 2], [None] * (e - s), a[s:e, 0])
                elif e - s > 1:
                    pairs += linked(a[s:e])
            if pairs:
                yield out([p[0] for p in pairs], [p[1] for p in pairs], [None] * len(pairs))
            held, key = a[starts[-1] :], tuple(a[-1, :2])
            if len(starts) > 1:
                over = False
            if over or len(held) > block:
                yield out(held[:, 2], [None] * len(held), held[:, 0])
                held, over = held[:0], True
        if held is not None and len(held) > 1:
            pairs = linked(held)
            if pairs:
                yield out([p[0] for p in pairs], [p[1] for p in pairs], [None] * len(pairs))

    return run


def near_links(fps: DataFrame, bits: int = 3, block: int = 2048, depth: int = 2) -> DataFrame:
    """(a, b) links among the distinct ``fp`` that connect exactly those within ``bits``."""
    if block < 1 << bits:
        raise ValueError("block is 2 to the bits at least: that many open bits make such a list")
    least = 8 - bits  # shared bytes that such pairs have
    fps = fps.select("fp")
    n = parallelism(fps.sparkSession)
    postings = _postings(fps, F.array(*[F.lit(m) for m in _byte_masks(min(depth, least), bits)]))
    links = None
    while True:
        dealt = postings.repartition(n, "mask", "key").sortWithinPartitions("mask", "key", "fp")
        found = materialize(dealt.mapInArrow(_linker(least, bits, block), "a long, b long, mask long"), "links")
        own = found.where("mask IS NULL").select("a", "b")
        links = own if links is None else links.unionByName(own)
        rest = found.where("mask IS NOT NULL")
        masks = [r["mask"] for r in rest.select("mask").distinct().collect()]  # 10 * 4 ** round at most
        if not masks:
            return links.distinct()
        cases = F.create_map(*[x for m in masks for x in (F.lit(m), F.array(*[F.lit(v) for v in _narrower(m, bits + 1)]))])
        postings = _postings(rest.select(F.col("a").alias("fp"), cases[F.col("mask")].alias("masks")), F.col("masks")).distinct()


def near_components(docs: DataFrame, bits: int = 3, k: int = 3, seed: int = 42, text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row: the least doc_id reachable over links of
    at most ``bits`` differing bits."""
    fps = materialize(fingerprints(docs, k, seed, text), "fingerprints")
    groups = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    named = _named(groups, components(near_links(groups, bits)), "fp")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def _named(groups: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """(key, component_id): the least ``least`` of each component of groups."""
    rooted = groups.join(roots, F.col(key) == F.col("node"), "left").select(key, "least", F.coalesce("root", key).alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialize(rooted.join(names, "root").select(key, "component_id"), "named")


class _Shingler:
    """Distinct shingle hashes of texts, from word hashes that are kept between texts."""

    def __init__(self, k: int, most: int = 1 << 20):
        self.k, self.most, self.known = k, most, {}

    def __call__(self, text: bytes) -> np.ndarray:
        w, known = text.lower().split(), self.known
        if len(known) > self.most:
            known.clear()
        for x in {*w}.difference(known):
            known[x] = xxhash.xxh64_intdigest(x)
        h = np.fromiter(map(known.__getitem__, w), dtype=np.uint64, count=len(w))
        if len(h) < self.k:
            return np.array([xxhash.xxh64_intdigest(b" ".join(w), 1)] if w else [], dtype=np.uint64)
        n = len(h) - self.k + 1
        g = h[:n].copy()
        for i in range(1, self.k):
            g = (g * np.uint64(0x9E3779B97F4A7C15) ^ g >> np.uint64(31)) + h[i : i + n]
        g = (g ^ g >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(g ^ g >> np.uint64(27))


def _parities(distinct: np.ndarray) -> np.ndarray:
    """Whether each of 256 buckets has an odd number of a set's hashes.  Two sets' words differ in no
    more bits than hashes are in one of the sets alone."""
    odd = np.bincount((distinct & np.uint64(8 * _BYTES - 1)).astype(np.int64), minlength=8 * _BYTES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_sets(docs: DataFrame, k: int = 5, text: str = "text") -> DataFrame:
    """(d, th, sid, n, f0 to f3): sid names the set of distinct k-word shingles, n is its size, th
    names the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = _Shingler(k)
        for b in batches:
            out = np.empty((b.num_rows, 2 + len(_LONG)), dtype=np.int64)
            for i, x in enumerate(b.column(2)):
                s = shingles(x.as_py())
                out[i, :2] = _sid(s), len(s)
                out[i, 2:] = _parities(s)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, out.T.copy())], names=["d", "th", "sid", "n", *_LONG])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("d"), F.xxhash64(text).alias("th"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("x"))
    return rows.mapInArrow(run, f"d long, th long, sid long, {_SETS}")


def _sid(distinct: np.ndarray) -> int:
    return _signed(xxhash.xxh3_64_intdigest(distinct.tobytes()))


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.where(F.col(text).isNotNull()).select(F.col(text).cast("binary").alias("x"))


def _held(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sets of the texts of a task, many at a time and each once: their hashes one after the
    other, the number of each set's and its sid."""
    shingles, given, sets, sids, size = _Shingler(k), set(), [], [], 0

    def held() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.concatenate(sets), np.array([len(s) for s in sets], dtype=np.int64), np.array(sids, dtype=np.int64)

    for b in batches:
        for x in b.column(0):
            s = shingles(x.as_py())
            sid = _sid(s)
            if len(s) and sid not in given:
                given.add(sid)
                sets.append(s)
                sids.append(sid)
                size += len(s)
                if size > _HELD:
                    yield held()
                    sets, sids, size = [], [], 0
    if size:
        yield held()


def _part(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


def _dealt(columns: list[np.ndarray], by: np.ndarray, parts: int) -> pa.RecordBatch:
    """A row for each part: the values of each column whose ``by`` falls to it, as bytes."""
    place = by % parts
    order = np.argsort(place, kind="stable")
    at = np.searchsorted(place[order], np.arange(parts + 1))
    rows = [[c[order][i:j].tobytes() for i, j in zip(at[:-1], at[1:])] for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(parts), pa.int64()), *[pa.array(r, pa.binary()) for r in rows]], names=["part", *[f"c{i}" for i in range(len(columns))]])


def _frequent(docs: DataFrame, k: int, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 4-byte parts of frequent hashes, ``_FREQUENT`` at most, and the logarithm of how
    many sets have each.  They decide the order of shingles alone."""
    parts = parallelism(docs.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, _, _ in _held(batches, k):
            mine = _part(hashes)
            yield _dealt([mine], mine, parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(v, dtype=np.uint32) for b in batches for v in b.column(0).to_pylist()]
        if held:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            found, n = found[n >= 8], n[n >= 8]
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(np.log2(n).astype(np.int64))], names=["part", "level"])

    dealt = _texts(docs, text).mapInArrow(deal, "part long, c0 binary").repartition(parts, "part")
    found = materialize(dealt.select("c0").mapInArrow(count, "part long, level long"), "frequent")
    total, lowest = 0, 64
    for level, n in sorted(found.groupBy("level").count().collect(), reverse=True):  # 60 rows at most
        total += n
        if total > _FREQUENT:
            break
        lowest = level
    rows = found.where(F.col("level") >= lowest).toArrow()
    part, level = rows["part"].to_numpy().astype(np.uint32), rows["level"].to_numpy().astype(np.uint8)
    order = np.argsort(part)
    return part[order], level[order]


def _prefix(hashes: np.ndarray, sizes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """Where in ``hashes`` the shingles stand that sets are listed under: of sets of n, one of the first
    n - ceil(least * n) + 1 is in every set that shares ``least`` with it."""
    parts, levels = frequent
    level = np.zeros(len(hashes), dtype=np.int64)
    if len(parts):
        mine = _part(hashes)
        at = np.minimum(np.searchsorted(parts, mine), len(parts) - 1)
        level = np.where(parts[at] == mine, levels[at], 0).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(owner << 8 | level, kind="stable")  # hashes are in order within a set
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = sizes - np.ceil(least * sizes - 1e-6).astype(np.int64) + 1
    return order[place < np.repeat(first, sizes)]


def _lists(docs: DataFrame, k: int, least: float, text: str) -> DataFrame:
    """(key, sid): the lists of two sets or more, under the shingles of ``_prefix``."""
    spark, parts = docs.sparkSession, parallelism(docs.sparkSession)
    frequent = spark.sparkContext.broadcast(_frequent(docs, k, text))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, sizes, sids in _held(batches, k):
            at = _prefix(hashes, sizes, frequent.value, least)
            keys = hashes[at]
            yield _dealt([keys, np.repeat(sids, sizes)[at]], keys, parts)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[np.frombuffer(v, dtype=np.int64) for v in c.to_pylist()] for b in batches for c in b.columns]
        if held:
            keys, sids = (np.concatenate([x for part in held[i::2] for x in part]) for i in (0, 1))
            order = np.lexsort((sids, keys))
            keys, sids = keys[order], sids[order]
            new = np.r_[True, (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1])][: len(keys)]
            keys, sids = keys[new], sids[new]  # tasks may give the same set
            same = keys[1:] == keys[:-1]
            shared = np.r_[False, same][: len(keys)] | np.r_[same, False][: len(keys)]
            keys, sids = keys[shared], sids[shared]
            for at in range(0, len(keys), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 65_536]), pa.array(sids[at : at + 65_536])], names=["key", "sid"])

    dealt = _texts(docs, text).mapInArrow(deal, "part long, c0 binary, c1 binary").repartition(parts, "part")
    return materialize(dealt.select("c0", "c1").mapInArrow(group, "key long, sid long"), "lists")


def _possible(words: np.ndarray, n: np.ndarray, least: float, comp: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, differing bits) of the pairs i < j, of different ``comp``, that sizes and parities do not rule out."""
    found, step = [], max(1, 262_144 // max(1, len(words)))
    for at in range(0, len(words), step):
        a, b = n[at : at + step, None], n[None, at:]
        apart = np.bitwise_count(words[at : at + step, None, :] ^ words[None, at:, :]).sum(axis=-1, dtype=np.int64)
        ok = (apart <= (1 - least) / (1 + least) * (a + b) + 1e-6) & (np.minimum(a, b) >= least * np.maximum(a, b) - 1e-6)
        if comp is not None:
            ok &= comp[at : at + step, None] != comp[None, at:]
        i, j = np.nonzero(np.triu(ok, 1))
        found.append((i + at, j + at, apart[i, j]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    at = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[at]  # numbers of hashes of two sets or more
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    owner, at, out = owner[order], at[order], np.zeros((len(sets), len(sets)), dtype=np.float32)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, 4_096):
        s, e = np.searchsorted(at, [low, low + 4_096])
        has = np.zeros((len(sets), min(4_096, int(at[-1]) + 1 - low)), dtype=np.float32)
        has[owner[s:e], at[s:e] - low] = 1
        out += has @ has.T
    return out.astype(np.int64)  # float32 counts exactly to 2 ** 24


def _joining(sets: list[np.ndarray], comp: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges of a forest over the components: pairs of different ones that share ``least``."""
    names, comp = np.unique(comp, return_inverse=True)
    n, both = np.array([len(s) for s in sets]), _shared(sets)
    i, j = np.nonzero(np.triu((both >= least * (n[:, None] + n[None, :] - both)) & (comp[:, None] != comp[None, :]), 1))
    pair = np.sort(np.stack([comp[i], comp[j]]), axis=0)
    first = np.unique(pair[0] * len(names) + pair[1], return_index=True)[1]
    return _forest(len(names), [(int(comp[i[k]]), int(comp[j[k]]), (int(i[k]), int(j[k]))) for k in first.tolist()])


def _forest(n: int, pairs: list[tuple]) -> list:
    """What stands beside the pairs (u, v, it), in order, that join parts of ``n`` nodes."""
    root, kept = list(range(n)), []

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for u, v, it in pairs:
        u, v = find(u), find(v)
        if u != v:
            root[u] = v
            kept.append(it)
    return kept


def _bridges(words: np.ndarray, comp: np.ndarray, least: int, bits: int) -> list[tuple[int, int]]:
    """Edges of a forest over the components that verified pairs of different ones connect,
    the least differing bits first.  The largest component is not compared with itself."""
    names, comp = np.unique(comp, return_inverse=True)
    most = np.argmax(np.bincount(comp))
    rest, best = np.flatnonzero(comp != most), {}
    for at in range(0, len(rest), max(1, 262_144 // len(words))):
        mine = rest[at : at + max(1, 262_144 // len(words))]
        x = words[mine][:, None, :] ^ words[None, :, :]
        i, j = np.nonzero((tally(x) >= least) & (comp[mine][:, None] != comp[None, :]))
        apart = np.bitwise_count(x[i, j]).sum(axis=-1, dtype=np.int64)
        i, j, apart = mine[i[apart <= bits]], j[apart <= bits], apart[apart <= bits]
        order = np.argsort(apart, kind="stable")
        pair = np.sort(np.stack([comp[i], comp[j]]), axis=0)
        first = np.unique(pair[0][order] * len(names) + pair[1][order], return_index=True)[1]
        for k in order[first].tolist():
            key, edge = (int(pair[0][k]), int(pair[1][k])), (int(apart[k]), int(i[k]), int(j[k]))
            best[key] = min(best.get(key, edge), edge)
    return _forest(len(names), [(u, v, (i, j)) for (u, v), (_, i, j) in sorted(best.items(), key=lambda e: e[1])])


_SURE = 12  # differing bits of 256 under which most sets share enough


def _followers(words: np.ndarray, rank: np.ndarray, least: int, bits: int) -> list[tuple[int, int]]:
    """For each member the leader that it is held against: of those that are surely near the
    first by rank, the same in most lists, else the nearest."""
    heads = np.flatnonzero(rank >= 0)
    if not len(heads):
        return []
    heads, out = heads[np.argsort(rank[heads], kind="stable")], []
    for at in range(0, len(words), 4_096):
        x = words[at : at + 4_096, None, :] ^ words[None, heads, :]
        apart = np.bitwise_count(x).sum(axis=-1, dtype=np.int64)
        apart[(tally(x) < least) | (apart > bits) | (np.arange(at, at + len(x))[:, None] == heads[None, :])] = _FAR
        sure = apart <= _SURE
        pick = np.where(sure.any(axis=1), sure.argmax(axis=1), apart.argmin(axis=1))
        near = apart[np.arange(len(x)), pick] < _FAR
        out += [(at + int(i), int(heads[pick[i]])) for i in np.flatnonzero(near)]
    return out


def _by_cell(rows: DataFrame, f, schema: str, name: str) -> DataFrame:
    """What ``f`` gives, as columns, for the rows of each list or cell of a list: their numbers after
    key and cell in columns, and their last column, bytes, where it is one."""
    held_names = [x.split()[0] for x in schema.split(", ")]
    last = dict(rows.dtypes)[rows.columns[-1]] == "binary"
    wide = len(rows.columns) - last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(a: np.ndarray, x: list) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, np.any(a[1:, :2] != a[:-1, :2], axis=1)])
            out = [f(a[s:e], x[s:e]) for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(a)]) if e - s > 1]
            table = np.array([row for part in out for row in part], dtype=np.int64).reshape(-1, len(held_names))
            return pa.RecordBatch.from_arrays(list(map(pa.array, table.T.copy())), names=held_names)

        held, tail = np.empty((0, wide), dtype=np.int64), []
        for b in batches:
            a = np.concatenate([held, np.column_stack([c.to_numpy() for c in b.columns[:wide]])])
            x = [*tail, *b.column(wide).to_pylist()] if last else []
            ends = np.flatnonzero(np.any(a[1:, :2] != a[:-1, :2], axis=1))
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if cut:
                yield give(a[:cut], x[:cut])
            held, tail = a[cut:], x[cut:]
        if len(held):
            yield give(held, tail)

    dealt = rows.repartition(parallelism(rows.sparkSession), "key", "cell").sortWithinPartitions("key", "cell", "sid")
    return materialize(dealt.mapInArrow(run, schema), name)


def _compared(rows: DataFrame, least: float, leading: bool = False) -> DataFrame:
    """(a, b) of a forest of what may be links, or of what may link to leaders, of the lists or
    cells of (key, cell, sid, mark, n, f0 to f3); mark is a leader's rank, -1 for others."""

    def edges(a: np.ndarray, _) -> list[tuple[int, int]]:
        words, n = np.ascontiguousarray(a[:, 5:]).view(np.uint64), a[:, 4]
        if leading:
            found = _followers(words, a[:, 3], 0, int((1 - least) / (1 + least) * 2 * n.max()))
        else:
            found = _spanning(len(a), *_possible(words, n, least))
        return [(min(p), max(p)) for p in ((a[i, 2], a[j, 2]) for i, j in found)]

    return _by_cell(rows.select("key", F.col("cell").cast("bigint"), "sid", F.col("mark").cast("bigint"), "n", *_LONG), edges, "a long, b long", "candidates").distinct()


def _open(rows: DataFrame, least: float) -> DataFrame:
    """Of (key, cell, sid, mark, n, f0 to f3) what different components, marks, may have in common.  Few
    pairs of a cell are rows (sid, other); of many, their members are rows without ``other``, under a
    key that cells of the same members share."""

    def found(a: np.ndarray, _) -> list:
        i, j, _ = _possible(np.ascontiguousarray(a[:, 5:]).view(np.uint64), a[:, 4], least, a[:, 3])
        members = np.unique(np.concatenate([i, j]))
        if len(i) <= 4 * len(members):
            return [(0, 1, min(p), max(p)) for p in zip(a[i, 2].tolist(), a[j, 2].tolist())]
        key = _sid(a[members, 2].view(np.uint64))
        return [(key, 0, sid, mark) for sid, mark in a[members, 2:4].tolist()]

    rows = rows.select("key", F.col("cell").cast("bigint"), "sid", F.col("mark").cast("bigint"), "n", *_LONG)
    return _by_cell(rows, found, "key long, pair long, sid long, mark long", "open").distinct()


def _joined(docs: DataFrame, fps: DataFrame, cells: DataFrame, k: int, least: float, text: str) -> DataFrame:
    """(a, b) links that join the components, marks, of (key, sid, mark) wherever two members share
    ``least``: all pairs are counted."""

    def counted(a: np.ndarray, x: list) -> list[tuple[int, int]]:
        shingles = _Shingler(k)
        found = _joining([shingles(v) for v in x], a[:, 3], least)
        return [(min(p), max(p)) for p in ((a[i, 2], a[j, 2]) for i, j in found)]

    held = _of(docs, fps, cells.select("sid").distinct(), text)
    rows = cells.join(held, "sid").select("key", F.lit(0).cast("bigint").alias("cell"), "sid", "mark", "x")
    return _by_cell(rows, counted, "a long, b long", "joined")


_LEADERS = 32  # of a crowded list, about


def _links(docs: DataFrame, fps: DataFrame, groups: DataFrame, k: int, least: float, block: int, text: str) -> DataFrame:
    """(a, b) sids of verified links that connect exactly the sets that share ``least``.

    Each list gives a forest of its most alike members, one of over ``block`` their likeness to about
    32 leaders, the same in all lists; verified links make components, and then all members of
    different components of a list are compared, in cells of ``block`` by ``block``.
    """
    lists = materialize(_lists(docs, k, least, text).join(groups, "sid").select("key", "sid", "n", *_LONG), "postings")
    sizes = lists.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > block)
    crowded = materialize(sizes.select(F.col("key").alias("_key"), "size"), "crowded")
    count = crowded.count()
    all_ = lists.withColumn("mark", F.lit(-1))
    side = lambda df: F.broadcast(df) if count <= _SMALL_KEYS else df
    same = F.col("key") == F.col("_key")
    first = _compared((all_.join(side(crowded), same, "left_anti") if count else all_).withColumn("cell", F.lit(0)), least)
    if count:
        # Leaders, in every cell of their list: those of the least ranks, which lists share.
        cells = F.ceil(F.col("size") / block).cast("int")
        rank = F.pmod(F.xxhash64("sid"), F.lit(1 << 40))
        lead = rank < F.lit(float(_LEADERS << 40)) / F.col("size")
        own = F.pmod(F.xxhash64("sid", F.lit(1)), cells).cast("int")
        hot = all_.join(side(crowded), same).withColumn("mark", F.when(lead, rank).otherwise(-1))
        hot = hot.withColumn("cell", F.explode(F.when(lead, F.sequence(F.lit(0), cells - 1)).otherwise(F.array(own))))
        first = first.unionByName(_compared(hot, least, leading=True)).distinct()
    tried = materialize(first, "tried")
    first = materialize(_verified(docs, fps, tried, k, least, text), "verified")
    # Lists with members of two components or more.
    rest = lists.join(components(first), F.col("sid") == F.col("node"), "left").withColumn("mark", F.coalesce("root", "sid")).drop("node", "root")
    rest = materialize(rest, "marked")
    split = rest.groupBy("key").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low <> high")
    rest = rest.join(split.select("key"), "key", "left_semi")
    small = (rest.join(side(crowded), same, "left_anti") if count else rest).withColumn("cell", F.lit(0))
    small = _open(small, least)
    if not count:
        return first.unionByName(_last(docs, fps, small, tried, k, least, text))
    rest = rest.join(side(crowded.select("_key")), same, "left_semi")
    # Chunks of a list: those of each component of over ``block`` members, then of the others.
    found = rest.groupBy("key", "mark").agg(F.count("*").alias("n"))
    large = F.col("n") > block
    found = found.groupBy("key", F.when(large, F.col("mark")).alias("big")).agg(F.sum("n").alias("n"))
    plan = found.groupBy(F.col("key").alias("_key")).agg(F.array_sort(F.collect_list(F.struct("big", F.ceil(F.col("n") / block).cast("int").alias("chunks")))).alias("bigs"))
    plan = materialize(plan, "chunks")
    of = lambda m: F.filter("bigs", lambda g: g["big"].eqNullSafe(m))
    spread = rest.join(side(plan), same).withColumn("big", F.when(F.size(of(F.col("mark"))) > 0, F.col("mark")))
    place = F.array_position(F.transform("bigs", lambda g: g["big"].eqNullSafe(F.col("big"))), True).cast("int")
    spread = spread.withColumns({"place": place - 1, "all": F.aggregate("bigs", F.lit(0), lambda n, g: n + g["chunks"])})
    spread = spread.withColumns({"start": F.aggregate(F.slice("bigs", 1, F.col("place")), F.lit(0), lambda n, g: n + g["chunks"]), "chunks": F.get("bigs", F.col("place"))["chunks"]})
    spread = spread.withColumn("own", (F.col("start") + F.pmod(F.xxhash64("sid"), F.col("chunks"))).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda x: F.col("big").isNull() | (x < F.col("start")) | (x >= F.col("start") + F.col("chunks")))
    cell = F.transform(others, lambda x: F.least(x, F.col("own")) * F.col("all") + F.greatest(x, F.col("own")))
    open_ = small.unionByName(_open(spread.withColumn("cell", F.explode(cell)), least))
    return first.unionByName(_last(docs, fps, open_, tried, k, least, text))


def _last(docs: DataFrame, fps: DataFrame, open_: DataFrame, tried: DataFrame, k: int, least: float, text: str) -> DataFrame:
    """(a, b) links of what is open: pairs but those that were counted before, and cells."""
    pairs = open_.where("pair = 1").select(F.col("sid").alias("a"), F.col("mark").alias("b")).distinct()
    pairs = _verified(docs, fps, pairs.join(tried, ["a", "b"], "left_anti"), k, least, text)
    cells = materialize(open_.where("pair = 0").select("key", "sid", "mark").distinct(), "cells")
    if cells.isEmpty():
        return pairs
    return pairs.unionByName(_joined(docs, fps, cells, k, least, text))


def _of(docs: DataFrame, fps: DataFrame, ids: DataFrame, text: str) -> DataFrame:
    """(sid, x): a text of each of the sets ``ids``."""
    ids = materialize(ids, "ids")
    one = fps.join(ids, "sid", "left_semi").groupBy("sid").agg(F.min(F.struct("d", "th")).alias("x"))
    one = materialize(one.select("sid", F.col("x.d").alias("_d"), F.col("x.th").alias("_th")), "texts_of")
    small = one.limit(_SMALL_IDS + 1).count() <= _SMALL_IDS
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("d"), F.xxhash64(text).alias("th"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("x"))
    found = keyed.join(F.broadcast(one) if small else one, F.col("d").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_th"))).select("sid", "x")
    return materialize(found.groupBy("sid").agg(F.first("x").alias("x")), "texts")


def _verified(docs: DataFrame, fps: DataFrame, edges: DataFrame, k: int, least: float, text: str) -> DataFrame:
    """The edges whose texts share ``least`` of their distinct shingles, counted exactly."""
    edges = materialize(edges, "edges")
    found = _of(docs, fps, edges.select(F.col("a").alias("sid")).unionByName(edges.select(F.col("b").alias("sid"))).distinct(), text)
    a, b = found.select(F.col("sid").alias("a"), F.col("x").alias("ax")), found.select(F.col("sid").alias("b"), F.col("x").alias("bx"))
    pairs = edges.join(a, "a").join(b, "b").select("a", "b", "ax", "bx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = _Shingler(k)
        for batch in batches:
            keep, known = [], {}
            for x, y, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if len(known) > 500:
                    known.clear()
                for name, raw in ((x, s), (y, t)):
                    if name not in known:
                        known[name] = shingles(raw.as_py())
                u, v = known[x], known[y]
                shared = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(shared >= least * (len(u) + len(v) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def similar_components(docs: DataFrame, k: int = 5, least: float = 0.8, block: int = 1024, text: str = "text") -> DataFrame:
    """(d, th, component_id) for every row: the least doc_id of the texts that links join.  A link:
    ``least`` of the distinct k-word shingles of both are shared, whatever the texts."""
    fps = materialize(shingle_sets(docs, k, text), "fingerprints")
    groups = materialize(fps.groupBy("sid", "n", *_LONG).agg(F.min("d").alias("least")), "groups")
    fps = fps.select("d", "th", "sid")
    links = _links(docs, fps, groups.drop("least"), k, least, block, text)
    named = _named(groups.select("sid", "least"), components(links), "sid")
    return fps.join(named, "sid").select("d", "th", "component_id")


def one_of_each(docs: DataFrame, k: int = 5, least: float = 0.8, text: str = "text") -> DataFrame:
    """``docs`` with one row of each component of ``similar_components``: that of its least
    doc_id.  Rows that repeat that id count once, the one of the least text hash; rows
    without an id whose component has none all stay."""
    found = materialize(similar_components(docs, k, least, text=text), "similar")
    # Hashes of the texts that carry the component's name; one row an id.
    keep = found.where("d = component_id").groupBy("d").agg(F.min("th").alias("th"))
    d, th, row = fresh(docs, "d"), fresh(docs, "th"), fresh(docs, "row")
    keep = keep.select(F.col("d").alias(d), F.col("th").alias(th))
    named = docs.withColumns({d: F.col("doc_id").cast("bigint"), th: F.xxhash64(text)}).join(keep, [d, th], "left_semi")
    first = named.withColumn(row, F.row_number().over(Window.partitionBy(d, th).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))).where(F.col(row) == 1)
    first = first.select(*[F.col(f"`{c}`") for c in docs.columns])
    if found.where("component_id IS NULL").isEmpty():
        return first
    return first.unionByName(docs.where("doc_id IS NULL"))
