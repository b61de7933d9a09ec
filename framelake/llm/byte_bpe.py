"""Byte-level BPE: ids of whole texts by a rank file, and texts of ids, without a regex.

Every code point has a class; what the usual pattern asks of the following one or two (a blank
before a word, ``'s``) is part of the class.  A class is a function from state to state of a
small automaton that says where a piece starts.  Functions compose, and the compositions are
few, so they are numbered once and a scan over their numbers, row by row of a table and then
over the rows' totals, gives the state before every code point of many texts at a time.
The slices between starts are looked up in a cache of merged pieces; new ones are merged by rank.

Rows: doc_id, ids, offsets.  An offset is the byte at which an id's piece starts, so ids
are decoded by putting each piece at its place, and any run of ids by itself.

Defined cases: a null or empty text has no ids and decodes to nothing; repeated rows are encoded
alike; a text of any length is taken whole, in parts that end where a piece starts; an empty
table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_GROUP = 1 << 20  # bytes of text scanned at once
_CACHE_BYTES = 5 << 20  # of pieces; some 40 times as much in memory
_BATCH_IDS = 1 << 19
_ROWS_AT_ONCE = 500
_ROWS = "doc_id long, ids array<int>, offsets array<int>"

# Classes of code points.  A mark is an apostrophe before s, t, m, d or before re, ve, ll;
# white space differs by what follows it.
LETTER, NUMBER, OTHER, MARK2, MARK3, SPACES, BLANK, LAST_SPACE, BREAK, SAME = range(10)
# States: nothing open; within letters, numbers, other signs, white space; behind a blank that
# belongs to what follows; within a mark with one letter or two to come.
_OPEN, _LETTERS, _NUMBERS, _OTHERS, _SPACE, _GLUED, _ONE, _TWO = range(8)


def _step(state: int, kind: int) -> tuple[int, bool]:
    """(next state, whether a piece starts here)."""
    if kind == SAME:
        return state, False
    if kind == LETTER and state in (_ONE, _TWO):
        return (_OPEN if state == _ONE else _ONE), False
    inside = {LETTER: _LETTERS, NUMBER: _NUMBERS, OTHER: _OTHERS, MARK2: _OTHERS, MARK3: _OTHERS, SPACES: _SPACE}.get(kind)
    if inside is not None and (state == inside or (state == _GLUED and kind != SPACES)):
        return inside, False
    return {MARK2: _ONE, MARK3: _TWO, BLANK: _GLUED, LAST_SPACE: _OPEN, BREAK: _OPEN}.get(kind, inside), True


@lru_cache(1)
def _automaton():
    """(number of each class's function, composition table, functions as rows of next states,
    starts by state and class)."""
    classes = [tuple(_step(s, k)[0] for s in range(8)) for k in range(10)]
    known = list(dict.fromkeys([tuple(range(8)), *classes]))
    number = {f: i for i, f in enumerate(known)}
    for f in known:  # grows while it is walked
        for g in classes:
            h = tuple(g[s] for s in f)
            if h not in number:
                number[h] = len(known)
                known.append(h)
    table = np.array([[number[tuple(g[s] for s in f)] for g in known] for f in known], dtype=np.uint16)
    starts = np.array([[_step(s, k)[1] for k in range(10)] for s in range(8)])
    return np.array([number[f] for f in classes], dtype=np.uint16), table, np.array(known, dtype=np.uint8), starts


def _scan(functions: np.ndarray, width: int = 128) -> np.ndarray:
    """Number of the composition of all functions up to each place, itself included."""
    _, table, _, _ = _automaton()
    n, size = len(functions), len(table)
    if n <= width:
        out, f = np.empty(n, dtype=np.uint16), 0
        for i, g in enumerate(functions.tolist()):
            f = out[i] = table[f, g]
        return out
    rows = -(-n // width)
    padded = np.zeros(rows * width, dtype=np.uint16)  # 0: the function that changes nothing
    padded[:n] = functions
    columns, flat = np.ascontiguousarray(padded.reshape(rows, width).T), table.ravel()
    for j in range(1, width):
        columns[j] = flat[columns[j - 1].astype(np.int32) * size + columns[j]]
    before = np.concatenate([np.zeros(1, dtype=np.uint16), _scan(columns[-1], width)[:-1]])
    return flat[before.astype(np.int32)[None, :] * size + columns].T.ravel()[:n]


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point, as the tokenizer library's own Unicode tables have it: what
    its patterns leave of a text of all code points."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACES)):
        lib = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = lib.decode_bytes(lib.encode_ordinary(every)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), dtype=np.uint32)] = kind
    return out


def _code_points(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the UTF-8 sequences that start at ``at``; ``raw`` has three bytes more."""
    out = raw[at].astype(np.int64)
    wide = np.flatnonzero(out >= 0x80)
    b = [raw[at[wide] + k].astype(np.int64) & 0x3F for k in range(1, 4)]
    lead = out[wide]
    two, three, four = (lead & 0x1F) << 6 | b[0], (lead & 0x0F) << 12 | b[0] << 6 | b[1], (lead & 0x07) << 18 | b[0] << 12 | b[1] << 6 | b[2]
    out[wide] = np.minimum(np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four)), 0x10FFFF)
    return out


def piece_starts(raw: bytes, begins: np.ndarray) -> np.ndarray:
    """Bytes at which pieces start in texts joined by one byte each, which is a piece of its own:
    ``begins`` are the texts' first bytes."""
    numbers, _, functions, starts = _automaton()
    data = np.frombuffer(raw + b"\0\0\0", dtype=np.uint8)
    lead = (data[:-3] & 0xC0) != 0x80
    lead[begins[begins < len(raw)]] = True
    breaks = begins[1:] - 1
    lead[breaks] = True
    at = np.flatnonzero(lead)
    if not len(at):
        return at
    cp = _code_points(data, at)
    kind = _classes()[cp]
    between = np.searchsorted(at, breaks)
    kind[between] = BREAK
    cp[between] = -1
    cp = np.concatenate([cp, [-1, -1]])
    white = np.flatnonzero(kind == SPACES)
    ends = np.append(kind, BREAK)[white + 1]
    kind[white] = np.where((ends == SPACES) | (ends == BREAK), SPACES, np.where(cp[white] == 0x20, BLANK, LAST_SPACE))
    marks = np.flatnonzero(cp[:-2] == 0x27)
    one, two = cp[marks + 1], cp[marks + 1] << 8 | (cp[marks + 2] & 0xFF)
    two[(one < 0) | (cp[marks + 2] < 0) | (cp[marks + 2] > 0x7F) | (one > 0x7F)] = 0
    kind[marks[np.isin(one, [ord(c) for c in "stmd"])]] = MARK2
    kind[marks[np.isin(two, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])]] = MARK3
    after = functions[_scan(numbers[kind]), _OPEN]
    return at[starts[np.concatenate([[_OPEN], after[:-1]]), kind]]


class Merges(dict):
    """Bytes of the ids of each piece; a piece that is met first is merged: of its neighbours the
    pair of least rank is joined, the leftmost of equal ones, until no pair has a rank."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.held = ranks, 0
        self.single = [ranks[bytes([i])] for i in range(256)]

    @cached_property
    def pairs(self) -> dict[int, int]:
        """A pair's rank is the id of what it makes."""
        r = self.ranks
        return {r[w[:i]] << 32 | r[w[i:]]: k for w, k in r.items() for i in range(1, len(w)) if w[:i] in r and w[i:] in r}

    def __missing__(self, piece: bytes) -> bytes:
        self.held += len(piece)
        self[piece] = out = np.array(self.merge(piece), dtype="<i4").tobytes()
        return out

    def merge(self, piece: bytes, long: int = 64) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        ids, pair = [self.single[c] for c in piece], self.pairs.get
        if len(piece) > long:
            return self._merge_long(ids)
        none = 1 << 32
        rank = [pair(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while rank and (least := min(rank)) < none:
            i = rank.index(least)
            ids[i] = least
            del ids[i + 1], rank[i]
            if i:
                rank[i - 1] = pair(ids[i - 1] << 32 | least, none)
            if i < len(rank):
                rank[i] = pair(least << 32 | ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same through a heap, in n log n steps."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (r := self.pairs.get(ids[i] << 32 | ids[after[i]])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[after[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two has been joined since
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return [x for x in ids if x >= 0]


class Vocabulary:
    """A rank file, its cache of merged pieces, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        most = max(self.ranks.values()) + 1
        self.sizes = np.zeros(most, dtype=np.int64)
        pieces = [b""] * most
        for piece, i in self.ranks.items():
            self.sizes[i], pieces[i] = len(piece), piece
        self.at = np.cumsum(self.sizes) - self.sizes
        self.pieces = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.merges = Merges(self.ranks)

    def encode(self, texts: list[bytes], most: int = _GROUP) -> Iterator[np.ndarray]:
        """Ids of each text.  Texts are scanned together up to ``most`` bytes; a longer one is
        scanned in parts."""
        group, size = [], 0
        for t in texts:
            if group and size + len(t) > most:
                yield from self._group(group)
                group, size = [], 0
            if len(t) > most:
                yield np.concatenate([ids for part in _parts(t, most) for ids in self._group([part])])
            else:
                group.append(t)
                size += len(t) + 1
        yield from self._group(group)

    def _group(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if not texts:
            return
        raw = b"\n".join(texts)
        begins = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
        starts = piece_starts(raw, begins)
        bounds = np.searchsorted(starts, np.append(begins, len(raw) + 1)).tolist()
        ends = [*starts[1:].tolist(), len(raw)]
        pieces = [raw[a:b] for a, b in zip(starts.tolist(), ends)]
        if self.merges.held > _CACHE_BYTES:
            self.merges.clear()
            self.merges.held = 0
        coded = list(map(self.merges.__getitem__, pieces))
        for k in range(len(texts)):
            # The byte between two texts is the last piece before the next text's first.
            last = bounds[k + 1] - (k + 1 < len(texts))
            yield np.frombuffer(b"".join(coded[bounds[k] : last]), dtype="<i4")

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        return np.cumsum(sizes) - sizes

    def decode(self, ids: np.ndarray, offsets: np.ndarray, most: int = 1 << 19) -> bytes:
        """The bytes of a run of ids: each id's piece at its offset, counted from the first's."""
        out = []
        for i in range(0, len(ids), most):
            part, at = ids[i : i + most], offsets[i : i + most].astype(np.int64)
            sizes = self.sizes[part]
            text = np.empty(int(sizes.sum()), dtype=np.uint8)
            within = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            text[np.repeat(at - at[0], sizes) + within] = self.pieces[np.repeat(self.at[part], sizes) + within]
            out.append(text.tobytes())
        return b"".join(out)


def _parts(text: bytes, most: int) -> Iterator[bytes]:
    """Parts of a long text that end where a piece starts, not behind white space, whose pieces
    depend on what follows: the last such start that the text behind the part cannot change."""

    def behind_space(i: int) -> bool:
        before = text[max(at, at + i - 4) : at + i].decode(errors="ignore")[-1:]
        return not before or _classes()[ord(before)] == SPACES

    at = 0
    while at < len(text):
        size = most
        while at + size < len(text):
            starts = piece_starts(text[at : at + size], np.zeros(1, dtype=np.int64))
            sure = starts[(starts > 0) & (starts < size - 16)].tolist()  # 16: more than two code points
            if cut := next((i for i in reversed(sure) if not behind_space(i)), 0):
                size = cut
                break
            size *= 2
        yield text[at : at + size]
        at += size


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    """One a worker process and file, its cache kept between tasks."""
    return Vocabulary(path)


def _bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    values = np.concatenate([*rows, np.zeros(0, dtype=np.int32)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(doc_id, ids, offsets) of every whole text by the rank file at ``path``, as its library
    gives them without special tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for b in batches:
            for at in range(0, b.num_rows, _ROWS_AT_ONCE):
                part, first, size = b.slice(at, _ROWS_AT_ONCE), 0, 0
                held: list[np.ndarray] = []
                for k, ids in enumerate(words.encode(_bytes(part.column(1)))):
                    held.append(ids)
                    size += len(ids)
                    if size >= _BATCH_IDS or k + 1 == part.num_rows:
                        yield pa.RecordBatch.from_arrays([part.column(0).slice(first, len(held)), _lists(held), _lists([words.offsets(i) for i in held])], names=["doc_id", "ids", "offsets"])
                        first, size, held = k + 1, 0, []

    return docs.select(F.col("doc_id").cast("bigint"), F.col(text)).mapInArrow(run, _ROWS)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encode`` with ``decoded``, the bytes of their ids.  Offsets may start
    anywhere, so the ids and offsets may be a slice of a document's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for b in batches:
            for at in range(0, b.num_rows, _ROWS_AT_ONCE):
                part = b.slice(at, _ROWS_AT_ONCE)
                out = [words.decode(i.values.to_numpy(), o.values.to_numpy()) if i.is_valid and len(i) else b"" for i, o in zip(part.column("ids"), part.column("offsets"))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=["doc_id", "ids", "offsets", "decoded"])

    return encoded.select("doc_id", "ids", "offsets").mapInArrow(run, _ROWS + ", decoded binary")
