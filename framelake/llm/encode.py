"""Token ids of whole texts, through a bounded cache of word pieces.

Two common pre-tokenizers never merge across the pieces that their pattern cuts, so a
dictionary of encoded pieces answers most of a corpus.  A megabyte of text is cut at
once by the classes of its bytes, each distinct piece is looked up once, and new pieces
go to the tokenizer joined into long strings.  The patterns are restated for texts of ASCII
and Latin-1 letters; any other text, and any other tokenizer, is encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

# Classes of the bytes of such texts, which are all that the patterns ask for.
_SPACE, _LETTER, _DIGIT, _MARK = range(4)
_CLASSES = np.full(256, _LETTER, dtype=np.uint8)
_CLASSES[:128] = _MARK
_CLASSES[list(b" \t\n\r\f\v")] = _SPACE
_CLASSES[list(b"0123456789")] = _DIGIT
_CLASSES[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = _LETTER
# First bytes beyond Latin-1 letters (1), and the second bytes of its two signs (2).
_OTHER = np.zeros(256, dtype=np.uint8)
_OTHER[[0xC2, *range(0xC4, 0x100)]] = 1
_OTHER[[0x97, 0xB7]] = 2
_ENDINGS = {1: [b"s", b"t", b"m", b"d"], 2: [b"re", b"ve", b"ll"]}  # that an apostrophe takes along
# The characters that stand for bytes in both vocabularies; a space is none of them.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_STAND_INS = {b: b for b in _SHOWN} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_GROUP = 1_000_000  # bytes of text taken at once
_CHUNK = 200  # pieces joined into one string, so that the tokenizer holds few ids at once


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _kind(spec: dict) -> str | None:
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "bytes"
    first = (pre.get("pretokenizers") or [{}])[0]
    if first.get("pattern", {}).get("Regex", "").startswith("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|") and first.get("invert") and norm and norm["normalizers"][-1]["type"] == "Lowercase":
        return "words"
    return None


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian bytes of ``dtype``."""

    def __init__(self, path: str, cache_pieces: int = 700_000):
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        with open(path, encoding="utf-8") as f:
            self.kind = _kind(json.load(f))
        self.plain = Tokenizer.from_file(path)  # for pieces in stand-ins, with spaces between
        self.plain.normalizer = Sequence([])
        self.plain.pre_tokenizer = CharDelimiterSplit(" ")
        self.lengths = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)  # bytes of each token
        for token, i in self.tokenizer.get_vocab().items():
            self.lengths[i] = len(token.removesuffix("</w>") if self.kind == "words" else token)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[bytes, bytes] = {}
        self.most = cache_pieces

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        group, size = [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size >= _GROUP:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _odd(self, texts: list[bytes]) -> np.ndarray:
        """Which texts are encoded whole: those with other letters, or a special token's string."""
        data, odd = b"".join(texts), np.zeros(len(texts), dtype=bool)
        if not data.isascii():
            found = _OTHER[d := np.frombuffer(data, dtype=np.uint8)]
            at = np.flatnonzero(found)
            at = at[(found[at] == 1) | (d[at - 1] == 0xC3)]
            odd[np.searchsorted(np.cumsum([len(t) for t in texts]), at, side="right")] = True
        for x in self.special:
            if x in data:
                odd |= [x in t for t in texts]
        return odd

    def _group(self, texts: list[bytes]) -> list[bytes]:
        if not self.kind:
            return self.whole([t.decode() for t in texts])
        odd = self._odd(texts)
        plain = [b"" if o else t for o, t in zip(odd, texts)] if odd.any() else texts
        raw, ends = self._plain([t.lower() for t in plain] if self.kind == "words" else plain)
        out = [raw[a:b] for a, b in zip([0, *ends], ends)]
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.whole([texts[i].decode()])[0]
        return out

    def _plain(self, texts: list[bytes]) -> tuple[bytes, list[int]]:
        """The ids of all texts, and where each text's end, in bytes."""
        data = b"".join(texts)
        if not data:
            return b"", [0] * len(texts)
        ends = np.cumsum([len(t) for t in texts])
        cuts = cut(data, ends, self.kind == "words")
        offsets = pa.py_buffer(np.append(cuts, len(data)).astype(np.int32))
        pieces = pa.Array.from_buffers(pa.binary(), len(cuts), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        distinct, codes = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), pieces.indices.to_numpy()
        if len(self.cache) > self.most:  # what this group has stays: frequent pieces are in it
            self.cache = {p: self.cache[p] for p in distinct if p in self.cache}
        found = list(map(self.cache.get, distinct))
        new = [i for i, x in enumerate(found) if x is None]
        self._learn([distinct[i] for i in new])
        for i in new:
            found[i] = self.cache[distinct[i]]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        take = sizes[codes]
        after = np.cumsum(take)
        source = np.repeat((np.cumsum(sizes) - sizes)[codes] - (after - take), take)
        source += np.arange(len(source))
        ids = np.frombuffer(b"".join(found), dtype=self.dtype)[source]
        at = np.append(0, after)[np.searchsorted(cuts, ends)]
        return ids.tobytes(), (at * self.dtype.itemsize).tolist()

    def _learn(self, pieces: list[bytes]) -> None:
        if self.kind == "words":
            self.cache.update((p, b"") for p in pieces if p[:1].isspace())
            pieces = [p for p in pieces if not p[:1].isspace()]
        if not pieces:
            return
        normal = pieces if self.kind == "bytes" else [p if p.isascii() else p.decode().lower().encode() for p in pieces]
        shown = [p.decode("latin-1").translate(_STAND_INS) for p in normal]
        joined = (" ".join(shown[at : at + _CHUNK]) for at in range(0, len(shown), _CHUNK))
        ids = np.concatenate([np.array(e.ids, dtype=self.dtype) for x in joined for e in self.plain.encode_batch_fast([x], add_special_tokens=False)])
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(p) for p in normal])) + 1
        raw, start = ids.tobytes(), 0
        for key, end in zip(pieces, (ends * self.dtype.itemsize).tolist()):
            self.cache[key] = raw[start:end]
            start = end


def cut(data: bytes, ends: np.ndarray, words: bool = False) -> np.ndarray:
    """Where the pieces of joined texts start; ``ends`` are the texts' ends.

    A piece is a run of one class.  White space before something else gives its last
    character up, which is a piece of its own, or, if it is a space, goes to the run behind it.
    For ``words`` it does not, digits stand alone, and runs of white space are left to the
    caller.  An apostrophe that no piece holds yet takes one of the endings along.
    """
    n = len(data)
    d = np.frombuffer(data, dtype=np.uint8)
    kind = _CLASSES[d]
    first = np.zeros(n + 3, dtype=bool)  # where texts start
    first[0], first[ends], first[n:] = True, True, True
    starts = first[:n].copy()
    starts[1:] |= kind[1:] != kind[:-1]
    if words:
        starts |= kind == _DIGIT
    else:
        behind = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~first[1:n]) + 1
        starts[behind] = d[behind - 1] != 0x20
        starts[behind - 1] = True
    marks = np.flatnonzero(d == 0x27)
    for at in marks[starts[marks]].tolist():
        for size, endings in _ENDINGS.items():
            if data[at + 1 : at + 1 + size] in endings and not first[at + 1 : at + 1 + size].any():
                starts[at + 1] = False
                starts[at + 1 + size : at + 2 + size] = True
    return np.flatnonzero(starts)


_OPEN: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary, its cache kept between tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]
