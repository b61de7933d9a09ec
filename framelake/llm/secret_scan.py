"""Secret scans: fixed patterns, and a randomness battery under false-discovery control.

Patterns find assigned, access-key and hexadecimal secrets.  Besides, every long token that is
no plain word gets an inferred encoding (hexadecimal, base32, base36, base64) and, over that
alphabet, a battery of tests: chi-squared uniformity, runs about the middle of the alphabet,
and lag-1 serial correlation.  A token that no test tells from a random one is held against
plain text of its length by two of them: how unevenly plain text uses the alphabet, and how
seldom it changes between letters of one case, digits and marks.  The two p-values are combined
by Fisher's rule and held to a false-discovery rate by Benjamini-Hochberg within each band of
lengths, over all tested tokens of the corpus, from a table of fixed size.  Tokens inside
pattern spans are tested like any other: their spans stay, and the battery tells which of them
it confirms.

Defined cases: a null or empty text has no spans; spans are in code points, end exclusive; an
added span never overlaps a pattern's; repeated rows are scanned alike; a text of any length is
swept once; extra columns do not matter.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
_WORDS = re.compile(r"[^A-Za-z0-9]")

_HEX_DIGITS, _BASE32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE36 = "abcdefghijklmnopqrstuvwxyz0123456789"
_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Chance that two characters of plain text are equal, by size of the alphabet that they
#: fall in; what uniformity is held against.  Plain numbers and a-f words repeat more.
_PROSE_COLLISION = {16: 0.15, 32: 0.0625, 36: 0.0625, 64: 0.0625}
#: Chance that plain text in an alphabet changes between classes (digits, lower and upper
#: letters, marks) from one character to the next: words with numbers, or in camel case.
_PROSE_CHANGE = {16: 0.15, 32: 0.08, 36: 0.12, 64: 0.3}
_BINS = 400  # of -log10 p, tenths; p under 1e-40 would tell from as many tokens as no corpus has
_SCHEMA = "doc_id long, base array<struct<kind:int,start:int,end:int>>, found array<struct<start:int,end:int,band:int,bin:int,own:boolean>>"


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by start, then kind."""
    out = [(0, *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(1, *m.span()) for m in _ACCESS.finditer(text)]
    out += [(2, *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def encoding(token: str) -> str | None:
    """Alphabet that a token is written in; None for plain words and paths of them."""
    low = token.lower()
    if all(c in _HEX_DIGITS for c in low):
        return _HEX_DIGITS if not token.isdigit() and token in (low, token.upper()) else None
    if all(c in _BASE32 for c in token):
        return _BASE32 if not token.isalpha() else None
    parts = [p for p in _WORDS.split(token) if p]
    if all(p.isdigit() or len(p) == 1 or _word(p) for p in parts):
        return None  # words and numbers
    if token.isalnum() and token in (low, token.upper()):
        return _BASE36
    return _BASE64


def _word(part: str) -> bool:
    """Letters alone: lower, upper or capitalized."""
    return part.isalpha() and (part.isupper() or part[1:].islower())


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _log_tail(z: float) -> float:
    """Natural logarithm of the normal upper tail, however far."""
    return math.log(_upper_tail(z)) if z < 30 else -z * z / 2 - math.log(z * math.sqrt(2 * math.pi))


def _log_at_least(k: int, n: int, p: float) -> float:
    """Natural logarithm of the chance of k or more of n, each of chance p."""
    if k <= 0:
        return 0.0
    if n > 2_000:
        return _log_tail((k - 0.5 - n * p) / math.sqrt(n * p * (1 - p)))
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
    top = max(logs)
    return min(0.0, top + math.log(sum(math.exp(x - top) for x in logs)))


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def battery(token: str) -> tuple[float, float] | None:
    """(least p-value of the randomness tests, -log10 of the p-value against plain text)."""
    alphabet = encoding(token)
    if alphabet is None:
        return None
    text = token.lower() if alphabet in (_HEX_DIGITS, _BASE36) else token.replace("-", "+").replace("_", "/")
    places = {c: i for i, c in enumerate(alphabet)}
    s, m, n = [places[c] for c in text], len(alphabet), len(text)
    expected, counts = n / m, Counter(s)
    chi = sum((c - expected) ** 2 / expected for c in counts.values()) + (m - len(counts)) * expected
    # Wilson-Hilferty: chi-squared of m - 1 degrees as a normal deviate.
    dof = m - 1
    uniform = _upper_tail(((chi / dof) ** (1 / 3) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof)))
    high = [v >= m / 2 for v in s]
    a = sum(high)
    runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
    if 0 < a < n:
        mean = 1 + 2 * a * (n - a) / n
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        run_p = 2 * _upper_tail(max(0.0, abs(runs - mean) - 0.5) / math.sqrt(var))
    else:
        run_p = 2 * 0.5**n
    mid = sum(s) / n
    spread = sum((v - mid) ** 2 for v in s)
    serial = sum((x - mid) * (y - mid) for x, y in zip(s, s[1:])) / spread if spread else 1.0
    serial_p = 2 * _upper_tail(abs(serial + 1 / n) * math.sqrt(n))
    # Plain text: a non-central chi-squared, as a normal deviate, and changes of class.
    apart = n * (m * _PROSE_COLLISION[m] - 1)
    uneven = _log_tail((dof + apart - chi) / math.sqrt(2 * (dof + 2 * apart)))
    classes = [_class(c) for c in text]
    changes = _log_at_least(sum(x != y for x, y in zip(classes, classes[1:])), n - 1, _PROSE_CHANGE[m])
    both = uneven + changes  # Fisher's rule: p = q (1 - ln q) of the product q
    return min(uniform, run_p, serial_p), -(both + math.log(1 - both)) / math.log(10)


def band(n: int) -> int:
    return 0 if n < 32 else 1 if n < 48 else 2 if n < 80 else 3


def _scan(least_p: float):
    def spans(text: str):
        base = pattern_spans(text)
        starts, reach = [b[1] for b in base], list(accumulate((b[2] for b in base), max))
        found = []
        for t in _TOKEN.finditer(text):
            p = None if _word(t[0]) else battery(t[0])
            if p is not None and p[0] >= least_p:
                before = bisect_left(starts, t.end())  # patterns' spans that start before its end
                own = before > 0 and reach[before - 1] > t.start()
                found.append((t.start(), t.end(), band(len(t[0])), max(0, min(_BINS - 1, int(10 * p[1]))), own))
        return [dict(zip(("kind", "start", "end"), b)) for b in base], [dict(zip(("start", "end", "band", "bin", "own"), f)) for f in found]

    base_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    found_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("band", pa.int32()), ("bin", pa.int32()), ("own", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [spans(x.as_py() or "") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in both], base_type), pa.array([x[1] for x in both], found_type)], names=["doc_id", "base", "found"])

    return run


def _cuts(scanned: DataFrame, rate: float) -> dict[int, int]:
    """Per band the least bin of -log10 p that Benjamini-Hochberg lets through."""
    counts = scanned.select(F.explode("found").alias("f")).groupBy("f.band", "f.bin").count().collect()  # 4 x 400 rows at most
    cuts = {}
    for k in {r["band"] for r in counts}:
        by_bin = {r["bin"]: r["count"] for r in counts if r["band"] == k}
        total, passed = sum(by_bin.values()), 0
        for b in range(_BINS - 1, -1, -1):
            passed += by_bin.get(b, 0)
            if passed and total * 10 ** (-b / 10) <= rate * passed:
                cuts[k] = b
    return cuts


def secret_spans(docs: DataFrame, rate: float = 0.01, least_p: float = 0.001, text: str = "text") -> DataFrame:
    """(doc_id, base, spans, n_tested, n_confirmed) for every row: spans are base spans and
    added ones (kind 3), array<struct<start, kind, end>> in order; n_tested counts the tokens
    that the battery took for random, n_confirmed those of them inside base spans that the
    false-discovery control lets through."""
    scanned = materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("x")).mapInArrow(_scan(least_p), _SCHEMA), "scanned")
    cuts = _cuts(scanned, rate)

    def passes(f: Column) -> Column:
        return f["bin"] >= F.get(F.array(*[F.lit(cuts.get(k, _BINS)) for k in range(4)]), f["band"])

    item = lambda kind, s: F.struct(s["start"].alias("start"), kind.alias("kind"), s["end"].alias("end"))
    added = F.transform(F.filter("found", lambda f: passes(f) & ~f["own"]), lambda f: item(F.lit(3), f))
    confirmed = F.size(F.filter("found", lambda f: passes(f) & f["own"])).cast("bigint")
    base = F.transform("base", lambda s: item(s["kind"], s))
    return scanned.select("doc_id", F.array_sort(base).alias("base"), F.array_sort(F.concat(base, added)).alias("spans"), F.size("found").cast("bigint").alias("n_tested"), confirmed.alias("n_confirmed"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
