"""Document fingerprints by winnowing, in DataFrame expressions alone.

A text's units are its words, cut every ``unit`` characters.  With ``roll`` set, characters of
scripts that write no spaces (Han, kana, Thai, Lao, Khmer, Burmese) are units one by one, and
so are those of any run without white space (base64, minified code) past its first ``roll``
characters, so that hashes roll over every offset there; a run that grows keeps the units it
had.  A unit is hashed once.  The hash of ``k`` units rolls: it is a cyclic polynomial, the
exclusive or of their hashes, each turned by one bit more than the one behind it, and is made
from shorter runs' hashes by turning one and adding the other, never from the units anew.  Each
window of ``w`` hashes marks its least one, the rightmost of equals.  Two texts that share
w + k - 1 units in a row therefore share a mark.  Hash prefix and position sit in one long, so
least and rightmost is a plain minimum.

Marks keep their positions, as steps from one to the next: no window is without a mark, so a
step is ``w`` at most and takes one byte.

Defined cases: a null or blank text has no marks, and two such texts are alike; fewer
than ``k`` units make one hash, fewer than ``w`` hashes one window; a text of any length is
marked whole, in its row; repeated rows have equal fingerprints, and a repeated row's next
document is its repetition; an empty table gives no rows; extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parallelism

_POS = (1 << 30) - 1
_NULL_ID = -(1 << 63)
_SPACE = r"\x20\x09-\x0D"
#: Scripts without spaces between words.
_UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"


def _turned(x: Column, n: int) -> Column:
    n %= 64
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n)) if n else x


def rolled(hashed: Column, k: int) -> Column:
    """Hashes of every run of ``k`` items of an array of hashes, from those of half as many."""

    def joined(a: Column, b: Column, behind: int, more: int) -> Column:
        # Runs of ``behind`` items, each with the run of ``more`` items that follows it.
        whole = F.slice(a, 1, F.greatest(F.size(b) - behind, F.lit(0)))
        return F.transform(whole, lambda x, i: _turned(x, more).bitwiseXOR(F.get(b, i + behind)))

    def doubled(a: Column, n: int) -> Column:
        return F.transform(F.array(a), lambda x: joined(x, x, n, n))[0]

    def grown(one: Column) -> Column:
        out, n = one, 1
        for bit in bin(k)[3:]:
            out, n = doubled(out, n), 2 * n
            if bit == "1":
                out, n = joined(out, one, n, 1), n + 1
        return out

    return F.transform(F.array(hashed), grown)[0]


def marks(text: Column, k: int = 4, w: int = 8, unit: int = 4, roll: int | None = None) -> Column:
    """array<struct<pos, hash>> in position order."""
    runs = lambda x, p: F.regexp_extract_all(x, F.lit(p), F.lit(0))
    known = F.coalesce(text, F.lit(""))
    units = runs(known, r"[^%s]{1,%d}" % (_SPACE, unit))
    if roll is not None:
        # Single characters, words up to ``roll`` characters, and what follows these in single
        # characters; words are then cut.  Most texts have short words alone, cut alike without.
        part = f"[^{_SPACE}{_UNSPACED}]"
        words = runs(known, "[%s]|(?<!%s)%s{1,%d}|%s" % (_UNSPACED, part, part, roll, part))
        cut = F.flatten(F.transform(words, lambda x: F.when(F.length(x) <= unit, F.array(x)).otherwise(runs(x, "(?s).{1,%d}" % unit))))
        plain = f"[^{_SPACE}]"
        long = known.rlike("(?<!%s)%s{%d}" % (plain, plain, roll + 1))
        unspaced = (F.octet_length(known) > F.length(known)) & known.rlike(f"[{_UNSPACED}]")
        units = F.when(unspaced | long, cut).otherwise(units)

    def grams(u: Column) -> Column:
        run = rolled(F.transform(u, lambda x: F.xxhash64(x)), k)
        return F.when(F.size(u) >= k, run).when(F.size(u) > 0, F.array(F.xxhash64(u))).otherwise(F.array().cast("array<bigint>"))

    def chosen(h: Column) -> Column:
        packed = F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~_POS)).bitwiseOR(F.lit(_POS) - i))
        windows = lambda p: F.transform(
            F.slice(p, 1, F.greatest(F.size(p) - (w - 1), F.least(F.size(p), F.lit(1)))),
            lambda x, i: F.least(x, *[F.get(p, i + j) for j in range(1, w)]) if w > 1 else x,
        )
        least = F.transform(F.array(packed), windows)[0]
        at = lambda x: (F.lit(_POS) - x.bitwiseAND(F.lit(_POS))).cast("int")
        return F.transform(F.array_distinct(least), lambda x: F.struct(at(x).alias("pos"), F.get(h, at(x)).alias("hash")))

    return F.transform(F.transform(F.array(units), grams), chosen)[0]


def hashes(marked: Column) -> Column:
    """Upper 32 bits of the marks' hashes in position order: what a fingerprint holds."""
    return F.transform(marked, lambda m: F.shiftright(m["hash"], 32).cast("int"))


def steps(marked: Column) -> Column:
    """Marks' positions, each as the distance from the mark before; the first as it is."""
    before = lambda i: F.when(i > 0, F.get(marked, i - 1)["pos"]).otherwise(0)
    return F.transform(marked, lambda m, i: (m["pos"] - before(i)).cast("tinyint"))


def printed(found: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits a mark, in position order."""
    return F.lower(F.array_join(F.transform(found, lambda h: F.lpad(F.hex(h.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Shared marks over all marks, 0 to 1, of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def with_next(docs: DataFrame, text: str = "text") -> DataFrame:
    """(d, th, n_chars, copies, next_d, next_th): each distinct (doc_id, text hash) with the
    one after it in ascending doc_id order, the first after the last.

    Ranks come from range partitions sorted in place plus one row a partition; texts
    are not moved, and no task sees more than its range.
    """
    spark = docs.sparkSession
    keys = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL_ID)).alias("d"), F.xxhash64(text).alias("th"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n_chars"))
    keys = keys.groupBy("d", "th").agg(F.max("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    sorted_ = keys.repartitionByRange(parallelism(spark), "d").sortWithinPartitions("d", "th").withColumn("id", F.monotonically_increasing_id())
    numbered = materialize(sorted_.withColumn("part", F.shiftright("id", 33)).withColumn("row", F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).drop("id"), "ranks")
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = numbered.join(bases, "part").withColumn("rank", F.col("row") + F.col("base")).drop("part", "row", "base")
    n = numbered.count()
    nexts = ranked.select(F.pmod(F.col("rank") - 1, F.lit(max(n, 1))).alias("rank"), F.col("d").alias("next_d"), F.col("th").alias("next_th"))
    return ranked.join(nexts, "rank").drop("rank")


def edited_fingerprints(docs: DataFrame, text: str = "text", **kw) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited (the last half of the text replaced by
    the first as many characters of the next document), the fingerprints of both with the
    steps between their marks, and the likeness of the text's marks to the edited text's and the
    next document's.

    A text is shuffled once and marked once; its hashes then go to its own row with their steps,
    and with its head to the row before it.
    """
    both = lambda m: F.struct(hashes(m).alias("hashes"), steps(m).alias("steps"))
    found = lambda x: F.transform(F.array(marks(x, **kw)), both)[0]
    nexts = materialize(with_next(docs, text), "nexts")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL_ID)).alias("d"), F.xxhash64(text).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    one = F.row_number().over(Window.partitionBy("d", "th").orderBy("th"))
    texts = keyed.withColumn("_k", one).where("_k = 1").drop("_k")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    before = nexts.select(F.col("d").alias("to_d"), F.col("th").alias("to_th"), "n_chars", "copies", F.col("next_d").alias("d"), F.col("next_th").alias("th"))
    sent = texts.join(before, ["d", "th"]).select("d", "th", "to_d", "to_th", "n_chars", "copies", F.substring(F.col("x"), F.lit(1), half).alias("head"), found(F.col("x")).alias("h"))
    row = lambda d, th, own, following, *rest: F.struct(F.col(d).alias("d"), F.col(th).alias("th"), own.alias("own"), following.alias("following"), *rest)
    none = F.lit(None)
    kept = "struct<hashes: array<int>, steps: array<tinyint>>"
    to_own = row("d", "th", F.col("h").cast(kept), none.cast("array<int>"), none.cast("string").alias("head"), none.cast("bigint").alias("n_chars"), none.cast("bigint").alias("copies"))
    to_previous = row("to_d", "to_th", none.cast(kept), F.array_distinct("h.hashes"), F.col("head"), F.col("n_chars").cast("bigint").alias("n_chars"), F.col("copies").cast("bigint").alias("copies"))
    sent = sent.select(F.explode(F.array(to_own, to_previous)).alias("r")).select("r.*")
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    got = sent.groupBy("d", "th").agg(*[first(c) for c in ("own", "following", "head", "n_chars", "copies")])
    rows = texts.join(got, ["d", "th"])
    # All but the last of repeated rows are followed by themselves.
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    own = F.col("_i") < F.col("copies")
    rows = rows.withColumn("head", F.when(own, F.substring(F.col("x"), F.lit(1), half)).otherwise(F.col("head")))
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("x"), F.lit(1), F.col("n_chars") - half), F.col("head")))
    rows = rows.select("d", "n_chars", "edited", "own", "following", own.alias("_own"), found(F.col("edited")).alias("changed"))
    distinct = F.array_distinct("own.hashes")
    return rows.select(
        F.when(F.col("d") != _NULL_ID, F.col("d")).alias("doc_id"),
        "n_chars",
        "edited",
        printed(F.col("own.hashes")).alias("fingerprint"),
        printed(F.col("changed.hashes")).alias("edited_fingerprint"),
        F.col("own.steps").alias("steps"),
        F.col("changed.steps").alias("edited_steps"),
        likeness(distinct, F.array_distinct("changed.hashes")).alias("near_edited"),
        F.when(F.col("_own"), 1.0).otherwise(likeness(distinct, F.col("following"))).alias("near_next"),
    )
