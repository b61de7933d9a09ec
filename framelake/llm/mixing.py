"""Mixing sources to target weights: capped water-filling and seeded repetition.

A source's target is min(cap, level * weight): sources clamp at ``max_epochs`` times
their size and the excess goes to the others in proportion to weight until none is above
its cap.  A target of r epochs takes floor(r) whole repetitions of every document and a
fractional one: documents in seeded hash order up to the target, the document at the
border for its first words only, so each source meets its target to a word.

Nothing is sorted per source: two levels of hash bins, summed before they are shuffled,
narrow the border to about a millionth of a source, so one that holds a third of all rows
costs no more than any other.  Sources themselves are a small dimension table.

Defined cases: null sources form one source, last; a null text has size 0 and is never
taken; repeated rows are separate documents that tie in hash order and are then ordered
by size and text hash; an empty table gives an empty mix; a source without words has target 0;
in the mix itself columns of any name pass through, and rows that repeat an id, text and source
share their words, which the one of the least hash of all columns carries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, fresh, materialize, words

_BINS = 1024
_SMALL_SOURCES = 100_000
_NULL_ID = -(1 << 63)


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``, in doubles."""
    order = Window.orderBy("_full", "source").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    ranked = (
        sources.withColumn("_cap", cap)
        .withColumn("_full", F.col("_cap") / F.col("weight"))
        .withColumn("_total", F.lit(float(share)) * F.sum("source_size").over(whole))
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(order), F.lit(0.0)))
        .withColumn("_open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.col("_open"))
    )
    # With sources by the level that fills them, the level rises while it passes the next
    # cap and falls from the first that it does not: the greatest is the one that holds.
    level = ranked.withColumn("_fits", F.when(F.col("_full") >= F.col("_level"), F.col("_level"))).withColumn("_level", F.max("_fits").over(whole))
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("weight")))
    return level.select("source", "source_size", "weight", target.alias("target"))


def cyclic_weights(sources: DataFrame, weights: list[float]) -> DataFrame:
    """Weights in turn over the sources by code point, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    values = F.array(*[F.lit(float(w)) for w in weights])
    return sources.withColumn("weight", F.get(values, (rank % len(weights)).cast("int")))


def _with_source(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Joins the dimension table; broadcast only after its rows have been counted."""
    small = sources.limit(_SMALL_SOURCES + 1).count() <= _SMALL_SOURCES
    side = sources.withColumnRenamed("source", "_s")
    return docs.join(F.broadcast(side) if small else side, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, max_epochs: float = 2.0, seed: int = 7, text: str = "text") -> DataFrame:
    """(doc_id, th, source, size, source_size, target, taken) for every row of ``docs``;
    th is the text's hash, by which repeated ids are told apart."""
    narrow = docs.select(
        F.col("doc_id"),
        F.xxhash64(text).alias("th"),
        F.col("source"),
        F.size(words(F.col(text))).cast("bigint").alias("size"),
        F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))), 1, 15), 16, 10).cast("bigint").alias("_u"),
    )
    narrow = materialize(narrow, "sizes")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(water_fill(cyclic_weights(sizes, weights), share, max_epochs).select("source", "source_size", "target"), "targets")
    rest = F.round(F.col("target")).cast("bigint") - F.col("_whole") * F.col("source_size")
    plan = targets.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")).withColumn("_rest", rest)

    b1 = F.pmod(F.col("_u"), F.lit(_BINS)).cast("int")
    b2 = F.pmod(F.shiftright("_u", 16), F.lit(_BINS)).cast("int")

    def border(rows: DataFrame, bin_: Column, rest_: str, name: str) -> DataFrame:
        """Per source the bin where its documents reach ``rest_``, and the words before it."""
        sums = rows.groupBy("source", bin_.alias("_b")).agg(F.sum("size").alias("_n"), F.max(rest_).alias("_r"))
        to = F.sum("_n").over(Window.partitionBy("source").orderBy("_b"))
        found = sums.withColumn("_to", to).where((F.col("_to") > F.col("_r")) & (F.col("_to") - F.col("_n") <= F.col("_r")))
        out = found.groupBy("source").agg(F.min(F.struct("_b", (F.col("_r") - F.col("_to") + F.col("_n")).alias("_left"))).alias("_x"))
        return out.select("source", F.col("_x._b").alias(f"_b{name}"), F.col("_x._left").alias(f"_left{name}"))

    rows = _with_source(narrow, plan).withColumns({"_1": b1, "_2": b2})
    first = materialize(border(rows, F.col("_1"), "_rest", "1"), "border")
    rows = _with_left(rows, first)
    second = materialize(border(rows.where("_1 = _b1"), F.col("_2"), "_left1", "2"), "border")
    rows = _with_left(rows, second)
    # What is left of one source in one second-level bin: ordered, cut at the border.
    at = (F.col("_1") == F.col("_b1")) & (F.col("_2") == F.col("_b2"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("_u", "doc_id", "size", "th").rowsBetween(Window.unboundedPreceding, -1))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left2") - F.coalesce(upto, F.lit(0))))
    edge = rows.where(at).withColumn("_extra", part)
    before = F.coalesce((F.col("_1") < F.col("_b1")) | ((F.col("_1") == F.col("_b1")) & (F.col("_2") < F.col("_b2"))), F.col("_b1").isNull() & (F.col("_rest") > 0))
    others = rows.where(~F.coalesce(at, F.lit(False))).withColumn("_extra", F.when(before, F.col("size")).otherwise(F.lit(0).cast("bigint")))
    both = others.unionByName(edge)
    return both.select("doc_id", "th", "source", "size", "source_size", "target", (F.col("_whole") * F.col("size") + F.col("_extra")).alias("taken"))


def _with_left(rows: DataFrame, side: DataFrame) -> DataFrame:
    """Left join of at most one row a source, broadcast after counting."""
    small = side.limit(_SMALL_SOURCES + 1).count() <= _SMALL_SOURCES
    side = side.withColumnRenamed("source", "_s")
    return rows.join(F.broadcast(side) if small else side, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    return F.array_join(F.slice(pieces, 1, n.cast("int")), "")


def apply_mix(docs: DataFrame, mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: each row once for every whole repetition and, where a repetition is
    a part, with its first words; the columns of ``docs``."""
    d, th, source, none, size, every, rank, copy, left = (fresh(docs, x) for x in ("d", "th", "source", "none", "size", "all", "rank", "copy", "left"))
    # A null source as two columns, by which rows are joined and ranked without another shuffle.
    key = {d: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL_ID)), source: F.coalesce("source", F.lit("")), none: F.col("source").isNull()}
    named = [c.alias(k) for k, c in key.items()]
    take = mixed.where("taken > 0").groupBy(*named, F.col("th").alias(th)).agg(F.min("size").alias(size), F.sum("taken").alias(every))
    joined = docs.withColumns({**key, th: F.xxhash64(text)}).join(take, [d, th, source, none])
    order = Window.partitionBy(d, th, source, none).orderBy(F.xxhash64(*columns(docs)))
    joined = joined.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1)
    copies = F.sequence(F.lit(1), F.ceil(F.col(every) / F.col(size)).cast("int"))
    out = joined.withColumn(copy, F.explode(copies)).withColumn(left, F.col(every) - (F.col(copy) - 1) * F.col(size))
    cut = F.when(F.col(left) >= F.col(size), F.col(text)).otherwise(first_words(F.col(text), F.col(left)))
    return out.withColumn(text, cut).select(*columns(docs))
