"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

Everything is DataFrame expressions: per-document work stays in the row (sorted
hash arrays instead of an exploded shuffle), and only bucket counts are shuffled.

Defined cases: a null or blank text has no words, all counts 0, ``llr`` null and
fails the base rules.  Repeated rows are judged alike; extra columns pass through, but for
those that have the name of a result, which it replaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fresh, words

_POS_BITS = 30
_POS_MASK = (1 << _POS_BITS) - 1


def _repeated_positions(w: Column) -> Column:
    """Starts of 3-word windows that occur twice or more in ``w``, ascending.

    Hash prefix and position share one long, so the sort is a primitive one; the few
    windows whose prefixes meet are compared as text before they count.
    """
    heads = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
    packed = F.sort_array(
        F.transform(
            heads,
            lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
            .bitwiseAND(F.lit(~_POS_MASK))
            .bitwiseOR(i.cast("bigint")),
        )
    )

    def met(p: Column) -> Column:
        same = lambda x, y: F.shiftright(x, _POS_BITS) == F.shiftright(y, _POS_BITS)
        return F.transform(
            F.filter(
                p,
                lambda x, i: F.coalesce(same(x, F.get(p, i + 1)), F.lit(False))
                | F.coalesce(same(x, F.get(p, i - 1)), F.lit(False)),
            ),
            lambda x: x.bitwiseAND(F.lit(_POS_MASK)).cast("int"),
        )

    met_at = F.transform(F.array(packed), met)[0]
    texts = F.array_sort(
        F.transform(met_at, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("s"), i.alias("i")))
    )

    def equal(p: Column) -> Column:
        return F.array_sort(
            F.transform(
                F.filter(
                    p,
                    lambda x, i: F.coalesce(x["s"] == F.get(p, i + 1)["s"], F.lit(False))
                    | F.coalesce(x["s"] == F.get(p, i - 1)["s"], F.lit(False)),
                ),
                lambda x: x["i"],
            )
        )

    return F.transform(F.array(texts), equal)[0]


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with x evaluated once, wherever the optimizer moves the expression to: a
    filter over these columns would else split the text anew for each word."""
    return F.transform(F.array(x), f)[0]


def _counts(w: Column, text: Column) -> list[Column]:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.length(F.trim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    covered = F.aggregate(
        _repeated_positions(w),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).cast("bigint").alias("n"), (i + 3).alias("end")),
    )["n"]
    return [
        F.size(w).cast("bigint").alias("n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        (F.size(F.split(F.coalesce(text, F.lit("")), r"[#*$%&|<>]", -1)) - 1).cast("bigint").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    ]


def _spread(docs: DataFrame, found: Column, names: list[str]) -> DataFrame:
    """The columns of ``docs``, but for those of the same names, and ``found``'s fields."""
    q = fresh(docs, "found")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*kept, found.alias(q)).select(*kept, *[F.col(f"{q}.{n}") for n in names])


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    return _spread(docs, _let(words(F.col(text)), lambda w: F.struct(*_counts(w, F.col(text)))), _COUNTS)


def _base_failed(c: Column, min_words: int, max_repeat_percent: int) -> Column:
    return (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeat_percent * c["n_words"])


def _buckets(w: Column, n_buckets: int) -> Column:
    """Hashed unigrams and bigrams of a word array."""
    bucket = lambda *x: F.pmod(F.xxhash64(*x), F.lit(n_buckets)).cast("int")
    two = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: bucket(x, F.get(w, i + 1)))
    return F.concat(F.transform(w, lambda x: bucket(x)), two)


def trusted_ids(labels: DataFrame, max_trusted: int = 20_000) -> DataFrame:
    """At most ``max_trusted`` ids labelled good and not toxic, picked by hash; the bound
    makes the later broadcast safe."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)


def llr_weights(docs: DataFrame, trusted: DataFrame, n_buckets: int = 10_000, alpha: float = 100.0, text: str = "text") -> DataFrame:
    """One row: ``weights``, log(p_target / p_raw) by bucket, over all documents.

    Counts are combined before the shuffle, so each task ships at most ``n_buckets``
    rows; the result has ``n_buckets`` numbers whatever the corpus size.  With no
    trusted document every weight is 0.
    """
    good = F.broadcast(trusted.select(F.col("doc_id").alias("_good")).distinct())
    counts = (
        docs.select("doc_id", text)
        .join(good, F.col("doc_id") == F.col("_good"), "left")
        .select(F.col("_good").isNotNull().cast("int").alias("t"), words(F.col(text)).alias("_w"))
        .select("t", F.explode(_buckets(F.col("_w"), n_buckets)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("r"), F.sum("t").alias("t"))
    )
    filled = docs.sparkSession.range(n_buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    gathered = filled.agg(
        F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("t", F.lit(0)).alias("t")))).alias("b"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("raw"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("target"),
    )
    # Both sides get the same share of pseudo-counts, so a bucket seen less than about
    # ``alpha`` times says nothing: a document's own rare words do not tell against it.
    ratio = F.col("target") / F.col("raw")
    weight = lambda x: F.when(F.col("target") > 0, F.log((x["t"] + alpha * ratio) / (x["r"] + alpha)) - F.log(ratio)).otherwise(F.lit(0.0))
    return gathered.select(F.transform("b", weight).alias("weights"))


def quality_rules(
    docs: DataFrame, labels: DataFrame, threshold: float = -0.035, n_buckets: int = 10_000, alpha: float = 100.0, max_trusted: int = 20_000, min_words: int = 50, max_repeat_percent: int = 50, text: str = "text"
) -> DataFrame:
    """Rows of ``docs`` with the base counts, ``llr`` (mean log-likelihood ratio per
    n-gram of the trusted target against the raw corpus), base_failed and kept.

    A document is kept if the base rules pass and ``llr`` reaches ``threshold``; the
    same corpus gives the same verdicts.
    """
    weights = llr_weights(docs, trusted_ids(labels, max_trusted), n_buckets, alpha, text=text).scalar()

    held = fresh(docs, "weights")

    def ratio(w: Column) -> Column:
        total = _let(F.col(held), lambda v: F.aggregate(_buckets(w, n_buckets), F.lit(0.0), lambda a, b: a + F.get(v, b)))
        return F.when(F.size(w) > 0, total / (2 * F.size(w) - 1)).alias("llr")

    def verdict(c: Column) -> Column:
        failed = _base_failed(c, min_words, max_repeat_percent)
        return F.struct(*[c[n].alias(n) for n in [*_COUNTS, "llr"]], failed.alias("base_failed"), (~failed & F.coalesce(c["llr"] >= threshold, F.lit(False))).alias("kept"))

    found = _let(_let(words(F.col(text)), lambda w: F.struct(*_counts(w, F.col(text)), ratio(w))), verdict)
    return _spread(docs.withColumn(held, weights), found, [*_COUNTS, "llr", "base_failed", "kept"]).drop(held)


__all__ = ["SPACES", "base_counts", "llr_weights", "quality_rules", "trusted_ids"]
