"""Language identification by compression.

A bounded sample of labelled texts becomes one raw-content zstandard dictionary a
language.  A text in lower case is compressed with each, in pieces so that a long text leans on the
dictionary and not on itself, and gets the language whose total is smallest; a margin too
narrow for its length marks it as rejected.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with no
training rows every text is; equal totals go to the language commonest in training; repeated
rows are judged alike; a text of any length is compressed whole; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_LETTER = regex.compile(r"\p{L}")
_OUT = "doc_id long, lang_pred string, score double, margin double, rejected boolean"


def train(labelled: DataFrame, docs_per_lang: int = 200, dictionary_bytes: int = 1 << 18, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionary content by language, the commonest first: whole texts, joined, of a bounded
    sample.  The sample: of each language's distinct texts of at most an eighth of
    ``dictionary_bytes``, the ``docs_per_lang`` first by hash; those that still fit into the
    dictionary are taken, in that order.  What reaches the driver is so bounded by the
    parameters and the number of languages."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # one row a language
    fitting = rows.where(F.octet_length(text) <= dictionary_bytes // 8).select(F.col(lang).alias("k"), F.xxhash64(text, F.lit(11)).alias("u"), F.col(text).alias("t"))
    # A language's first hashes; a partial top of each task is what the window shuffles.
    first = fitting.select("k", "u").distinct().withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("u"))).where(F.col("n") <= docs_per_lang)
    least = {r[0]: r[1] for r in first.groupBy("k").agg(F.max("u")).collect()}
    if not least:
        return {}
    upto = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
    picked = fitting.where(F.col("u") <= upto[F.col("k")]).groupBy("k", "u").agg(F.min("t").alias("t"))
    out: dict[str, list[bytes]] = {k: [] for k in counts}
    for r in picked.orderBy("k", "u").collect():
        t = r["t"].lower().encode()
        if sum(map(len, out[r["k"]])) + len(t) < dictionary_bytes:
            out[r["k"]].append(t)
    return {k: b"\n".join(out[k]) for k in sorted(out, key=lambda k: (-counts[k], k)) if out[k]}


def classify(docs: DataFrame, dictionaries: dict[str, bytes], level: int = 6, piece: int = 1_024, least_margin: float = 0.005, text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected) of every whole text.  score is the share
    of the best language if texts are weighed by 2 ** -bits; margin is the runner-up's
    extra bytes a byte of text."""
    names = list(dictionaries)
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)  # dictionary_bytes a language at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tools = []
        for k in names:
            d = zstandard.ZstdCompressionDict(held.value[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            tools.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

        def judge(t: str | None) -> tuple[str, float, float, bool]:
            if not tools or t is None or not _LETTER.search(t):
                return "und", 0.0, 0.0, True
            raw = t.lower().encode()
            parts = [raw[i : i + piece] for i in range(0, len(raw), piece)]
            sizes = [sum(len(c.compress(p)) for p in parts) for c in tools]
            best = min(range(len(sizes)), key=sizes.__getitem__)
            score = 1.0 / sum(2.0 ** (8 * max(sizes[best] - s, -100)) for s in sizes)
            margin = (min((s for i, s in enumerate(sizes) if i != best), default=sizes[best] + len(raw)) - sizes[best]) / len(raw)
            return names[best], score, margin, margin < least_margin

        for b in batches:
            rows = [judge(x.as_py()) for x in b.column(1)]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_())], names=[x.split()[0] for x in _OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("x")).mapInArrow(run, _OUT)
