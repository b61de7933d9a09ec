"""The registered queries against SQL, and the pipeline's stages against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash

import corpus_pipeline
from framelake.llm import queries
from framelake.llm.encode import encoder, tokenizer_path

from .test_filters import SCHEMA, brute_lines, brute_similar


def norm(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    data = "/root/testdata/sf0.001"
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = duckdb.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    df = queries.QUERIES[name](spark, data)
    assert sorted(df.columns) == sorted(names) and norm(df.columns, df.collect()) == norm(names, want.fetchall())


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(4)
    vocab = ["w%d" % i for i in range(60)]
    rows, labels = [], []
    for i in range(90):
        words = [r.choice(vocab) for _ in range(90)]
        lines = [" ".join(words[k : k + 15]) for k in range(0, 90, 15)]
        if i % 5 == 0:
            lines.insert(2, "Shared line of the site")
        if i % 9 == 1:
            lines = [" ".join(x + "$$$" for x in line.split()) for line in lines]
        rows.append((i, "\n".join(lines), "en", r.choice("aab") if i % 7 else None, 0))
        if i % 2 == 0 and i % 9 != 1:
            labels.append((i, 1, 0))
    for i in range(90, 96):  # near copies
        base = rows[i - 88][1].split(" ")
        base[3] = "other"
        rows.append((i, " ".join(base), "en", "a", 0))
    rows += [(96, rows[2][1], "en", "b", 0), (97, None, "en", "b", 0), (98, "too short", None, None, 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def llr_kept(rows, good, n_buckets=10_000):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = lambda *x: (lambda s: s - (1 << 64) if s >> 63 else s)(__import__("functools").reduce(lambda seed, v: xxhash.xxh64_intdigest(v.encode(), seed), x, 42)) % n_buckets
        return w, [h(x) for x in w] + [h(*p) for p in zip(w, w[1:])]

    raw, target = Counter(), Counter()
    for i, t in rows:
        g = grams(t)[1]
        raw.update(g)
        if i in good:
            target.update(g)
    n, m = sum(raw.values()), sum(target.values())
    out = set()
    for i, t in rows:
        w, g = grams(t)
        three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        times = Counter(three)
        repeat = len({k + j for k, x in enumerate(three) if times[x] > 1 for j in range(3)})
        if len(w) < 50 or 100 * repeat > 50 * len(w):
            continue
        llr = sum(math.log((target[b] + 100 * m / n) / (raw[b] + 100)) - math.log(m / n) for b in g) / len(g)
        if llr >= -0.035:
            out.add(i)
    return out


def test_stages_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "simhash_near_dedup", "mixing", "packing"]
    rows = {r["doc_id"]: r for r in docs.collect()}

    def step(name, df):
        out = stages[name](spark, df, sf_dir)
        assert name == "packing" or out.columns == columns
        return spark.createDataFrame(out.collect(), out.schema) if name != "packing" else out

    one = step("quality_rules", docs)
    kept = {r["doc_id"] for r in one.collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert kept == llr_kept([(i, r["text"]) for i, r in rows.items()], good) and 50 < len(kept) < 90 and not kept & set(range(1, 90, 9))

    two = step("line_dedup", one)
    texts = {r["doc_id"]: r["text"] for r in two.collect()}
    want = brute_lines([(i, rows[i]["text"]) for i in kept], 10, "none")
    assert texts == {i: want[i][2] for i in kept} and all("Shared" not in t for t in texts.values())

    three = step("simhash_near_dedup", two)
    ids = sorted(texts)
    comp = brute_similar([texts[i] for i in ids])
    assert sorted(r["doc_id"] for r in three.collect()) == sorted({ids[c] for c in comp}) and 96 not in {r["doc_id"] for r in three.collect()}

    four = step("mixing", three)
    size, taken = defaultdict(int), defaultdict(int)
    for r in three.collect():
        size[r["source"]] += len(r["text"].split())
    for r in four.collect():
        taken[r["source"]] += len(r["text"].split())
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), abs=len(size)) and all(taken[s] <= 2 * size[s] for s in size)

    tok = encoder(tokenizer_path("byte_bpe_50k.json")).tokenizer
    pieces = step("packing", four).collect()
    assert sum(r["length"] for r in pieces) == sum(len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in four.collect())
    last = corpus_pipeline.run(spark, sf_dir)
    assert norm(last.columns, last.collect()) == norm(last.columns, pieces)


def test_an_empty_table_runs_through(spark, sf_dir, tmp_path):
    d = str(tmp_path)
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0).write.parquet(f"{d}/labels.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
