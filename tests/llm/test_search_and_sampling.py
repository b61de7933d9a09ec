"""Byte-level BPE, ranked search and importance resampling, held to libraries and brute force."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake.llm import byte_bpe, ranked_search, resampling
from framelake.llm.encode import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.tiktoken")
ODD = [*"ab's tre vl dmLL'\n\t  7\xa0é中!.　́²Ⅷ𝒳\x1c\x85\0﻿ ", "'s", "'re", "'ll", " '", "\r\n", "Ᲊ", "abc"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd(seed, n, longest=60):
    r = random.Random(seed)
    return ["".join(r.choices(ODD, k=r.randint(0, longest))) for _ in range(n)]


# byte-level BPE
def test_ids_are_the_library_s(library):
    texts = odd(1, 4_000) + ["", "'", "''s", " 's", "\n's", "  's", "a's's", "'rex", "<|endoftext|>", "x" * 300, "ab" * 200, "日本" * 90]
    v = byte_bpe.vocabulary(PATH)
    got = list(v.encode([t.encode() for t in texts]))
    assert [g.tolist() for g in got] == [library.encode_ordinary(t) for t in texts]
    assert [v.decode(g, v.offsets(g)).decode() for g in got] == texts


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("'stremdvl \n\xa0a1."), st.characters(codec="utf-8")), max_size=25), max_size=5))
def test_ids_of_any_texts(library, texts):
    got = byte_bpe.vocabulary(PATH).encode([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("most", [40, 700, 1 << 20])
def test_a_long_text_in_parts(library, most):
    text = odd(2, 1, 6_000)[0] + "a" * 900 + " " * 900 + "né" * 400 + "'s" * 300
    parts = list(byte_bpe._parts(text.encode(), most))
    assert b"".join(parts) == text.encode() and (len(parts) > 3 or most > 700)
    (ids,) = byte_bpe.vocabulary(PATH).encode([text.encode()], most)
    assert ids.tolist() == library.encode_ordinary(text)


def test_scan_is_the_automaton_step_by_step():
    numbers, _, functions, starts = byte_bpe._automaton()
    kinds = np.array(random.Random(4).choices(range(10), k=5_000))
    state, want = 0, []
    for k in kinds.tolist():
        state = byte_bpe._step(state, k)[0]
        want.append(state)
    for width in (2, 7, 128):
        assert functions[byte_bpe._scan(numbers[kinds], width), 0].tolist() == want


def test_merges_through_a_heap_are_the_same():
    merges = byte_bpe.vocabulary(PATH).merges
    r = random.Random(5)
    for _ in range(300):
        piece = bytes(r.choices(b"abenrst \xc3\xa9", k=r.randint(2, 60)))
        assert merges.merge(piece, long=1) == merges.merge(piece)


def test_encode_and_decode_rows(spark, library):
    texts = [*odd(6, 200), None, "", "long text " * 40_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    rows = byte_bpe.decode(byte_bpe.encode(docs, PATH), PATH).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == library.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
        assert r["offsets"] == np.cumsum([0, *[len(library.decode_single_token_bytes(i)) for i in r["ids"]]])[:-1].tolist()
    # Ids in the middle of a text are decoded by themselves.
    some = byte_bpe.encode(docs, PATH).select("doc_id", F.slice("ids", 2, 3).alias("ids"), F.slice("offsets", 2, 3).alias("offsets"))
    for r in byte_bpe.decode(some, PATH).collect():
        assert bytes(r["decoded"]) == library.decode_bytes(library.encode_ordinary(texts[r["doc_id"]] or "")[1:4])
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0), PATH), PATH).count() == 0


# ranked search
def found_by_hand(docs, items, k=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    cuts = [(i, cut(t)) for i, t in docs]
    n_docs, n_terms = sum(1 for _, t in cuts if t), sum(len(t) for _, t in cuts)
    df = Counter(x for _, t in cuts for x in set(t))
    out = []
    for item, text in items:
        scores = []
        for i, t in cuts:
            tf, m = Counter(t), 100 - 75 + ((75 * len(t) * n_docs) // n_terms if n_terms else 0)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1000000000 * tf[x]) // (1000 * tf[x] + 8 * m)) for x in cut(text) if tf[x])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def search_rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def searched(seed, n):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["the"] * 40 + ["Éa", "éa", "中文", "A1", "a-b", "x_y", "K"]
    docs = [(i, " ".join(r.choices(vocab, k=r.randint(1, 30)))) for i in r.sample(range(10 * n), n)]
    docs += [(-5, docs[0][1]), (-5, docs[0][1]), (None, docs[0][1]), (None, None), (7_000_001, ""), (7_000_002, "-- !"), (7_000_003, docs[1][1] * 200)]
    items = [(i, " ".join(r.choices(vocab, k=r.randint(1, 12)))) for i in range(12)]
    return docs, [*items, (90, docs[0][1]), (91, None), (92, ""), (93, "nowhere"), (94, "the the the w1"), (95, docs[1][1])]


@pytest.mark.parametrize("shard, block", [(1, 1 << 20), (40, 200), (1 << 15, 1 << 20)])
def test_ranked_search_is_brute_force(spark, monkeypatch, shard, block):
    docs, items = searched(3, 150)
    monkeypatch.setattr(ranked_search, "_SHARD_DOCS", shard)  # taken along by the tasks' functions
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n int, score int").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert search_rows(ranked_search.search(df, asked, block_bytes=block)) == found_by_hand(docs, items)


def test_ties_beyond_the_tenth_go_to_the_least_ids(spark):
    docs = [(i, "same words here") for i in range(3_000, 0, -1)] + [(5_000 + i, "other w%d" % i) for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame([(1, "words"), (1, "same HERE")], "item_id long, text string")
    rows = search_rows(ranked_search.search(df, asked))
    assert [r[2] for r in rows if r[1] == 10] == [10, 10] and len(rows) == 20 and {r[2] for r in rows} == set(range(1, 11))
    assert ranked_search.search(df.limit(0), asked).count() == 0 and ranked_search.search(df, asked.limit(0)).count() == 0


def test_a_search_opens_few_ranges(monkeypatch):
    r = np.random.default_rng(1)
    docs, term = np.repeat(np.arange(20_000), 5), r.integers(0, 400, 100_000)
    key = np.unique(term * 20_000 + docs)
    share = r.integers(1, 900_000, len(key))
    share[key % 20_000 == 12_345] = 10**6  # one document stands out
    trees = ranked_search.MaxTrees(key // 20_000, key % 20_000, share, 20_000)
    opened, real = [], trees.open
    monkeypatch.setattr(trees, "open", lambda *a: opened.append(a) or real(*a))
    asked = np.array(sorted(set((key[key % 20_000 == 12_345] // 20_000).tolist())))
    best = trees.search(asked, np.ones(len(asked), dtype=np.int64), np.arange(20_000), [], 1)
    sums = np.zeros(20_000, dtype=np.int64)
    np.add.at(sums, key[np.isin(key // 20_000, asked)] % 20_000, share[np.isin(key // 20_000, asked)])
    assert best == [(-int(sums.max()), int(sums.argmax()))] and len(opened) < 40  # of 646


# importance resampling
def weighed_by_hand(docs, target, percent=5, buckets=10_000):
    def runs(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    cut = [(i, *runs(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in cut for b in f), Counter(b for x in target for b in runs(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for i, n, f in cut:
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    drawn = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(drawn[: percent * len(drawn) // 100], 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def resample_rows(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=str)


def sampled(seed, n):
    r = random.Random(seed)
    vocab = [f"W{i}" for i in range(50)] + ["é", "É", "中文", "x" * 70, "don't", "a_b", "`q", "{z", "K"]
    text = lambda k: " ".join(r.choices(vocab, k=k))
    docs = [(i, text(r.randint(0, 60))) for i in r.sample(range(10 * n), n)]
    one = text(40)
    docs += [(-1, one), (-1, one), (None, one), (None, one), (None, None), (8_000_000, ""), (8_000_001, " .\n"), (8_000_002, text(9_000))]
    return docs, [text(20) for _ in range(8)] + [None, "", docs[0][1]]


def test_resampling_is_brute_force(spark):
    docs, target = sampled(7, 240)
    df = spark.createDataFrame([(*d, 5, 6) for d in docs], "doc_id long, text string, rank int, u int").repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    assert resample_rows(resampling.resample(df, aim, percent=30)) == weighed_by_hand(docs, target, 30)


def test_resampling_of_nothing(spark):
    docs, target = sampled(8, 60)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    assert resample_rows(resampling.resample(df, none)) == weighed_by_hand(docs, [])
    assert resampling.resample(df.limit(0), none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=300), min_size=1, max_size=4))
def test_crc_follows_from_its_parts(parts):
    crc = np.array([zlib.crc32(parts[0])], dtype=np.uint32)
    for p in parts[1:]:
        crc = resampling._apply(resampling._shift(len(p))[None], np.zeros(1, dtype=np.int64), crc) ^ np.uint32(zlib.crc32(p))
    assert int(crc[0]) == zlib.crc32(b"".join(parts))


@pytest.mark.parametrize("most", [1, 30, 1_000])
def test_parts_of_texts_give_the_same_totals_and_weights(most):
    texts = [(t or "").encode() for _, t in sampled(9, 40)[0]]
    gain, n = np.arange(500) - 250, len(texts)

    def over(most):
        totals, weight, known = np.zeros(500, dtype=np.int64), np.zeros(n, dtype=np.int64), resampling.Words()
        for trie, doc, new in resampling._tries(texts, known, most):
            totals += trie.totals(500)
            trie.weigh(gain, doc, weight)
        return totals.tolist(), weight.tolist()

    assert over(most) == over(1 << 30)


def test_trie_nodes_hold_the_counts_and_crcs_of_runs():
    texts = [b"a b a b c", b"b a b", b"", b"c"]
    ((trie, doc, new),) = resampling._tries(texts, resampling.Words())
    want = Counter(" ".join(w[i : i + n]).encode() for w in (t.decode().split() for t in texts) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    got = Counter({int(c): int(k) for crc, count in zip(trie.crc, trie.count) for c, k in zip(crc, count)})
    assert got == Counter({zlib.crc32(w): k for w, k in want.items()}) and len(doc) == 9 and new.all()
