"""Quality rules, line dedup and SimHash against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from framelake.llm import line_dedup, quality, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)], SCHEMA)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocab = ["al", "Be", "ç", "dé", "ea", "fu x", "gi", "#h", "$i|"]
    out = [None, "", " \n\t", "one", "one two", "a b c a b c a b c", "x\n x \nX\n\nx", "line\nline\n \n \nline"]
    for _ in range(n):
        lines = [" ".join(r.choices(vocab, k=r.randint(0, 12))) for _ in range(r.randint(1, 8))]
        out.append(r.choice(["\n", " \n", "\r\n"]).join(lines))
    return out + ["common\nrare %d" % i for i in range(15)] + [" ".join(r.choices(vocab, k=3000))]


def test_base_counts_match_brute_force(spark):
    texts = corpus()
    got = {r["doc_id"]: r for r in quality.base_counts(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        times = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if times[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, (i, t)


def test_llr_keeps_target_like_text(spark):
    r = random.Random(3)
    good = [" ".join(r.choices(["the", "cat", "sat", "on", "mat", "and", "dog"], k=80)) for _ in range(60)]
    bad = [" ".join(r.choices(["buy", "$$$", "click", "###"], k=80)) for _ in range(6)]
    docs = frame(spark, good + bad + [None])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {x["doc_id"]: x for x in quality.quality_rules(docs, labels).collect()}
    bad_llr = max(out[i]["llr"] for i in range(60, 66))
    assert min(out[i]["llr"] for i in range(60)) > bad_llr and bad_llr < -0.035
    assert out[66]["llr"] is None and not out[66]["kept"]
    none = quality.quality_rules(docs, labels.limit(0)).collect()
    assert all(x["llr"] in (0.0, None) for x in none)
    assert quality.quality_rules(docs.limit(0), labels).count() == 0


def brute_lines(rows, min_docs, keep):
    keys = lambda t: [re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")]
    docs, first = defaultdict(set), {}
    for i, t in rows:
        for p, k in enumerate(keys(t)):
            if k:
                docs[k].add((i, t))
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        drop = [bool(k) and len(docs[k]) >= min_docs for k in keys(t)]
        out[i] = (len(lines), sum(drop), "\n".join(x for x, d in zip(lines, drop) if not d))
    return out


@pytest.mark.parametrize("min_docs", [2, 5, 10])
def test_line_dedup_none_matches_brute_force(spark, min_docs):
    texts = corpus(5, 80)
    d = line_dedup.line_dedup(frame(spark, texts), min_docs=min_docs, keep="none").collect()
    want = brute_lines(list(enumerate(texts)), min_docs, "none")
    assert {r["doc_id"]: line_dedup.kept_text(r["text"], r["keep_bitmap"]) for r in d} == want


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_line_dedup_first_keeps_each_line_once(spark, parts):
    texts = ["same\nown %d\nsame" % i for i in range(40)] + ["Same ", None, ""]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        out = line_dedup.line_dedup(frame(spark, texts), keep="first").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    kept = {r["doc_id"]: line_dedup.kept_text(r["text"], r["keep_bitmap"])[2] for r in out}
    assert kept[0] == "same\nown 0\nsame" or kept[0] == "same\nown 0"
    assert all(kept[i] == "own %d" % i for i in range(1, 40)) and kept[40] == "" and kept[42] == ""


def test_line_dedup_edges(spark):
    docs = frame(spark, ["a\nb", "a\nb", "a\nc", None], [1, 1, None, 4])
    rows = line_dedup.line_dedup(docs, min_docs=2, keep="none").collect()
    assert sorted((str(r["doc_id"]), line_dedup.kept_text(r["text"], r["keep_bitmap"])[2]) for r in rows) == [("1", "b"), ("1", "b"), ("4", ""), ("None", "c")]
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0
    out = line_dedup.drop_lines(line_dedup.line_dedup(docs, min_docs=2, keep="none"))
    assert out.columns == docs.columns and sorted(str(r["text"]) for r in out.collect()) == ["None", "b", "b", "c"]


def brute_fp(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    g = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(fps, alike=lambda i, j: False):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 or alike(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def near_texts():
    r = random.Random(9)
    out = [None, "", "one", "ONE", "a b"]
    for _ in range(12):
        base = [str(r.randint(0, 9999)) for _ in range(300)]
        for _ in range(r.randint(1, 8)):
            w = list(base)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(300)] = str(r.randint(0, 9999))
            out.append(" ".join(w))
    return out


def test_simhash_components_match_brute_force(spark):
    texts = near_texts()
    fps = [brute_fp(t) for t in texts]
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_components(frame(spark, texts)).collect()}
    assert got == {i: x for i, x in enumerate(zip(fps, brute_components(fps)))}


@pytest.mark.parametrize("block", [8, 2048])
def test_links_of_crowded_postings_stay_exact(spark, block):
    r = random.Random(block)
    fps = {0}
    for _ in range(150):
        f = r.choice(sorted(fps)) if r.random() < 0.7 else r.getrandbits(64)
        for _ in range(r.randint(1, 5)):
            f ^= 1 << r.choice([1, 2, 3, 9, 17, 40, 41, 42, 63])
        fps.add(f)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    at = {simhash._signed(f): i for i, f in enumerate(fps)}
    edges = [(at[x["a"]], at[x["b"]]) for x in simhash.near_links(df, block=block).collect()]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        assert (fps[a] ^ fps[b]).bit_count() <= 3
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert [find(i) for i in range(len(fps))] == brute_components(fps)


def test_the_tally_decides_what_is_verified():
    r = random.Random(6)
    words = np.array([[r.getrandbits(64) for _ in range(4)] for _ in range(40)], dtype=np.uint64)
    for i in range(1, 40, 2):  # pairs that share from 0 to 32 bytes
        flip = [0 if k < i % 33 else r.randint(1, 255) for k in range(32)]
        words[i] = words[i - 1] ^ np.frombuffer(bytes(flip), dtype=np.uint64)
    shared = lambda a, b: sum(x == y for x, y in zip(a.tobytes(), b.tobytes()))
    assert simhash.tally(words[0] ^ words[1]) == shared(words[0], words[1])
    for least in (1, 4, 9, 32):
        i, j, x = simhash.retained(words, least)
        assert sorted(zip(i.tolist(), j.tolist())) == [(a, b) for a in range(40) for b in range(a + 1, 40) if shared(words[a], words[b]) >= least]
        assert all((x[k] == (words[i[k]] ^ words[j[k]])).all() for k in range(len(i)))
    near = np.array([[0], [0x010101]], dtype=np.uint64)  # three bits in three bytes
    assert simhash._tree(near, 5, 3) == [(0, 1)] and simhash._tree(near, 6, 3) == [] and simhash._tree(near, 5, 2) == []
    assert list(simhash._crowded(near, np.array([0]), np.array([2]), 5, 3)) == [True] and list(simhash._crowded(near, np.array([0]), np.array([2]), 6, 3)) == [False]


def brute_similar(texts, k=5, least=0.8):
    """Components over texts that share ``least`` of their distinct k-word shingles."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)})
    return brute_components([15 << 4 * i for i in range(len(sets))], lambda i, j: len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]))


def edited(r, words, n):
    w = list(words)
    for _ in range(n):
        w[r.randrange(len(w))] = str(r.randint(0, 9999))
    return " ".join(w)


@pytest.mark.parametrize("block", [8, 1024])
def test_similar_components_match_brute_force(spark, block):
    r = random.Random(3)
    texts = [None, "", " \n", "one", "ONE", "a b", "a b c d e", "a b c d f"]
    base = [str(r.randint(0, 9999)) for _ in range(200)]
    texts += [edited(r, base, r.randint(0, 9)) for _ in range(60)]  # a crowded group, some of it below 0.8
    for _ in range(25):
        base = [str(r.randint(0, 9999)) for _ in range(r.randint(60, 300))]
        texts += [" ".join(base)] + [edited(r, base, r.randint(1, len(base) // 40)) for _ in range(r.randint(0, 3))]
    texts += texts[30:34] + ["x y z " * 5_000, "x y z " * 5_001]
    got = {x["d"]: x["component_id"] for x in simhash.similar_components(frame(spark, texts), block=block).collect()}
    want = brute_similar(texts)
    apart = sum(got[i] != c for i, c in enumerate(want))
    assert all(want[i] == want[c] for i, c in got.items()) and apart <= 2, apart  # nothing is linked that should not be


def test_bridges_join_what_near_pairs_of_components_join():
    r = random.Random(4)
    for _ in range(30):
        n = r.randint(1, 60)
        seeds = [[r.getrandbits(64) for _ in range(4)] for _ in range(4)]
        words = np.array([[w ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 4))) & (1 << 64) - 1 for w in r.choice(seeds)] for _ in range(n)], dtype=np.uint64)
        comp = np.array([r.choice([1, 1, 1, 5, 7, 100 + i]) for i in range(n)])
        near = lambda i, j: simhash.tally(words[i] ^ words[j]) >= 4 and int(np.bitwise_count(words[i] ^ words[j]).sum()) <= 12  # noqa: E731, B023
        alike = lambda i, j: comp[i] == comp[j] or near(i, j)  # noqa: E731, B023
        want = brute_components([15 << 4 * i for i in range(n)], alike)
        edges = simhash._bridges(words, comp, 4, 12)
        assert all(comp[i] != comp[j] and near(i, j) for i, j in edges) and len(edges) < len(set(comp.tolist()))
        linked = {(min(e), max(e)) for e in edges}
        assert brute_components([15 << 4 * i for i in range(n)], lambda i, j: comp[i] == comp[j] or (j, i) in linked) == want
        rank = np.array([r.randrange(100) if r.random() < 0.3 else -1 for _ in range(n)])
        led = simhash._followers(words, rank, 4, 12)
        assert all(rank[j] >= 0 and near(i, j) for i, j in led)
        assert {i for i, _ in led} == {i for i in range(n) if any(rank[j] >= 0 and j != i and near(i, j) for j in range(n))}


def test_a_dense_group_is_one_component(spark):
    r = random.Random(5)
    base = [str(r.randint(0, 9999)) for _ in range(120)]
    texts = [edited(r, base, r.randint(1, 2)) for _ in range(300)] + [" ".join(str(r.randint(0, 9999)) for _ in range(90)) for _ in range(30)]
    got = {x["d"]: x["component_id"] for x in simhash.similar_components(frame(spark, texts), block=32).collect()}
    want = brute_similar(texts)
    assert sum(got[i] != c for i, c in enumerate(want)) <= 3 and all(want[i] == want[c] for i, c in got.items())


@pytest.mark.parametrize("block", [16, 1024])
def test_no_pair_that_reaches_the_share_is_left_out(spark, block):
    r = random.Random(11)
    number = lambda: str(r.randint(0, 999_999))
    texts = []
    for _ in range(150):  # 36 of 44 or 45 shingles and near it: just over and just under four fifths
        base = [number() for _ in range(44)]
        texts += [" ".join(base), " ".join([*base[: r.randint(39, 41)], *[number() for _ in range(4)]])]
    chain = [number() for _ in range(400)]  # each is like the next alone
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 340, 5)]
    base = [number() for _ in range(80)]  # a crowded group about the share, and what all its texts have
    texts += [edited(r, base, r.randint(0, 3)) for _ in range(90)]
    got = {x["d"]: x["component_id"] for x in simhash.similar_components(frame(spark, texts), block=block).collect()}
    assert [got[i] for i in range(len(texts))] == brute_similar(texts)


def test_sets_that_share_enough_meet_in_a_list_and_are_not_ruled_out():
    r = np.random.default_rng(12)
    for _ in range(200):
        n, least = int(r.integers(1, 300)), float(r.choice([0.5, 0.8, 0.9, 1.0]))
        a = r.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[int(r.integers(0, n // 6 + 1)) :], r.integers(0, 1 << 63, int(r.integers(0, n // 8 + 1))).astype(np.uint64)])
        sets = [np.unique(a), np.unique(b)]
        shared = len(np.intersect1d(*sets))
        assert simhash._shared(sets)[0, 1] == shared
        hashes, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
        some = np.unique(simhash._part(r.choice(hashes, 1 + len(hashes) // 3)))
        frequent = some, r.integers(3, 60, len(some)).astype(np.uint8)
        at = simhash._prefix(hashes, sizes, frequent, least)
        meet = set(hashes[at[at < sizes[0]]].tolist()) & set(hashes[at[at >= sizes[0]]].tolist())
        words = np.stack([simhash._parities(x) for x in sets]).view(np.uint64)
        if shared >= least * (sizes.sum() - shared):
            assert meet and len(simhash._possible(words, sizes, least)[0]) == 1
            assert simhash._joining(sets, np.array([7, 9]), least) == [(0, 1)]
        else:
            assert simhash._joining(sets, np.array([7, 9]), least) == []
        assert simhash._joining(sets, np.array([7, 7]), least) == []


def test_one_of_each_passes_any_columns(spark):
    r = random.Random(8)
    base = [str(r.randint(0, 9999)) for _ in range(100)]
    one, two, other = " ".join(base), edited(r, base, 1), edited(r, base, 60)
    rows = [(5, one), (3, two), (9, one), (3, two), (None, one), (None, "alone here"), (7, None)]
    df = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    for c in ("d", "th", "_d", "__d", "__th", "__row", "sid", "component_id", "f0", "a.b"):
        df = df.withColumn(c, F.lit(1))
    out = simhash.one_of_each(df)
    assert out.columns == df.columns and other
    assert sorted(str(x["doc_id"]) for x in out.collect()) == ["3", "7", "None", "None"]
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_simhash_edges(spark):
    docs = frame(spark, ["x y z", "x y z", "x y z", None], [7, None, 3, None])
    got = sorted(((str(r["doc_id"]), r["component_id"]) for r in simhash.near_components(docs).collect()), key=str)
    assert [g[0] for g in got] == ["3", "7", "None", "None"] and [g[1] for g in got[:2]] == [3, 3]
    assert simhash.near_components(docs.limit(0)).count() == 0
