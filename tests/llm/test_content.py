"""Fingerprints, secret scans, language id and HTML extraction on small tables."""

import base64
import itertools
import random

import pytest
from pyspark.sql import functions as F

from framelake.llm import html_extract, lang_id, secret_scan, winnowing

from .test_filters import corpus, frame


def brute_marks(text, k=4, w=8, unit=4):
    import re

    import xxhash

    u = re.findall(r"[^\x20\x09-\x0D]{1,%d}" % unit, text or "")

    turn = lambda x, n: (x << n | x >> 64 - n) & (1 << 64) - 1
    one = [xxhash.xxh64_intdigest(p.encode(), 42) for p in u]
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    if not u:
        return []
    if len(u) < k:
        whole = 42
        for p in u:
            whole = xxhash.xxh64_intdigest(p.encode(), whole)
        h = [signed(whole)]
    else:
        state, h = 0, []
        for i, x in enumerate(one):  # one unit in, one out
            state = turn(state, 1) ^ x ^ (turn(one[i - k], k) if i >= k else 0)
            if i >= k - 1:
                h.append(signed(state))
    top = lambda v: v >> 30
    out = []
    for i in range(max(1, len(h) - w + 1)):
        win = range(i, min(len(h), i + w))
        at = min(win, key=lambda j: (top(h[j]), -j))
        if at not in out:
            out.append(at)
    return [(p, h[p]) for p in out]


def test_winnowing_matches_brute_force(spark):
    texts = corpus(11, 40) + ["y" * 300, "ab ab ab ab ab ab ab ab ab ab ab ab ab"]
    df = frame(spark, texts).withColumns({c: F.lit(1) for c in ("d", "th", "x", "head", "own", "marks", "copies", "rank")})
    rows = winnowing.edited_fingerprints(df).collect()
    marked = {r["doc_id"]: [(m["pos"], m["hash"]) for m in r["m"]] for r in frame(spark, texts).select("doc_id", winnowing.marks(F.col("text")).alias("m")).collect()}
    shown = lambda x: "".join("%08x" % (v >> 32 & 0xFFFFFFFF) for _, v in x)
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts)
    sim = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    marks = {}
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert r["edited"] == edited and r["n_chars"] == len(t)
        want, ed, nx = brute_marks(t), brute_marks(edited), brute_marks(nxt)
        assert r["fingerprint"] == shown(want) and r["edited_fingerprint"] == shown(ed), t[:60]
        assert marked[i] == want
        for steps, w in ((r["steps"], want), (r["edited_steps"], ed)):
            assert list(itertools.accumulate(steps)) == [p for p, _ in w] and max(steps, default=0) <= 8
        hs = lambda x: {v >> 32 for _, v in x}
        assert r["near_edited"] == pytest.approx(sim(hs(want), hs(ed))) and r["near_next"] == pytest.approx(sim(hs(want), hs(nx)))
        marks[t] = want


def test_winnowing_guarantee():
    r = random.Random(2)
    shared = [str(r.randint(1000, 9999)) for _ in range(11)]  # w + k - 1 units
    for _ in range(30):
        a, b = ([str(r.randint(1000, 9999)) for _ in range(r.randint(0, 30))] for _ in range(2))
        one, two = (brute_marks(" ".join(x + shared + y)) for x, y in ((a, b), (b, a)))
        assert {h for _, h in one} & {h for _, h in two}


@pytest.mark.parametrize("k", [1, 2, 3, 5, 7, 8])
def test_hashes_roll_for_any_k(spark, k):
    texts = corpus(12, 8)
    for w in (1, 6):
        got = [[(m["pos"], m["hash"]) for m in x["m"]] for x in frame(spark, texts).orderBy("doc_id").select(winnowing.marks(F.col("text"), k=k, w=w).alias("m")).collect()]
        assert got == [brute_marks(t, k, w) for t in texts]


def test_winnowing_edges(spark):
    rows = winnowing.edited_fingerprints(frame(spark, ["same words here", "same words here", None, "z"], [4, 4, None, 9])).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["4", "4", "9", "None"]
    assert sorted(r["near_next"] for r in rows if r["doc_id"] == 4) == [0.0, 1.0]
    assert winnowing.edited_fingerprints(frame(spark, ["a"]).limit(0)).count() == 0
    one = winnowing.edited_fingerprints(frame(spark, ["only one text"])).collect()[0]
    assert one["near_next"] == 1.0 and one["edited"] == "only on" + "only o"
    d = frame(spark, ["a b", "a b", "a c"]).select(winnowing.printed(winnowing.hashes(winnowing.marks(F.col("text")))).alias("d"))
    assert len({r["d"] for r in d.collect()}) == 2


def test_winnowing_rolls_over_unspaced_runs(spark):
    import re

    r = random.Random(3)
    han = [chr(c) for c in [*range(0x4E00, 0x4F00), 0x20001]]
    code = [chr(c) for c in range(0x21, 0x7F)] + ["\U0001f600"]
    for signs in (han, code):
        text = lambda n: "".join(r.choices(signs, k=n))  # noqa: E731, B023
        shared = text(11)  # w + k - 1 units
        runs = [text(24 + i) + shared + text(30) for i in range(4)] + ["short words and " + text(25) + " a-word-of-24-characters" + " x" * 9, "x" * 25 + " " + "y" * 24]
        if signs is han:  # short runs of such scripts too
            runs[3] = text(2) + shared + " " + text(1)
        found = [[(m["pos"], m["hash"]) for m in x["m"]] for x in frame(spark, runs).orderBy("doc_id").select(winnowing.marks(F.col("text"), roll=24).alias("m")).collect()]
        assert all({h for _, h in a} & {h for _, h in b} for a in found[:4] for b in found[:4])
        for t, got in zip(runs, found):
            parts = [p for w in re.findall("[%s]|[^ %s]+" % ("".join(han), "".join(han)), t) for p in (*re.findall(".{1,4}", w[:24]), *w[24:])]
            assert got == brute_marks(" ".join(parts)), t
    plain = frame(spark, ["Plain words, none of them long, and élan."]).select(winnowing.marks(F.col("text"), roll=24).alias("a"), winnowing.marks(F.col("text")).alias("b")).first()
    assert plain["a"] == plain["b"]
    # A run that grows keeps its units, so all of its marks but those of the last windows.
    grows = [text(n) for n in (24,)] + [text(40)]
    grows += [grows[0] + text(1), grows[1] + text(1)]
    found = [{m["hash"] for m in x["m"]} for x in frame(spark, grows).orderBy("doc_id").select(winnowing.marks(F.col("text"), k=2, w=2, roll=24).alias("m")).collect()]
    assert all(len(a - b) <= 1 for a, b in zip(found, found[2:])) and all(found)
    near = winnowing.edited_fingerprints(frame(spark, runs[:2]), roll=24).collect()
    assert all(x["near_next"] > 0 for x in near)


def test_pattern_spans():
    text = 'x PassWord = "hunter2!!" token: abcd.efgh-1 é api_key:"AKIAABCDEFGHIJKL9" ' + "0a" * 20 + " secret=short"
    kinds = [(secret_scan.KINDS[k], text[s:e]) for k, s, e in secret_scan.pattern_spans(text)]
    assert kinds == [("assign", "token: abcd.efgh-1"), ("assign", 'api_key:"AKIAABCDEFGHIJKL9'), ("access", "AKIAABCDEFGHIJKL9"), ("hex", "0a" * 20)]
    assert secret_scan.pattern_spans("toKen=12345678")[0][0] == 0 and not secret_scan.pattern_spans("toKen=12345678")
    assert not secret_scan.pattern_spans("token: token: abcdefgh12")
    assert secret_scan.pattern_spans("AKIA" + "A" * 11) == [] and len(secret_scan.pattern_spans("f" * 31)) == 0


def test_random_tokens_are_found_and_prose_is_not(spark):
    r = random.Random(5)
    keys = [base64.b64encode(r.randbytes(n)).decode().rstrip("=") for n in (24, 30, 33, 48, 60) for _ in range(6)]
    prose = ["Thinonwhreederonhein counterrevolutionaryTendencies /usr/share/documentation/readme-first 2021-01-01-2022-02-02", "aaaaaaaaaaaaaaaaaaaaaaaaB1aaaaaaaaaaaa", None, ""]
    keys += [r.randbytes(20).hex().upper() for _ in range(6)]
    docs = frame(spark, ["pre %s post" % k for k in keys] + prose * 5)
    out = {x["doc_id"]: x for x in secret_scan.secret_spans(docs).collect()}
    found = [i for i in range(len(keys)) if any(s["kind"] == 3 for s in out[i]["spans"])]
    assert len(found) >= 0.7 * len(keys)
    for i in found:
        s = [s for s in out[i]["spans"] if s["kind"] == 3][0]
        assert ("pre %s post" % keys[i])[s["start"] : s["end"]] == keys[i]
    assert all(not out[i]["spans"] for i in range(len(keys), len(keys) + len(prose) * 5))
    assert secret_scan.secret_spans(docs.limit(0)).count() == 0


def test_keys_of_one_case_with_digits_are_tested(spark):
    r = random.Random(6)
    low, up = "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    keys = ["".join(r.choices(a, k=n)) for a in (low, up) for n in (32, 40, 48, 64) for _ in range(6)]
    short = [r.randbytes(14).hex() for _ in range(20)]
    parts = ["-".join("".join(r.choices(low, k=4)) for _ in range(9)) for _ in range(5)]
    assert all(secret_scan.battery(k) for k in keys + short + parts)
    assert {secret_scan.encoding(k) for k in keys} <= {secret_scan._BASE36, secret_scan._BASE32, secret_scan._HEX_DIGITS}
    words = ["counterrevolutionaries", "COUNTERREVOLUTIONARIES", "Counterrevolutionaries", "some-plain-words-and-2021-numbers"]
    assert not any(secret_scan.encoding(w) for w in words)
    out = {x["doc_id"]: x for x in secret_scan.secret_spans(frame(spark, keys + short)).collect()}
    hit = lambda ids: sum(any(s["kind"] == 3 for s in out[i]["spans"]) for i in ids)
    assert hit(range(len(keys))) >= 0.6 * len(keys) and hit(range(len(keys), len(keys) + len(short))) > 0


def test_language_by_compression(spark):
    r = random.Random(8)
    vocab = {"en": "the of and that with this from have they which house water".split(), "de": "der die und nicht mit sich auch eine haus wasser über".split(), "fr": "le les des est dans pour qui maison avec été eau".split()}
    rows = [(i, " ".join(r.choices(vocab[k], k=60)), k) for i, k in enumerate(list(vocab) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    d = lang_id.train(docs.where("doc_id < 90"))
    assert set(d) == set(vocab) and all(len(v) <= 1 << 18 for v in d.values())
    test = docs.where("doc_id >= 90").unionByName(spark.createDataFrame([(1000, None, "en"), (1001, "12 !", "en"), (1002, "", None)], docs.schema))
    out = {x["doc_id"]: x for x in lang_id.classify(test, d).collect()}
    assert sum(out[i]["lang_pred"] == k for i, _, k in rows[90:]) / len(rows[90:]) > 0.97
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert all(0 <= x["score"] <= 1 for x in out.values())
    none = lang_id.classify(test, lang_id.train(docs.limit(0))).collect()
    assert {x["lang_pred"] for x in none} == {"und"}


def test_languages_of_the_table_are_told(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    out = lang_id.classify(docs.where(held), lang_id.train(docs.where(~held)))
    right = out.join(docs.select("doc_id", "lang"), "doc_id").where("lang_pred <> 'und'")
    n, ok = right.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 200 and ok >= 0.97 * n, (n, ok)
    rows = [(1, "der die und " * 400_000, "de"), (2, "the of and " * 20, "en"), (2, "the of and " * 20, "en"), (3, "der die und " * 20, "de")]
    few = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("x", "k", "u", "t", "n", "score", "lang_pred")})
    d = lang_id.train(few)
    assert len(d["de"]) < 1_000 and d["en"].count(b"the") == 20  # whole texts, each once
    assert [(r["doc_id"], r["lang_pred"]) for r in lang_id.classify(few, d).orderBy("doc_id").collect()] == [(1, "de"), (2, "en"), (2, "en"), (3, "de")]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="cookie-notice">we use cookies</div><!-- <p>gone</p> -->
<article><header><h1>Title &amp;  <em>more</em></h1></header><p>One<b>bold</b> &lt;x&gt;<br>two <p>three&nbsp;four<div class="ad">buy</div><ul><li>i1<li>i2</ul>
<form><input><p>mail</p></form></article><section class="comments"><p>first!</p></section><footer>&copy; f</footer></body></html>"""


def test_main_text_of_an_article():
    assert html_extract.main_text(PAGE) == "Title & more\n\nOnebold <x> two\n\nthree four\n\ni1\n\ni2"
    assert html_extract.main_text(None) == html_extract.main_text("") == ""
    assert html_extract.main_text("<p>open <b>tags") == "open tags"
    assert html_extract.main_text('<p>a <span class="ad">x</span> b</p>') == "a b"


def test_wrapper_of_a_host_without_articles(spark):
    page = "<html><body><div class='top'>Site name</div><div class='content'><h2>{0}</h2><p>body {0} text</p>{1}</div><div class='box'>About us</div></body></html>"
    pages = [(i, "http://h.example/%d" % i, page.format("number %d" % i, "<p>extra %d</p>" % i * (i % 3))) for i in range(12)]
    df = spark.createDataFrame(pages + [(90, None, None), (91, "bad url", "<p>x"), (92, "http://one.example/", "<div>only</div>")], "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert out[4] == "number 4\n\nbody number 4 text\n\nextra 4" and out[90] == "" and out[91] == "x" and out[92] == "only"
    w = html_extract.infer([p[2] for p in pages[:5]])
    items, at = w["region"][-1]
    assert items[at][0] == "div.content" and "#TEXT" in w["expression"] and ")+" in w["expression"]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_wrappers_of_deep_and_long_pages():
    page = "<html><body>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "".join(f"<h2>t{i}</h2><p>x{i}</p>" for i in range(1500)) + "</body></html>"
    assert html_extract.infer([page, page])["expression"]
    assert html_extract.main_text(page).startswith("deep\n\nt0\n\nx0")


LINKS = "page_id long, url string, html string"


def extracted(spark, pages):
    rows = [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, LINKS)).collect()}


def test_a_wrapper_holds_beside_and_inside_articles(spark):
    article = "<body><article><h1>title {0}</h1><p>own words {0}</p><p>Share this with a friend</p></article></body>"
    plain = "<body><div class='top'>Site name</div><div class='content'><h2>number {0}</h2><p>body {0}</p></div><div class='box'>About us</div></body>"
    out = extracted(spark, [(article if i % 2 else plain).format(i) for i in range(12)])
    assert out[1] == "title 1\n\nown words 1" and out[2] == "number 2\n\nbody 2"


def test_copies_do_not_make_a_template(spark):
    copy = "<div class='content'><h2>T</h2><p>P</p></div>"
    assert extracted(spark, [copy, copy]) == {0: "T\n\nP", 1: "T\n\nP"}
    others = ["<div class='content'><h2>t%d</h2><p>p%d</p></div>" % (i, i) for i in range(8)]
    out = extracted(spark, [copy] * 20 + others)
    assert out[0] == "T\n\nP" and out[25] == "t5\n\np5"
    mixed = ["<body><div class='%s'><h2>t%d</h2><p>p%d</p><p>Notice of %s</p></div></body>" % (c, i, i, c) for c, n in (("a", 30), ("b", 9)) for i in range(n)]
    out = extracted(spark, mixed)
    assert out[3] == "t3\n\np3" and out[32] == "t2\n\np2"


def test_rules_that_are_joined_give_what_rules_sent_to_tasks_give(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    odd = spark.createDataFrame([(-1, None, None), (-2, "bad url", "<p>x"), (-2, "bad url", "<p>x"), (None, "http://one.example/", "")], LINKS)
    # A host whose pages have a template each, with a notice that all of them share.
    own = spark.createDataFrame([(10_000 + i, f"http://own.example/{i}", f"<body><div class='c{i}'><h2>t{i}</h2><p>own words of page {i}</p></div><div><p>Notice to all</p></div></body>") for i in range(40)], LINKS)
    rows = pages.select("page_id", "url", "html").unionByName(odd).unionByName(own)
    texts = lambda df: sorted((repr(r["page_id"]), r["text"]) for r in df.collect())
    sent, joined = html_extract.extract(rows), html_extract.extract(rows, small_rules=0)
    assert texts(sent) == texts(joined) and sent.count() == rows.count()
    found = {r["page_id"]: r["text"] for r in joined.where("page_id >= 10000").collect()}
    assert found == {10_000 + i: f"t{i}\n\nown words of page {i}" for i in range(40)}
    rules = html_extract.template_rules(own).collect()
    assert len(rules) == 40 and all(len(r["fixed"]) == 1 for r in rules)


def test_pages_kept_for_wrappers_are_held_by_their_length():
    import pyarrow as pa

    pages = ["<div class='a%d'><p>%s</p></div>" % (i, "x" * 500) for i in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(["h"] * 20), pa.array(pages)], names=["host", "html"])
    out = list(html_extract._contents(6, held=2_000)(iter([batch])))
    kept = [[p for p in b.column(4).to_pylist() if p is not None] for b in out]
    assert sorted(p for b in kept for p in b) == sorted(pages) and max(map(len, kept)) == 4


def test_near_copies_keep_their_text(spark):
    body = "".join("<p>paragraph %d of a text that some pages share</p>" % i for i in range(9))
    page = "<body><article><h1>t</h1>%s<p>edit %d</p></article></body>"
    pages = [page % (body, i) for i in range(5)] + ["<body><article><h1>other</h1><p>words %d</p></article></body>" % i for i in range(2)]
    out = extracted(spark, pages)
    assert all(out[i].count("paragraph") == 9 and out[i].endswith(f"edit {i}") for i in range(5)) and out[6] == "other\n\nwords 1"


def test_long_and_many_fixed_texts_are_dropped(spark):
    notices = "".join("<p>fixed line %d</p>" % i for i in range(70)) + "<p>%s</p>" % ("legal " * 80)
    out = extracted(spark, ["<body><nav>menu</nav><div><h2>t%d</h2><p>p%d</p></div><div>%s</div></body>" % (i, i, notices) for i in range(6)])
    assert out == {i: "t%d\n\np%d" % (i, i) for i in range(6)}


def brute_common(x, y):
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_matches_brute_force():
    r = random.Random(1)
    for n in [0, 1, 2, 5, 9, 17, 40] * 20:
        x, y = ([r.choice("abcd#") for _ in range(r.randint(0, n))] for _ in range(2))
        found = html_extract.align(x, y)
        assert len(found) == brute_common(x, y) and all(x[i] == y[j] for i, j in found)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(found, found[1:]))
    assert len(html_extract.align(list("ab") * 2_000, list("ba") * 2_000)) == 3_999


def random_page(r):
    item = lambda: r.choice(["<p>w%d</p>", "<h2>w%d</h2>", "<ul><li>w%d</li><li>x</li></ul>", "<dl><dt>w%d</dt><dd>y</dd></dl>"]) % r.randint(0, 3)
    pairs = "".join("<h3>t%d</h3><p>u</p>" % r.randint(0, 9) for _ in range(r.randint(0, 4)))
    return "<html><body><div class=top>Site</div><div class=content>%s%s</div>%s</body></html>" % ("".join(item() for _ in range(r.randint(0, 5))), pairs, "<div class=more>m</div>" * r.randint(0, 1))


def test_a_wrapper_is_an_expression_of_its_pages():
    import re

    r = random.Random(2)
    for n in (1, 2, 3, 6):
        for _ in range(25):
            pages = [random_page(r) for _ in range(n)]
            w = html_extract.wrapper(pages)
            assert "|" not in re.sub(r"\\.", "", w.pattern())  # free of unions
            for p in pages:
                assert re.fullmatch(w.pattern(), html_extract.stream(html_extract.page_tree(p))), (p, w.expression())


def test_every_page_of_the_table_comes_through_its_wrapper(spark):
    import json

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = html_extract.wrappers(pages).collect()
    assert all(json.loads(w["region"]) and "#TEXT" in w["expression"] for w in found if w["n"] > 1)
    ways = {(w["host"], w["template"]): json.loads(w["region"]) for w in found}
    rows = pages.select("html", html_extract.host(F.col("url")).alias("host")).collect()
    many = {h for h in {x["host"] for x in rows} if sum(x["host"] == h for x in rows) > 1}
    decided = set()
    for x in rows:
        root = html_extract.page_tree(x["html"])
        at = html_extract.locate(root, ways[x["host"], html_extract.template(root)])
        assert [k.tag for k, _, _ in at] == ["article"]
        decided.add(x["host"])
    assert many and many <= decided


def test_names_are_hints_and_not_words_in_names(spark):
    page = "<html><body><form><div class=top>Site</div><article class='post'><header class='article-header'><h1>T{0}</h1></header><p>own {0} text</p><div class='search-results'><p>found {0}</p></div><div class='related-work'><p>work {0}</p></div><div class='related-posts'><p>see {0}</p></div><div class='post-comments'><p>first {0}</p></div></article><article class=teaser><p>tea {0}</p></article><article class=small><p>z{0}</p></article></form></body></html>"
    out = extracted(spark, [page.format(i) for i in range(5)])
    assert out == {i: f"T{i}\n\nown {i} text\n\nfound {i}\n\nwork {i}" for i in range(5)}
    assert html_extract.main_text("<form><p>one</p><p>two</p></form>") == "one\n\ntwo"
    hidden = "<p>a <span class=ad>x <span>y</span> z</span> b<i hidden>never closed</p><p>c</p>"
    assert html_extract.main_text(hidden) == "a b\n\nc"


def test_a_long_page_and_odd_columns(spark):
    long = "<html><body><article><h1>t</h1>%s</article></body></html>" % "".join(f"<p>words of paragraph {i}</p>" for i in range(150_000))
    df = spark.createDataFrame([(1, "http://a.example/", long), (2, "http://a.example/", long), (3, "http://a.example/", None), (3, "http://a.example/", "<p>x")], LINKS)
    for c in ("text", "host", "h", "rules", "blocks", "content", "template", "n_chars", "_k"):
        df = df.withColumn(c, F.lit(1))
    out = sorted((r["page_id"], r["n_chars"]) for r in html_extract.extract(df).collect())
    want = 1 + sum(2 + len(f"words of paragraph {i}") for i in range(150_000))
    assert out == [(1, want), (2, want), (3, 0), (3, 1)]


def planted(r, kind, n):
    raw = r.randbytes(n)
    if kind == "b36":
        return "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    return raw.hex() if kind == "hex" else (base64.b32encode(raw) if kind == "b32" else base64.b64encode(raw)).decode().rstrip("=")


PLAIN = "getElementByIdAndNameFromTheList AbstractSingletonProxyFactoryBean article-12345-how-to-do-x9-things GL_TEXTURE_2D_MULTISAMPLE_ARRAY V2ExtendedUserInformationModel img_20210304_112233_burst 550e8400-e29b-41d4-a716-446655440000 deadbeefdeadbeefdead counterrevolutionaryTendencies /2021/03/04/some-news-from-5-places abcdefghijklmnopqrstuvwxyz0123456789".split()


def test_false_discovery_control_matches_brute_force(spark):
    r = random.Random(11)
    keys = [planted(r, k, n) for k, n in (("hex", 12), ("hex", 15), ("b32", 18), ("b32", 30), ("b64", 15), ("b64", 30), ("b64", 45), ("b36", 24), ("b36", 60)) for _ in range(8)]
    texts = ["see %s and %s" % (k, r.choice(PLAIN)) for k in keys] + PLAIN * 3 + ['token = "%s"' % planted(r, "hex", 20) for _ in range(9)] + [None, ""]
    tested = []
    for i, t in enumerate(texts):
        base = secret_scan.pattern_spans(t or "")
        for m in secret_scan._TOKEN.finditer(t or ""):
            p = None if secret_scan._word(m[0]) else secret_scan.battery(m[0])
            if p and p[0] >= 0.001:
                tested.append((secret_scan.band(len(m[0])), max(0, int(10 * p[1])), i, m.span(), any(s < m.end() and m.start() < e for _, s, e in base)))
    passed = set()
    for b in range(4):
        mine = sorted((x for x in tested if x[0] == b), key=lambda x: -x[1])
        least = [x[1] for k, x in enumerate(mine) if len(mine) * 10 ** (-x[1] / 10) <= 0.01 * sum(y[1] >= x[1] for y in mine)]
        passed |= {x[2:] for x in mine if least and x[1] >= min(least)}
    out = {x["doc_id"]: x for x in secret_scan.secret_spans(frame(spark, texts)).collect()}
    got = {(i, (s["start"], s["end"])) for i, x in out.items() for s in x["spans"] if s["kind"] == 3}
    assert got == {(i, span) for i, span, own in passed if not own}
    for i, x in out.items():
        assert x["n_tested"] == sum(t[2] == i for t in tested) and x["n_confirmed"] == sum(p[0] == i and p[2] for p in passed)
    assert sum(x["n_confirmed"] for x in out.values()) >= 8


def test_planted_keys_are_caught_and_plain_tokens_left(spark):
    r = random.Random(12)
    kinds = [("hex", 15), ("b32", 30), ("b64", 24), ("b36", 40)]
    keys = [planted(r, k, n) for k, n in kinds for _ in range(50)]
    texts = ["a %s b" % k for k in keys] + ["a %s b" % x for x in PLAIN]
    out = {x["doc_id"]: [(s["start"], s["end"]) for s in x["spans"] if s["kind"] == 3] for x in secret_scan.secret_spans(frame(spark, texts)).collect()}
    for q, k in enumerate(kinds):
        assert sum(out[i] == [(2, 2 + len(keys[i]))] for i in range(50 * q, 50 * q + 50)) >= 45, k
    assert sum(bool(out[i]) for i in range(len(keys), len(texts))) <= 1


def test_a_dump_of_keys_takes_one_sweep(spark):
    import time

    r = random.Random(13)
    text = " ".join(planted(r, "hex", 20) for _ in range(50_000)) + " " + "aB3" * 300_000
    df = frame(spark, [text]).withColumns({c: F.lit(1) for c in ("base", "found", "spans", "x", "own")})
    began = time.perf_counter()
    row = secret_scan.secret_spans(df).collect()[0]
    assert len(row["base"]) == 50_000 and row["n_confirmed"] > 49_000 and time.perf_counter() - began < 60
    assert secret_scan._log_tail(40) == pytest.approx(-804.6, abs=0.1) and secret_scan._log_at_least(3_000, 5_000, 0.3) < -500


def test_headings_that_pages_share_stay(spark):
    page = lambda i: f"<body><nav>Home</nav><article><h1>Report {i}</h1><h2>Introduction</h2><p>First part of {i}, at some length.</p><h2>Summary</h2><h3>In short</h3><p>Second part of {i}.</p><h2>About us</h2><p>We write reports.</p></article></body>"
    for n in (2, 6, 9):
        df = spark.createDataFrame([(i, f"http://h.example/{i}", page(i)) for i in range(n)], "page_id long, url string, html string")
        for r in html_extract.extract(df).collect():
            i = r["page_id"]
            want = [f"Report {i}", "Introduction", f"First part of {i}, at some length.", "Summary", "In short", f"Second part of {i}."]
            assert r["text"].split("\n\n")[:6] == want and ("We write reports." in r["text"]) == ("About us" in r["text"])


def test_own_blocks_are_those_of_the_rule():
    r = random.Random(8)
    for _ in range(2_000):
        blocks = [(str(i), 0, r.randint(0, 5), r.choice([0, 0, 0, 1, 2, 3])) for i in range(r.randint(0, 12))]
        fixed = set(r.sample(range(6), 3))
        want = []
        for i, b in enumerate(blocks):
            upto = next((j for j in range(i + 1, len(blocks)) if 0 < blocks[j][3] <= b[3]), len(blocks))
            if b[2] not in fixed or (b[3] and any(x[3] == 0 and x[2] not in fixed for x in blocks[i + 1 : upto])):
                want.append(b)
        assert html_extract._own(blocks, fixed) == want


def test_formulas_are_text():
    assert html_extract.main_text("<article><p>Maths: <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>TeX</annotation></math> done</p></article>") == "Maths: x=2 done"


def test_wrappers_find_articles_without_names(spark):
    """The table with its articles renamed and its class names hashed: the wrapper's region is all there is."""
    import hashlib
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    name = lambda m: 'class="%s"' % " ".join("c" + hashlib.md5(w.encode()).hexdigest()[:8] for w in m[1].split())
    bare = lambda h: re.sub(r'class="([^"]*)"', name, re.sub(r"(</?)(article|main)\b", r"\1div", h))
    rows = [(r["page_id"], r["url"], bare(r["html"])) for r in pages.collect() if r["html"]]
    hidden = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    got = {r["page_id"]: r["text"] for r in html_extract.extract(hidden).collect()}
    wrong = [i for i in got if got[i] != want[i]]
    off = [i for i, _, h in rows if html_extract.main_text(h) != want[i]]
    assert not wrong and off
