"""HTML main-text extraction with wrappers inferred per host.

A page is a stream of tokens: open tags, close tags and texts; parts that tags and names
drop (menus, adverts, comments) are single tokens.  Like neighbours in a stream fold into
repeated groups, of one, two or three elements; then the streams of pages of one host are
aligned one after the other into a union-free regular expression: tokens in step are merged,
those that some pages lack become optional, and texts that differ become slots.  A host's
pages fall into templates by their skeleton of containers, and each template has its wrapper.

Every page is matched against its template's wrapper.  The wrapper's region is the element
that holds most of the text of its slots; the page's text is that of the element that matches
it, wherever it lies: inside a form, beside other articles, or without any article.  Tags and
class names are hints alone: they tell parts that vary from page to page and still are no
article, such as adverts and reader comments.

Texts that a template fixes are dropped, inside the region too.  They are counted over all
pages: a text is fixed if more than half, and ``LEAST`` at least, of the distinct page contents
of a host, or of one of its templates, that have text at its place have this text there.
Headings that pages share stay where text of the page's own follows.

Defined cases: a null or empty page gives an empty text; repeated rows and pages whose host
cannot be read are handled like any other (host ''); broken markup is closed at the end, and
nothing is dropped or kept for being long.  Copies count once.  A page that is alone in its
template, or does not match, is its own wrapper.  A page of which every text is fixed keeps
them, and so does an article of whose text over three quarters is fixed: a near copy of others.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator, Set

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|iframe|svg|annotation-xml|annotation|select|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!?(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_VOID = frozenset("doctype area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr b bdi bdo big cite code data dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br del"
    " math mfenced mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split()
)
_DROP = frozenset("head nav footer aside form button menu dialog object audio video canvas".split())
#: Names of parts that are no main text; a name's last word, or all its words but plain ones, must be here.
_NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored banner promo promotion cookie cookies consent notice notices alert gdpr sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments reply replies respond discussion disqus related recommended share sharing social newsletter subscribe signup login popup modal overlay widget toolbar pagination pager complementary contentinfo search teaser".split()
)
_HEADS = frozenset("header masthead".split())
_PLAIN = frozenset("bar block box bottom container form global group inner item items left link links list main outer page post posts right section site slot top unit wrap wrapper zone".split())
_WITH = frozenset("has no with without".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES_SAME = frozenset("li dt dd tr td th option".split())
_SKELETON = frozenset("div section main article aside nav header footer".split())
#: Elements that a region may be looked for in.
_CONTAINERS = _SKELETON | frozenset("# html body form table tbody tr td center".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
LEAST = 3  # distinct contents that tell a fixed text; two may be copies with an edit
_DEPTH = 150  # elements deeper than this are read as parts of the one at it
_TEXT = "#text"
_KEEP, _HEAD, _DROPPED = 0, 1, 2


class Node:
    """An element: its signature (tag.class), and its elements and texts in order."""

    __slots__ = ("sig", "tag", "state", "kids")

    def __init__(self, sig: str, tag: str, state: int = _KEEP):
        self.sig, self.tag, self.state, self.kids = sig, tag, state, []


def _noise(name: str) -> bool:
    words = [w for w in _SPLIT.split(name) if w and not w.isdigit()]
    if not words or _WITH & set(words):
        return False
    return words[-1] in _NOISE or (bool(_NOISE & set(words)) and all(w in _NOISE or w in _PLAIN for w in words))


def _element(tag: str, attrs: str) -> Node:
    state, first = _DROPPED if tag in _DROP else _HEAD if tag == "header" else _KEEP, ""
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key in ("class", "id", "role"):
            names = value.split()
            if key == "class" and names:
                first = "." + names[0]
            if tag not in ("html", "body", "article", "main"):
                if any(_noise(n) for n in names):
                    state = _DROPPED
                elif state == _KEEP and any(n in _HEADS or n in ("site-header", "page-header") for n in names):
                    state = _HEAD
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            state = _DROPPED
    return Node(tag + first, tag, state)


def page_tree(page: str) -> Node:
    """The page's elements and block texts; inline elements belong to the text around them,
    and those that are dropped leave it."""
    root = Node("#", "#")
    stack, parts = [root], []
    lost: str | None = None  # the dropped inline element, and its like within
    depth = at = 0

    def flush() -> None:
        if parts:
            t = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if t:
                stack[-1].kids.append(t)

    for m in _MARKUP.finditer(page):
        if m.start() > at and not lost:
            parts.append(page[at : m.start()])
        at = m.end()
        if not m[3]:
            continue
        tag, close = m[3].lower(), bool(m[2])
        if lost:
            if tag == lost:
                depth += -1 if close else 1
                if not depth:
                    lost = None
                continue
            if tag in _INLINE or tag in _VOID:
                continue
            lost = None  # an inline element that is never closed ends with its block
        if tag in _INLINE:
            if tag == "br":
                parts.append(" ")
            elif not close and tag not in _VOID and tag != "a" and m[4].strip() and _element(tag, m[4]).state == _DROPPED:
                lost, depth = tag, 1
        elif tag in _VOID:
            if tag == "hr":
                flush()
        elif not close:
            flush()
            if tag in _CLOSES_P and stack[-1].tag == "p" or tag in _CLOSES_SAME and stack[-1].tag == tag:
                stack.pop()
            node = _element(tag, m[4])
            if len(stack) < _DEPTH:
                stack[-1].kids.append(node)
            elif node.state != _DROPPED:
                node.kids = stack[-1].kids
            stack.append(node)
        else:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    flush()
                    del stack[i:]
                    break
            else:
                flush()
    if at < len(page) and not lost:
        parts.append(page[at:])
    flush()
    _free_forms(root)
    return root


def _length(node: Node) -> int:
    """Characters of text that is not dropped."""
    return sum(len(k) if isinstance(k, str) else _length(k) if k.state != _DROPPED else 0 for k in node.kids)


def _free_forms(root: Node) -> None:
    """A form around most of a page's text is a container, not a form."""
    forms = [(n, p) for n, p in _walk(root) if n.tag == "form"]
    if forms:
        whole = _length(root) + sum(_length(n) for n, p in forms if not any(a.tag == "form" for a in p))
        for n, _ in forms:
            if 2 * _length(n) > whole:
                n.state = _KEEP


def _walk(node: Node, above: tuple = ()) -> Iterator[tuple[Node, tuple]]:
    for k in node.kids:
        if isinstance(k, Node):
            yield k, above
            yield from _walk(k, (*above, k))


class Part:
    """A part of a wrapper: an element, a text (sig '#text') or a repeated group (sig '(...)').
    times is '1', '?', '+' or '*'; text is the fixed text, None in a slot."""

    __slots__ = ("sig", "kids", "times", "text", "size")

    def __init__(self, sig: str, times: str = "1", text: str | None = None, size: int = 0):
        self.sig, self.kids, self.times, self.text, self.size = sig, [], times, text, size

    def expression(self) -> str:
        if self.sig == _TEXT:
            body = "#TEXT" if self.text is None else html.escape(self.text)
        else:
            inner = "".join(k.expression() for k in self.kids)
            body = inner if self.sig[0] == "(" or self.sig == "#" else f"<{self.sig}>{inner}</{_tag(self.sig)}>"
        return body if self.times == "1" else f"({body}){self.times}"

    def pattern(self) -> str:
        """A regular expression over token streams."""
        if self.sig == _TEXT:
            body = "\x01[^\x00-\x02]*\x02" if self.text is None else "\x01" + re.escape(self.text) + "\x02"
        else:
            inner = "".join(k.pattern() for k in self.kids)
            body = inner if self.sig[0] == "(" else f"\x00{re.escape(self.sig)}\x01{inner}\x00/\x02"
        return body if self.times == "1" else f"(?:{body}){self.times}"


def stream(node: Node) -> str:
    """The tokens of a page, as ``Part.pattern`` reads them."""
    inner = "".join("\x01" + k + "\x02" if isinstance(k, str) else stream(k) for k in node.kids) if node.state != _DROPPED else ""
    return f"\x00{node.sig}\x01{inner}\x00/\x02"


def _tag(sig: str) -> str:
    return sig.split(".", 1)[0]


def _part(node: Node) -> Part:
    out = Part(node.sig)
    if node.state != _DROPPED:
        out.kids = _fold([Part(_TEXT, "1", k, len(k)) if isinstance(k, str) else _part(k) for k in node.kids])
    return out


def _fold(kids: list[Part]) -> list[Part]:
    """Runs of like neighbours become one repeated group."""
    for q in (1, 2, 3):
        out, i = [], 0
        while i < len(kids):
            n, sigs = 1, [k.sig for k in kids[i : i + q]]
            while len(sigs) == q and [k.sig for k in kids[i + n * q : i + (n + 1) * q]] == sigs:
                n += 1
            if n == 1 or (q > 1 and len(set(sigs)) == 1):
                out.append(kids[i])
                i += 1
                continue
            runs = [kids[i + k * q : i + (k + 1) * q] for k in range(n)]
            each = runs[0]
            for r in runs[1:]:
                each = [_merge(a, b) for a, b in zip(each, r)]
            if q == 1:
                each[0].times = "*" if "*" in each[0].times or "?" in each[0].times else "+"
                out.append(each[0])
            else:
                group = Part("(%s)" % " ".join(sigs), "+")
                group.kids = each
                out.append(group)
            i += n * q
        kids = out
    return kids


def _optional(k: Part) -> Part:
    k.times = {"1": "?", "+": "*"}.get(k.times, k.times)
    return k


def _merge(a: Part, b: Part) -> Part:
    """Aligns the streams of two parts of one signature."""
    many, none = any(x.times in "+*" for x in (a, b)), any(x.times in "?*" for x in (a, b))
    out = Part(a.sig, "*" if many and none else "+" if many else "?" if none else "1", a.text if a.text == b.text else None, max(a.size, b.size))
    i = j = 0
    for at_a, at_b in [*align([k.sig for k in a.kids], [k.sig for k in b.kids]), (len(a.kids), len(b.kids))]:
        out.kids += [_optional(k) for k in [*a.kids[i:at_a], *b.kids[j:at_b]]]
        if at_a < len(a.kids):
            out.kids.append(_merge(a.kids[at_a], b.kids[at_b]))
        i, j = at_a + 1, at_b + 1
    return out


def align(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places in step of a longest common subsequence, in memory that is linear."""
    names = {s: i for i, s in enumerate(dict.fromkeys([*x, *y]))}
    return _align(np.array([names[s] for s in x], dtype=np.int64), np.array([names[s] for s in y], dtype=np.int64), 0, 0)


def _row(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of x and each prefix of y."""
    row = np.zeros(len(y) + 1, dtype=np.int64)
    for v in x:
        new = row.copy()
        new[1:] = np.maximum(row[1:], row[:-1] + (y == v))
        row = np.maximum.accumulate(new)
    return row


def _align(x: np.ndarray, y: np.ndarray, at: int, to: int) -> list[tuple[int, int]]:
    head: list[tuple[int, int]] = []
    n = min(len(x), len(y))
    same = int(np.argmin(np.r_[x[:n] == y[:n], False]))
    head = [(at + i, to + i) for i in range(same)]
    x, y, at, to = x[same:], y[same:], at + same, to + same
    if not len(x) or not len(y):
        return head
    if len(x) == 1:
        found = np.flatnonzero(y == x[0])
        return head + ([(at, to + int(found[0]))] if len(found) else [])
    half = len(x) // 2
    cut = int(np.argmax(_row(x[:half], y) + _row(x[half:][::-1], y[::-1])[::-1]))
    return head + _align(x[:half], y[:cut], at, to) + _align(x[half:], y[cut:], at + half, to + cut)


def _mass(p: Part, lone: bool) -> int:
    if p.sig == _TEXT:
        return p.size if lone or p.text is None else 0
    return sum(_mass(k, lone) for k in p.kids)


def _items(kids: list[Part]) -> list[tuple[Part, int]]:
    """(part, furthest place that may come before) of a stream; groups are laid out."""
    out: list[tuple[Part, int]] = []
    for k in kids:
        if k.sig[0] == "(":
            last = len(out) + len(k.kids) - 1
            out += [(x, last) for x in k.kids]
        else:
            out.append((k, len(out) if k.times in "+*" else len(out) - 1))
    return out


def wrapper(pages: list[str]) -> Part | None:
    """The union-free expression of pages."""
    out = None
    for p in pages:
        part = _part(page_tree(p))
        out = part if out is None else _merge(out, part)
    return out


def region(w: Part, lone: bool = False) -> list:
    """The way from the top of a wrapper to its region: at each step the element's stream as
    [signature, furthest place before] and the place of the next element in it."""
    way, node = [], w
    while _tag(node.sig) not in ("article", "main") or any(_tag(k.sig) == "article" and 2 * _mass(k, lone) > _mass(node, lone) for k, _ in _items(node.kids)):
        items = _items(node.kids)
        weights = [0 if _tag(k.sig) == "header" else _mass(k, lone) for k, _ in items]
        if not any(weights):
            break
        at = int(np.argmax(weights))
        best = items[at][0]
        titled = _tag(best.sig) in ("article", "main") and 3 * weights[at] > sum(weights)
        if best.sig == _TEXT or _tag(best.sig) not in _CONTAINERS or not any(k.sig != _TEXT for k in best.kids):
            if not titled:
                break
        if not titled and (weights[at] < 0.7 * sum(weights) or items[at][1] >= at):
            break
        way.append([[[k.sig, before] for k, before in items], at])
        node = best
    return way


def infer(pages: list[str]) -> dict:
    """{expression, region} of pages of one template."""
    w = wrapper(pages)
    return {"expression": w.expression() if w else "", "region": region(w, len(pages) < 2) if w else []}


def _matched(kids: list, items: list, at: int) -> list[int]:
    """Places of the elements of a page's stream that match an item of the wrapper's, in the
    longest match of the two."""
    sig = items[at][0]
    sigs = [_TEXT if isinstance(k, str) else k.sig for k in kids]
    found = [i for i, s in enumerate(sigs) if s == sig]
    if len(found) < 2 and sum(s == sig for s, _ in items) < 2:
        return found
    places: dict[str, list[int]] = {}
    for j, (s, _) in enumerate(items):
        places.setdefault(s, []).append(j)
    best: list[tuple] = [(0, None)] * len(items)  # by last item matched: (length, chain)
    for i, s in enumerate(sigs):
        if s not in places:
            continue
        top, upto = [(0, None)], (0, None)
        for b in best:
            upto = b if b[0] > upto[0] else upto
            top.append(upto)
        for j in places[s]:
            n, chain = top[max(0, items[j][1] + 1)]
            if n + 1 > best[j][0]:
                best[j] = (n + 1, (i, j, chain))
    chain, out = max(best, key=lambda b: b[0])[1], []
    while chain:
        i, j, chain = chain
        if j == at:
            out.append(i)
    return out[::-1]


def locate(root: Node, way: list) -> list[tuple[Node, int, list]]:
    """(element, place hash, headings before it) of a page that match a region; none where the
    page does not match.  Of several articles the largest, and those half as large, count."""
    here: list[tuple[Node, int, list]] = [(root, 0, [])]
    for items, at in way:
        found = []
        for node, place, _ in here:
            for i in _matched(node.kids, items, at):
                k = node.kids[i]
                if isinstance(k, Node) and k.state != _DROPPED:
                    heads = [h for h in node.kids[:i] if isinstance(h, Node) and _titles(h)] if k.tag not in ("article", "main") else []
                    found.append((k, _place(k.sig, place), [(h, place) for h in heads]))
        if len(found) > 1:
            most = max(_length(k) for k, _, _ in found)
            found = [x for x in found if 2 * _length(x[0]) >= most]
        here = found
    return here


def _titles(node: Node) -> bool:
    """A heading, or a header around one."""
    if node.tag in ("h1", "h2"):
        return node.state != _DROPPED
    return node.state == _HEAD and any(k.tag == "h1" for k, _ in _walk(node))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _place(sig: str, above: int) -> int:
    return xxhash.xxh64_intdigest(sig, above)


_HEADINGS = {f"h{i}": i for i in range(1, 7)}


def _blocks(node: Node, place: int, out: list[tuple[str, int, int, int]], level: int = 0) -> list[tuple[str, int, int, int]]:
    """(text, place, key, level) of the texts that are not dropped; a place is a hash of the elements
    around, a key one of place and text, a level that of the heading around, 0 if there is none."""
    level = _HEADINGS.get(node.tag, level)
    for k in node.kids:
        if isinstance(k, str):
            out.append((k, _signed(place), _signed(xxhash.xxh64_intdigest(k, place)), level))
        elif k.state != _DROPPED:
            _blocks(k, _place(k.sig, place), out, level)
    return out


def _own(blocks: list[tuple[str, int, int, int]], fixed: set[int]) -> list[tuple[str, int, int, int]]:
    """The blocks without fixed texts.  A heading that many pages share stays where it heads text
    of this page: text that is not fixed, before the next heading of its level or above."""
    out, open_ = [], 0  # levels of headings with text of the page's own behind them, as bits
    for b in reversed(blocks):
        level = b[3]
        if not level:
            own = b[2] not in fixed
            open_ = 0b1111110 if own else open_
        else:
            own = b[2] not in fixed or bool(open_ >> level & 1)
            open_ &= (1 << level) - 1 if level > 1 else 0
        if own:
            out.append(b)
    return out[::-1]


def template(root: Node) -> int:
    """Names the skeleton: the containers of a page, four deep, down to its articles."""
    found = set()

    def down(node: Node, path: str, n: int) -> None:
        for k in node.kids:
            if isinstance(k, Node):
                if k.tag not in _SKELETON:
                    down(k, path, n)
                elif n < 4:
                    found.add(f"{path}/{k.sig}")
                    if k.tag not in ("article", "main"):
                        down(k, f"{path}/{k.sig}", n + 1)

    down(root, "", 0)
    return _signed(xxhash.xxh64_intdigest("\n".join(sorted(found))))


def main_text(page: str | None, rule: Callable[[int], tuple[list | None, Set[int]]] | None = None) -> str:
    """Texts of the region in page order, joined by two newlines.  ``rule`` gives the way to the
    region, if known, and the keys of the fixed texts of a template."""
    if not page:
        return ""
    root, found, fixed = page_tree(page), [], frozenset()
    if rule:
        way, fixed = rule(template(root))
        found = locate(root, way) if way is not None else []
    if not found or not any(_length(k) for k, _, _ in found):
        found = locate(root, region(_part(root), True))
    blocks: list[tuple[str, int, int, int]] = []
    for node, place, heads in found:
        for h, above in heads:
            _blocks(h, _place(h.sig, above), blocks)
        _blocks(node, place, blocks)
    own = _own(blocks, fixed)
    size = lambda x: sum(len(b[0]) for b in x)
    least = 4 if any(k.tag in ("article", "main") for k, _, _ in found) else size(blocks)
    return "\n\n".join(b[0] for b in (own if own and least * size(own) >= size(blocks) else blocks))


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _contents(sample: int, held: int = 1 << 25):
    """A row a page without its html; besides, with it, the ``sample`` least contents of each
    template in the task's share, given out whenever ``held`` characters are kept."""
    kind = pa.list_(pa.struct([("place", pa.int64()), ("key", pa.int64())]))

    def out(hosts, names, contents, blocks, pages) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(names, pa.int64()), pa.array(contents, pa.int64()), pa.array(blocks, kind), pa.array(pages, pa.string())], names=["host", "template", "content", "blocks", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[tuple[str, int], dict[int, str]] = {}
        n = 0

        def given() -> pa.RecordBatch:
            rows = [(h, t, c, None, page) for (h, t), x in least.items() for c, page in x.items()]
            return out(*zip(*rows))

        for b in batches:
            names, contents, found = [], [], []
            for h, x in zip(b.column(0), b.column(1)):
                page = x.as_py() or ""
                root = page_tree(page)
                blocks = sorted({(p, k) for _, p, k, _ in _blocks(root, 0, [])})
                names.append(template(root))
                contents.append(_signed(xxhash.xxh64_intdigest(repr(blocks))))
                found.append([{"place": p, "key": k} for p, k in blocks])
                few = least.setdefault((h.as_py(), names[-1]), {})
                if contents[-1] not in few:
                    few[contents[-1]] = page
                    n += len(page) + 1
                    if len(few) > sample:
                        n -= len(few.pop(max(few))) + 1
                if n > held:
                    yield given()
                    least, n = {}, 0
            yield out(b.column(0), names, contents, found, [None] * len(names))
        if n:
            yield given()

    return run


def _fixed(contents: DataFrame, *group: str) -> DataFrame:
    """(group, key) of the fixed blocks; only those found often enough are joined."""
    found = contents.select(*group, F.explode("blocks").alias("b")).groupBy(*group, "b.place", "b.key").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    places = contents.select(*group, F.explode(F.array_distinct(F.col("blocks.place"))).alias("place")).groupBy(*group, "place").agg(F.count("*").alias("of")).where(F.col("of") >= LEAST)
    return found.join(places, [*group, "place"]).where("2 * n > of").select(*group, "key")


def wrappers(pages: DataFrame, sample: int = 6, seen: DataFrame | None = None) -> DataFrame:
    """(host, template, n, expression, region) of every template: the wrapper of ``sample`` of
    its distinct contents, the first by hash; n counts all of them."""
    seen = _seen(pages, sample) if seen is None else seen
    key = ["host", "template", "content"]
    order = Window.partitionBy("host", "template").orderBy("content")
    few = seen.where("h IS NOT NULL").groupBy(*key).agg(F.min("h").alias("h")).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= sample)
    sizes = seen.where("blocks IS NOT NULL").groupBy(*key).agg(F.lit(1)).groupBy("host", "template").agg(F.count("*").alias("n"))
    gathered = few.groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("content", "h"))).alias("p")).join(sizes, ["host", "template"])

    @F.pandas_udf("expression string, region string")
    def run(p: pd.Series) -> pd.DataFrame:
        found = [infer([r["h"] for r in rows]) for rows in p]
        return pd.DataFrame({"expression": [f["expression"] for f in found], "region": [json.dumps(f["region"]) for f in found]})

    return gathered.select("host", "template", "n", run("p").alias("w")).select("host", "template", "n", "w.*")


def _seen(pages: DataFrame, sample: int) -> DataFrame:
    rows = pages.select(host(F.col("url")).alias("host"), "html")
    return materialize(rows.mapInArrow(_contents(sample), "host string, template long, content long, blocks array<struct<place:long,key:long>>, h string"), "contents")


def template_rules(pages: DataFrame, sample: int = 6) -> DataFrame:
    """(host, template, region, fixed): the region of each template of two contents or more, and the
    keys of the texts on its pages that are fixed in it or in its host, counted over all pages.

    A row is a template's, never a host's: it holds no more keys than its pages have texts.
    """
    seen = _seen(pages, sample)
    contents = materialize(seen.where("blocks IS NOT NULL").groupBy("host", "template", "content").agg(F.first("blocks").alias("blocks")), "distinct")
    regions = wrappers(pages, sample, seen).where("n > 1").select("host", "template", "region")
    texts = contents.select("host", "template", F.explode("blocks.key").alias("key")).distinct()
    shared = texts.join(_fixed(contents, "host").distinct(), ["host", "key"]).select("host", "template", "key")
    fixed = shared.unionByName(_fixed(contents, "host", "template")).groupBy("host", "template").agg(F.collect_set("key").alias("fixed"))
    return regions.join(fixed, ["host", "template"], "full")


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = [template(page_tree(h.as_py() or "")) for h in b.column(2)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.int64())], names=[*b.schema.names, "template"])


def extract(pages: DataFrame, sample: int = 6, small_rules: int = 20_000, small_chars: int = 1 << 24) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    Rules that are few and small, both counted first, go to every task once, to be looked up by
    host and template.  Others are joined: pages get their template by a pass of its own and a
    row its template's rule alone, by a shuffle that Spark splits where a template is large.
    """
    needed = materialize(template_rules(pages, sample), "rules")
    size = F.coalesce(F.length("region"), F.lit(0)) + 20 * F.greatest(F.size(F.coalesce("fixed", F.array().cast("array<bigint>"))), F.lit(0))
    count, chars = needed.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    keyed = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.col("html").alias("h"), host(F.col("url")).alias("host"))
    if count <= small_rules and chars <= small_chars:
        held = pages.sparkSession.sparkContext.broadcast({(r["host"], r["template"]): (r["region"], r["fixed"]) for r in needed.collect()})
        return keyed.mapInArrow(_extractor(lambda: held.value), _TEXTS)
    kind = "page_id long, url string, h string, host string, template long"
    rows = keyed.mapInArrow(_templates, kind).join(needed, ["host", "template"], "left")
    return rows.select("page_id", "url", "h", "host", "template", "region", "fixed").mapInArrow(_extractor(None), _TEXTS)


_TEXTS = "page_id long, url string, text string, n_chars long"


def _extractor(held: Callable[[], dict] | None):
    """The texts of pages by the rules of ``held`` or, without, by those in the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, known = held() if held else {}, {}

        def rule(of: str, name: int) -> tuple[list | None, Set[int]]:
            if (of, name) not in known:
                if len(known) > 10_000:
                    known.clear()
                region, fixed = rules.get((of, name)) or (None, None)
                known[of, name] = json.loads(region) if region else None, frozenset(fixed or ())
            return known[of, name]

        for b in batches:
            texts = []
            for i, (h, site) in enumerate(zip(b.column(2), b.column(3).to_pylist())):
                if not held:
                    rules = {(site, b.column(4)[i].as_py()): (b.column(5)[i].as_py(), b.column(6)[i].as_py())}
                texts.append(main_text(h.as_py(), lambda name: rule(site, name)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run
