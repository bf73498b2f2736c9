"""HTML extraction by wrapper induction.

Pages of one host are made from a template. The tree of each page is aligned with a
reference tree of its host (the commonest shape of tree there) by simple tree matching.
A node's place in the reference is its slot; nodes that match nothing there have slots
by their own path, so pages of another layout keep slots of their own. All pages of a
host are counted: a slot most of whose texts come again on different pages is constant
and belongs to the template, a slot whose texts vary holds content. Texts that come
again in constant slots are left out.

Trees are aligned and counted as they are in the page, before any judgement of names.
What is left is then read as HTML means it: menus, footers, forms and so on are never
the article, and an `<article>` or `<main>` is, if there is one.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from bisect import bisect_left
from functools import lru_cache
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.shipping import ship
from granary.llm.common import cut, replacing

RESULTS = ("text", "n_chars")
#: Pages of differing content on which a text has to stand in one slot to come again:
#: so many, or the second number in a slot that has MANY texts or more.
AGAIN, AGAIN_OF_MANY, MANY = 3, 2, 20
#: Percent of a slot's texts that come again from which the slot is constant, and of a
#: page's characters from which the page is taken for a copy and is no evidence.
CONSTANT, COPY = 50, 50
#: Levels of a tree that are aligned; nodes further down have slots by their path.
DEPTH = 64
#: Pairs of neighbours that are compared in full; longer lists are matched in order.
MOST_PAIRS = 1 << 14
#: Texts of templates that are broadcast (16 bytes each, so 64 MB at most), and bytes of
#: reference trees that are; more are joined.
MOST_CONSTANTS, MOST_REFERENCE_BYTES = 1 << 22, 1 << 25

# Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr br".split())
#: Not the article, wherever they stand.
APART = frozenset("head nav footer aside form button select dialog menu object audio video canvas map".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Class and id names of containers that are no article: whole names, or compounds of
#: these words with those of PLACES ("cookie-banner", "sidebar_left"). Of the second
#: list also if an article element lies within.
MARKS = frozenset("nav navbar navigation menu cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social breadcrumb breadcrumbs pagination pager footer header masthead banner widget toolbar skip".split())
STRONG = frozenset("comment comments reply replies disqus respond related recommended sidebar aside ad ads advert adverts advertisement advertising adsense promo promotion sponsor sponsored".split())
PLACES = frozenset("site page main top bottom left right box bar area list container wrapper wrap section block inner outer global primary secondary thread form links slot".split())
#: Elements whose class says nothing of this kind.
TEXTUAL = INLINE | frozenset("html body main p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot blockquote pre figcaption caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "optgroup": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}

#: A quote opens a value only after an equals sign; the second form is for a quote that
#: is never closed.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=(?!\s*["']))*)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
OF_INTEREST = re.compile(r"class|id|role|hidden|style", re.I)
DIGITS = re.compile(r"\d+")
PARTS = re.compile(r"[-_]+")


@lru_cache(1 << 14)
def _marked(names: str) -> int:
    """2 for strong marks, 1 for others, 0 for none."""
    mark = 0
    for name in names.split():
        parts = [p for p in PARTS.split(name) if p]
        if all(p in MARKS or p in STRONG or p in PLACES for p in parts):
            mark = max(mark, 2 * any(p in STRONG for p in parts), 1 * any(p in MARKS for p in parts))
    return mark


class Page:
    """A parsed page. Nodes are numbered in page order, the root is 0; events are
    numbers of nodes that begin, their complements where they end, and texts."""

    __slots__ = ("apart", "events", "headed", "holds", "mark", "parent", "sig", "tag")

    def __init__(self):
        self.tag, self.sig, self.parent, self.apart, self.mark, self.events = ["#root"], ["#root"], [-1], [False], [0], []

    def add(self, tag: str, attributes: str, parent: int) -> int:
        sig, apart, mark = tag, tag in APART, 0
        if attributes and OF_INTEREST.search(attributes):
            found: dict[str, str] = {}
            for name, value in ATTRIBUTE.findall(attributes):
                found.setdefault(name.lower(), value.strip("\"'").lower())
            names = found.get("class", "")
            sig = f"{tag}.{DIGITS.sub('', ' '.join(names.split()))}" if names else tag
            if tag not in TEXTUAL:
                mark = _marked(f"{names} {found.get('id', '')}")
            if found.get("role") in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
                apart = True
            if found.get("role") == "main":
                tag, mark = "main", 0
        self.tag.append(tag), self.sig.append(sig), self.parent.append(parent), self.apart.append(apart), self.mark.append(mark)
        self.events.append(len(self.tag) - 1)
        return len(self.tag) - 1

    def finish(self) -> Page:
        """holds: an article or the main part lies within; headed: a heading does."""
        n = len(self.tag)
        self.holds, self.headed = [False] * n, [False] * n
        for i in range(n - 1, 0, -1):
            up, tag = self.parent[i], self.tag[i]
            if not self.apart[i] and self.mark[i] < 2 and (self.holds[i] or tag == "article" or tag == "main"):
                self.holds[up] = True
            if self.headed[i] or tag in HEADINGS:
                self.headed[up] = True
        return self


def parse(text: str | None) -> Page:
    """The tree of a page. Missing end tags are supplied as browsers do; a tag that the
    end of the page cuts off is dropped. Nothing here recurses, however deep it is."""
    page = Page()
    events, names = page.events, page.tag
    stack, opened = [0], {}
    raw_names: list[str] = ["#root"]  # as written, as a role may rename a tag
    text = text or ""
    at, end = 0, len(text)

    def close(k: int) -> None:
        for i in reversed(stack[k:]):
            events.append(~i)
            opened[raw_names[i]] -= 1
        del stack[k:]

    while at < end:
        lt = text.find("<", at)
        if lt < 0:
            events.append(html_lib.unescape(text[at:]))
            break
        if lt > at:
            events.append(html_lib.unescape(text[at:lt]))
        m = TAG.match(text, lt) or LOOSE_TAG.match(text, lt)
        if m is None:
            after = text[lt + 1 : lt + 3]
            if text.startswith("<!--", lt):
                at = text.find("-->", lt + 2)
                at = end if at < 0 else at + 3
            elif after[:1] in ("!", "?") or (after[:1] == "/" and not after[1:].isalpha() and after[1:]):
                at = text.find(">", lt)
                at = end if at < 0 else at + 1
            elif after[:1].isascii() and after[:1].isalpha() or (after[:1] == "/" and after[1:].isalpha()):
                break
            else:
                events.append("<")
                at = lt + 1
            continue
        at = m.end()
        tag = m.group(2).lower()
        if m.group(1):
            if opened.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if raw_names[stack[k]] == tag:
                        close(k)
                        break
            continue
        if tag in CLOSES:
            if any(opened.get(x) for x in CLOSES[tag]):
                for k in range(len(stack) - 1, 0, -1):
                    if raw_names[stack[k]] in SCOPES[tag]:
                        break
                    if raw_names[stack[k]] in CLOSES[tag]:
                        close(k)
                        break
        elif tag not in INLINE and opened.get("p"):  # a block ends an open paragraph
            for k in range(len(stack) - 1, 0, -1):
                if raw_names[stack[k]] == "p":
                    close(k)
                    break
                if raw_names[stack[k]] not in INLINE:
                    break
        i = page.add(tag, m.group(3), stack[-1])
        raw_names.append(tag)
        if tag in RAW:
            closed = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(text, at)
            at = closed.end() if closed else end
            events.append(~i)
        elif tag in VOID:
            events.append(~i)
        else:
            stack.append(i)
            opened[tag] = opened.get(tag, 0) + 1
    close(1)
    assert len(names) == len(raw_names)
    return page.finish()


def blocks(page: Page, marks: bool = True) -> list[tuple[str, int, bool]]:
    """All texts of the page in its order, as (text, element that holds it, whether it
    is the article's as HTML has it). marks: whether class and id names count."""
    tag, apart, mark, holds = page.tag, page.apart, page.mark, page.holds

    def skipped(i: int, inside: bool) -> bool:
        if apart[i]:
            return True
        if tag[i] == "header" and not (inside and page.headed[i]):
            return True
        return marks and (mark[i] == 2 or (mark[i] == 1 and not holds[i]))

    def chosen(name: str) -> set[int]:
        """The outermost elements of this name that nothing sets apart."""
        out, away, within = set(), 0, 0
        for e in page.events:
            if isinstance(e, str):
                continue
            i = e if e >= 0 else ~e
            gone = apart[i] or (marks and (mark[i] == 2 or (mark[i] == 1 and not holds[i])))
            if gone:
                away += 1 if e >= 0 else -1
            elif tag[i] == name:
                if e >= 0 and not away and not within and not (marks and mark[i]):
                    out.add(i)
                within += (1 if e >= 0 else -1) if i in out else 0
        return out

    roots = chosen("article") or chosen("main")
    out: list[tuple[str, int, bool]] = []
    buffer: list[str] = []
    owner, away, within = 0, 0, 0
    outer: list[tuple[list[str], int]] = []
    holder = [0]  # the elements that are not inline
    gone_at: list[bool] = []  # for each open element whether it is skipped

    def flush() -> None:
        if buffer:
            line = " ".join("".join(buffer).split())
            if line:
                out.append((line, owner, not away and (within > 0 or not roots)))
            buffer.clear()

    for e in page.events:
        if isinstance(e, str):
            if not buffer:
                owner = holder[-1]
            buffer.append(e)
        elif e >= 0:
            gone = skipped(e, within > 0)
            inline = tag[e] in INLINE
            if tag[e] == "br":
                buffer.append(" ")
            if tag[e] in RAW:
                gone = False  # holds no text
            elif not inline:
                flush()
            elif gone:  # its text is apart, what is around it goes on
                outer.append((buffer, owner))
                buffer = []
            gone_at.append(gone)
            away += gone
            if not inline:
                holder.append(e)
            if e in roots:
                within += 1
        else:
            i = ~e
            gone = gone_at.pop()
            inline = tag[i] in INLINE
            if tag[i] not in RAW and (not inline or gone):
                flush()
            if inline and gone:
                buffer, owner = outer.pop()
            away -= gone
            if not inline:
                holder.pop()
            if i in roots:
                within -= 1
    flush()
    return out


# --- alignment ----------------------------------------------------------------


class Shape:
    """A tree without inline elements, in which neighbours of equal signature are one
    node (a repeated element is one slot). nodes: the page's elements that it stands for."""

    __slots__ = ("kids", "nodes", "sig")

    def __init__(self, sig: str, nodes: list[int], kids: list[Shape]):
        self.sig, self.nodes, self.kids = sig, nodes, kids


def shape(page: Page) -> Shape:
    kids: dict[int, list[int]] = {}
    holder = [0] * len(page.tag)  # the nearest element above that is not inline, or the element itself
    for i in range(1, len(page.tag)):
        up = holder[page.parent[i]]
        if page.tag[i] in INLINE or page.tag[i] in RAW:
            holder[i] = up
        else:
            holder[i] = i
            kids.setdefault(up, []).append(i)

    def of(nodes: list[int], sig: str, depth: int) -> Shape:
        below = [k for n in nodes for k in kids.get(n, ())] if depth < DEPTH else []
        return Shape(sig, nodes, [of(list(run), s, depth + 1) for s, run in groupby(below, key=lambda k: page.sig[k])])

    return of([0], "#root", 0)


def written(s: Shape) -> list:
    """The signatures of a shape, nested, for JSON."""
    return [s.sig, [written(k) for k in s.kids]]


def read(tree: list) -> Shape:
    """A shape from its signatures; its nodes are numbered in order."""
    count = -1

    def of(t: list) -> Shape:
        nonlocal count
        count += 1
        return Shape(t[0], [count], [of(k) for k in t[1]])

    return of(tree)


def aligned(a: list[Shape], b: list[Shape]) -> list[tuple[Shape, Shape]]:
    """Simple tree matching of two child lists: the pairs of the largest matching that
    keeps the order, a pair counting as many nodes as its own subtrees match."""
    head = 0
    while head < min(len(a), len(b)) and a[head].sig == b[head].sig:
        head += 1
    if head == len(a) == len(b):
        return list(zip(a, b, strict=True))
    if len(a) * len(b) > MOST_PAIRS:
        return _in_order(a, b)
    known: dict[tuple[int, int], int] = {}

    def table(xs: list[Shape], ys: list[Shape]) -> list[list[int]]:
        w = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, x in enumerate(xs):
            for j, y in enumerate(ys):
                w[i + 1][j + 1] = max(w[i][j + 1], w[i + 1][j], w[i][j] + (weight(x, y) if x.sig == y.sig else 0))
        return w

    def weight(x: Shape, y: Shape) -> int:
        key = (id(x), id(y))
        if key not in known:
            small = len(x.kids) * len(y.kids) <= MOST_PAIRS
            known[key] = 1 + (table(x.kids, y.kids)[-1][-1] if small else len(_in_order(x.kids, y.kids)))
        return known[key]

    w, pairs = table(a, b), []
    i, j = len(a), len(b)
    while i and j:
        if w[i][j] == w[i - 1][j]:
            i -= 1
        elif w[i][j] == w[i][j - 1]:
            j -= 1
        else:
            pairs.append((a[i - 1], b[j - 1]))
            i, j = i - 1, j - 1
    return pairs[::-1]


def _in_order(a: list[Shape], b: list[Shape]) -> list[tuple[Shape, Shape]]:
    """Each node with the next of equal signature."""
    places: dict[str, list[int]] = {}
    for j, y in enumerate(b):
        places.setdefault(y.sig, []).append(j)
    pairs, at = [], 0
    for x in a:
        where = places.get(x.sig, [])
        k = bisect_left(where, at)
        if k < len(where):
            pairs.append((x, b[where[k]]))
            at = where[k] + 1
    return pairs


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def slots(page: Page, host: str, reference: Shape) -> list[int]:
    """The slot of each element: its place in the reference tree, or else the slot above
    and its signature. Slots of different hosts differ."""
    out: list[int | None] = [None] * len(page.tag)
    todo = [(shape(page), reference)]
    while todo:
        mine, theirs = todo.pop()
        slot = _hash(f"{host} {theirs.nodes[0]}")
        for n in mine.nodes:
            out[n] = slot
        todo += aligned(mine.kids, theirs.kids)
    for i in range(1, len(out)):
        if out[i] is None:
            up = out[page.parent[i]]
            out[i] = up if page.tag[i] in INLINE else _hash(f"{up}/{page.sig[i]}")
    return out


def keys(slot: np.ndarray, text: np.ndarray) -> np.ndarray:
    """One number for a slot and a text in it."""
    return slot.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ text.view(np.uint64)


def found(page: Page, host: str, reference: Shape) -> tuple[list[tuple[str, int, bool]], np.ndarray, np.ndarray]:
    """The page's blocks, and for each its slot and the hash of its text."""
    texts, where = blocks(page), slots(page, host, reference)
    return texts, np.array([where[n] for _, n, _ in texts], np.int64), np.array([_hash(t) for t, _, _ in texts], np.int64)


class Constants:
    """The constant texts: keys of slot and text, and the texts alone, both sorted."""

    def __init__(self, slot: np.ndarray, text: np.ndarray):
        self.keys, self.texts = np.sort(keys(slot, text)), np.unique(text)

    def __len__(self) -> int:
        return len(self.keys)


def _among(sorted_: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)] == wanted


def extract(html: str | None, constant: Constants | None = None, host: str = "", reference: Shape | None = None, marks: bool = True) -> str:
    """The article's text, without the constant texts of its host."""
    if not html:
        return ""
    page = parse(html)
    left = [(t, n) for t, n, mine in blocks(page, marks) if mine]
    if reference is not None and constant is not None and len(constant) and left:
        text = np.array([_hash(t) for t, _ in left], np.int64)
        if _among(constant.texts, text).any():  # trees are aligned only where it can matter
            where = slots(page, host, reference)
            again = _among(constant.keys, keys(np.array([where[n] for _, n in left], np.int64), text))
            left = [x for x, out in zip(left, again, strict=True) if not out]
    return "\n".join(t for t, _ in left)


# --- the operator -------------------------------------------------------------

HOST, KEY, REFERENCE, CONSTANTS = "__gr_host", "__gr_key", "__gr_reference", "__gr_constants"


def host(url):
    """Lower-cased host of a URL; null if there is none."""
    got = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(got != "", got)


def _shapes(batches):
    """(host, shape as JSON) of each page."""
    for batch in batches:
        column = lambda c, b=batch: b.column(b.schema.get_field_index(c))
        found_ = [json.dumps(written(shape(parse(h))), separators=(",", ":")) for h in column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([column(HOST), pa.array(found_, pa.string())], names=[HOST, "shape"])


class _References:
    """Reference trees by their JSON; the trees of a few hosts are held."""

    def __init__(self):
        self.held: dict[str, Shape] = {}

    def __getitem__(self, text: str) -> Shape:
        if text not in self.held:
            if len(self.held) > 256:
                self.held.clear()
            self.held[text] = read(json.loads(text))
        return self.held[text]


def _placed(batches):
    """(page's key, page's content, slot, text, characters) of each distinct (slot, text)
    of a page. Pages of equal host and text have equal content."""
    references = _References()
    for batch in batches:
        column = lambda c, b=batch: b.column(b.schema.get_field_index(c))
        rows: list[tuple] = []

        def out(rows=rows):
            parts = list(zip(*rows, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()) for p in parts], names=["k", "c", "slot", "t", "chars"])

        for html, host_, reference, key in zip(*[column(c).to_pylist() for c in ("html", HOST, REFERENCE, KEY)], strict=True):
            texts, slot, text = found(parse(html), host_, references[reference])
            content = _hash(host_ + "\n" + "\n".join(t for t, _, _ in texts))
            distinct = {(s, t): len(x[0]) for s, t, x in zip(slot.tolist(), text.tolist(), texts, strict=True)}
            rows += [(key, content, s, t, n) for (s, t), n in distinct.items()]
            if len(rows) > 1 << 16:
                yield out()
                rows.clear()
        yield out()


def references(pages: DataFrame) -> DataFrame:
    """(host, reference tree as JSON): the commonest shape of each host's pages, the
    least of several."""
    shapes = pages.select(HOST, "html").mapInArrow(_shapes, f"{HOST} string, shape string")
    counted = shapes.groupBy(HOST, F.xxhash64("shape").alias("s")).agg(F.count("*").alias("n"), F.min("shape").alias("shape"))
    return counted.groupBy(HOST).agg(F.max_by("shape", F.struct("n", F.negate(F.col("s").cast("double")))).alias(REFERENCE))


def constants(placed: DataFrame) -> DataFrame:
    """(slot, t) of the texts of templates, from (c, slot, t, chars) of all pages. A page
    most of whose characters come again elsewhere is a copy, and no evidence of what
    different pages share."""
    rows = cut(placed.select("c", "slot", "t", "chars").distinct())
    again = rows.groupBy("slot", "t").agg(F.count("*").alias("n")).where(F.col("n") >= AGAIN_OF_MANY).select("slot", "t", F.lit(True).alias("again"))
    marked = rows.join(again, ["slot", "t"], "left")
    pages = marked.groupBy("c").agg(F.sum("chars").alias("all"), F.sum(F.when(F.col("again"), F.col("chars")).otherwise(0)).alias("again"))
    own = pages.where(100 * F.col("again") <= COPY * F.col("all")).select("c")
    counted = cut(rows.join(own, "c", "left_semi").groupBy("slot", "t").agg(F.count("*").alias("n")))
    come = lambda least: F.sum(F.when(F.col("n") >= least, F.col("n")).otherwise(0)) * 100 >= CONSTANT * F.sum("n")
    least = F.when((F.sum("n") >= MANY) & come(AGAIN_OF_MANY), AGAIN_OF_MANY).when(come(AGAIN), AGAIN)
    constant = counted.groupBy("slot").agg(least.alias("least")).where("least IS NOT NULL")
    return counted.join(constant, "slot").where("n >= least").select("slot", "t")


def extract_articles(pages: DataFrame, marks: bool = True, most_constants: int = MOST_CONSTANTS) -> DataFrame:
    """`pages` with text and n_chars (code points). The caller's columns of these names
    are replaced. marks: whether class and id names of containers count. most_constants:
    texts of templates up to which they are broadcast; results do not depend on it.

    A null or empty html gives an empty text. A page without a host, or of a host
    without a template, is judged by its own markup alone. Pages are read whole, all
    pages of a host are counted, and copies of a page count once. An empty table gives
    no rows.
    """
    ship(pages.sparkSession)
    base = replacing(pages, *RESULTS)
    keyed = base.withColumn(HOST, host(F.col("url"))).withColumn(KEY, F.xxhash64("url", "html"))
    hosted = keyed.where(F.col("html").isNotNull() & F.col(HOST).isNotNull())
    trees = cut(references(hosted))
    size = trees.agg(F.sum(F.octet_length(REFERENCE))).first()[0] or 0
    trees = F.broadcast(trees) if size <= MOST_REFERENCE_BYTES else trees
    placed = cut(hosted.select("html", HOST, KEY).join(trees, HOST).select("html", HOST, KEY, REFERENCE).mapInArrow(_placed, "k long, c long, slot long, t long, chars long"))
    template = cut(constants(placed))
    joined = keyed.join(trees, HOST, "left")
    if template.count() <= most_constants:
        got = template.toArrow()
        table = Constants(np.asarray(got.column("slot")).astype(np.int64), np.asarray(got.column("t")).astype(np.int64))
        shared = pages.sparkSession.sparkContext.broadcast(table)
        joined = joined.withColumn(CONSTANTS, F.lit(None).cast("array<struct<slot:bigint,t:bigint>>"))
    else:
        shared = None
        mine = placed.join(template, ["slot", "t"]).select("k", "slot", "t").distinct().groupBy("k").agg(F.collect_list(F.struct("slot", "t")).alias(CONSTANTS))
        joined = joined.join(mine, F.col(KEY) == F.col("k"), "left")
    out = base.withColumn("text", F.lit("")).withColumn("n_chars", F.lit(0).cast("bigint")).schema
    names = base.columns

    def run(batches):
        references_ = _References()
        for batch in batches:
            column = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            own = column(CONSTANTS).to_pylist() if shared is None else [None] * batch.num_rows
            texts = []
            for html, host_, reference, mine in zip(*[column(c).to_pylist() for c in ("html", HOST, REFERENCE)], own, strict=True):
                if shared is not None:
                    constant = shared.value
                else:
                    pairs = np.array([(x["slot"], x["t"]) for x in mine or ()], np.int64).reshape(-1, 2)
                    constant = Constants(np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))
                texts.append(extract(html, constant, host_ or "", references_[reference] if reference else None, marks))
            columns = [*[column(c) for c in names], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "text", "n_chars"])

    return joined.select(*[F.col(f"`{c}`") for c in names], HOST, REFERENCE, CONSTANTS).mapInArrow(run, out)
