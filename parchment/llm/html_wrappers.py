"""Main text of web pages by wrappers: union-free regular expressions inferred from pages of one host.

A page is read into a tree of block elements and text slots.  Trees of a host are aligned one after the other: sequences
that mismatch are resolved into repeated groups (an element, or a run of elements, that follows itself), into optional
parts, and text that differs into open slots.  What is left is the host's wrapper: a sequence of elements, each possibly
repeated or optional, with slots that are constant or open, and never a choice.

The wrapper says which slots are the article: its elements are judged once a host by what all its pages hold there (marks
of tags and attributes, characters, links, constant text), and each page takes the text of its slots by aligning it with
the wrapper.  A page, or a part of one, that the wrapper doesn't know is judged by its own tree alone.

Wrappers are made by a fold in each task, then by folds over the hosts' partial wrappers in two rounds, sorted and salted,
so that a host with a third of all pages is folded by many tasks and no group is ever collected.  Pages meet their
wrapper by broadcast while all wrappers are below ``BROADCAST_BYTES``, else by a join salted for the hosts with many pages.

Defined cases: a null or empty html, or a page without an article, has an empty text; a null url, or one without a host,
belongs to the host of no name; a null page_id is carried; repeated rows are returned each; other columns are ignored;
elements nested deeper than MAX_DEPTH are cut into blocks but not told apart; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

MAX_DEPTH = 60
#: Nodes of a wrapper; what further pages add beyond is judged page by page.
MAX_NODES = 1500
#: Distinct pages that must agree before a text counts as the host's own.
SUPPORT = 8
#: Hosts whose partial wrappers a task holds before it hands them on.
HOSTS = 500
#: Cells of an alignment's table; longer pairs of sequences are matched greedily.
CELLS = 250_000
#: Salts of a host's partial wrappers, and of the pages of a host with more than one in HOT pages.
SALTS, HOT = 32, 200
BROADCAST_BYTES = 16 << 20
OUTPUT = "page_id long, url string, text string, n_chars long"

# Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd map mark nobr q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr".split()
)
NEVER = frozenset("head script style noscript template iframe noembed noframes object svg canvas audio video form button select option optgroup textarea input label datalist fieldset dialog menu nav footer aside xmp title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = HEADINGS | frozenset("p li ul ol dl dt dd blockquote pre table tbody thead tfoot tr td th figure figcaption caption".split())
CLOSES = {
    "li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}),
    "tbody": ("thead tbody tfoot tr td th", {"table"}), "thead": ("thead tbody tfoot tr td th", {"table"}), "tfoot": ("thead tbody tfoot tr td th", {"table"}), "option": ("option", {"select"}),
}
# Words of class, id and role that mark what is not the article, and what is.
ASIDE = frozenset(
    "nav navbar menu menubar breadcrumb breadcrumbs header masthead banner footer foot bottom sidebar aside related recommended recommendations widget widgets ad ads adv advert adverts adbox adslot sponsor sponsored "
    "promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist reply replies "
    "respond disqus discussion toolbar pagination pager skip search navigation contentinfo complementary dialog alertdialog".split()
)
ASIDE_STARTS = ("advert", "sponsor", "sidebar", "breadcrumb", "comment", "cookie", "newsletter", "navigat")
MAIN = frozenset("article content post entry story main body articlebody maincontent maintext".split())
UNLESS = frozenset("has with no without".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^>]*>)", re.S)
_MARKS = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """An element (``kids``), a group (label ``()``), or a slot of text (label ``#``).

    ``many`` and ``maybe`` say that it repeats and that pages may lack it; ``const`` is the digest of the text that all
    pages hold there, False once they differ, in ``seen`` uses; ``slots`` are the page's blocks behind it.
    """

    __slots__ = ("label", "kids", "many", "maybe", "chars", "links", "const", "seen", "slots", "rank")

    def __init__(self, label, kids=(), many=False, maybe=False, chars=0, links=0, const=None, seen=1, slots=()):
        self.label, self.kids, self.many, self.maybe, self.chars, self.links = label, list(kids), many, maybe, chars, links
        self.const, self.seen, self.slots, self.rank = const, seen, list(slots), 0

    def key(self):
        return self.label if self.label != "()" else ("()", *(k.key() for k in self.kids))

    def plain(self):
        return [self.label, int(self.many) | 2 * int(self.maybe), self.chars, self.links, self.const, self.seen, [k.plain() for k in self.kids]]


def from_plain(x) -> Node:
    return Node(x[0], [from_plain(k) for k in x[6]], bool(x[1] & 1), bool(x[1] & 2), x[2], x[3], x[4], x[5])


# --- reading a page --------------------------------------------------------------------------------------------------


@lru_cache(maxsize=20_000)
def label_of(tag: str, attributes: str) -> str:
    """The element's name with its marks: ``div.sidebar``, digits as 0."""
    marks = {k.lower(): v.strip("\"'") for k, v in reversed(_MARKS.findall(attributes))}
    words = [f"{sign}{unescape(marks[name]).strip()}" for name, sign in (("id", "#"), ("class", "."), ("role", "@"), ("itemprop", "$")) if marks.get(name, "").strip()]
    return (tag + "".join(re.sub(r"\s+", ".", re.sub(r"\d+" if w[0] == "#" else r"\d{3,}", "0", w)) for w in words))[:200]


@lru_cache(maxsize=20_000)
def kind_of(label: str) -> str:
    """``never``, ``header``, ``aside``, ``article``, ``main`` or nothing, by tag and marks."""
    tag, names = re.match(r"([^#.@$]*)(.*)", label, re.S).groups()
    if tag in NEVER:
        return "never"
    main = tag in ("article", "main")
    for name in re.split(r"[#.@$]", names):
        words = [w.lower() for w in _PARTS.findall(name)]
        if words and not UNLESS & set(words) and (words[0] in ASIDE or words[-1] in ASIDE or words[0].startswith(ASIDE_STARTS)) and tag not in ("html", "body"):
            return "header" if words[-1] in ("header", "masthead") or words[0] == "header" else "aside"
        main = main or bool(words) and tag not in TEXTUAL and (words[-1] in MAIN or "".join(words) in MAIN)
    if tag == "header":
        return "header"
    return "article" if tag == "article" else "main" if main else ""


class Reader:
    """Builds a page's tree; ``blocks[i]`` is the raw text of the i-th slot."""

    def __init__(self, html: str):
        self.root, self.blocks, self.run = Node("page"), [], []
        self.stack, self.run_chars, self.run_links, self.in_link, self.hidden = [(self.root, "page")], 0, 0, 0, []
        low, at = None, 0
        while True:
            m = _TOKEN.search(html, at)
            if m is None:
                self.say(html[at:])
                break
            if m.start() > at:
                self.say(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    self.say(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
                continue
            tag = m[2].lower()
            if m[1]:
                self.close(tag)
                continue
            if tag in RAW:  # markup isn't read inside
                if low is None:
                    low = html.lower() if len(html.lower()) == len(html) else re.sub("[A-Z]", lambda c: c[0].lower(), html)
                end = low.find(f"</{tag}", at)
                at = len(html) if end < 0 else end
                self.open(tag, m[3])
                continue
            self.open(tag, m[3])
        self.flush()

    def say(self, text: str) -> None:
        if self.hidden or self.stack[-1][1] in RAW:
            return
        self.run.append(text)
        n = len(text) if not text.isspace() else 0
        self.run_chars += n
        self.run_links += n if self.in_link else 0

    def flush(self) -> None:
        if self.run_chars:
            node = self.stack[-1][0]
            text = "".join(self.run)
            node.kids.append(Node("#", chars=self.run_chars, links=self.run_links, const=hashlib.md5(" ".join(text.split()).encode("utf-8", "replace")).hexdigest()[:8], slots=[len(self.blocks)]))
            self.blocks.append(text)
        self.run, self.run_chars, self.run_links = [], 0, 0

    def open(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            if tag in ("br", "wbr", "img"):
                self.run.append(" " if tag == "br" else "")
            elif tag == "a":
                self.in_link = 1
            if self.hidden:
                self.hidden += [tag] * (tag == self.hidden[0] and tag not in VOID)
            elif tag not in VOID and "=" in attributes and kind_of(label_of(tag, attributes)) == "aside":
                self.hidden = [tag]
            return
        self.flush()
        self.hidden, self.in_link = [], 0
        stack = self.stack
        if stack[-1][1] == "p":  # a block ends an open paragraph
            stack.pop()
        if tag in CLOSES:
            ends, walls = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][1] in walls:
                    break
                if stack[k][1] in ends.split():
                    del stack[k:]
                    break
        label = label_of(tag, attributes if "=" in attributes else "")
        deep = len(stack) > MAX_DEPTH and not kind_of(label)
        node = stack[-1][0] if deep else Node(label)
        if not deep:
            stack[-1][0].kids.append(node)
        if tag not in VOID and not (attributes.endswith("/>") and tag in ("path", "circle", "rect", "use")):
            stack.append((node, tag))

    def close(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self.in_link = 0
            if self.hidden and tag == self.hidden[0]:
                self.hidden.pop()
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][1] == tag:
                self.flush()
                self.hidden, self.in_link = [], 0
                del self.stack[k:]
                return
        if tag == "p":  # ends a block, though none is open
            self.flush()


# --- alignment -------------------------------------------------------------------------------------------------------


def merge(a: Node, b: Node, repeat: bool) -> Node:
    """``b`` taken into ``a``: the same part of another page, or its next repetition."""
    a.many, a.maybe = a.many or b.many or repeat, a.maybe or b.maybe
    a.chars, a.links = a.chars + b.chars, a.links + b.links
    if a.const != b.const:
        a.const = b.const if a.const is None else a.const if b.const is None else False
    a.seen += b.seen
    a.slots += b.slots
    if a.kids or b.kids:
        a.kids = align(a.kids, b.kids)
    return a


def fold(nodes: list[Node]) -> list[Node]:
    """Repeated groups for runs that follow themselves: single elements first, then runs of two to six."""
    out: list[Node] = []
    for n in nodes:
        if out and out[-1].label == n.label and n.label not in ("#", "()"):
            merge(out[-1], n, True)
        else:
            out.append(n)
    period = 2
    while period <= 6 and len(out) >= 2 * period:
        keys, k, done, found = [n.key() for n in out], 0, [], False
        while k < len(out):
            if keys[k : k + period] == keys[k + period : k + 2 * period] and k + 2 * period <= len(out):
                group, first = out[k : k + period], keys[k : k + period]
                k += period
                while keys[k : k + period] == first:
                    for x, y in zip(group, out[k : k + period], strict=True):
                        merge(x, y, False)
                    k += period
                done.append(Node("()", group, many=True))
                found = True
            else:
                done.append(out[k])
                k += 1
        out, period = done, 2 if found else period + 1
    return out


def fold_as(nodes: list[Node], groups: list[tuple]) -> list[Node]:
    """``nodes`` with runs that spell one of the known groups made into it."""
    for key in groups:
        body = key[1:]
        n, keys, out, k = len(body), tuple(x.key() for x in nodes), [], 0
        while k < len(nodes):
            if keys[k : k + n] == body:
                out.append(Node("()", nodes[k : k + n], many=True))
                k += n
            else:
                out.append(nodes[k])
                k += 1
        if len(out) < len(nodes):
            merged: list[Node] = []
            for x in out:
                if merged and x.label == "()" and merged[-1].key() == key == x.key():
                    merge(merged[-1], x, True)
                else:
                    merged.append(x)
            nodes = merged
    return nodes


def matches(x: list, y: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; greedy first matches where the table would be large."""
    head = 0
    while head < len(x) and head < len(y) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    a, b = x[head : len(x) - tail], y[head : len(y) - tail]
    middle = []
    if a and b:
        if len(a) * len(b) <= CELLS:
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i in range(len(a) - 1, -1, -1):
                for j in range(len(b) - 1, -1, -1):
                    best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
            i = j = 0
            while i < len(a) and j < len(b):
                if a[i] == b[j]:
                    middle.append((head + i, head + j))
                    i, j = i + 1, j + 1
                elif best[i + 1][j] >= best[i][j + 1]:
                    i += 1
                else:
                    j += 1
        else:
            places: dict = {}
            for k, v in enumerate(b):
                places.setdefault(v, []).append(k)
            at = 0
            for i, v in enumerate(a):
                j = next((p for p in places.get(v, ()) if p >= at), None)
                if j is not None and j - at <= len(b) // max(1, len(a)) + 50:
                    middle.append((head + i, head + j))
                    at = j + 1
    return [(k, k) for k in range(head)] + middle + [(len(x) - tail + k, len(y) - tail + k) for k in range(tail)]


def paired(a: list[Node], b: list[Node]) -> tuple[list[Node], list[Node], list[tuple[int, int]]]:
    """Both sequences with each other's groups, and the places that match."""
    if [n.label for n in a] == [n.label for n in b] and not any(n.label == "()" for n in a):
        return a, b, [(k, k) for k in range(len(a))]
    groups = [n.key() for n in (*a, *b) if n.label == "()"]
    if groups:
        a, b = fold_as(a, groups), fold_as(b, groups)
    return a, b, matches([n.key() for n in a], [n.key() for n in b])


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """One sequence for both: what matches is merged, the rest is optional, and repeats among them become groups."""
    a, b, pairs = paired(a, b)
    out, i, j = [], 0, 0
    for x, y in [*pairs, (len(a), len(b))]:
        for n in (*a[i:x], *b[j:y]):
            n.maybe = True
            out.append(n)
        if x < len(a):
            out.append(merge(a[x], b[y], False))
        i, j = x + 1, y + 1
    return out if len(out) == len(pairs) else fold(out)


def folded(node: Node) -> Node:
    """The tree with repeats of its own folded, from the leaves up."""
    order, stack = [], [node]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += n.kids
    for n in reversed(order):
        if len(n.kids) > 1:
            n.kids = fold(n.kids)
    return node


def size(node: Node) -> int:
    return 1 + sum(size(k) for k in node.kids)


class Wrapper:
    """A host's wrapper with its number of pages and digests of up to SUPPORT different pages."""

    def __init__(self, tree: Node, pages: int, kinds: list[str]):
        self.tree, self.pages, self.kinds = tree, pages, kinds

    @classmethod
    def of_page(cls, html: str) -> Wrapper:
        reader = Reader(html)
        longest = max((" ".join(b.split()) for b in reader.blocks), key=lambda b: (len(b), b), default="")
        tree = folded(reader.root)
        stack = [tree]
        while stack:
            n = stack.pop()
            n.slots = []
            stack += n.kids
        return cls(tree, 1, [hashlib.md5(longest.encode("utf-8", "replace")).hexdigest()[:8]])

    def take(self, other: Wrapper) -> None:
        self.pages += other.pages
        self.kinds = sorted({*self.kinds, *other.kinds})[:SUPPORT]
        if size(self.tree) + size(other.tree) <= 2 * MAX_NODES:
            self.tree = merge(self.tree, other.tree, False)
        if size(self.tree) > MAX_NODES:
            prune(self.tree)

    def dumps(self) -> str:
        return json.dumps([self.pages, self.kinds, self.tree.plain()], separators=(",", ":"))

    @classmethod
    def loads(cls, text: str) -> Wrapper:
        pages, kinds, tree = json.loads(text)
        return cls(from_plain(tree), pages, kinds)


def prune(tree: Node) -> None:
    """Drops optional parts, those of least text first, until the wrapper is within MAX_NODES."""
    parts, stack = [], [tree]
    while stack:
        n = stack.pop()
        parts += [(total(k), size(k), n, k) for k in n.kids if k.maybe and kind_of(k.label) not in ("article", "main")]
        stack += n.kids
    over = size(tree) - MAX_NODES
    for _, n, parent, kid in sorted(parts, key=lambda p: p[0]):
        if over <= 0:
            break
        if any(k is kid for k in parent.kids):
            parent.kids = [k for k in parent.kids if k is not kid]
            over -= n


def total(node: Node) -> int:
    return node.chars + sum(total(k) for k in node.kids)


# --- which slots are the article ---------------------------------------------------------------------------------------


def prose(node: Node) -> int:
    """Characters outside links and of no fixed text in a part, without what its marks exclude."""
    if node.label == "#":
        return node.chars - node.links
    return 0 if kind_of(node.label) in ("never", "aside", "header") else sum(prose(k) for k in node.kids)


def candidates(tree: Node) -> list[Node]:
    """Elements that may be the article, the likeliest first."""
    found: list[tuple[int, int, int, Node]] = []

    def walk(node, off, depth):
        kind = kind_of(node.label)
        if kind == "never":
            return
        off = off or kind in ("aside", "header")
        if kind in ("article", "main"):
            words = prose(node) if not off else sum(prose(k) for k in node.kids)
            found.append((2 * off + (kind != "article"), -words, len(found), node))
            if kind == "article":
                return
        for k in node.kids:
            walk(k, off, depth + 1)

    walk(tree, False, 0)
    marked = [n for _, w, _, n in sorted(found, key=lambda f: f[:3]) if w < 0]
    return [*marked, dense(tree)]


def dense(tree: Node) -> Node:
    """The smallest container of most of the prose: down while one part holds seven tenths of it."""
    node = tree
    while True:
        whole = prose(node)
        best = max((k for k in node.kids if k.label != "#"), key=prose, default=None)
        tag = re.match(r"[^#.@$]*", best.label)[0] if best is not None else ""
        if best is None or tag in TEXTUAL or not whole or prose(best) < 0.7 * whole:
            return node
        node = best


def decide(tree: Node, kinds: int, pages: int) -> None:
    """Ranks every slot: 0 outside the article, else the number of the region that it belongs to (1 is the likeliest)."""
    stack = [tree]
    while stack:
        n = stack.pop()
        n.rank = 0
        stack += n.kids
    regions = candidates(tree)
    for rank, region in enumerate(regions, 1):
        marked = rank < len(regions)

        def keep(node, inside_header, at_top, rank=rank, marked=marked):
            kind, tag = kind_of(node.label), re.match(r"[^#.@$]*", node.label)[0]
            if not at_top and kind in ("never", "aside"):
                return
            inside_header = inside_header or kind == "header" and not at_top
            texts = [k for k in node.kids if k.label == "#"]
            # the host's own words: one text in most of its pages, which differ
            fixed = kinds >= SUPPORT and bool(texts) and all(k.const and k.seen >= SUPPORT and 2 * k.seen >= pages for k in texts)
            own = fixed and not node.many and tag not in HEADINGS and not at_top and (not marked or node.label != tag)
            # an unmarked region has menus of its own
            menu = not marked and not at_top and tag in ("ul", "ol", "div", "section", "table") and total(node) and links(node) >= 0.8 * total(node)
            if menu:
                return
            for k in node.kids:
                if k.label == "#":
                    if not k.rank and not own and (not inside_header or marked and tag in HEADINGS):
                        k.rank = rank
                else:
                    keep(k, inside_header, False)

        keep(region, False, True)


def links(node: Node) -> int:
    return node.links + sum(links(k) for k in node.kids)


@lru_cache(maxsize=2000)
def decided(wrapper: str) -> Node:
    w = Wrapper.loads(wrapper)
    decide(w.tree, len(w.kinds), w.pages)
    return w.tree


def place(page: Node, wrapper: Node, ranks: dict[int, int]) -> bool:
    """Gives the page's slots the ranks of the wrapper's; False if a part of the page isn't in the wrapper."""
    mine, known, pairs = paired(page.kids, wrapper.kids)
    whole = len(pairs) == len(mine)
    for i, j in pairs:
        a, b = mine[i], known[j]
        if a.label == "#":
            for s in a.slots:
                ranks[s] = b.rank
        elif a.kids:
            whole = place(a, b, ranks) and whole
    return whole


def main_text(html: str | None, wrapper: str | None) -> str:
    """The page's article, a block a line."""
    if not html:
        return ""
    reader = Reader(html)
    page = folded(reader.root)
    texts = [" ".join(unescape(b).split()) for b in reader.blocks]
    ranks: dict[int, int] = {}
    known = wrapper is not None and place(page, decided(wrapper), ranks)
    if not known or not any(r and texts[s] for s, r in ranks.items()):  # unlike the host's other pages, in part or as a whole
        ranks = ranks if any(r and texts[s] for s, r in ranks.items()) else {}
        decide(page, 0, 1)
        stack = [page]
        while stack:
            n = stack.pop()
            for s in n.slots if n.label == "#" else ():
                ranks.setdefault(s, n.rank)
            stack += n.kids
    first = min((r for s, r in ranks.items() if r and texts[s]), default=0)
    return "\n".join(t for s, t in enumerate(texts) if t and first and ranks.get(s) == first)


# --- Spark -------------------------------------------------------------------------------------------------------------

_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_PARTIAL = pa.schema([("host", pa.string()), ("pages", pa.int64()), ("wrapper", pa.string())])


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.coalesce(F.regexp_extract("url", _HOST, 1), F.lit("")))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))


def _rows(wrappers: dict[str, Wrapper]):
    got = sorted(wrappers.items())
    return pa.RecordBatch.from_arrays([pa.array([h for h, _ in got], pa.string()), pa.array([w.pages for _, w in got], pa.int64()), pa.array([w.dumps() for _, w in got], pa.string())], schema=_PARTIAL)


def _first_fold(batches):
    have: dict[str, Wrapper] = {}
    for batch in batches:
        for host, html in zip(C.column(batch, "host").to_pylist(), C.column(batch, "html").to_pylist(), strict=True):
            if not html:
                continue
            page = Wrapper.of_page(html)
            if host in have:
                have[host].take(page)
            else:
                have[host] = page
            if len(have) > HOSTS:
                yield _rows(have)
                have = {}
    if have:
        yield _rows(have)


def _fold_sorted(batches):
    """Folds the wrappers of each host from rows in host order; holds one wrapper."""
    host, have, ready = None, None, []
    for batch in batches:
        for h, text in zip(C.column(batch, "host").to_pylist(), C.column(batch, "wrapper").to_pylist(), strict=True):
            got = Wrapper.loads(text)
            if have is not None and h == host:
                have.take(got)
                continue
            if have is not None:
                ready.append((host, have))
                if len(ready) >= 200:
                    yield _rows(dict(ready))
                    ready = []
            host, have = h, got
    if have is not None:
        yield _rows(dict([*ready, (host, have)]))


def infer(pages: DataFrame) -> DataFrame:
    """One row per host: host, pages, wrapper.  ``pages`` has url and html."""
    C.tune(pages.sparkSession)
    ddl = "host string, pages long, wrapper string"
    out = with_host(pages).select("host", "html").mapInArrow(_first_fold, ddl)
    for salts in (SALTS, 1):
        keys = ["host"] if salts == 1 else ["host", F.pmod(F.xxhash64("wrapper"), F.lit(salts))]
        out = out.repartition(*keys).sortWithinPartitions("host", F.desc("pages"), "wrapper").mapInArrow(_fold_sorted, ddl)
    return out


def extract(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.  ``wrappers`` is what ``infer`` gave, inferred here if absent."""
    C.tune(pages.sparkSession)
    wrappers = C.written(infer(pages)) if wrappers is None else wrappers
    rows = with_host(pages)
    size_of, page_count = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host")), F.sum("pages")).first()
    if (size_of or 0) <= BROADCAST_BYTES:
        met = rows.join(F.broadcast(wrappers.select("host", "wrapper")), "host", "left")
    else:
        hot = wrappers.where(F.col("pages") > (page_count or 0) / HOT).select("host", F.lit(True).alias("hot"))  # at most HOT rows
        salt = F.when(F.col("hot"), F.pmod(F.xxhash64("page_id", "url"), F.lit(HOT))).otherwise(0).cast("int")
        copies = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(HOT - 1))).otherwise(F.array(F.lit(0))))
        spread = wrappers.join(F.broadcast(hot), "host", "left").select("host", "wrapper", copies.alias("salt"))
        met = rows.join(F.broadcast(hot), "host", "left").withColumn("salt", salt).join(spread, ["host", "salt"], "left")

    def run(batches):
        for batch in batches:
            texts = [main_text(h, w) for h, w in zip(C.column(batch, "html").to_pylist(), C.column(batch, "wrapper").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([C.column(batch, "page_id"), C.column(batch, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return met.select("page_id", "url", "html", "wrapper").mapInArrow(run, OUTPUT.replace(", ", ","))
