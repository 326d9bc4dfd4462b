"""Main text of web pages by union-free wrappers of their hosts.

* A page is tokenised into a tree of elements (end tags that HTML lets out are supplied).
* Its wrapper is folded from that tree: neighbouring siblings of one kind become a repeated group
  ``( )+``, texts become slots, which keep the digest of each text that stands once on the page.
* The wrappers of a host are aligned one after the other: the n-th group of a kind under one parent is the partner of the n-th
  group of that kind on other pages; partners are merged, what has none becomes an optional group ``( )?``.  Where texts
  of a slot differ from page to page the slot holds data.  All that a wrapper counts is sums, and what it keeps of texts is what all
  pages with the slot have, so neither the order of pages nor how they are dealt to tasks changes it.  Pages of a host are merged in
  each task first and the tasks' wrappers in two steps, so no task reads all pages of a hot host.
* Which of its nodes are the article is decided on the wrapper.  From the root, the element that holds nine tenths of
  the varying text is entered as long as there is one (no repeated group, no block of text).  Marks (article, main, names of classes) only
  break ties: the best marked nodes on that way, or the marked ones at its end that
  hold half of the varying text, are the article; without any, the last element entered is.  Nodes in it that are menus, footers,
  sidebars, notices, adverts, forms and comments by their kind are left out; the article's own header stays.
* The template's texts go too: a text that every page with its slot has, on three pages at least where the slot holds nothing
  else, and on eight where it stands in a slot or repeated group that also holds data, as pages may share a paragraph.  They stay
  where they are half or more of a page's article, as pages that repeat one article have nothing else.
* A page's tokens are then matched with the wrapper, node by node, and its text is what they put into the slots of the article's nodes.

A class is a sign of an aside only if all its parts are: ``share-buttons`` and ``cookie-notice`` are, ``share-price``
and ``notice-period`` are not.

Cases: a null or empty html gives the empty text; broken markup is read as far as it goes; pages
without a host share one wrapper; repeated pages and page ids are rows of their own; a very long or deeply
nested page is read whole; where an element has over 4096 kinds of children in a wrapper, those that the fewest pages have are forgotten there, and with them
only what they would have told of the template: their texts stay in the pages; a page without its host's article is read as if it were alone;
an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import html
import json
import re
import sys
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longleaf.llm.common import Tables, map_arrow, texts

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^<>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
#: Elements of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
ASIDE = frozenset("nav header footer aside form button select head dialog menu".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|main|content|entry|post|story)(?:[\s_-]?(?:body|text|content))?(?=$|[\s_-])", re.I)
#: Words that say of an element, as a whole class or id, that it is no part of an article: outside of one, and in one.
ASIDES = frozenset("ad ads advert adverts advertisement advertising banner banners sponsor sponsors sponsored promo promos promotion sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer footers cookie cookies consent notice notices popup popups modal modals newsletter newsletters subscribe subscription share shares sharing social related recommended recommendations recommendation comment comments pagination pager".split())
OUTSIDE = ASIDES | frozenset("side header headers masthead foot reply replies respond login signup search widget widgets copyright legal disclaimer toolbar tag tags".split())
#: Parts that may stand beside these words without changing what they say.
NEUTRAL = frozenset("bar bars bottom box boxes block blocks body btn btns button buttons column container content contents form global group inner item items js left link links list lists main my outer page panel post posts right row section sections site slot story stories sticky strip teaser teasers thread top unit web widget widgets wrap wrapper zone area article articles blog module component".split())
#: Marks of elements that are no part of an article if other marked elements are there.
TEASER = re.compile(r"(?:^|[\s_-])(?:teasers?|related|recommend\w*|promo\w*|sponsor\w*|advert\w*|share|sharing|social|tags|comments?)(?=$|[\s_-]|\d)", re.I)
#: Blocks of text, which are parts of an article and never all of it.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure".split())
#: Pages that a template text stands on at least, in a slot of its own and beside data; kinds of children that an element keeps; hosts that a task merges at a time; groups of a host's wrappers.
EVIDENCE, SHARED, KINDS, HOSTS, GROUPS = 3, 8, 4096, 2000, 32


@lru_cache(maxsize=100_000)
def aside(mark: str, inside: bool) -> bool:
    """Whether one of an element's classes, ids or roles says that it is no part of an article."""
    words = ASIDES if inside else OUTSIDE
    for name in mark.lower().split():
        parts = [p for p in re.split(r"[-_\d]+", name) if p]
        if any(p in words for p in parts) and all(p in OUTSIDE or p in NEUTRAL or len(p) == 1 for p in parts):
            return True
    return False


@dataclass
class Node:
    tag: str
    mark: str = ""
    children: list[Node | str] = field(default_factory=list)


def parse(page: str) -> Node:
    """The page's tree; strings are texts as they stand, without comments and raw elements."""
    root = Node("#root")
    stack = [root]
    at = 0
    raw_until = ""
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        name = (m.group(2) or "").lower()
        if raw_until:
            if not (m.group(1) and name == raw_until):
                continue
            raw_until, at = "", m.end()
            continue
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if not name:
            continue
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    del stack[i:]
                    break
                if name in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        if name in RAW:
            if not m.group(3).rstrip().endswith("/"):
                raw_until = name
            continue
        if name in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE:
                    break
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            peers = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(name, ("dt", "dd"))
            while len(stack) > 1 and (stack[-1].tag in peers or stack[-1].tag in INLINE or stack[-1].tag == "p"):
                del stack[-1]
        mark = " ".join(v.strip("\"'") for k, v in _ATTRIBUTE.findall(m.group(3)) if k.lower() in ("class", "id", "role")) if m.group(3) else ""
        node = Node(name, mark)
        stack[-1].children.append(node)
        if name not in VOID and not m.group(3).rstrip().endswith("/"):
            stack.append(node)
    if not raw_until and at < len(page):
        stack[-1].children.append(page[at:])
    return root


# A wrapper node is [tag, mark, how often ("1", "?", "+", "*"), pages, characters, children, characters in links, {digest of a
# text that stands once on each of its pages: characters}, sum of its places among its parent's children].


def _deep() -> None:
    """Let calls nest as deeply as pages do (only Python's own frames do, and these are on the heap)."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000_000))


def _kind(n: Node) -> str:
    """An element's marks, with numbers made alike."""
    return re.sub(r"\d+", "0", n.mark) if n.mark else ""


def _plain(n: Node) -> bool:
    """Whether an element is part of the text around it."""
    return n.tag in INLINE and not any(isinstance(x, Node) and x.tag not in INLINE for x in n.children)


def _said(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def _below(path: int, n: Node | list) -> int:
    """Digest of an element, or of a wrapper's node, below one of that digest."""
    tag, kind = (n.tag, _kind(n)) if isinstance(n, Node) else (n[0], n[1])
    return xxhash.xxh64_intdigest(f"{tag} {kind}", path)


def _digest(path: int, text: str) -> int:
    """A text in the slot of that path."""
    return xxhash.xxh64_intdigest(text, path)


def _key(w: list) -> tuple[str, str]:
    return w[0], w[1]


def _keys(children: list[list]) -> list[tuple[str, str, int]]:
    """Kinds of children, with which of its kind each is."""
    seen: Counter[tuple[str, str]] = Counter()
    out = []
    for w in children:
        out.append((*_key(w), seen[_key(w)]))
        seen[_key(w)] += 1
    return out


def fold(node: Node) -> list:
    """The wrapper of a page alone; inline elements are part of the text around them."""
    _deep()
    seen: Counter[int] = Counter()

    def one(node: Node, path: int) -> list:
        said: list[list[str]] = [[]]
        linked = 0
        inner: list[list] = []

        def read(n: Node, link: bool) -> None:
            nonlocal linked
            for c in n.children:
                if isinstance(c, str):
                    said[-1].append(c)
                    linked += len(c.strip()) if link else 0
                elif c.tag in ("br", "hr"):
                    said.append([]) if c.tag == "hr" else said[-1].append(" ")
                elif _plain(c):
                    read(c, link or c.tag == "a")
                elif c.tag not in VOID:
                    said.append([])
                    inner.append(one(c, _below(path, c)))

        read(node, False)
        pieces = [t for t in map(_said, said) if t]
        chars = sum(map(len, pieces))
        fixed = {}
        for t in pieces:
            d = _digest(path, t)
            seen[d] += 1
            fixed[d] = len(t)
        children: list[list] = []
        for w in inner:
            if children and _key(children[-1]) == _key(w):
                children[-1] = _again(children[-1], w)
            else:
                children.append(w)
        for place, w in enumerate(children):
            w[8] = place
        return [node.tag, _kind(node), "1", 1, chars, children, min(linked, chars), fixed, 0]

    def once(w: list) -> None:
        w[7] = {d: n for d, n in w[7].items() if seen[d] == 1}
        for c in w[5]:
            once(c)

    out = one(node, 0)
    once(out)
    return out


def _often(a: str, b: str) -> str:
    optional, repeated = a in "?*" or b in "?*", a in "+*" or b in "+*"
    return "*" if optional and repeated else "?" if optional else "+" if repeated else "1"


def _aligned(x: list[list], y: list[list], join) -> list[list]:
    """Children of two nodes, by their mean places: partners joined, the others optional."""
    one, other = dict(zip(_keys(x), x, strict=True)), dict(zip(_keys(y), y, strict=True))
    if list(one) == list(other):
        return [join(p, q) for p, q in zip(x, y, strict=True)]
    lone = lambda w: [*w[:2], _often(w[2], "?"), *w[3:]]
    both = {k: join(w, other[k]) if k in other else lone(w) for k, w in one.items()} | {k: lone(w) for k, w in other.items() if k not in one}
    order = sorted(both, key=lambda k: (both[k][8] / both[k][3], k))
    # of one kind, which is the first is what was merged as the first
    rank = {k: n for n, k in enumerate(order)}
    by_kind: dict[tuple[str, str], list[int]] = {}
    for k in order:
        by_kind.setdefault(k[:2], []).append(rank[k])
    out: list[list] = [[]] * len(order)
    for kind, places in by_kind.items():
        for n, place in enumerate(sorted(places)):
            out[place] = both[(*kind, n)]
    return out


def _again(a: list, b: list) -> list:
    """A repeated group from two neighbours on one page."""
    return [a[0], a[1], _often(_often(a[2], b[2]), "+"), 1, a[4] + b[4], _aligned(a[5], b[5], _again_once), a[6] + b[6], {**a[7], **b[7]}, a[8]]


def _again_once(a: list, b: list) -> list:
    w = _again(a, b)
    w[2] = _often(a[2], b[2])
    return w


def merge(a: list, b: list) -> list:
    """Align two wrapper nodes of one kind, from different pages; texts that not both have are data."""
    children = _aligned(a[5], b[5], merge)
    if len(children) > KINDS:
        least = sorted((c[3] for c in children), reverse=True)[KINDS - 1]
        children = [c for c in children if c[3] >= least]
    return [a[0], a[1], _often(a[2], b[2]), a[3] + b[3], a[4] + b[4], children, a[6] + b[6], {d: n for d, n in a[7].items() if d in b[7]}, a[8] + b[8]]


def dumps(w: list) -> str:
    """A wrapper as JSON: its nodes, parents first, with their depth, at any nesting."""
    out, todo = [], [(0, w)]
    while todo:
        depth, n = todo.pop()
        out.append([depth, *n[:5], n[6], sorted(n[7].items()), n[8]])
        todo += [(depth + 1, c) for c in reversed(n[5])]
    return json.dumps(out)


def loads(text: str) -> list:
    _deep()
    way: list[list] = []
    for depth, tag, mark, often, pages, chars, links, fixed, place in json.loads(text):
        node = [tag, mark, often, pages, chars, [], links, {d: n for d, n in fixed}, place]
        del way[depth:]
        if way:
            way[-1][5].append(node)
        way.append(node)
    return way[0]


def off(w: list | Node) -> bool:
    """Whether an element outside of an article is no way to one."""
    tag, mark = (w.tag, w.mark) if isinstance(w, Node) else (w[0], w[1])
    told = bool(mark) and tag not in ("article", "main") and aside(mark, False)
    return tag in ASIDE or told and not (ARTICLE.search(mark) and not re.search(r"comment|sidebar|footer|header|related", mark, re.I))


def inner_off(w: list | Node) -> bool:
    """Whether an element in an article is no part of it."""
    tag, mark = (w.tag, w.mark) if isinstance(w, Node) else (w[0], w[1])
    return tag in ASIDE and tag != "header" or bool(mark) and tag not in ("article", "main") and aside(mark, True)


def _rank(w: list | Node) -> int:
    """How well an element is marked as an article, 0 for not at all."""
    tag, mark = (w.tag, w.mark) if isinstance(w, Node) else (w[0], w[1])
    return 3 if tag == "article" else 2 if tag == "main" else 1 if mark and ARTICLE.search(mark) and not off(w) else 0


def _weights(w: list, varying: bool) -> dict[int, int]:
    """By id of node: text below it, without links (and, if varying, without the template's), outside of what is off."""
    out: dict[int, int] = {}

    def weigh(n: list) -> int:
        total = max(0, n[4] - n[6] - (n[3] * sum(n[7].values()) if varying and n[3] > 1 else 0))
        for c in n[5]:
            if not off(c):
                total += weigh(c)
        out[id(n)] = total
        return total

    weigh(w)
    return out


def article(w: list) -> dict:
    """What a wrapper says of its pages: the digests of the article's nodes (roots), of the nodes in them that are no part of it (off), of the template's texts (fixed), and whether roots are marked as an article."""
    _deep()
    weight = _weights(w, True)
    if weight[id(w)] * 10 < _weights(w, False)[id(w)]:  # pages that repeat one text
        weight = _weights(w, False)
    node, digest, rank = w, 0, 0
    while inner := [c for c in node[5] if not off(c)]:
        most = max(inner, key=lambda c: weight[id(c)])
        if weight[id(most)] * 10 < weight[id(node)] * 9 or most[0] in BLOCKS or most[2] in "+*" and not _rank(most):
            break
        node, digest = most, _below(digest, most)
        rank = max(rank, _rank(node))
    if not rank:
        share: Counter[int] = Counter()
        todo = [node]
        while todo:
            for c in todo.pop()[5]:
                if off(c):
                    continue
                if r := _rank(c):
                    share[r] += weight[id(c)]
                    best = max((_rank(x) for x in _nodes(c) if not off(x)), default=0)
                    if best > r:
                        share[best] += weight[id(c)]
                else:
                    todo.append(c)
        rank = max((r for r, n in share.items() if 2 * n >= weight[id(node)]), default=0)
    roots = _marked(w, rank) if rank else [(node, digest)]
    gone: set[int] = set()
    for root, at in roots:
        own = root[0] not in ("#root", "html", "body")  # whether a header in it is the article's
        todo_in = [(c, _below(at, c)) for c in root[5]]
        while todo_in:
            c, d = todo_in.pop()
            if inner_off(c) if rank or own and c[0] == "header" else off(c):
                gone.add(d)
            else:
                todo_in += [(x, _below(d, x)) for x in c[5]]
    fixed = sorted({d for n in _nodes(w) for d in n[7] if n[3] >= (EVIDENCE if n[2] in "1?" and n[4] == n[3] * sum(n[7].values()) else SHARED)})
    return {"roots": sorted({d for _, d in roots}), "off": sorted(gone), "fixed": fixed, "marked": bool(rank)}


def _nodes(w: list) -> list[list]:
    out, todo = [], [w]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += n[5]
    return out


def _marked(root: list, rank: int) -> list[tuple[list, int]]:
    """The outermost nodes of a wrapper that are marked with that rank, with their digests, without teasers beside others."""
    out: list[tuple[list, int]] = []
    todo = [(root, 0)]
    while todo:
        n, path = todo.pop()
        if n is not root and _rank(n) == rank:
            out.append((n, path))
            continue
        todo += [(c, _below(path, c)) for c in reversed(n[5]) if not off(c)]
    return [x for x in out if not TEASER.search(x[0][1])] or out


def _matched(root: Node, where: dict) -> list[tuple[Node, int]]:
    """The page's elements that are the article's nodes of the wrapper, in page order, outermost ones, with their digests."""
    roots = where["roots"]
    if 0 in roots:
        return [(root, 0)]
    out: list[tuple[Node, int]] = []
    todo = [(root, 0)]
    while todo:
        n, path = todo.pop()
        if path in roots:
            out.append((n, path))
            continue
        todo += [(c, _below(path, c)) for c in reversed(n.children) if isinstance(c, Node) and not _plain(c)]
    return out


def _menu(n: Node) -> bool:
    """Whether a list or division outside of marked articles holds little but links, two at least."""
    links, linked, all_of = 0, 0, 0
    todo: list[tuple[Node | str, bool]] = [(n, False)]
    while todo:
        c, inside = todo.pop()
        if isinstance(c, str):
            size = len("".join(c.split()))
            all_of += size
            linked += size if inside else 0
        else:
            links += c.tag == "a"
            todo += [(x, inside or c.tag == "a") for x in c.children]
    return links > 1 and linked * 10 >= all_of * 9


def blocks(node: Node, path: int, where: dict) -> list[tuple[int, str]]:
    """Digests (of path and text) and texts of the blocks that a page puts into an article's node, in page order."""
    out: list[tuple[int, str]] = []
    said: list[str] = []
    gone, marked = where["off"], where["marked"]

    def close(path: int) -> None:
        if text := _said(said):
            out.append((_digest(path, text), text))
        said.clear()

    todo: list = [(iter(node.children), path, False)]
    while todo:
        children, path, block = todo[-1]
        c = next(children, None)
        if c is None:
            todo.pop()
            if block or not todo:
                close(path)
        elif isinstance(c, str):
            said.append(c)
        elif c.tag in ("br", "wbr"):
            said.append(" " if c.tag == "br" else "")
        elif c.tag in INLINE and _plain(c):
            if inner_off(c):
                close(path)
            else:
                todo.append((iter(c.children), path, False))
        elif c.tag not in VOID:
            below = _below(path, c)
            if below in gone or not marked and c.tag in ("ul", "ol", "dl", "div", "section", "table", "p") and _menu(c):
                close(path)
            elif c.tag in INLINE:
                todo.append((iter(c.children), below, False))
            else:
                close(path)
                todo.append((iter(c.children), below, True))
        elif c.tag == "hr":
            close(path)
    return out


def known(place: str) -> dict:
    """What article() gave, from JSON, ready to be asked."""
    where = json.loads(place)
    return where | {k: frozenset(where[k]) for k in ("roots", "off", "fixed")}


def extract_page(page: str, where: dict | None) -> str:
    """The text of a page whose host's wrapper says so (see article), or of a page alone."""
    root = parse(page)

    def at(where: dict) -> list[tuple[int, str]]:
        return [b for n, path in _matched(root, where) for b in blocks(n, path, where)]

    found = at(where) if where else []
    if not found:
        found = at(article(fold(root)))
    fixed = where["fixed"] if where else ()
    own = [text for digest, text in found if digest not in fixed]
    everything = [text for _, text in found]
    return "\n\n".join(own if 2 * sum(map(len, own)) > sum(map(len, everything)) else everything)


def host_of(url_col: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def wrappers(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, place): each host's wrapper and where its article is (see article), as JSON."""

    def each(known: dict[str, list], task: int) -> dict[str, object]:
        return {"host": list(known), "group": [task % GROUPS] * len(known), "wrapper": list(map(dumps, known.values()))}

    def add(known: dict[str, list], host: str, w: list) -> None:
        known[host] = merge(known[host], w) if host in known else w

    def pages(batches):
        """One wrapper for each host of a task (more where it has many hosts)."""
        known: dict[str, list] = {}
        task = TaskContext.get().partitionId()
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                if host not in known and len(known) == HOSTS:
                    yield each(known, task)
                    known = {}
                add(known, host, fold(parse(page)))
        if known:
            yield each(known, task)

    def grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
        """Wrappers (host, group, wrapper) of equal keys as one, in a task that reads them sorted."""

        def joined(batches):
            mine: tuple | None = None
            whole: list = []
            for batch in batches:
                for host, group, w in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    key = (host, group) if len(keys) == 2 else (host,)
                    if key == mine:
                        whole = merge(whole, loads(w))
                        continue
                    if mine is not None:
                        yield {"host": [mine[0]], "group": [0 if len(mine) == 1 else mine[1]], "wrapper": [dumps(whole)], "place": [json.dumps(article(whole))]}
                    mine, whole = key, loads(w)
            if mine is not None:
                yield {"host": [mine[0]], "group": [0 if len(mine) == 1 else mine[1]], "wrapper": [dumps(whole)], "place": [json.dumps(article(whole))]}

        dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "wrapper").select("host", "group", "wrapper")
        return map_arrow(dealt, joined, {"host": "string", "group": "int", "wrapper": "string", "place": "string"}, whole=True)

    first = map_arrow(df.select(host_of(url_col).alias("host"), F.col(html_col).alias("html")), pages, {"host": "string", "group": "int", "wrapper": "string"}, whole=True)
    return grouped(grouped(first, ["host", "group"]), ["host"]).select("host", "wrapper", "place")


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    places = Tables(df.sparkSession).write(wrappers(df, url_col, html_col).select("host", "place"), "wrappers")

    def extract(batch: pa.RecordBatch) -> dict[str, object]:
        places_of: dict[str, dict] = {}
        out = []
        for p, place in zip(texts(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            if place is not None and place not in places_of:
                places_of[place] = known(place)
            out.append(extract_page(p, places_of.get(place)))
        return {"page_id": batch.column(0), "url": batch.column(1), "text": out, "n_chars": [len(t) for t in out]}

    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(url_col).alias("host"))
    return map_arrow(pages.join(places, "host", "left").select("page_id", "url", "html", "place"), extract, {"page_id": "long", "url": "string", "text": "string", "n_chars": "long"})
