"""Main text of web pages by site template removal.

Pages are read into element trees.  Subtrees are hashed and counted in Spark over the pages of each host, and those that
recur under many different main texts of a host are the site's template: they are deleted, and what is left is the text.
Boxes outside a page's main passage are hashed by structure (tags, attribute names, classes, ids, the shapes of their
children, no words), as a menu or an advert differs in words from page to page; everything is also hashed by tags and
words, for boxes and lines that recur literally.

Hosts of few pages have no template: there the article and what elements say of themselves (tags, and words of class, id and
role outside articles) are all there is to go by.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.common import cut

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[-_]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes template svg xmp".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Start tags that end an open element of the same kind, up to the element that holds such ones.
_CLOSES = {"p": ({"p"}, {"body", "div", "article", "section", "td", "li", "blockquote"}), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements and marks (whole words of class or id, or joined of such alone) of what is no article.
_NO_ARTICLE = frozenset("nav footer aside form button select option dialog menu head".split())
_MARKS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice popup promo related replies share sharing sidebar signup social sponsor sponsored subscribe widget".split())
#: Of these marks the only ones that count inside an article: readers' comments.
_COMMENTS = frozenset("comment comments disqus replies reply".split())
#: Controls and what isn't shown; header counts as no article where it stands outside of one.
_UNSEEN = frozenset("head button select option".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: Elements whose recurrence makes them template, unless they are a page's main passage; inline ones where their parent has no text beside them.
_TEMPLATE = frozenset("aside blockquote center details dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header menu nav ol p pre section table ul".split())
_LEAF = frozenset("blockquote h1 h2 h3 h4 h5 h6 p pre".split())
_INLINE = frozenset("a b em i small span strong".split())
#: Boxes that are hashed by structure, those of them that say what they are without class, id or role, and elements that lend
#: a box no shape.
_BOXES = frozenset("aside center details div dl fieldset figure footer form header menu nav ol section table ul".split())
_TELLING = frozenset("aside footer form header menu nav".split())
_SHAPELESS = frozenset("b br em hr i img small strong sub sup u wbr".split())
#: Share of the prose (text outside links) of its pages below which a recurring structure is template.
MOST_SHARE = 0.1
_DIGITS = re.compile(r"\d+")
#: Different main texts of a host under which a template's subtree stands: LEAST_PAGES at least, and LEAST_SHARE of all or, on
#: large hosts, LOG_PAGES times the binary logarithm of all.
LEAST_PAGES, LEAST_SHARE, LOG_PAGES = 5, 0.25, 4
#: Stands for a host's having a template.
SITE = 1
#: Recurring subtrees up to which every worker holds all of them (8 bytes each).
BROADCAST_SUBTREES = 4_000_000


class Node:
    __slots__ = ("attributes", "children", "name", "parent")

    def __init__(self, name: str, attributes: str, parent: Node | None):
        self.name, self.attributes, self.parent = name, attributes, parent
        self.children: list[Node | str] = []


def parse(page: str) -> Node:
    """The element tree of a page, however badly formed; texts have their character references decoded."""
    root = node = Node("#root", "", None)
    at, low, end = 0, None, len(page)
    opened: Counter[str] = Counter()  # names of open elements, so that no search goes up in vain

    def close(inner: Node, outer: Node) -> Node:
        """Ends outer and all open elements inside it."""
        while inner is not outer.parent:
            opened[inner.name] -= 1
            inner = inner.parent
        return inner

    def text(a: int, b: int) -> None:
        if b > a:
            s = page[a:b]
            node.children.append(html.unescape(s) if "&" in s else s)

    while at < end:
        start = page.find("<", at)
        if start < 0:
            break
        m = _TAG.match(page, start)
        if m is None:  # a bare sign
            text(at, start + 1)
            at = start + 1
            continue
        text(at, start)
        at = m.end()
        name = m[2] and m[2].lower()
        if not name:
            continue
        if m[1]:
            seek = node if opened[name] else root
            while seek is not root and seek.name != name and not (name not in _BLOCK and seek.name in _BLOCK):
                seek = seek.parent
            if seek is not root and seek.name == name:
                node = close(node, seek)
            elif name in ("p", "br"):
                node.children.append(Node(name, "", node))
            continue
        if name in _RAW:
            low = page.lower() if low is None else low
            if len(low) != end:  # some letters change length
                found = re.compile(f"</{name}", re.I).search(page, at)
                stop = found.start() if found else -1
            else:
                stop = low.find(f"</{name}", at)
            at = end if stop < 0 else stop
            if stop >= 0:
                m = _TAG.match(page, stop)
                at = m.end() if m else stop + 2
            continue
        if name in _BLOCK:
            kinds, holders = _CLOSES.get(name, _CLOSES["p"] if name != "body" else (set(), set()))
            seek = node if any(opened[k] for k in kinds) else root
            while seek is not root and seek.name not in holders:
                if seek.name in kinds:
                    node = close(node, seek)
                    break
                seek = seek.parent
        child = Node(name, m[3], node)
        node.children.append(child)
        if name not in _VOID and not (m[3].endswith("/") and name not in _BLOCK):
            node = child
            opened[name] += 1
    text(at, end)
    return root


def _marks(node: Node) -> tuple[dict[str, str], set[str]]:
    """The attributes, and the words of class and id with those joined of marks alone taken apart."""
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(node.attributes)}
    words = f"{found.get('class', '')} {found.get('id', '')}".split()
    marks = set(words)
    for word in words:
        parts = [x for x in _SPLIT.split(word) if x]
        if _MARKS.issuperset(parts):
            marks.update(parts)
    return found, marks


def _no_article(node: Node, inside: bool, guarded: set[int] = frozenset(), in_article: bool = False) -> bool:
    """Whether the element says itself that it is no part of an article; inside: it stands in an article or main element;
    in_article: in an article, where of class, id and role only readers' comments count; guarded: see there."""
    if node.name in _NO_ARTICLE and not (node.name in ("form", "dialog") and id(node) in guarded) or node.name == "header" and not inside:
        return True
    if not node.attributes or node.name in ("main", "body", "html"):
        return False
    found, marks = _marks(node)
    if node.name == "article":  # only readers' comments are articles that don't count
        return not marks.isdisjoint(("comment", "comments", "reply", "replies"))
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return True
    if id(node) in guarded:
        return False
    if in_article:
        return not _COMMENTS.isdisjoint(marks)
    if not _ROLES.isdisjoint(found.get("role", "").split()):
        return True
    return not _MARKS.isdisjoint(marks)


def _unseen(node: Node) -> bool:
    """Whether the element is a control or isn't shown."""
    if node.name in _UNSEEN:
        return True
    if not node.attributes or node.name in ("main", "body", "html", "article"):
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(node.attributes)}
    return "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()


def guarded(root: Node) -> set[int]:
    """Elements (by id()) that no mark, role or form tag drops: those around all articles and main elements of the page, or
    around one of them and most of the page's text; on pages without such, those around most of the text."""
    tops, chars = {}, {}
    order = list(_walk(root))
    for node in reversed(order):
        texts = [" ".join(c.split()) if isinstance(c, str) else c for c in node.children]
        chars[id(node)] = sum(len(c) if isinstance(c, str) else chars[id(c)] for c in texts)
        own = node.name == "main" or node.name == "article" and not _no_article(node, False)
        tops[id(node)] = own + sum(tops[id(c)] for c in texts if not isinstance(c, str))
    n, size = tops[id(root)], chars[id(root)]
    most = lambda k: 2 * chars[k] > size
    return {k for k in chars if (tops[k] == n or tops[k] and most(k)) and (n or most(k))}


def _walk(node: Node):
    """All elements, parents first."""
    todo = [node]
    while todo:
        node = todo.pop()
        yield node
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]


def _signature(node: Node) -> tuple[str, bool]:
    """Tag, classes, id (digits as 0) and the names of other attributes; whether class, id or role tell the element apart."""
    if not node.attributes.strip(" /"):
        return node.name, False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(node.attributes)}
    own = [*sorted(set(found.get("class", "").split())), "#" + _DIGITS.sub("0", found.get("id", "")), found.get("role", "")]
    return " ".join([node.name, *own, *sorted(found.keys() - {"class", "id", "role"})]), any(x in found for x in ("class", "id", "role"))


class Subtrees:
    """Hashes of a page's template-like elements: literal (by id(), of tags and words) and shapes (by id(), of structure).

    Elements around an article have none.  Shapes are given to boxes outside the main passage: all articles and main
    elements (articles: whether these hold any text), else the innermost element with at least half of the page's prose.
    share: prose of all boxes of each shape."""

    def __init__(self, root: Node):
        order = list(_walk(root))
        digests, shapes, chars, prose, holds, mixed, telling = {}, {}, {}, {}, set(), set(), set()
        self.literal: dict[int, int] = {}
        for node in reversed(order):
            h, key = xxhash.xxh64(node.name), id(node)
            size = plain = 0
            kids = set()
            for c in node.children:
                if isinstance(c, Node):
                    k = id(c)
                    h.update(digests[k])
                    size += chars[k]
                    plain += prose[k]
                    if c.name not in _SHAPELESS:
                        kids.add(shapes[k])
                    if k in holds or c.name in ("article", "main"):
                        holds.add(key)
                else:
                    words = " ".join(c.split())
                    if words:
                        h.update(words)
                        size += len(words)
                        plain += len(words)
                        mixed.add(key)
            name, own = _signature(node)
            digests[key], chars[key], prose[key] = h.digest(), size, 0 if node.name in ("a", "button", "option") else plain
            shape = xxhash.xxh64("shape " + name)
            for k in sorted(kids):
                shape.update(k)
            shapes[key] = shape.digest()
            if own or node.name in _TELLING or not prose[key]:
                telling.add(key)
            if size and node.name in (_TEMPLATE | _INLINE) and key not in holds:
                self.literal[key] = int.from_bytes(digests[key], "big", signed=True)
        self.nodes, self.prose, self.chars = {id(n): n for n in order}, prose[id(root)], chars[id(root)]
        within, passage, top = set(), set(), root
        while inner := next((c for c in top.children if isinstance(c, Node) and prose[id(c)] and 2 * prose[id(c)] >= self.prose), None):
            passage.add(id(top))
            top = inner
        passage.add(id(top))
        for node in order:
            if node.name in ("article", "main") or id(node.parent) in within:
                within.add(id(node))
        self.articles = any(chars[k] for k in within)
        if self.articles:
            passage, top = set(), None
        inside = set(within)
        for node in order:
            key, up = id(node), id(node.parent)
            if node is top or up in inside:
                inside.add(key)
            if node.name in _INLINE and (up in mixed or node.parent.name in _INLINE or node.parent.name == "p"):
                self.literal.pop(key, None)  # a part of a sentence
            elif node.name in _LEAF and key in within and any(isinstance(c, Node) for c in node.children):
                self.literal.pop(key, None)  # a passage with marked up words is the article's own
        free = [k for k, n in self.nodes.items() if n.name in _BOXES and chars[k] and k in telling and k not in holds and k not in inside and k not in passage]
        self.share: Counter[int] = Counter()
        self.shapes = {k: int.from_bytes(shapes[k], "big", signed=True) for k in free}
        for k, shape in self.shapes.items():
            self.share[shape] += prose[k]
        #: Text of the main passage, by which copies of a page are told.
        texts = [c for n in order if id(n) in inside for c in n.children if isinstance(c, str)] or [c for n in order for c in n.children if isinstance(c, str)]
        passage_text = " ".join("".join(texts).split())
        self.main, self.passage_chars = xxhash.xxh64_intdigest(passage_text) - (1 << 63), len(passage_text)

    def counted(self) -> dict[int, int]:
        """The page's distinct hashes with their prose; literal ones, and boxes that stand outside of articles, count without."""
        return dict.fromkeys(self.literal.values(), 0) | {h: 0 if self.articles else n for h, n in self.share.items() if self.articles or 2 * n < self.prose or not n}


def template_nodes(root: Node, known) -> set[int]:
    """The elements (by id()) whose hashes known(array) finds in the template, without a page's main passage: on pages without
    articles boxes of one shape with half of the prose, and a paragraph, heading, quotation or inline element with half of the text."""
    s = Subtrees(root)
    keys = [*s.literal, *s.shapes]
    if not keys:
        return set()
    hits = known(np.fromiter([*s.literal.values(), *s.shapes.values()], np.int64))
    out = set()
    for n, (k, hit) in enumerate(zip(keys, hits, strict=True)):
        if not hit:
            continue
        if n >= len(s.literal):
            keep = not s.articles and s.share[s.shapes[k]] and 2 * s.share[s.shapes[k]] >= s.prose
        else:
            keep = s.nodes[k].name in _LEAF | _INLINE and 2 * _length(s.nodes[k]) >= (s.passage_chars or s.chars)
        if not keep:
            out.add(k)
    return out


def _length(node: Node) -> int:
    return sum(len(" ".join(c.split())) for x in _walk(node) for c in x.children if isinstance(c, str))


def main_text(root: Node, deleted: set[int] = frozenset(), names: bool = True, site: bool = False) -> str:
    """The text of a page without what is deleted (by id()), controls and what isn't shown.

    site: the page's host has a template, which is deleted; all that is left is text, but for elements outside articles whose
    very tag says that they are none (nav, footer, aside, form, header and so on).  Otherwise the text of all main elements and
    articles (else of the body), without elements that say that they are no article; inside an article their tag says so, or
    the words of class and id for readers' comments.  names=False: nothing is told by names, neither tags nor words."""
    guard = guarded(root) if names else frozenset()

    def drops(node: Node, inside: bool, in_article: bool) -> bool:
        if id(node) in deleted:
            return True
        if not names:
            return node.name == "head"
        if site:
            outside = node.name in _NO_ARTICLE or node.name == "header"
            return _unseen(node) or outside and not in_article and id(node) not in guard
        return _no_article(node, inside, guard, in_article)

    kept, todo = [], [root]
    while todo and names and not site:  # outermost articles and main elements that aren't part of something dropped
        node = todo.pop()
        if drops(node, False, False):
            continue
        if node.name in ("article", "main"):
            kept.append(node)
            continue
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    inside = bool(kept)
    parts: list[str] = []
    for top in kept or [root]:
        stack: list[tuple[Node | str, bool]] = [(top, False)]
        while stack:
            node, in_article = stack.pop()
            if isinstance(node, str):
                parts.append(node)
                continue
            if node is not top and drops(node, inside, in_article):
                if node.name in _BLOCK:
                    parts.append(" ")
                continue
            if node.name in _BLOCK or node.name == "br":
                parts.append(" ")
                stack.append((" ", False))
            here = in_article or node.name == "article"
            stack += [(c, here) for c in reversed(node.children)]
        parts.append(" ")
    return " ".join("".join(parts).split())


def host_of(url):
    """The host of a url, in lower case; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return F.when(host != "", host)


def _of_host(host: str, hashes: np.ndarray) -> np.ndarray:
    """Subtree hashes mixed with their host's, so that one sorted array can hold those of all hosts."""
    return hashes ^ np.int64(xxhash.xxh64_intdigest(host) - (1 << 63))


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, subtrees, mains, prose, whole = [], [], [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            s = Subtrees(parse(page))
            found = s.counted()
            hosts += [host] * (len(found) + 1)
            subtrees += [*found, None]  # null stands for the page
            prose += [*found.values(), 0]
            mains += [s.main] * (len(found) + 1)
            whole += [s.prose] * (len(found) + 1)
        columns = [pa.array(hosts, pa.string()), *(pa.array(x, pa.int64()) for x in (subtrees, mains, prose, whole))]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "subtree", "main", "prose", "whole"])


def site_rules(pages: DataFrame, url: str = "url", page: str = "html", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, subtree long): the templates of all hosts of at least least_pages different main texts, with a row of subtree SITE
    for each such host; see templates."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(page).alias("html")).where("host is not null and html is not null")
    seen = rows.mapInArrow(_subtrees, "host string, subtree long, main long, prose long, whole long")
    seen = seen.groupBy("host", "subtree", "main").agg(F.max("prose").alias("prose"), F.max("whole").alias("whole"))
    counts = seen.groupBy("host", "subtree").agg(F.count("*").alias("n"), F.sum("prose").alias("prose"), F.sum("whole").alias("whole"))
    counts = cut(counts.where((F.col("n") >= least_pages)))
    hosts = counts.where("subtree is null").select("host", F.col("n").alias("all"))
    bar = F.least(F.col("all") * least_share, LOG_PAGES * F.log2("all"))
    found = counts.where("subtree is not null").where((F.col("prose") == 0) | (F.col("prose") < MOST_SHARE * F.col("whole")))
    found = found.join(hosts, "host").where(F.col("n") >= bar).select("host", "subtree")
    return found.union(hosts.select("host", F.lit(SITE).alias("subtree")))


def templates(pages: DataFrame, url: str = "url", page: str = "html", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, subtree long): subtrees under at least least_pages different main texts of the host and, of all its n main texts,
    least_share or LOG_PAGES * log2(n), whichever is less; structures hold less than MOST_SHARE of these pages' prose.

    Copies of a page count once, as they have one main text.  Pages without a host have no template."""
    return site_rules(pages, url, page, least_pages, least_share).where(F.col("subtree") != SITE)


def _extract(shared, names: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for host, page, own in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                root = parse(page or "")
                known = None
                if host is not None:
                    every = shared.value if shared is not None else np.array(own or [], np.int64)
                    known = lambda x: np.isin(x, every) if shared is None else _found(every, _of_host(host, x))  # noqa: E731, B023
                if known is not None and known(np.array([SITE], np.int64))[0]:
                    texts.append(main_text(root, template_nodes(root, known), names, site=True))
                else:
                    texts.append(main_text(root, names=names))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def _found(every: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array."""
    return every[np.minimum(np.searchsorted(every, x), len(every) - 1)] == x if len(every) else np.zeros(len(x), bool)


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        mixed = [int(_of_host(h, np.int64(x))) for h, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(mixed, pa.int64())], names=["subtree"])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", broadcast_subtrees: int = BROADCAST_SUBTREES, names: bool = True) -> DataFrame:
    """page_id, url, text and n_chars (code points) of the main text of every page.

    On hosts of at least LEAST_PAGES different main texts the site's template is removed, and what is left is the text; on
    others, and where there is no url, the text is found by names (see main_text).  Each block's white space is one space,
    blocks follow in page order, joined by one space; character references are decoded.  Null and empty pages, and those
    without main text, give the empty text.  Repeated rows stay.  Without rows the result is empty.  Pages aren't shuffled while
    at most broadcast_subtrees subtrees recur; beyond, they are joined by host, where adaptive execution splits a hot one.
    names=False leaves all to template removal."""
    found = cut(site_rules(pages, url, page))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), host_of(F.col(url)).alias("host"), F.col(page).alias("html"))
    if found.count() <= broadcast_subtrees:
        every = np.sort(np.asarray(found.mapInArrow(_mixed, "subtree long").toArrow()["subtree"].combine_chunks(), np.int64))
        shared = pages.sparkSession.sparkContext.broadcast(every)
        rows = rows.withColumn("subtrees", F.lit(None).cast("array<long>"))
    else:
        shared = None
        rows = rows.join(found.groupBy("host").agg(F.collect_list("subtree").alias("subtrees")), "host", "left").select("page_id", "url", "host", "html", "subtrees")
    return rows.mapInArrow(_extract(shared, names), f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long")
