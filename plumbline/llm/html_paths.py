"""Main text of web pages by tag-path ratios.

A page's text nodes are grouped by their root-to-leaf tag path (tag names with their classes). For each
path, text length per node and punctuation per node are taken, fused as their geometric mean, given to
the path's nodes and smoothed along page order. The shares of its text inside links and menus lower a path's value, and so
does what its own markup says where ratios can't tell, since it is prose too (an element that is a footer, form or the
like, or whose class, id or role names one, an advert or a comment). Paths whose value reaches a threshold (a share of the values' standard deviation, and of the largest value) are content paths.
The smallest element that holds most of the content paths' text is the content element; it grows to its enclosing
article or main element where there is one. Its blocks are returned: all text but that of paths below the threshold
which are lowered or in a menu, since nothing else of an article may go. Text outside of the content element belongs to it
where its path's value is at least the mean of the element's content. Where there is no article, list items and rows of links
that hold nothing else are menus too. The first h1 before an element without an own h1 or h2 that is neither lowered nor
in a menu is its headline.

A class or id counts only where all words of one of its names are such words or modifiers (``nav-menu`` and
``site-footer`` do, ``share-price`` and ``has-sidebar`` don't), and not on an element that holds the page's
article, main element or h1 and half of its text outside links.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and
joined in page order by two line feeds. Null or empty html, or html without content, gives the empty
text. Whole pages are read whatever their length and depth; attributes are read by HTML's rules, broken markup
the way browsers do for unclosed paragraphs and list items, and an article or main element ends an unclosed
menu. Repeated rows each return a row, extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import string
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.common import map_column

#: Element names and words that classes, ids and roles use for what isn't article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
MENU_TAGS = frozenset("nav menu".split())
LOWERED_TAGS = frozenset("footer aside form button select option dialog".split())
MENU_WORDS = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager".split())
LOWERED_WORDS = frozenset(
    "header masthead topbar footer foot bottombar sidebar aside widget widgets rail "
    "notice notices alert cookie cookies consent gdpr popup modal overlay banner promo promotion paywall disclaimer toast "
    "ad ads adv advert adverts advertisement advertising adsense adslot adsbygoogle adbox adunit adbanner adcontainer sponsor sponsored sponsors outbrain taboola dfp "
    "form login signin signup register subscribe subscription newsletter search searchbox "
    "comment comments commentlist disqus respond reply replies discussion "
    "share sharing social sharebar related recommended recommendations trending skip hidden copyright legal".split()
)
#: Words that only say where or how, so that a name made of them and LOWERED_WORDS is lowered.
MODIFIERS = frozenset(
    "site page global main primary secondary top bottom left right upper lower inner outer sub mini small large fixed sticky inline "
    "list lists box block blocks wrapper wrap container content area section panel bar row col column group item items link links text body "
    "button buttons icon icons slot unit zone holder placeholder thread post posts article articles entry story stories news media module modules "
    "google js the and of id div no new tab tabs wide full floating mobile desktop".split()
)
#: Words that make a class of a header its article's own.
ARTICLE_WORDS = frozenset("article post entry story content page title".split())
MENU_ROLES = frozenset("navigation menu menubar".split())
LOWERED_ROLES = frozenset("banner contentinfo complementary search form dialog alertdialog alert".split())
KEEPERS = frozenset("html body main article h1".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
NEAR = frozenset("ul ol dl table tr select li dt dd td th option".split())
UNSEEN = frozenset("head title script style template noscript iframe object svg canvas audio video datalist map".split())
LISTS = frozenset("li ul ol dl menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Factor of a path that its markup lowers.
LOWERED = 0.05
#: Part of the largest value that a content path has at least.
FLOOR = 0.1

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?+)?+)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+))?+)?+""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NAMES = re.compile(r"\s+")
_PUNCTUATION = str.maketrans("", "", string.punctuation + "。、，；：？！…«»“”‘’„¿¡—–")


class Element:
    """An element of the page. ``path`` numbers its tag path; ``own`` says that its markup names what isn't article text,
    ``named`` that it names a menu; ``lowered`` and ``menu`` that it does so itself or an element around it."""

    __slots__ = ("tag", "parent", "path", "label", "own", "named", "menu", "lowered", "unseen", "link", "article", "depth", "solid", "near", "mass", "keeps", "inside")

    def __init__(self, tag: str, parent: Element | None, label: str, own: bool, paths: dict, named: bool = False):
        self.tag, self.parent, self.label, self.own, self.named, self.menu = tag, parent, label, own, named, False
        self.path = paths.setdefault((parent.path if parent else -1, label), len(paths))
        self.unseen = tag in UNSEEN or (parent is not None and parent.unseen)
        self.link = tag == "a" or (parent is not None and parent.link)
        inside = parent.article if parent else None
        self.article = inside or (self if tag in ("article", "main") and not own else None)
        self.depth = parent.depth + 1 if parent else 0
        self.solid = parent.solid if parent and tag in INLINE else self
        self.near = parent.near if parent and tag not in NEAR else self
        self.lowered, self.mass, self.keeps, self.inside = False, 0.0, False, False


class Node:
    __slots__ = ("element", "text", "block", "size")

    def __init__(self, element: Element, text: str, block: int):
        self.element, self.text, self.block = element, text, block
        self.size = len(text.strip())

    @property
    def path(self) -> tuple[int, bool]:
        """The node's tag path; what markup lowers is a path of its own."""
        return self.element.path, self.element.lowered


def path_of(e: Element | None) -> str:
    """The tag path of an element as text."""
    labels = []
    while e is not None:
        labels.append(e.label)
        e = e.parent
    return "/".join(reversed(labels))


def _names_boilerplate(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, str]:
    """(whether the element's own markup says it isn't article text, whether it calls it a menu, its path label)."""
    own, menu = tag in LOWERED_TAGS or tag == "header" and not in_article, tag in MENU_TAGS
    if not attributes or attributes.isspace() or attributes == "/":
        return own, menu, tag
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    kind = found.get("class", "")
    label = f"{tag}.{'.'.join(kind.split())}" if kind.strip() else tag
    if own or menu or tag in ("html", "body"):
        return own, menu, label
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True, False, label
    if tag in ("main", "h1"):
        return False, False, label
    role = found.get("role", "").lower()
    if role in LOWERED_ROLES or role in MENU_ROLES:
        return role in LOWERED_ROLES, role in MENU_ROLES, label
    for name in _NAMES.split(f"{kind} {found.get('id', '')}"):
        words = {w.lower() for w in _WORDS.findall(name)}
        lowered, menus = words & LOWERED_WORDS, words & MENU_WORDS
        if not (lowered or menus) or words - LOWERED_WORDS - MENU_WORDS - MODIFIERS:
            continue
        if lowered == {"header"} and not menus and (in_article or words & ARTICLE_WORDS):
            continue
        return bool(lowered), not lowered, label
    return False, False, label


def parse(page: str, plain: bool = False) -> list[Node]:
    """Text nodes in page order, without what a browser never shows, each with its element and the number of its block.

    ``plain`` leaves the markup's own words unread, where only the visible text is wanted.
    """
    paths: dict = {}
    root = Element("#root", None, "", False, paths)
    at, nodes, block, pos = root, [], 0, 0
    size, opened, elements = len(page), Counter(), [root]

    def close(to: Element) -> Element:
        """Close elements up to and including ``to``; the element then at hand."""
        e = at
        while e is not to:
            opened[e.tag] -= 1
            e = e.parent
        opened[to.tag] -= 1
        return to.parent

    while pos < size:
        m = _TOKEN.search(page, pos)
        end = m.start() if m else size
        if end > pos and not at.unseen:
            nodes.append(Node(at, entities.unescape(page[pos:end]), block))
        if not m:
            break
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            block += 1
        if m[1]:
            if opened[tag] > 0:
                e = at
                while e.tag != tag:
                    e = e.parent
                at = close(e)
            continue
        attributes = m[3] or ""
        if tag in CLOSES_P and opened["p"] > 0 and at.solid.tag == "p":
            at = close(at.solid)
        if tag in SIBLINGS:
            names, limits = SIBLINGS[tag]
            e = at.near
            while e is not root and e.tag not in limits and e.tag not in names.split():
                e = e.parent.near
            if e.tag in names.split():
                at = close(e)
        for limit in ("nav", "header", "form", "head") if tag in ("article", "main") else ("head",) if tag == "body" else ():
            while opened[limit] > 0:
                e = at
                while e.tag != limit:
                    e = e.parent
                at = close(e)
        own, menu, label = (False, False, tag) if plain else _names_boilerplate(tag, attributes, at.article is not None)
        if tag in VOID:
            if tag == "br" and not at.unseen:
                nodes.append(Node(at, " ", block))
            continue
        if attributes.endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]|\Z", re.I).search(page, pos)
            shut = page.find(">", stop.start())
            pos = size if shut < 0 else shut + 1
            block += 1
            continue
        at = Element(tag, at, label, own, paths, menu)
        elements.append(at)
        opened[tag] += 1
    if not plain:
        _lower(elements, nodes)
    return nodes


def _lower(elements: list[Element], nodes: list[Node]) -> None:
    """Say of each element whether markup lowers it or calls it a menu: its own or an ancestor's, void where it holds the article and half the text."""
    for n in nodes:
        if not n.element.link:
            n.element.mass += n.size
    for e in reversed(elements):
        e.keeps = e.keeps or e.tag in ("article", "main", "h1") and not e.own
        if e.parent is not None:
            e.parent.mass += e.mass
            e.parent.keeps = e.parent.keeps or e.keeps
    total = elements[0].mass
    for e in elements:
        void = e.keeps and e.tag != "article" and 2 * e.mass >= total > 0
        e.lowered = e.own and not void or (e.parent is not None and e.parent.lowered)
        e.menu = e.named and not void or (e.parent is not None and e.parent.menu)


def joined_blocks(nodes: list[Node]) -> str:
    """The nodes' blocks in page order: white space collapsed, trimmed, joined by two line feeds."""
    held: dict[int, list[str]] = defaultdict(list)
    for n in nodes:
        held[n.block].append(n.text)
    blocks = (" ".join("".join(texts).split()) for _, texts in sorted(held.items()))
    return "\n\n".join(b for b in blocks if b)


def path_values(nodes: list[Node], smoothing: tuple[float, ...]) -> dict[tuple[int, bool], float]:
    """The value of each path: fused ratios, smoothed along page order, lowered by markup and by the shares of links and menus."""
    length, marks, links, menus, count = defaultdict(float), defaultdict(float), defaultdict(float), defaultdict(float), defaultdict(int)
    for n in nodes:
        p = n.path
        length[p] += n.size
        marks[p] += len(n.text) - len(n.text.translate(_PUNCTUATION))
        links[p] += n.size * n.element.link
        menus[p] += n.size * n.element.menu
        count[p] += 1
    fused = {p: ((length[p] / count[p]) * (marks[p] / count[p] + 0.1)) ** 0.5 for p in count}
    raw = np.array([fused[n.path] for n in nodes])
    kernel = np.array(smoothing) / sum(smoothing)
    half = len(kernel) // 2
    smooth = np.convolve(np.pad(raw, half, mode="edge"), kernel, mode="valid")
    sums = defaultdict(float)
    for n, v in zip(nodes, smooth, strict=True):
        sums[n.path] += v
    return {p: 0.5 * (s / count[p] + fused[p]) * (1 - links[p] / length[p]) * (1 - (1 - LOWERED) * menus[p] / length[p]) * (LOWERED if p[1] else 1.0) for p, s in sums.items()}


def content_paths(nodes: list[Node], threshold: float, smoothing: tuple[float, ...]) -> dict[tuple[int, bool], float]:
    """The paths whose value reaches the threshold, by the values' standard deviation over nodes and by the largest value."""
    values = path_values(nodes, smoothing)
    spread = float(np.array([values[n.path] for n in nodes]).std())
    top = max(values.values())
    limit = min(max(threshold * spread, FLOOR * top), top)
    return {p: v for p, v in values.items() if v >= limit}


def main_text(page: str | None, threshold: float = 0.8, smoothing: tuple[float, ...] = (1, 2, 4, 2, 1), majority: float = 0.9) -> str:
    """The main text of one page."""
    nodes = [n for n in parse(page or "") if n.text]
    solid = [n for n in nodes if n.size]
    if all(n.element.lowered or n.element.menu for n in solid):
        return ""
    content = content_paths(solid, threshold, smoothing)
    chosen = _content_element(solid, content, majority)
    own = [(content[n.path], n.size) for n in solid if n.element.inside and n.path in content]
    mean = sum(v * k for v, k in own) / max(sum(k for _, k in own), 1)
    beside = {p for p, v in content.items() if v >= mean * (1 - 1e-9)}
    within = [n for n in nodes if (n.path in content or not (n.element.lowered or n.element.menu) if n.element.inside else n.path in beside)]
    links, sizes, anchors, prose = defaultdict(int), defaultdict(int), defaultdict(set), set()
    for n in within:
        sizes[n.block] += n.size
        if n.element.link:
            links[n.block] += n.size
            anchors[n.block].add(n.element)
        if _prose(n.element, chosen):
            prose.add(n.block)
    listed = {n.block for n in within if _under(n.element, chosen, LISTS)}
    whole = chosen.tag in ("#root", "html", "body")
    accepted = {n.block for n in within if n.size and (n.path in content or not whole or n.element.tag in HEADINGS)}
    ours = chosen.article is None  # of an article nothing but what markup names is left out
    menus = {b for b, n in sizes.items() if ours and n and links[b] == n and b not in prose and (whole or len(anchors[b]) > 1 or b in listed)}
    if accepted <= menus:
        menus = set()
    kept = [n for n in within if n.block in accepted and n.block not in menus]
    return joined_blocks(_headline(nodes, within, chosen) + kept)


def _headline(nodes: list[Node], within: list[Node], chosen: Element) -> list[Node]:
    """The nodes of the first unlowered h1 before a content element that has no h1 or h2."""
    if chosen.tag in ("#root", "html", "body", "article", "main") or any(n.element.solid.tag in ("h1", "h2") for n in within):
        return []
    found = None
    for n in nodes:
        if n.element.inside:
            break
        if found is None and n.size and n.element.solid.tag == "h1" and not (n.element.lowered or n.element.menu):
            found = n.element.solid
    return [n for n in nodes if found is not None and n.element.solid is found]


def _content_element(solid: list[Node], content: dict[tuple[int, bool], float], majority: float) -> Element:
    """The deepest element with the given share of the content text, grown to its article or main element; marks what is inside."""
    elements: dict[Element, float] = defaultdict(float)
    total = 0.0
    for pick in (lambda n: n.path in content and not n.element.link, lambda n: n.path in content):
        for n in solid:
            if pick(n):
                elements[n.element] += n.size
                total += n.size
        if total:
            break
    every = set(elements)
    for e in list(elements):
        while e.parent is not None and e.parent not in every:
            e = e.parent
            every.add(e)
    best = None
    for e in sorted(every, key=lambda e: -e.depth):
        if best is None and elements[e] >= majority * total:
            best = e
        if e.parent is not None:
            elements[e.parent] += elements[e]
    if best.article:
        best = best.article
    else:
        while best.parent and (best.tag in INLINE or best.tag in ("p", "blockquote", "li", "pre") or best.tag in HEADINGS):
            best = best.parent
    _mark_inside(solid, best)
    return best


def _mark_inside(nodes: list[Node], top: Element) -> None:
    known: dict[Element, bool] = {top: True}
    for n in nodes:
        e, way = n.element, []
        while e is not None and e not in known:
            way.append(e)
            e = e.parent
        inside = e is not None and known[e]
        for x in way:
            known[x] = inside
    for e, inside in known.items():
        e.inside = inside


def _under(e: Element, top: Element, tags: frozenset[str]) -> bool:
    while e is not top and e is not None:
        if e.tag in tags:
            return True
        e = e.parent
    return False


def _prose(e: Element, top: Element) -> bool:
    """The nearest block element is a paragraph or heading outside a list."""
    while e.tag in INLINE and e is not top:
        e = e.parent
    return (e.tag in ("p", "blockquote", "figcaption", "pre", "td", "dd") or e.tag in HEADINGS) and not _under(e, top, LISTS)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), **options) -> DataFrame:
    """(id, keep..., text, n_chars): the main text of every page and its length in code points."""

    def make():
        def work(rows: list) -> list:
            texts = [main_text(p, **options) for p in rows]
            return [texts, [len(t) for t in texts]]

        return work

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return map_column(pages, html_col, make, fields, [id_col, *keep])
