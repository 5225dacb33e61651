"""Main text of web pages by composite text density.

For each DOM node: C characters, T tags below it, and LC, LT of these in links. The density C / T is adjusted
for links by the logarithm of (C / LC)(T / LT) to a base that grows with the share of link text, in the node and in
the body. A node's sum is that of its children's densities. The least density on the path from the node of the largest
sum up to the body is the threshold: every subtree that reaches it, from the body down, holds a part of the
article, and of each that of the largest sum is taken. Menus, forms, adverts and the like, known by their tags
or class names, are taken out before, unless they wrap the main content. (Sun, Song and Liao 2011.)
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, texts_of, trimmed

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.DOTALL)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
_WHITE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Taken out with all below them, unless spare() finds that they wrap the main content.
DROPPED = frozenset("nav footer aside form script style noscript iframe template svg math button select option textarea title head dialog menu object embed canvas audio video input search".split())
#: Words in a class, id or role that mark what is no article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead comment comments disqus respond replies cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login popup modal overlay share sharing social related recommended widget toolbar pagination pager search complementary contentinfo alert paywall skip".split()
)
#: Those of DROPPED that may wrap the main content.
WRAPPERS = frozenset("nav footer aside form menu dialog search".split())
#: Those that as a part of a name leave no doubt.
CLEAR = frozenset("banner related recommended advert adverts advertisement advertising sponsor sponsored nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead comment comments disqus respond replies cookie cookies consent gdpr newsletter subscribe subscription signup popup modal pagination paywall".split())
#: Why a node goes: by all means; by its tag or a whole name; by a part of a name, or as a form; by a hint in its name.
HARD, BY_TAG, BY_PART, BY_HINT = 1, 2, 3, 4
#: Of the main content, what a node must hold more than to stay nevertheless.
SHARE = {BY_TAG: 0.9, BY_PART: 0.5, BY_HINT: 0.5}
#: A node that only a hint marks goes if it has less than so many characters outside links, or more of them inside: density
#: has the last word about the others.
HINTED_CHARS = 100
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of a sentence, a list or an article.
INLINE = HEADINGS | frozenset("b i em strong span a u small mark code br sup sub p li".split())
#: Elements that end an open one of the same group.
_CLOSES = {
    "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"),
}
_SCOPE = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",)}


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "drop", "named", "text", "sum", "top")

    def __init__(self, tag: str, parent: Node | None, drop: int = 0):
        self.tag, self.parent, self.drop = tag, parent, drop
        self.children: list[Node | str] = []
        self.named = False
        self.text = self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.top = self


def parse(page: str) -> Node:
    """A tree good enough for any bytes: unclosed elements end with what holds them, stray ends are ignored."""
    root = body = Node("body", None)
    now, at, size = root, 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else size
        if stop > at:
            now.children.append(page[at:stop])
        if not m:
            break
        at = m.end()
        if not m[2]:
            if page.startswith("<![CDATA[", m.start()):
                now.children.append(page[m.start() + 9 : at].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            node = now
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node is not body and not (tag not in BLOCKS and _block_between(now, node)):
                now = node.parent
            elif tag == "p":
                now.children.append(Node("p", now))
            continue
        if tag in ("html", "body"):
            continue
        if tag in BLOCKS:
            now = _close(now, ("p",), ("table", "td", "th", "li", "div", "article", "section", "main", "blockquote", "button")) if tag not in ("html", "body") else now
        if tag in _CLOSES:
            now = _close(now, _CLOSES[tag], _SCOPE.get(tag, ()))
        node = Node(tag, now, _dropped(tag, m[3], now))
        node.named = tag == "article" and _named(m[3]) > 0
        now.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            now = node
        elif tag not in VOID and tag not in ("path", "use"):
            now = node  # a slash closes nothing in HTML
    return root


def _block_between(now: Node, node: Node) -> bool:
    while now is not node:
        if now.tag in BLOCKS:
            return True
        now = now.parent
    return False


def _close(now: Node, tags: tuple[str, ...], scope: tuple[str, ...]) -> Node:
    node = now
    while node.parent is not None and node.tag not in scope:
        if node.tag in tags:
            now = node.parent
            if tags == ("p",):
                return now
        node = node.parent
    return now


def _dropped(tag: str, attributes: str, parent: Node) -> int:
    """0: stays; otherwise HARD, or BY_TAG, BY_PART or BY_HINT, about which spare() has the last word."""
    if tag in DROPPED:
        return (BY_PART if tag == "form" else BY_TAG) if tag in WRAPPERS else HARD
    if tag == "header":
        while parent is not None:
            if parent.tag in ("article", "main"):
                return 0
            parent = parent.parent
        return BY_TAG
    if not attributes or tag in ("article", "main"):
        return 0
    if _HIDDEN.search(attributes):
        return HARD
    return _named(attributes)


def _named(attributes: str) -> int:
    """BY_TAG if a whole name is a mark ("navbar", "cookieNotice"), BY_PART if a part of one is ("with-sidebar"), BY_HINT if that may
    be a word of another name as well ("share-price")."""
    out = 0
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = [p.lower() for p in _SPLIT.split(name) if p]
            if name.lower() in MARKS or (parts and MARKS.issuperset(parts)):
                return BY_TAG
            if not CLEAR.isdisjoint(parts):
                out = BY_PART
            elif not MARKS.isdisjoint(parts):
                out = out or BY_HINT
    return out


def spare(root: Node) -> None:
    """Keep what would go by its name or tag but wraps the main content: more than SHARE of what main elements
    hold, or without them article elements, or without both of all text outside links; in an article or main element,
    of what that holds. If nothing at all would be left, the node with the most text outside links stays."""
    nodes, todo = [], [(root, root, False)]
    base: list[Node] = []
    links: list[bool] = []
    while todo:
        node, b, link = todo.pop()
        link = link or node.tag == "a"
        nodes.append(node)
        base.append(b)
        links.append(link)
        inner = node if node.tag in ("article", "main") else b
        todo += [(c, inner, link) for c in reversed(node.children) if isinstance(c, Node) and c.drop != HARD]
    soft = any(n.drop for n in nodes)
    held: dict[int, list[int]] = {id(n): [0, 0, 0, 0] for n in nodes}  # outside links: all text, that in articles, in main; in links
    for node, link in zip(reversed(nodes), reversed(links), strict=True):
        node.text = sum(len(_WHITE.sub(" ", html.unescape(c)).strip()) for c in node.children if isinstance(c, str))
        if not soft:
            continue
        h = held[id(node)]
        h[3 if link else 0] += node.text
        if node.tag == "article" and not node.named:
            h[1] = h[0]
        elif node.tag == "main":
            h[2] = h[0]
        if node.parent is not None:
            up = held[id(node.parent)]
            for k in range(4):
                up[k] += h[k]
    if not soft:
        return
    for node, b in zip(nodes, base, strict=True):
        if node.drop:
            whole, h = held[id(b)], held[id(node)]
            k = 0 if b.tag == "article" else 1 if b.tag == "main" and whole[1] else 2 if b is root and whole[2] else 1 if b is root and whole[1] else 0
            if h[k] > SHARE[node.drop] * whole[k] or (node.drop == BY_HINT and h[0] >= HINTED_CHARS and h[0] > h[3]):
                node.drop = 0
    kept = _nodes(root)
    if not any(n.text for n in kept):
        stay = {id(n) for n in kept}
        edge = [n for n in nodes if n.drop and id(n.parent) in stay and held[id(n)][0]]
        if edge:
            max(edge, key=lambda n: held[id(n)][0]).drop = 0


def _nodes(root: Node) -> list[Node]:
    """In document order, without dropped subtrees; an explicit stack, since pages nest without bound."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node) and not c.drop]
    return out


def measure(root: Node) -> list[Node]:
    spare(root)
    nodes = _nodes(root)
    inside = {id(root): False}
    for node in nodes[1:]:
        inside[id(node)] = node.tag == "a" or inside[id(node.parent)]
    for node in reversed(nodes):
        node.chars += node.text
        if inside[id(node)]:
            node.link_chars += node.text
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags + (node.tag == "a")
    c, lc = max(root.chars, 1), root.link_chars
    for node in nodes:
        tags = max(node.tags, 1)
        plain = max(node.chars - node.link_chars, 1)
        base = math.log(node.chars / plain * node.link_chars + lc / c * node.chars + math.e)
        ratio = node.chars / max(node.link_chars, 1) * tags / max(node.link_tags, 1)
        node.density = node.chars / tags * math.log(ratio) / math.log(base) if node.chars and ratio > 1 and base > 1 + 1e-12 else (node.chars / tags if node.chars and ratio > 1 else 0.0)
    return nodes


def select(root: Node) -> tuple[Node, float]:
    """The subtree of the largest sum of densities, and the least density from it up to the body."""
    nodes = measure(root)
    for node in nodes:  # a node of text alone has its own density as sum
        below = [c for c in node.children if isinstance(c, Node) and not c.drop]
        node.sum = sum(c.density for c in below) if any(c.tag in BLOCKS for c in below) else node.density
        node.top = node
    for node in reversed(nodes):
        if node.parent is not None and node.top.sum >= node.parent.top.sum and not (node.parent.top is node.parent and node.top.sum == node.parent.sum):
            node.parent.top = node.top
    best = root.top
    while best.parent is not None and best.tag in INLINE:  # a part of a sentence or a list isn't the article
        best = best.parent
    least, node = best.density, best
    while node is not None:
        least, node = min(least, node.density), node.parent
    return best, least


def content(root: Node) -> tuple[Node, frozenset[int]]:
    """The smallest subtree with all marked ones, and the subtrees in it that are left out.

    From the body down, of each subtree whose density reaches the threshold that of its largest sum is marked.
    Beside marked subtrees stay headings, paragraphs and bare text; within an article element all that is not mostly
    links. A heading in front of the marked ones, if they have none of the first rank, is theirs.
    """
    best, threshold = select(root)
    marked, todo = {id(best)}, [root]
    found = [best]
    while todo:
        node = todo.pop()
        if id(node) in marked or node.density < threshold or not node.chars:
            continue
        top = node.top
        while top is not node and top.tag in INLINE:
            top = top.parent
        if id(top) not in marked:
            marked.add(id(top))
            found.append(top)
        if top is not node:
            todo += [c for c in node.children if isinstance(c, Node) and not c.drop]
    holds: dict[int, int] = {}  # marked subtrees at or below a node
    for node in found:
        up: Node | None = node
        while up is not None:
            holds[id(up)] = holds.get(id(up), 0) + 1
            up = up.parent
    low = best
    while holds[id(low)] < len(found):
        low = low.parent
    up = low
    while up is not None:
        low, up = (up if up.tag == "article" else low), up.parent
    while low.parent is not None and not any(n.tag == "h1" for n in _nodes(low)) and _titled(low):
        low = low.parent
    skip: list[int] = []
    walk = [(low, low.tag == "article")]
    while walk:
        node, article = walk.pop()
        if id(node) in marked:
            continue
        for c in node.children:
            if isinstance(c, Node) and not c.drop:
                if id(c) in holds:
                    walk.append((c, article or c.tag == "article"))
                elif c.density < threshold and c.tag not in INLINE and not (article and c.chars > 2 * c.link_chars):
                    skip.append(id(c))
    return low, frozenset(skip)


def _titled(node: Node) -> bool:
    """A heading stands before it."""
    for c in node.parent.children:
        if c is node:
            return False
        if isinstance(c, Node) and not c.drop and c.tag in HEADINGS:
            return True
    return False


def text_below(node: Node, skip: frozenset[int] = frozenset()) -> str:
    out: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(html.unescape(x))
        elif id(x) not in skip and not x.drop:
            if x.tag in BLOCKS or x.tag == "br":
                out.append(" ")
                todo.append(" ")
            todo += reversed(x.children)
        elif x.tag in BLOCKS:
            out.append(" ")
    return _WHITE.sub(" ", "".join(out)).strip()


def extract(page: str | None) -> str:
    if not page:
        return ""
    return text_below(*content(parse(page)))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages(page_id, url, html, ...).

    Null, empty and text-free pages have an empty text; null ids and urls stay null; repeated rows are extracted
    each; other columns are ignored; an empty table gives an empty one. White space inside a block becomes one
    space, blocks are joined by one.
    """

    small_batches(pages.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [extract(x) for x in texts_of(b, "html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), b.column("url").cast(pa.string()), pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(trimmed(run), "page_id long, url string, text string, n_chars long")
