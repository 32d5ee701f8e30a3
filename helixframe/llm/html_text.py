"""Main text of web pages by tree scoring (operator 5).

A page becomes a small element tree. Each paragraph earns points for its length and its commas and passes them to its
ancestors, half as many to each next one; an element's points are discounted by the share of its text that stands in
links. The best element and those of its siblings that score alike give the text. The work on a page is a plain
function; Spark deals the pages to tasks.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import map_batches

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object xmp".split())
#: Of these one without an end tag takes the rest of the page; any other RAW tag without one is left out alone.
TO_THE_END = frozenset("script style textarea title xmp".split())
BOILERPLATE = frozenset("nav select menu head annotation annotation-xml".split())
#: What is boilerplate unless it holds the text: a form or dialog around the article, an aside that is most of its article.
AROUND, BESIDE = frozenset("form dialog button".split()), frozenset("aside footer".split())
BLOCKS = frozenset("address article blockquote body caption dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main section div body td blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What stays where it stands between chosen siblings.
BETWEEN = HEADINGS | frozenset("p ul ol dl pre table blockquote figure".split())
#: Which open elements an opening tag ends, up to the nearest of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
}

#: Words in class, id or role that mark what is not the article, wherever they stand in a name (comments-list).
_UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promoted cookie cookies consent gdpr popup modal overlay sidebar complementary comment comments disqus "
    "menu nav navbar navigation breadcrumb breadcrumbs footer contentinfo masthead topbar sharing newsletter subscribe signup login toolbar pagination pager widget recommended".split()
)
#: Words that do so only in a name of such words alone (related, related-posts; but not related-work, content-header).
_ALONE = frozenset("banner notice notices alert side header share social related search tags byline replies respond".split())
_BESIDE = _UNLIKELY | _ALONE | frozenset("list box bar section area wrap wrapper container block inner item items links posts articles stories pages buttons icons site page main top bottom left right global more form".split())
#: Of these a paragraph's or heading's class says that it is an advert; other words say nothing of it in an article.
_ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promoted".split())
#: In an article a name counts if it is made of such words alone (post-comments; but not code-widget, login-guide).
_WITHIN = _BESIDE | frozenset("post article entry blog user reader content single list-item".split())
#: Words that turn the meaning of the next (no-sidebar: a layout's name).
_TURNS = frozenset("no not has with without hide show".split())
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+)(>|\Z)", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


def _unlikely(names: str, words_that_count: frozenset[str] = _UNLIKELY, article: bool = False) -> bool:
    for name in re.split(r"\s+", names.lower()):
        words = [w for w in re.split(r"[_-]+", name) if w]
        if article and not all(w in _WITHIN for w in words):
            continue
        for k, w in enumerate(words):
            if w in words_that_count and not (k and words[k - 1] in _TURNS):
                return True
        if words_that_count is _UNLIKELY and any(w in _ALONE for w in words) and all(w in _BESIDE for w in words):
            return True
    return False


class Element:
    __slots__ = ("tag", "parent", "parts", "dropped", "points", "chars", "linked", "commas", "named", "block", "article", "within")

    def __init__(self, tag: str, parent: Element | None, dropped: bool) -> None:
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.parts: list[Element | str] = []
        self.points, self.chars, self.linked, self.commas, self.named = 0.0, 0, 0, 0, False
        self.article: bool = tag in ("article", "main") or (parent is not None and parent.article)
        #: The nearest article or main above, or the root.
        self.within: Element = self if parent is None else parent if parent.tag in ("article", "main") else parent.within
        #: The nearest block at or above.
        self.block = self if parent is None or tag in BLOCKS or tag in ("button", "object") else parent.block


class _Open:
    """The open elements, with the depths of each tag: every step takes constant or logarithmic time at any depth."""

    def __init__(self, root: Element) -> None:
        self.nodes, self.depths = [root], {}

    def push(self, node: Element) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, depth: int) -> None:
        while len(self.nodes) > depth:
            self.depths[self.nodes.pop().tag].pop()

    def last(self, tags) -> int:
        """The depth of the innermost of ``tags``; 0 if none is open."""
        return max((own[-1] for t in tags if (own := self.depths.get(t))), default=0)

    def outermost(self, tags, above: int) -> int:
        """The depth of the outermost of ``tags`` within the element at the depth ``above``; 0 if there is none."""
        found = [own[k] for t in tags if (own := self.depths.get(t)) and (k := bisect_right(own, above)) < len(own)]
        return min(found, default=0)


def parse(html: str) -> tuple[Element, list[Element]]:
    """The root and all elements in page order, in time linear in the page but for a logarithm."""
    root = Element("html", None, False)
    every, at, up, endless = [root], 0, _Open(root), set()
    while m := _MARKUP.search(html, at):
        here = up.nodes[-1]
        if m.start() > at:
            here.parts.append(html[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag or tag == "html" or not m[4]:  # a tag that the page's end cut off says nothing
            continue
        if m[1]:
            if depth := up.last((tag,)):
                up.cut(depth)
            elif tag == "br":
                here.parts.append(" ")
            continue
        alone = m[3].rstrip().endswith("/")
        if tag in RAW and not (alone and tag == "svg"):
            end = None if tag in endless else _end_of(tag).search(html, at)
            if end:
                at = end.end()
            else:
                endless.add(tag)
                at = len(html) if tag in TO_THE_END else at
            continue
        if tag in BLOCKS and here.block.tag == "p":
            up.cut(up.last(("p",)))
        if tag in ENDS:
            ended, within = ENDS[tag]
            if depth := up.outermost(ended, up.last(within)):
                up.cut(depth)
        here = up.nodes[-1]
        if tag in VOID:
            here.parts.append(Element("hr", here, False) if tag == "hr" else " ")
            continue
        inside = here.dropped or tag in BOILERPLATE or (tag in BESIDE and not here.article) or (tag == "header" and not up.last(("article", "main")))
        named = tag in AROUND or tag in BESIDE
        if not inside and m[3] and tag not in ("body", "article", "main"):
            own = here.article and (tag in PARAGRAPHS or tag == "section")
            names = " ".join(x or y or z for kind, x, y, z in _NAMES.findall(m[3]) if not (own and kind.lower() == "id"))
            named |= bool(names and _unlikely(names, _ADVERTS if own and tag != "section" else _UNLIKELY, here.article))
            inside = bool(_HIDDEN.search(m[3]))
        node = Element(tag, here, inside)
        node.named = named
        here.parts.append(node)
        every.append(node)
        if not alone or tag in BLOCKS or tag == "a":
            up.push(node)
    if at < len(html):
        up.nodes[-1].parts.append(html[at:])
    return root, every


@cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I)


def _drop_named(every: list[Element]) -> bool:
    """Drop what its names or tag call no article; tells whether anything went. To be measured anew after that.

    Kept are elements that hold an article or main (an aside or footer does not by that), and, unless half of their text
    stands in links, headings, elements that hold an h1 and those with half of the article's text, or of the page's where
    they stand in none; a form or dialog beside an article goes.
    """
    if not any(n.named and not n.dropped for n in every):
        return False
    holds, titled = set(), set()
    somewhere = any(n.tag in ("article", "main") and n.chars and not n.dropped for n in every)
    for node in every:
        if not node.dropped and node.tag in ("article", "main", "h1"):
            up, found = node.parent, titled if node.tag == "h1" else holds
            while up is not None and id(up) not in found:
                found.add(id(up))
                up = up.parent
    for node in every:
        if node.parent is not None and node.parent.dropped:
            node.dropped = True
        elif node.named and not node.dropped and (id(node) not in holds or node.tag in BESIDE):
            main = node.tag in HEADINGS or (id(node) in titled and node.tag not in AROUND | BESIDE) or 2 * node.chars > node.within.chars
            beside = node.tag in AROUND and somewhere and not node.article
            node.dropped = not main or beside or 2 * node.linked >= node.chars
    for node in every:
        node.points, node.chars, node.linked, node.commas = 0.0, 0, 0, 0
    return True


def _measure(every: list[Element]) -> None:
    """Text length, length in links and commas of each element, without what is dropped; then the points."""
    for node in reversed(every):
        if node.dropped:
            continue
        for part in node.parts:
            if isinstance(part, str):
                text = part.strip()
                node.chars += len(text)
                node.commas += text.count(",")
            elif not part.dropped:
                node.chars += part.chars
                node.linked += part.linked
                node.commas += part.commas
        if node.tag == "a":
            node.linked = node.chars
    for node in every:
        if node.dropped or not node.chars:
            continue
        own = sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        if node.tag in PARAGRAPHS or (own and node.tag in CONTAINERS):
            size, commas = (node.chars, node.commas) if node.tag in PARAGRAPHS else (own, 0)
            points, up = 1 + min(size / 100, 3) + commas, node if node.tag in CONTAINERS else node.parent
            while up is not None and points > 0.01:
                up.points += points
                points, up = points / 2, up.parent
    for node in every:
        if node.chars:
            node.points *= 1 - node.linked / node.chars


def _best(every: list[Element]) -> Element:
    likely = [n for n in every if not n.dropped and n.tag in CONTAINERS and n.chars]
    articles = [n for n in likely if n.tag in ("article", "main")]
    best = max(articles or likely, key=lambda n: n.points, default=every[0])
    inner = max((n for n in likely if n.parent is best and n.points > best.points), key=lambda n: n.points, default=None)
    return best if articles or inner is None else inner


def _blocks(node: Element, out: list[list[str]]) -> None:
    """Append the element's text to ``out``: a list of pieces for each block."""
    if node.dropped:
        return
    stack: list = [(node, iter(node.parts))]
    out.append([])
    while stack:
        here, parts = stack[-1]
        part = next(parts, None)
        if part is None:
            stack.pop()
            if here.tag in BLOCKS:
                out.append([])
        elif isinstance(part, str):
            out[-1].append(part)
        elif not part.dropped and not _link_list(part):
            if part.tag in BLOCKS:
                out.append([])
            stack.append((part, iter(part.parts)))


def _link_list(node: Element) -> bool:
    """A list of bare links: a menu, unless it stands in an article or main, where it may be the article's references."""
    return node.tag in ("ul", "ol", "div", "section") and node.chars > 0 and node.linked >= 0.9 * node.chars and sum(1 for p in node.parts if not isinstance(p, str)) > 2 and not node.article


def _siblings(best: Element) -> list[Element]:
    """The best element and those of its siblings that belong to its text, in page order."""
    if best.parent is None:
        return [best]
    least = max(2.0, best.points / 5)
    same = ("article",) if best.tag == "article" else tuple(CONTAINERS | {"p"})
    around = [n for n in best.parent.parts if n is best or (isinstance(n, Element) and not n.dropped and (n.chars or n.tag in BLOCKS))]
    at = [k for k, n in enumerate(around) if n is best or (n.tag in same and n.points >= least) or (n.tag == "p" and best.tag != "article" and n.chars > 80 and n.linked < 0.25 * n.chars)]
    first = at[0]
    while first and around[first - 1].tag in HEADINGS:
        first -= 1
    taken = set(at)
    return [n for k, n in enumerate(around) if k in taken or (first <= k <= at[-1] and n.tag in BETWEEN and 2 * n.linked < n.chars)]


def _text_of(every: list[Element]) -> str:
    out: list[list[str]] = []
    for node in _siblings(_best(every)):
        _blocks(node, out)
    texts = [" ".join(unescape("".join(pieces)).split()) for pieces in out if pieces]
    return "\n\n".join(t for t in texts if t)


def main_text(html: str | None) -> str:
    """Blocks of the main text, white space within a block made one blank, joined by an empty line."""
    if not html:
        return ""
    _, every = parse(html)
    _measure(every)
    if not _drop_named(every):
        return _text_of(every)
    _measure(every)
    text = _text_of(every)
    if not text:  # nothing but what the names call none: then they say nothing
        _, every = parse(html)
        _measure(every)
        text = _text_of(every)
    return text


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points).

    A null or empty page, or one without text, gives an empty text. Repeated rows each return a row; extra columns are
    ignored; an empty table gives an empty result. Depth and length of a page are unbounded: no recursion, and hostile markup takes
    no more than time in proportion.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_batches(rows, run, "page_id long, url string, text string, n_chars long")
