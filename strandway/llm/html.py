"""Main text of HTML pages by tree scoring.

Paragraphs pass points for length and commas to their nearest ancestors, discounted by link density; the best container
and its siblings of worth are kept. Before that, parts that are never the article are cut out of the tree: by tag, by
role, by a class or id that says nothing else or has a word that only such parts have, and by one that has another such
word where the part is mostly links. Other parts whose name merely has such a word stay and only lose points. How long
a part is doesn't matter to that, so no comment section is long enough to be taken for the article; only where nothing
is left on a page do names not count. An ``article``, or else a ``main``, with text of its own comes before any part
outside it; an article inside another one is a reader's, as the standard has it. Work is linear in the length of a page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandway.llm.words import plain

#: A tag ends at the next ">", or isn't one where a "<" outside quotes comes first; so broken markup costs linear time.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^<>]*+)>|<[!?/][^<>]*+>", re.S)
RAW = set("script style title textarea iframe noframes xmp template svg math object noscript select canvas audio video".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
JUNK_TAGS = set("nav footer aside form button fieldset dialog menu head".split())
JUNK_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
JUNK_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer discussion discussions disqus"
    " feedback footer gdpr header hidden legal login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion"
    " recommended related replies reply respond response responses share sharing sidebar signup skip social sponsor sponsored subscribe subscription toast toolbar widget widgets".split()
)
#: Words that only parts outside the article have in a name, words that go with a name without changing what it says,
#: and words of the article itself or of a page's frame, beside which a name says nothing of that kind.
SURE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense breadcrumb breadcrumbs comments cookie cookies disqus gdpr login modal nav navbar newsletter pager pagination"
    " popup sidebar signup sponsor sponsored toolbar".split()
)
WITH_NAMES = set("area articles bar block box button buttons container form group icons inner left links list main media outer panel posts right section site stories top wrapper".split())
#: Names of sections of articles too, so an article's part with such an id alone is its own.
SLUGS = set("copyright disclaimer discussion discussions feedback legal notice notices related response responses".split())
FRAME_NAMES = set("article body col column content entry free grid has layout main no page post row story text template theme with without wrap wrapper".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = set("ul ol dl table article section div body td th form nav aside main".split())
PARAGRAPHS = set("p pre td blockquote li dd h1 h2 h3 h4 h5 h6".split())
STOPS = SCOPES | PARAGRAPHS | set("dt tr th thead tbody".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "parent", "stop", "attrs", "items", "chars", "linked", "score", "junk", "doubt")

    def __init__(self, tag: str, parent: Node | None, attrs: str) -> None:
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.items: list[str | Node] = []
        self.chars, self.linked, self.score, self.junk, self.doubt = 0, 0, 0.0, False, False
        #: The nearest element, itself included, that a search for an open paragraph or row looks at.
        self.stop: Node = self if parent is None or tag in STOPS else parent.stop


def parse(html: str) -> list[Node]:
    """Block elements in page order, the root first. Inline elements only mark which characters are linked."""
    root = Node("body", None, "")
    nodes, here, link, at = [root], root, None, 0
    opened: Counter = Counter()  # open elements by tag, as a closing tag without one closes nothing

    def back(to: Node) -> Node:
        """Close elements up to ``to``, which stays open."""
        up = here
        while up is not to:
            opened[up.tag] -= 1
            up = up.parent
        return to

    def text(piece: str) -> None:
        if piece:
            piece = unescape(piece) if "&" in piece else piece
            here.items.append(piece)
            n = len(piece) - piece.count(" ") if piece.strip() else 0
            here.chars += n
            if link is not None:
                here.linked += n

    while m := MARKUP.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = None
            elif tag not in INLINE and tag not in ("html", "body") and opened[tag] > 0:
                up = here
                while up is not root and up.tag != tag and not (tag == "p" and up.tag in SCOPES):
                    up = up.parent
                if up is not root and up.tag == tag:
                    here = back(up.parent)
                    link = None
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^<>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            here.items.append(" ")
        elif tag == "a":
            link = here
        elif tag in VOID:
            if tag in ("br", "hr"):
                here.items.append(" ")
        elif tag == "body":
            root.attrs = m[3]
        elif tag not in INLINE and tag != "html":
            if tag in CLOSES:
                up = here.stop
                while up is not root and up.tag not in CLOSES[tag] and up.tag not in SCOPES:
                    up = up.parent.stop
                while up.tag in CLOSES[tag]:
                    here = back(up.parent)
                    up = here
            up = here.stop
            while up is not root and up.tag not in SCOPES and up.tag not in PARAGRAPHS:
                up = up.parent.stop
            if up.tag == "p" or (tag in HEADINGS and up.tag in HEADINGS):
                here = back(up.parent)
            here.items.append(child := Node(tag, here, m[3]))
            nodes.append(child)
            if not m[3].rstrip().endswith("/") or tag in PARAGRAPHS:
                here = child
                opened[tag] += 1
    text(html[at:])
    return nodes


def _named(value: str, names: set[str], inside: bool) -> bool:
    """Whether one of the space-separated names consists of ``names`` and words that go with them."""
    for one in value.split():
        parts = {x.lower() for x in NAME_PARTS.findall(one)} - WITH_NAMES
        if parts and parts <= names and not (inside and "header" in parts):
            return True
    return False


def _junk_name(node: Node, name: str, value: str, inside: bool, links: bool) -> bool:
    """Whether a class or id makes a part junk: where the whole name says so or a word of it for certain, outside an
    article also where a word of it may, in a part of mostly ``links``. Headings, and paragraphs by id, are never junk
    in an article."""
    block = node.tag not in PARAGRAPHS
    if inside and (node.tag in HEADINGS or name == "id" and not links and value.strip().lower() in SLUGS):
        return False
    if (block or name == "class") and _named(value, JUNK_NAMES, inside):
        return True
    words = {x.lower() for x in NAME_PARTS.findall(value)}
    if block and not SURE_NAMES.isdisjoint(words) and FRAME_NAMES.isdisjoint(words):
        return True
    if inside or JUNK_NAMES.isdisjoint(words):
        return False
    node.doubt = True
    return links and (block or name == "class")


def _is_junk(node: Node, inside: bool, links: bool, names: bool) -> bool:
    if node.tag in JUNK_TAGS or node.tag == "header" and not inside:
        return True
    if not node.attrs:
        return False
    for name, value in NAMED.findall(node.attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value in JUNK_ROLES or names and name in ("class", "id") and _junk_name(node, name, value, inside, links):
            return True
    return False


def _cut(nodes: list[Node], names: bool = True) -> bool:
    """Mark junk subtrees, by name too unless told otherwise; whether any text is left outside them."""
    whole: dict[int, list[int]] = {id(x): [x.chars, x.linked] for x in nodes}
    for node in reversed(nodes[1:]):
        mine, up = whole[id(node)], whole[id(node.parent)]
        up[0] += mine[0]
        up[1] += mine[1]
    inside = {id(nodes[0]): False}
    for node in nodes[1:]:
        within = inside[id(node)] = inside[id(node.parent)] or node.tag in ("article", "main")
        chars, linked = whole[id(node)]
        node.junk = node.parent.junk or _is_junk(node, within, 2 * linked > chars, names) or node.parent.tag == "header" and node.tag not in HEADINGS
    return any(not x.junk and x.chars > x.linked for x in nodes)


def _article(nodes: list[Node]) -> Node | None:
    """The article of the most points with text of its own, or else such a main part. What is in an article inside it
    is cut from it."""
    for tag in ("article", "main"):
        top: dict[int, Node | None] = {}
        own: dict[int, list[int]] = {}
        for node in nodes:
            up = top.get(id(node.parent)) if node.parent is not None else None
            inner = up is not None and node.tag == tag
            if node.junk or inner or node.parent is not None and id(node.parent) not in top:
                continue  # junk and inner articles have no place
            top[id(node)] = up or (node if node.tag == tag else None)
            if top[id(node)] is not None:
                sums = own.setdefault(id(top[id(node)]), [0, 0])
                sums[0] += sum(len(x) - x.count(" ") for x in node.items if isinstance(x, str) and x.strip())
                sums[1] = max(sums[1], node.score)
        # links are weighed by the part's whole text, which the score has summed up
        found = [x for x in nodes if id(x) in own and top[id(x)] is x and own[id(x)][0] > 0 and 2 * x.linked < x.chars]
        if found:
            best = max(found, key=lambda x: own[id(x)][1])
            for node in nodes:
                if node is not best and node.tag == tag and not node.junk and id(node) not in top:
                    node.junk = True
            return best
    return None


def _score(nodes: list[Node]) -> None:
    """Points go to the parent in full, to the grandparent by half, and by a sixth to the one above; a part with a
    doubtful name gives a quarter of its points."""
    kept = [x for x in nodes if not x.junk]
    for node in kept:
        if node.parent is not None and node.parent.doubt:
            node.doubt = True
        if node.chars and (node.tag in PARAGRAPHS or node.tag in ("div", "section", "article", "main", "body")):
            commas = sum(x.count(",") for x in node.items if isinstance(x, str))
            points = (node.chars >= 25) + commas + min(node.chars / 100, 3) + 0.01
            points *= (1 - node.linked / node.chars) * (0.25 if node.doubt else 1)
            up = node.parent if node.tag in PARAGRAPHS else node
            for part in (1, 1 / 2, 1 / 6):
                if up is not None:
                    up.score += points * part
                    up = up.parent
    for node in reversed(kept[1:]):  # density of whole subtrees
        node.parent.chars += node.chars
        node.parent.linked += node.linked
    for node in kept:
        node.score *= 1 - node.linked / max(node.chars, 1)


def _text(node: Node, out: list[str]) -> None:
    stack: list[Iterator] = [iter(node.items)]
    out.append(" ")
    while stack:
        for item in stack[-1]:
            if isinstance(item, str):
                out.append(item)
            elif not item.junk:
                out.append(" ")
                stack.append(iter(item.items))
                break
        else:
            stack.pop()
            out.append(" ")


def main_text(html: str) -> str:
    """The article of a page; '' where the page has no text outside its junk."""
    nodes = parse(html)
    if not _cut(nodes):
        _cut(nodes, names=False)
    _score(nodes)
    out: list[str] = []
    if (article := _article(nodes)) is not None:
        _text(article, out)
        return " ".join("".join(out).split())
    best = max((x for x in nodes if not x.junk and x.tag not in PARAGRAPHS), key=lambda x: x.score)
    if best.parent is None:
        _text(best, out)
    else:
        for item in best.parent.items:
            if item is best:
                _text(best, out)
            elif isinstance(item, Node) and not item.junk and item.chars and item.linked < item.chars / 4:
                if item.tag in PARAGRAPHS or item.score >= max(1.0, best.score / 5):
                    _text(item, out)
    return " ".join("".join(out).split())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row. Null html is an empty page; repeated rows and null ids give rows of
    their own; other columns, whatever their names, don't matter; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in plain(batch.column(2)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kept = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return kept.mapInArrow(run, "page_id long, url string, text string, n_chars long")
