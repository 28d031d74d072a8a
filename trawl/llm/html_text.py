"""Main text of web pages by composite text density.

A page becomes a tree without the parts that are never article text; a part that
is known by its class or id only stays in it if it may hold the article. Every node
has a density: its characters per tag, lowered by the share of its text and tags
that are links. The subtree whose children's densities sum up highest is the
article; the smallest density on its path to the body is the threshold that
other subtrees must reach to belong to it.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Element names of HTML and usual names of page parts.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_NEVER = frozenset(
    "head title script style noscript template svg math iframe object canvas audio video button select textarea input option "
    "nav aside footer menu dialog noembed noframes map".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar tablist".split())
_PARTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|advertisement\w*|sponsor\w*|promo\w*|banners?|menus?|navs?|navbar|navigation|navlinks|sidebars?|rail|"
    r"breadcrumbs?|comments?|commentlist|respond|disqus|replies|reply|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletter|"
    r"subscribe|signup|share|sharing|social|related|recommend\w*|widgets?|toolbar|pagination|pager|login|masthead|copyright|disclaimer)(?=$|[\s_-])",
    re.I,
)
#: Adverts and notices, which have texts of their own, and discussions, which hold articles of their own.
_OWN_TEXT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|advertisement\w*|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|copyright|disclaimer)(?=$|[\s_-])", re.I)
_TALK = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|respond|disqus|replies|reply)(?=$|[\s_-])", re.I)
#: Names that say that a part is or is not there, or what a layout is made of, name no part.
_LAYOUT = re.compile(
    r"(?:^|[_-])(?:has|have|no|non|not|with|without|hide)[_-]|[_-](?:free|less|open|closed|enabled|disabled|on|off|layout)$|"
    r"(?:content|main|primary|article)[_-]+(?:sidebars?|rail)[_-]+(?:wrap|wrapper|container|grid|inner|outer)$",
    re.I,
)
_LAYOUT_PART, _OWN_TEXT_PART, _TALK_PART, _FORM_PART = 1, 2, 3, 4
_EDGES = re.compile(r"(?:^|[\s_-])(?:header|footer|topbar|bottombar|site-info)(?=$|[\s_-])", re.I)
#: A start tag of the key ends an open element of the value, up to the nearest table cell, list or section.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LIMITS = frozenset("ul ol dl table td th div section article main body aside nav form blockquote".split())
_P_ENDS = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")

#: An unquoted last value that ends with a slash, as in href=/a/, closes nothing.
_SLASH_IN_VALUE = re.compile(r"=\s*[^\s\"'>]+/\Z")


class Node:
    __slots__ = ("tag", "children", "part", "chars", "tags", "link_chars", "link_tags", "density", "total", "kept", "block")

    def __init__(self, tag: str, part: int = 0) -> None:
        self.tag, self.children, self.part = tag, [], part  # children: nodes and strings, in order; part: what its name says
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.kept = False
        self.block = tag in _BLOCK


def _judged(tag: str, attributes: str, inside_article: bool) -> tuple[bool, int]:
    """Whether an element is a menu, header, footer, sidebar, notice, advert, form, script, style or comments
    by its tag, role or style; and if not, which kind of part it is by its name, 0 for none."""
    if tag in _NEVER or (tag == "header" and not inside_article):
        return True, 0
    kind = _FORM_PART if tag == "form" else 0
    if not attributes or tag in ("html", "body"):
        return False, kind
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return True, 0
    if found.get("role", "").lower() in _ROLES:
        return True, 0
    if kind:
        return False, kind
    names = f"{found.get('class', '')} {found.get('id', '')}"
    if tag == "main" or not (_PARTS.search(names) or _EDGES.search(names)):
        return False, 0
    names = " ".join(n for n in names.split() if not _LAYOUT.search(n))
    if _PARTS.search(names):
        return False, _TALK_PART if _TALK.search(names) else _OWN_TEXT_PART if _OWN_TEXT.search(names) else _LAYOUT_PART
    return False, _LAYOUT_PART if not inside_article and tag != "article" and _EDGES.search(names) else 0


def _drop_parts(root: Node) -> None:
    """Drop the parts that are known by their names only, but for those that may hold the article.

    A part stays, for the densities to decide, if it holds a main, or an article
    that is none of a discussion; if it is the only article; or if it holds most
    of the page's text, discussions aside. Discussions, adverts and notices must
    hold nearly all of it, on a page without an article or main outside of all
    parts. A form stays if it is the wrapper of the page: it holds an article, a main,
    or paragraphs and most of the text. Parts inside a part that stays are judged
    alike. If no text is left, layout parts stay, or else all but forms.
    """
    order, waiting, outside = [], [(root, False)], False
    while waiting:
        node, inside = waiting.pop()
        inside = inside or node.part > 0
        outside |= not inside and node.tag in ("article", "main")
        order.append(node)
        waiting.extend((c, inside) for c in reversed(node.children) if isinstance(c, Node))
    # by node: characters, those of discussions, whether it holds an article, a main or a paragraph
    size, talk, article, main, paragraph = {}, {}, {}, {}, {}
    for node in reversed(order):
        own = [c for c in node.children if isinstance(c, Node)]
        n = sum(size[id(c)] for c in own) + sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        size[id(node)], talk[id(node)] = n, n if node.part == _TALK_PART else sum(talk[id(c)] for c in own)
        paragraph[id(node)] = node.tag == "p" or any(paragraph[id(c)] for c in own)
        main[id(node)] = node.tag == "main" or any(main[id(c)] for c in own)
        article[id(node)] = any(article[id(c)] and c.part != _TALK_PART or c.tag == "article" and not c.part for c in own)
    total, said = size[id(root)], talk[id(root)]

    def stays(node: Node) -> bool:
        i = id(node)
        if not node.part or main[i]:
            return True
        if node.part == _FORM_PART:
            return article[i] or paragraph[i] and size[i] - talk[i] > 0.5 * (total - said)
        if node.part == _TALK_PART:
            return not outside and size[i] > (0.5 if article[i] else 0.9) * total
        if article[i] or node.tag == "article" and not outside:
            return True
        if node.part == _OWN_TEXT_PART and outside:
            return False
        return size[i] - talk[i] > (0.5 if node.part == _LAYOUT_PART else 0.9) * (total - said)

    for fallback in (None, _LAYOUT_PART, _TALK_PART):
        gone, left, waiting = set(), False, [root]
        while waiting:
            node = waiting.pop()
            for c in node.children:
                if isinstance(c, str):
                    left = left or not c.isspace() and c != ""
                elif stays(c) or fallback and c.part <= fallback:
                    waiting.append(c)
                else:
                    gone.add(id(c))
        if left:
            break
    for node in order:
        node.children = [c for c in node.children if id(c) not in gone]


def parse(html: str) -> Node:
    """The page as a tree without dropped parts, named ones too; end tags that are missing or superfluous are put up with."""
    root = Node("body")
    stack, at, article, drop = [root], 0, 0, 0  # drop: depth of the stack where a dropped part began
    named, opened = False, Counter()  # open elements by name: an end tag without one costs no search

    def close_from(i: int) -> None:
        opened.subtract(n.tag for n in stack[i:])
        del stack[i:]

    while True:
        token = _TOKEN.search(html, at)
        if token is None or token.start() > at:
            piece = html[at : token.start()] if token else html[at:]
            if not drop:
                stack[-1].children.append(unescape(piece) if "&" in piece else piece)
        if token is None:
            break
        at = token.end()
        end, tag, attributes = (token[1], token[2], token[3]) if token[2] else (token[4], token[5], token[6])
        if tag is None:
            continue
        tag = tag.lower()
        if end:
            if tag in ("html", "body") or not opened[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    article -= sum(n.tag in ("article", "main") for n in stack[i:])
                    close_from(i)
                    drop = 0 if drop >= i else drop
                    break
            continue
        if tag in ("html", "body"):
            continue
        ends = {"p"} if tag in _P_ENDS else _ENDS.get(tag, ())
        if any(opened[t] for t in ends):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    close_from(i)
                    drop = 0 if drop >= i else drop
                    if tag in ("tr",):
                        continue
                    break
                if stack[i].tag in _LIMITS and not (stack[i].tag in ("td", "th") and "tr" in ends):
                    break
        gone, part = (True, 0) if drop else _judged(tag, attributes, article > 0)
        node = Node(tag, part)
        named = named or part > 0
        if not gone:
            stack[-1].children.append(node)
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            if not gone:
                node.children.append(html[at : close.start() if close else len(html)])
            at = close.end() if close else len(html)
            continue
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCK and not _SLASH_IN_VALUE.search(attributes):
            continue
        stack.append(node)
        opened[tag] += 1
        article += tag in ("article", "main")
        if gone and not drop:
            drop = len(stack) - 1
    if named:
        _drop_parts(root)
    return root


def _measured(root: Node) -> list[Node]:
    """All nodes, parents first, with characters and tags of their subtrees counted."""
    order, waiting = [], [(root, False)]
    linked = {}
    while waiting:
        node, in_link = waiting.pop()
        in_link = in_link or node.tag == "a"
        linked[id(node)] = in_link
        order.append(node)
        waiting.extend((c, in_link) for c in reversed(node.children) if isinstance(c, Node))
    for node in reversed(order):
        in_link = linked[id(node)]
        for c in node.children:
            if isinstance(c, Node):
                node.chars += c.chars
                node.link_chars += c.link_chars
                node.tags += c.tags + 1
                node.link_tags += c.link_tags + (c.tag == "a")
                node.block |= c.block
            else:
                n = len(" ".join(c.split()))
                node.chars += n
                node.link_chars += n if in_link else 0
    return order


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    if not chars:
        return 0.0
    base = log(log(chars / max(chars - link_chars, 1) * link_chars + share * chars + e))
    ratio = chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1)
    return chars / max(tags, 1) * log(max(ratio, 1)) / (base if base > 1e-9 else 1.0)


def _weigh(order: list[Node]) -> None:
    """Densities of all blocks, and their sums over a block's children; text and inline
    elements that stand in a block beside others, or alone, count as one more child."""
    share = order[0].link_chars / max(order[0].chars, 1)
    for node in reversed(order):
        if not node.block:
            continue
        own = [node.chars, node.tags, node.link_chars, node.link_tags]
        node.density = _density(*own, share)
        for c in node.children:
            if isinstance(c, Node) and c.block:
                node.total += c.density
                own = [own[0] - c.chars, own[1] - c.tags - 1, own[2] - c.link_chars, own[3] - c.link_tags - (c.tag == "a")]
        node.total += _density(*own, share)


def _densest(order: list[Node]) -> dict[int, Node]:
    """By node: the one below or at it with the largest sum of child densities, first in page order."""
    best: dict[int, Node] = {}
    for node in reversed(order):
        found = node
        for c in node.children:
            if isinstance(c, Node) and best[id(c)].total > found.total:
                found = best[id(c)]
        best[id(node)] = found
    return best


def _path(order: list[Node], target: Node) -> list[Node]:
    """The nodes from the target up to the root; the root alone for a target without text."""
    if not target.chars:
        return [order[0]]
    above = {id(c): node for node in order for c in node.children if isinstance(c, Node)}
    path = [target]
    while id(path[-1]) in above:
        path.append(above[id(path[-1])])
    return path


def select(root: Node) -> None:
    """Mark the article's subtrees as kept."""
    root.block = True
    order = _measured(root)
    _weigh(order)
    densest = _densest(order)
    best = densest[id(root)]
    threshold = min(n.density for n in _path(order, best))
    best.kept = True
    waiting = [c for c in root.children if isinstance(c, Node)]
    while waiting:
        node = waiting.pop()
        if node.density and node.density >= threshold and not node.kept:
            densest[id(node)].kept = True
            waiting.extend(c for c in node.children if isinstance(c, Node))


def _menu(node: Node) -> bool:
    """A list or section inside the article that is links for the most part."""
    return node.tag in ("ul", "ol", "div", "section", "table", "dl") and node.link_tags > 1 and node.link_chars > 0.6 * node.chars


def blocks(root: Node) -> list[str]:
    """Texts of the kept blocks in page order, white space runs as one space, empty ones left out."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    waiting: list = [(root, False)]
    while waiting:
        node, kept = waiting.pop()
        if node is None:
            close()
            continue
        if isinstance(node, str):
            if kept:
                run.append(node)
            continue
        kept = kept or node.kept
        if kept and node is not root and _menu(node):
            continue
        if node.tag in ("br", "img"):
            run.append(" ")
        block = node.tag in _BLOCK
        if block:
            close()
            waiting.append((None, False))
        waiting.extend((c, kept) for c in reversed(node.children))
    close()
    return out


def main_text(html: str | None) -> str:
    """The article of a page, blocks parted by an empty line; '' if there is none."""
    if not html:
        return ""
    root = parse(html)
    select(root)
    return "\n\n".join(blocks(root))


def with_main_text(pages: DataFrame, html: str = "html", out: str = "main_text") -> DataFrame:
    """pages with the main text of each whole page as a STRING column, never null.

    Null and empty pages give ''. Rows are independent: repeated pages give equal
    texts. A column of that name is replaced; an empty table stays empty.
    """

    def texts(batch: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in batch], pa.string())

    return pages.withColumn(out, F.arrow_udf(texts, "string")(F.col(f"`{html}`")))
