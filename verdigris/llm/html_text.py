"""Main text of HTML pages by composite text density.

For every block of a page's tree the characters for each tag are computed and
adjusted for links; a block's density sum adds those of its children.  The block
of largest sum is the seed of the article, and the least density on its path to
the body is the threshold that the other blocks beside the path must reach.
Headings beside the path, and what lies in the seed's own article or main
element, need only be free of links.

What its tag, role or class names as navigation, advertising, comments and the
like counts in the densities above it, but is no seed and is left out of the
text.  All passes are linear in the size of the page.

Each page is handled on its own, in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What HTML calls blocks, elements without content, and whose start ends an open one.
_BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address details summary fieldset hr center hgroup header footer nav aside form".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_ENDS_P = _BLOCKS - {"html", "body", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "summary"}
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
# Tags, roles and words of class or id that name what isn't the article.
_CUT_TAGS = frozenset("nav footer aside button select dialog menu svg canvas audio video object".split()) | _RAW
_CONTROLS = frozenset("label legend option output datalist".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar share sharing social comment comments disqus reply replies respond related recommended widget pagination pager login search copyright".split()
)
_HEADS = frozenset({"header", "banner"})
#: Of these words, those that stand in other names too: a section on a share of the market, or on related work.
_AMBIGUOUS = frozenset("share sharing social comment comments reply replies respond related recommended notice search copyright menu promotion sponsor sponsored overlay login navigation sidebar".split())
#: Words that say of what kind a part is, not what it is about.
_STRUCTURE = frozenset(
    "a the main page site post posts entry article articles blog news story stories reader readers user users author body content contents text box bar block blocks area list lists item items link links button buttons icon icons "
    "wrapper wrap container inner outer section panel pane group row col column columns grid left right top bottom nav form field input header head title count counts thread tree tools tool plugin js css is has no fixed sticky float mobile desktop small large primary secondary wp fb id ui".split()
)
#: Characters of a part that is kept in spite of its name, and how many times what is left of the page it has.
_LEAST_ARTICLE, _TIMES_LEFT = 400, 4
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")


class _Node:
    __slots__ = ("chars", "children", "cut", "link_chars", "link_tags", "parent", "tag", "tags", "density")

    def __init__(self, tag: str, parent: _Node | None, cut: int):
        self.tag, self.parent, self.cut, self.children = tag, parent, cut, []  # children: nodes and (text, in a link)
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0


def _named(tag: str, attributes: str, in_article: bool) -> int:
    """2: cut for its tag, role or style; 1: cut for its names or as a form, unless it holds the article or most of the text; 0: stays.

    A name made of an ambiguous word and others that are no structure decides nothing.
    """
    if tag in _CUT_TAGS or tag == "header" and not in_article:
        return 2
    if tag == "form":
        return 1
    found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attributes)} if attributes.strip() else {}
    if not found or tag in ("html", "body"):
        return 0
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return 2
    if found.get("role", "").lower() in _CUT_ROLES:
        return 2
    names: set[str] = set()
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = {w.lower() for w in _NAME.findall(name)}
        cut = words & _CUT_WORDS
        if not cut or not cut <= _AMBIGUOUS or words - cut <= _STRUCTURE:
            names |= words
    return 1 if names & _CUT_WORDS or not in_article and names & _HEADS else 0


def parse(page: str) -> _Node:
    """The tree of a page's blocks; inline elements are part of their block."""
    root = here = _Node("html", None, 0)
    stack: list[tuple[str, _Node]] = [("html", root)]  # open elements, with the block that each belongs to
    is_open: Counter[str] = Counter()
    at = 0

    def close_to(depth: int) -> None:
        for t, _ in stack[depth:]:
            is_open[t] -= 1
        del stack[depth:]

    while at < len(page):
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            here.children.append((html.unescape(text), is_open["a"] > 0))
        if not m:
            break
        at = m.end()
        close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            if is_open[tag] > 0:
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                close_to(depth)
                here = stack[-1][1]
            continue
        if tag in _RAW:  # its content is no markup
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in ("html", "body"):
            continue
        if tag in _VOID:
            here.tags += 1
            if tag == "hr":
                here.children.append(_Node(tag, here, 0))
            elif tag in ("br", "img"):
                here.children.append((" ", False))
            continue
        if tag in _ENDS_P and is_open["p"] > 0:
            ends, stops = {"p"}, {"table", "button"}
        else:
            ends, stops = _ENDS.get(tag, ((), ()))
        if any(is_open[t] > 0 for t in ends):
            k = len(stack) - 1
            while k and stack[k][0] not in stops and stack[k][0] not in ends:
                k -= 1
            if k and stack[k][0] in ends:
                close_to(k - (tag == "tr" and stack[k - 1][0] == "tr"))
                here = stack[-1][1]
        here.link_tags += tag == "a"
        cut = _named(tag, attributes, is_open["article"] + is_open["main"] > 0) or 2 * (tag in _CONTROLS and is_open["form"] > 0)
        if tag in _BLOCKS or cut:
            node = _Node(tag, here, cut)
            here.children.append(node)
            here = node
        else:
            here.tags += 1
        if not attributes.endswith("/") or tag in _BLOCKS:
            stack.append((tag, here))
            is_open[tag] += 1
        else:
            here = stack[-1][1]
    return root


def _order(root: _Node) -> list[_Node]:
    """All nodes, parents first; without recursion, as pages may nest deeply."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, _Node))
    return out


def measure(nodes: list[_Node]) -> None:
    """Characters and tags of every node, its links' share of both, and its composite text density: characters a tag, raised where links have a small share."""
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, _Node):
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags
            else:
                n = len(c[0]) - c[0].count(" ")
                node.chars += n
                node.link_chars += n * c[1]
    body = nodes[0]
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        if node.chars:
            tags, plain = max(1, node.tags), max(1, node.chars - node.link_chars)
            base = math.log(node.chars / plain * node.link_chars + share * node.chars + math.e)
            ratio = node.chars / max(1, node.link_chars) * tags / max(1, node.link_tags)
            node.density = node.chars / tags * max(0.0, math.log(max(ratio, 1.0)) / base)


def _decide_cuts(nodes: list[_Node]) -> None:
    """Undo cuts for a name, where what is cut is the article by what it holds.

    That is a part with main, an h1 or an article that isn't cut itself, a form with
    most of the text that isn't cut otherwise, and a part of any name with several
    times the text that would be left of the page, most of it not in links.
    """
    kept: dict[int, int] = {}
    inside: dict[int, int] = {}  # with what is cut for its names alone
    for node in reversed(nodes):
        own = sum(len(c[0]) - c[0].count(" ") for c in node.children if not isinstance(c, _Node))
        inner = own + sum(kept[id(c)] for c in node.children if isinstance(c, _Node))
        kept[id(node)] = inner if not node.cut or node.tag == "form" else 0
        inside[id(node)] = own + sum(inside[id(c)] for c in node.children if isinstance(c, _Node)) if node.cut < 2 else 0
    left = kept[id(nodes[0])]
    holds = set()
    for node in nodes:
        if node.tag in ("main", "h1") or node.tag == "article" and not node.cut:
            up = node.parent
            while up is not None and up.cut < 2 and id(up) not in holds:
                holds.add(id(up))
                up = up.parent
    for node in nodes:
        most = node.cut == 1 and inside[id(node)] >= max(_LEAST_ARTICLE, _TIMES_LEFT * left) and 3 * node.link_chars <= node.chars
        if node.cut == 1 and (id(node) in holds or most or node.tag == "form" and 2 * kept[id(node)] > left):
            node.cut = 0


def _sum(node: _Node) -> float:
    return sum(c.density for c in node.children if isinstance(c, _Node) and not c.cut)


def article(root: _Node) -> None:
    """Leave the main text only in the tree: the subtree of largest density sum, and beside its path to the body the blocks that reach the threshold."""
    nodes = _order(root)
    measure(nodes)
    _decide_cuts(nodes)
    seed, best = root, (0.0, 0)
    todo = [root]
    while todo:  # parents first; of equal sums the first block stays
        node = todo.pop()
        if (mine := (_sum(node), node.chars)) > best:
            seed, best = node, mine
        todo.extend(c for c in reversed(node.children) if isinstance(c, _Node) and not c.cut)
    path = [seed]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(node.density for node in path)
    marked = max((k for k, node in enumerate(path) if node.tag in ("article", "main")), default=-1)

    def stays(c: _Node | tuple[str, bool], inside: bool) -> bool:
        if not isinstance(c, _Node):
            return not c[0].strip() or not c[1] and (inside or len(c[0]) >= threshold)
        return 2 * c.link_chars <= c.chars and (inside or c.tag in _HEADINGS or c.density >= threshold)

    for k, node in enumerate(path[1:], 1):
        node.children = [c for c in node.children if c is path[k - 1] or stays(c, k <= marked)]
    for node in _order(root):
        node.children = [c for c in node.children if not (isinstance(c, _Node) and c.cut)]


def render(top: _Node) -> str:
    """Blocks in page order; white space within a block is one space."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := _SPACE.sub(" ", "".join(run)).strip():
            blocks.append(text)
        run.clear()

    todo: list = [top]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, _Node):
            flush()
            todo.append(None)
            todo.extend(reversed(x.children))
        else:
            run.append(x[0])
    flush()
    return "\n".join(blocks)


def main_text(page: str | None) -> str:
    """The article's text; empty for null and for pages without text."""
    if not page:
        return ""
    root = parse(page)
    article(root)
    return render(root)


def extract(page: Column) -> Column:
    """main_text of a column, in Arrow batches."""

    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages], pa.string())

    return run(page)


def extract_text(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns of each page, text and n_chars (its code points).

    * A null or empty page, and one without text outside of what is cut, has an empty text.
    * Broken markup is read as far as it goes: open elements end with the page, an unfinished tag at its end is left out.
    * Repeated rows are extracted alike; extra columns are ignored; an empty table gives an empty result.
    """
    return pages.select(*keep, extract(F.col(html_col)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
