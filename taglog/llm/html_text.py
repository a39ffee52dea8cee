"""Main text of web pages by tree scoring.

The page is read into a light tree (tags without an end tag, implied ends, raw script and style content, comments).
Every paragraph gives its ancestors points for its length and its commas, halved at each level up; a container's points
are discounted by its link density and raised where it holds a main heading or is named like an article. The best
container, or the article (main, if there is none) around it, is kept together with those of its siblings that hold few
links, score well or read like its text, and the kept blocks are written in page order.

Blocks are headings, paragraphs, list items, table cells, quotes, preformatted text and loose text between them. Inside
the kept part, navigation, headers, footers, asides, forms, scripts, styles, comments and named furniture are left out.
Names are class, id and role words, compared whole or by their parts (``comment-list``); words that file an entry under a
value (``tag-news``, ``category-social``) or say what stands beside it (``has-sidebar``) are no names of furniture, nor is
an element marked as an entry. A page that has no text left by its names is read again without them.

Time and memory are proportional to the page: every pass over the tree goes through its nodes in order, once.

Defined results: null or empty html, or a page without text, gives the empty string; markup that is cut off or badly
nested is read as far as it goes; text outside any block is a block of its own; repeated rows give repeated rows;
other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from taglog.llm.common import ids_of

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")  # where quotes do not pair up
_HINT = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "select", "xmp", "noframes"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|$)[^>]*>?", re.I) for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "button", "label", "option",
}
_LEFT_OUT = {"nav", "header", "footer", "aside", "form", "button", "menu", "search", "dialog", "head", "fieldset"}
#: Tags whose start ends an open tag of the second set, up to the nearest tag of the third.
_IMPLIED = {
    "li": ({"li", "p"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_ENDS_P = _BLOCK - {"button", "label", "option", "caption", "head", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "summary"}
_BAD = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist community cookie cookies consent disqus footer gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice outbrain pagination pager popup promo related replies respond rss search share sharing sidebar signup skip social sponsor sponsored subscribe taboola toolbar widget widgets "
    "complementary contentinfo alert".split()
)
_BAD_WHOLE = frozenset("tags taglist tag-list tag-links tagcloud tag-cloud post-tags entry-tags".split())
_VALUE = re.compile(r"(?:tag|category|cat|term|topic|author|keyword|label|type|format|status|postid|page-id|has|with|without|no|show|hide|is|not)[-_]|\S*(?:has|with|without|no|show|hide)[-_]", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_ENTRY = frozenset(("hentry", "h-entry", "type-post", "blogposting", "article-body", "articlebody", "post-content", "entry-content", "article-content"))
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|hentry|main|page|post|story|text)(?:$|[\s_-])", re.I)
_HOLDERS = ("p", "pre", "blockquote", "li", "td", "dd", "dt", "figcaption")


def _named_bad(hint: str) -> bool:
    """Whether class, id and role words name page furniture."""
    words = hint.split()
    if any(w.lower() in _ENTRY for w in words):
        return False
    for w in words:
        low = w.lower()
        if low in _BAD_WHOLE or low in _BAD:
            return True
        if not _VALUE.match(w) and any(x.lower() in _BAD for x in _PART.findall(w)):
            return True
    return False


class Node:
    __slots__ = ("tag", "hint", "parent", "score", "chars", "linked", "headed", "named", "out_by_tag", "out_by_name", "inside", "side")

    def __init__(self, tag: str, hint: str, parent: Node | None) -> None:
        self.tag, self.hint, self.parent = tag, hint, parent
        self.score, self.chars, self.linked, self.headed = 0.0, 0, 0, False
        self.named = bool(hint) and _named_bad(hint)
        named = self.named and tag not in ("html", "body", "article", "main")
        self.out_by_tag = tag in _LEFT_OUT or (parent is not None and parent.out_by_tag)
        self.out_by_name = named or (parent is not None and parent.out_by_name)
        self.inside, self.side = False, None


class Block:
    __slots__ = ("node", "text", "linked", "heading")

    def __init__(self, node: Node, text: str, linked: int) -> None:
        self.node, self.text, self.linked = node, text, linked
        self.heading = len(node.tag) == 2 and node.tag[0] == "h" and node.tag[1].isdigit()


def _tokens(html: str) -> Iterator[tuple[int, int, re.Match | None]]:
    """(start, end, tag) of markup, in order; a comment or declaration has no tag. ``send`` a position to go on from there."""
    at, paired = 0, True
    while m := _OPEN.search(html, at):
        token = _TOKEN.match(html, m.start()) if paired else None
        if token is None:
            if html.startswith("<!", m.start()) or html.startswith("<?", m.start()):
                token = _TOKEN.match(html, m.start())
            else:
                token = _PLAIN.match(html, m.start())
                paired = paired and (token is None or not _quoted(token.group(3)))
        if token is None:
            if html.find(">", m.start()) < 0:
                return  # nothing closes from here on
            at = m.start() + 1
            continue
        jump = yield token.start(), token.end(), token if token.group(2) else None
        at = token.end() if jump is None else jump


def _quoted(attributes: str) -> bool:
    return '"' in attributes or "'" in attributes


def blocks_of(html: str) -> tuple[list[Block], list[Node]]:
    """Text blocks in page order, each with its tree node, and all nodes, parents first."""
    node = Node("html", "", None)
    nodes, out, parts = [node], [], []
    open_: dict[str, int] = {"html": 1}  # open elements by tag, so that no search goes up for a tag that is not open
    linked, links = 0, 0

    def close() -> None:
        nonlocal parts, linked
        text = _SPACE.sub(" ", unescape("".join(parts))).strip()
        if text:
            out.append(Block(node, text, min(linked, len(text))))
        parts, linked = [], 0

    def leave(target: Node) -> None:
        """Close elements up to and with ``target``."""
        nonlocal node
        while True:
            open_[node.tag] -= 1
            done, node = node is target, node.parent
            if done:
                return

    at, tokens, jump = 0, _tokens(html), None
    while True:
        try:
            start, end, m = tokens.send(jump)
        except StopIteration:
            start, end, m = len(html), len(html), None
        jump = None
        if start > at:
            text = html[at:start]
            parts.append(text)
            if links:
                linked += len(text.strip())
        at = end
        if start == len(html):
            break
        if m is None:
            continue
        tag = m.group(2).lower()
        if not m.group(1):
            if tag in _RAW:
                raw = _RAW_END[tag].search(html, at)
                at = jump = raw.end() if raw else len(html)
                if tag not in ("svg", "math"):
                    parts.append(" ")
            elif tag == "a":
                links += 1
            elif tag == "br":
                parts.append(" ")
            elif tag in _BLOCK:
                close()
                drop, stop = _IMPLIED.get(tag, ({"p"} if tag in _ENDS_P else set(), {"button", "td", "th", "table"} if tag in _ENDS_P else set()))
                if any(open_.get(d) for d in drop):
                    x, cut = node, None
                    left = sum(open_.get(d, 0) for d in drop)
                    while left and x is not None and x.tag not in stop:
                        if x.tag in drop:
                            cut = x
                            left -= 1
                        x = x.parent
                    if cut is not None and cut.parent is not None:
                        leave(cut)
                hint = " ".join(a or b or c for a, b, c in _HINT.findall(m.group(3))) if m.group(3) and tag not in ("html", "body") else ""
                node = Node(tag, hint, node)
                nodes.append(node)
                open_[tag] = open_.get(tag, 0) + 1
                links = 0
            elif tag in ("hr", "img", "input"):
                parts.append(" ")
        elif tag == "a":
            links = max(0, links - 1)
        elif tag in _BLOCK:
            close()
            if open_.get(tag):
                x = node
                while x.tag != tag:
                    x = x.parent
                if x.parent is not None:
                    leave(x)
            links = 0
    close()
    return out, nodes


def main_text(html: str | None) -> str:
    """The main text of a page, blocks joined by blank lines."""
    if not html:
        return ""
    blocks, nodes = blocks_of(html)
    kept = [b for b in blocks if not b.node.out_by_tag and not b.node.out_by_name]
    return _main(kept or [b for b in blocks if not b.node.out_by_tag], nodes)


def _main(blocks: list[Block], nodes: list[Node]) -> str:
    if not blocks:
        return ""
    for b in blocks:
        b.node.chars += len(b.text)
        b.node.linked += b.linked
        b.node.headed |= b.node.tag == "h1"
        if not b.heading:
            points = (1 + b.text.count(",") + min(len(b.text) / 100, 3)) * (1 - b.linked / len(b.text))
            holder = b.node.parent if b.node.tag in _HOLDERS and b.node.parent is not None else b.node
            holder.score += points
    for x in reversed(nodes):  # children before parents; points are halved at each level
        if x.parent is not None:
            x.parent.chars += x.chars
            x.parent.linked += x.linked
            x.parent.score += x.score / 2
            x.parent.headed |= x.headed

    def value(x: Node) -> float:
        weight = 1.25 if x.tag in ("article", "main") or (x.hint and _GOOD.search(x.hint)) else 1.0
        return x.score * weight * (1.5 if x.headed else 1.0) * (1 - x.linked / max(1, x.chars))

    best = max((x for x in nodes if x.chars), key=value)  # the first of equals
    up = best.parent  # a container that holds clearly more of the text than its best child is the article
    while up is not None and up.tag not in ("body", "html") and value(up) >= 0.75 * value(best):
        best, up = up, up.parent
    article = main = None
    x = best
    while x is not None:
        article, main = x if x.tag == "article" else article, x if x.tag == "main" else main
        x = x.parent
    best = article or main or best
    for x in nodes:
        x.inside = x is best or (x.parent is not None and x.parent.inside)
        x.side = x if x.parent is best.parent else x.parent.side if x.parent is not None else None
    bar = 0.2 * value(best)
    kept: list[str] = []
    for b in blocks:
        side = b.node.side
        if b.node.inside:
            kept.append(b.text)
        elif best.parent is not None and b.node is best.parent:  # loose text beside the container
            if len(b.text) > 80 and b.linked < 0.25 * len(b.text):
                kept.append(b.text)
        elif best.parent is not None and side is not None:
            density = side.linked / max(1, side.chars)
            same = bool(side.hint) and side.hint == best.hint and side.tag == best.tag
            if side.tag in ("p", "h1", "h2", "h3"):
                good = density < 0.25 and (len(b.text) > 80 or b.heading or b.text[-1] in ".!?")
            else:
                good = density < 0.25 and not side.named or (value(side) + (bar if same else 0) >= max(10.0, bar) and density < 0.5)
            if good:
                kept.append(b.text)
    return "\n\n".join(kept)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([ids_of(b, id_col), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kind, url = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"{id_col} {kind}, {url_col} {url}, text string, n_chars long")
