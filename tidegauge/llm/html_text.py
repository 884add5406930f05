"""Main text of web pages by tree scoring.

Paragraphs earn points for their length and commas and pass them to their ancestors, less with
every level. A container's points are discounted by its link density; the best container is kept
with those of its siblings that read like text. Boilerplate is known by its tags, roles and names.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidegauge.llm.common import col, map_texts

# HTML elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe noscript noembed noframes xmp svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body caption dd dt html legend li option summary tbody td tfoot th thead tr".split())
DROPPED = RAW | frozenset(
    "nav aside footer form button select dialog menu object canvas audio video applet head datalist".split()
)
ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form note".split())
# Parts of class and id names.
NOISE = frozenset(
    "ad ads adbanner adbox adcontainer adframe adslot adspace adunit adwrapper advert adverts advertisement advertising adsense adsbygoogle banner breadcrumb breadcrumbs byline captcha "
    "comment comments commentlist consent cookie cookies disqus disclaimer donate footer gdpr hidden login masthead menu "
    "modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup "
    "privacy promo promoted promotion recommended recommendations related replies respond search share sharing shoutbox "
    "sidebar sidenav signup skip social sponsor sponsored subscribe subscription taboola tags teaser toc toolbar trending "
    "widget widgets".split()
)
TEXT_NAMES = frozenset("article main".split())  # the whole text, whatever else a name says
FRAMES = frozenset("body column container grid inner layout outer page row site wrap wrapper".split())  # may hold it beside noise
READERS = frozenset("comment comments commentlist disqus replies respond".split())
NEGATIONS = frozenset("with has no without is have".split())
HEADER_ENDS = frozenset("header area bar block container inner outer top wrap wrapper".split())
SCORED = frozenset("p pre td blockquote li dd div section article figcaption".split())
START = {"article": 25, "main": 25, "section": 5, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "form": -3, "ol": -3, "ul": -3, "dl": -3, "li": -3}
LEAST_CHARS = 25
LEVELS = 6

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=(?:\s*(?:\"[^\"]*\"|'[^']*'))?)*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_COMMAS = re.compile("[,،、，﹐]")

MAIN = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


class Node:
    """An element with its pieces, elements and text, in order."""

    __slots__ = ("tag", "parent", "pieces", "noise", "frame", "in_text", "chars", "linked", "commas", "points", "level")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.noise = tag, parent, False
        self.frame = parent.frame if parent else None  # the nearest element around that is noise by a frame's name
        self.in_text = tag in ("article", "main") or (parent is not None and parent.in_text)
        self.pieces: list[Node | str] = []
        self.chars = self.linked = self.commas = 0
        self.points = 0.0
        self.level = parent.level + 1 if parent else 0

    def links(self) -> float:
        return self.linked / self.chars if self.chars else 0.0


def _name_is_noise(name: str) -> bool:
    parts = [p.lower() for p in _PARTS.findall(name)]
    if not parts or parts[0] in NEGATIONS or (parts[-1] in TEXT_NAMES and NOISE.isdisjoint(parts[-2:-1]) and not READERS.intersection(parts)):
        return False
    return not NOISE.isdisjoint(parts)


def _name_is_frame(name: str) -> bool:
    """Noise by name, but of a box that may well hold the text too."""
    return _PARTS.findall(name)[-1].lower() in FRAMES


def _name_is_header(name: str) -> bool:
    parts = [p.lower() for p in _PARTS.findall(name)]
    return "header" in parts and parts[0] not in NEGATIONS and parts[-1] in HEADER_ENDS


def _judge(node: Node, attributes: str) -> None:
    """Set whether an element is boilerplate by its tag, role or name."""
    tag, in_text = node.tag, node.parent.in_text
    if node.frame is not None and tag in ("article", "main"):
        _clear(node)
    if tag in DROPPED or (tag == "header" and not in_text):
        node.noise = True
    if node.noise or tag in ("html", "body") or not attributes.strip():
        return
    frames = []
    for name, a, b, c in _ATTR.findall(attributes):
        name, value = name.lower(), a or b or c
        if (
            name == "hidden"
            or (name == "aria-hidden" and value == "true")
            or (name == "role" and value.lower() in ROLES)
            or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        ):
            node.noise = True
        elif name in ("class", "id") and tag not in ("article", "main"):
            if not in_text and any(map(_name_is_header, value.split())):
                node.noise = True
            frames += [_name_is_frame(v) for v in value.split() if _name_is_noise(v)]
    if frames and not node.noise:
        node.noise = True
        if all(frames):
            node.frame = node


def _clear(node: Node) -> None:
    """An article or main element shows that the frames around it are no boilerplate."""
    frame = node.frame
    while frame is not None and frame.noise:
        frame.noise = False
        frame = frame.parent.frame


def parse(html: str) -> Node:
    """Tree of a page; unclosed and misplaced tags are mended as browsers do in the common cases."""
    root = Node("#root", None)
    here, at, open_tags = root, 0, {}

    def leave(node: Node) -> Node:
        open_tags[node.tag] -= 1
        return node.parent

    def close(wanted, stops) -> Node | None:
        """The place after closing the nearest of the wanted elements, if no stop lies before it."""
        if not any(open_tags.get(t) for t in wanted):
            return None
        node = here
        while node.parent is not None and node.tag not in wanted:
            if node.tag in stops:
                return None
            node = node.parent
        if node.parent is None:
            return None
        end, node = node.parent, here
        while node is not end:
            node = leave(node)
        return end

    size = len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if not m:
            here.pieces.append(html[at:])
            break
        if m.start() > at:
            here.pieces.append(html[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            if m.group().startswith("<![CDATA["):
                here.pieces.append(m.group()[9:].removesuffix("]]>"))
            continue
        tag = m.group(2).lower()
        if m.group(1):
            stops = () if tag in BLOCKS and tag != "p" else BLOCKS - {tag}
            here = close({tag}, stops) or here
            continue
        if tag in VOID:
            here.pieces.append(Node(tag, here))
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if tag in CLOSES_P:
            here = close({"p"}, BLOCKS - {"p"}) or here
        if tag in ENDED_BY:
            here = close(ENDED_BY[tag], SCOPES[tag]) or here
        if tag == "body":
            here = close({"head"}, ()) or here
        node = Node(tag, here)
        _judge(node, m.group(3))
        here.pieces.append(node)
        if not m.group(3).rstrip().endswith("/") or tag in BLOCKS:
            open_tags[tag] = open_tags.get(tag, 0) + 1
            here = node
    return root


def _walk(root: Node):
    """Nodes outside boilerplate, parents first."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [x for x in reversed(node.pieces) if isinstance(x, Node) and not x.noise]


def _measure(root: Node) -> list[Node]:
    """Lengths, commas and link text of every node, then the points that paragraphs pass on."""
    nodes = list(_walk(root))
    own: dict[int, tuple[int, int]] = {}
    for node in reversed(nodes):
        chars = commas = 0
        for x in node.pieces:
            if isinstance(x, str):
                chars += len(" ".join(x.split()))
                commas += len(_COMMAS.findall(x))
            elif not x.noise and x.tag not in BLOCKS:
                chars, commas = chars + own.get(id(x), (0, 0))[0], commas + own.get(id(x), (0, 0))[1]
        own[id(node)] = (chars, commas)
        inner = [x for x in node.pieces if isinstance(x, Node) and not x.noise]
        text = sum(len(" ".join(x.split())) for x in node.pieces if isinstance(x, str))
        node.chars = text + sum(x.chars for x in inner)
        node.linked = node.chars if node.tag == "a" else sum(x.linked for x in inner)
    for node in nodes:
        node.points += START.get(node.tag, 0)
    for node in nodes:
        chars, commas = own[id(node)]
        if node.tag in SCORED and chars >= LEAST_CHARS:
            points = 1 + commas + min(3, chars // 100)
            above, level = (node if node.tag in ("div", "section", "article") else node.parent), 0
            while above is not None and level < LEVELS:
                above.points += points / (1, 2, 6, 9, 12, 15)[level]
                above, level = above.parent, level + 1
    return nodes


def _chosen(root: Node) -> list[Node]:
    """The best container and the siblings kept with it, in page order."""
    nodes = _measure(root)
    scored = [n for n in nodes if n.tag in BLOCKS and n.tag not in ("html", "p", "hr") and n.chars]
    value = lambda n: n.points * (1 - n.links())
    if not scored:
        return [root]
    best = max(scored, key=value)  # of equals the first, so the outer one
    if best.chars < LEAST_CHARS:
        return [root]
    top, node = None, best
    while node is not None:
        if node.tag in ("article", "main") and node.links() < 0.5:
            top = node
            if node.tag == "article":
                break
        node = node.parent
    if top is not None:
        best = top
    while best.parent is not None and best.parent.tag in BLOCKS - {"html", "body"} and value(best.parent) >= 0.75 * value(best):
        best = best.parent
    if best.parent is None or best.tag == "body":
        return [best]
    floor, kept = max(10.0, 0.2 * value(best)), []
    for x in best.parent.pieces:
        if not isinstance(x, Node) or x.noise or not (x.chars or x is best):
            continue
        reads = x.tag in ("p", "pre", "blockquote") and x.links() < 0.25 and x.chars >= LEAST_CHARS
        heads = x.tag in ("h1", "h2") and not x.linked and best.tag not in ("article", "main")
        if x is best or reads or heads or (x.tag in BLOCKS and x.links() < 0.5 and value(x) >= floor):
            kept.append(x)
    return kept


def _text(nodes: list[Node]) -> str:
    blocks, line = [], []

    def flush():
        words = " ".join("".join(line).split())
        line.clear()
        if words:
            blocks.append(words)

    for top in nodes:
        todo: list[Node | str | None] = [top]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                line.append(unescape(x) if "&" in x else x)
            elif x.tag == "br":
                line.append(" ")
            elif not x.noise:
                if x.tag in BLOCKS:
                    flush()
                    todo.append(None)
                todo += reversed(x.pieces)
        flush()
    return " ".join(blocks)


def main_text(html: str | None) -> str:
    """Main text of one page; empty without any."""
    return _text(_chosen(parse(html))) if html and html.strip() else ""


def page_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """``keep``, text and n_chars (code points) of every page.

    Null, empty and textless pages have an empty text. Text without any markup is its own main
    text. Repeated rows and null ids are kept as they are; an empty table gives an empty one; kept
    columns named ``text`` or ``n_chars`` are left out.
    """

    def work(pages):
        texts = [main_text(p) for p in pages]
        return [texts, [len(t) for t in texts]]

    out = map_texts(pages, html_col, keep, MAIN, lambda: work)
    return out.select(*[col(c) for c in out.columns])
