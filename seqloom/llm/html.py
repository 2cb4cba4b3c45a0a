"""Main text of web pages by tree scoring.

A page is parsed leniently into a tree. Paragraph-like blocks give points, for their length and
their commas, to their parent and, in falling shares, to the ancestors above; a container's points
are discounted by its link density. The best container is kept, with those siblings that score
close to it or read like prose, with unlinked lists, tables, code, quotes and headings between them;
inside an article or main, the siblings of its holders are treated alike. Menus, headers and footers of the page, sidebars, notices, adverts,
forms, comments of readers, scripts and styles are dropped before.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqloom.llm.common import text_of

# Element groups of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp template noscript svg math".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset("body caption html tbody td tfoot th thead tr summary".split())
_DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed footer form iframe input label map math menu meter nav noembed noframes noscript "
    "object option output progress script select style svg template textarea title video head".split()
)
_PARAGRAPHS = frozenset("p pre blockquote li dd dt td th figcaption h1 h2 h3 h4 h5 h6 div section article main".split())
_SAME_CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
    "td": ("td th", ("table", "tr")), "th": ("td th", ("table", "tr")), "option": ("option", ("select",)),
}
_PARTS = frozenset("article section div header hgroup".split())
_HEADINGS = frozenset("h3 h4 h5 h6".split())
_BETWEEN = frozenset("ul ol dl table pre blockquote figure".split())
# Words of class, id and role that name what is not the article.
_ODD = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|promo|promoted|sponsor|sponsored|sidebar|side-bar|menu|menus|"
    r"navbar|nav|navigation|breadcrumb|breadcrumbs|footer|masthead|comment|comments|commentlist|disqus|respond|reply|replies|cookie|"
    r"cookies|consent|gdpr|notice|notices|notification|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|"
    r"social|related|recommended|recommendations|pagination|pager|toolbar|widget|copyright|legal|disclaimer|skip|hidden|search|"
    r"site-header|page-header|topbar|outbrain|taboola|complementary|contentinfo|alert|alertdialog)(?:$|[\s_-])", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text|blog)(?:$|[\s_-])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)|<[!?][^>]*(?:>|\Z)", re.S)
# A quote holds a value only after "="; one that is never closed is a character like others.
_TAG_REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_COMMAS = re.compile("[,،、，]")
_DEEPEST = 512


class Node:
    __slots__ = ("tag", "named", "parent", "children", "depth")

    def __init__(self, tag: str, named: str, parent: Node | None):
        self.tag, self.named, self.parent, self.children = tag, named, parent, []
        self.depth = parent.depth + 1 if parent is not None else 0


def parse(page: str) -> Node:
    """A tree of elements and strings; unclosed elements end where HTML lets them.

    Takes time in proportion to the page. A tag that never ends reaches to the end of the page; elements
    below ``_DEEPEST`` levels become siblings of each other.
    """
    root = here = Node("#page", "", None)
    at, size = 0, len(page)
    endless: set[str] = set()  # elements known to have no end tag further on
    while at < size:
        found = _TOKEN.search(page, at)
        if not found:
            here.children.append(page[at:])
            break
        if found.start() > at:
            here.children.append(page[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        rest = _TAG_REST.match(page, at)
        if rest is None:
            break
        tag, attributes, at = found[2].lower(), rest[1], rest.end()
        if found[1]:
            here = _close(here, tag)
            continue
        here = _make_room(here, tag)
        node = Node(tag, _named(attributes) if "=" in attributes or "hidden" in attributes else "", here)
        here.children.append(node)
        closed = attributes.endswith("/")
        if tag in _RAW and not (tag in ("svg", "math") and closed):
            end = None if tag in endless else re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            if end is not None:
                at = page.find(">", end.end()) + 1 or size
                continue
            endless.add(tag)
            if tag not in ("noscript", "template", "svg", "math", "iframe"):
                break
        elif tag not in _VOID and not (tag in ("svg", "math") and closed) and node.depth < _DEEPEST:
            here = node  # a slash does not close an HTML element
    return root


def _named(attributes: str) -> str:
    """Class, id and role as one string; ``hidden`` where the element is not shown."""
    out = []
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            out.append(value)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            out.append("hidden")
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            out.append("hidden")
    return " ".join(out)


def _make_room(here: Node, tag: str) -> Node:
    """Close what a start tag closes by itself."""
    if tag in _CLOSES_P:
        node = here
        while node.parent is not None and (node.tag == "p" or node.tag not in _BLOCK):
            if node.tag == "p":
                return node.parent
            node = node.parent
    if tag in _SAME_CLOSES:
        closed, stops = _SAME_CLOSES[tag]
        closed, node = closed.split(), here
        out = here
        while node.parent is not None and node.tag not in stops:
            if node.tag in closed:
                out = node.parent
            node = node.parent
        return out
    return here


def _close(here: Node, tag: str) -> Node:
    node = here
    while node.parent is not None and node.tag != tag:
        if tag not in _BLOCK and node.tag in _BLOCK:
            return here  # an inline end tag does not close blocks
        node = node.parent
    return node.parent if node.parent is not None else here


def _unwanted(node: Node) -> bool:
    if node.tag in _DROPPED:
        return True
    if node.tag == "header":
        return not any(up.tag in ("article", "main") for up in _ancestors(node))
    if node.named and node.tag not in ("body", "html", "article", "main"):
        return bool(_ODD.search(node.named)) and not (_GOOD.search(node.named) and _prose(node) > 400)
    return False


def _ancestors(node: Node) -> Iterator[Node]:
    node = node.parent
    while node is not None:
        yield node
        node = node.parent


def _prose(node: Node) -> int:
    """Characters of text in paragraphs below."""
    total, stack = 0, [(node, node.tag == "p")]
    while stack:
        here, inside = stack.pop()
        for child in here.children:
            if isinstance(child, str):
                total += len(child) if inside else 0
            elif child.tag not in _DROPPED:
                stack.append((child, inside or child.tag == "p"))
    return total


def _prune(root: Node) -> None:
    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not _unwanted(c)]
        stack.extend(c for c in node.children if not isinstance(c, str))


def _measure(root: Node) -> dict[Node, tuple[int, int, str]]:
    """Per element: characters of text, characters of it in links, and its own direct text."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if not isinstance(c, str))
    out: dict[Node, tuple[int, int, str]] = {}
    for node in reversed(order):
        own = " ".join(" ".join(c for c in node.children if isinstance(c, str)).split())
        chars, linked = len(own), 0
        for c in node.children:
            if not isinstance(c, str):
                chars += out[c][0]
                linked += out[c][1]
        out[node] = chars, chars if node.tag == "a" else linked, own
    return out


def _inline_text(node: Node) -> str:
    """Text of a block without the blocks in it."""
    out, stack = [], list(reversed(node.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag not in _BLOCK:
            stack.extend(reversed(c.children))
    return " ".join("".join(out).split())


def main_nodes(root: Node) -> list[Node]:
    """The best container and the siblings kept with it, in page order."""
    _prune(root)
    sizes = _measure(root)
    density = lambda n: sizes[n][1] / sizes[n][0] if sizes[n][0] else 0.0
    scored: dict[Node, float] = {}
    for node in sizes:
        if node.tag not in _PARAGRAPHS:
            continue
        text = _inline_text(node)
        if len(text) < 25:
            continue
        points = 1 + len(_COMMAS.findall(text)) + min(len(text) // 100, 3)
        share = 1.0
        for depth, up in enumerate(_ancestors(node)):
            if depth > 4 or up.tag in ("#page", "html"):
                break
            if up not in scored:
                scored[up] = {"article": 12.0, "main": 10.0, "div": 4.0, "section": 4.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0}.get(up.tag, 0.0)
                scored[up] -= 3.0 if up.tag in ("ul", "ol", "dl", "form", "li", "h1", "h2", "h3") else 0.0
                scored[up] += 15.0 if up.named and _GOOD.search(up.named) else 0.0
            scored[up] += points * share
            share = 0.5 if depth == 0 else 1 / (3 * (depth + 1))
    if not scored:
        bodies = [n for n in sizes if n.tag == "body"]
        return bodies[:1] or [root]
    for node in scored:
        scored[node] *= 1 - density(node)
    best = max(scored, key=scored.get)  # equal points: the one met first, which is the outer one
    # An article spread over several parts: its container holds most of the prose.
    while best.parent is not None and best.parent.tag in ("article", "main") and best.tag not in ("article", "main"):
        best = best.parent
    # A sibling needs a fifth of the points of a strong container, but must come close to a weak one.
    top = max(scored[best], 0.0)
    kept, here, limit = [best], best, max(top * 0.2, min(10.0, top * 0.6))

    def close_to_best(node: Node) -> bool:
        text = _inline_text(node)
        prose = node.tag == "p" and (
            (len(text) > 80 and density(node) < 0.25) or (0 < len(text) <= 80 and density(node) == 0 and re.search(r"[.!?]( |$)", text))
        )
        points = scored.get(node, 0.0) + (top * 0.2 if node.named and node.named == best.named else 0.0)
        return bool(0 < points >= limit or prose or node.tag in ("h1", "h2"))

    # The siblings of the best container and, inside an article or main, of what holds it.
    while here.parent is not None and here.tag not in ("body", "html"):
        inside = any(up.tag in ("article", "main") for up in _ancestors(here))
        if here is not best and not inside:
            break
        row = [n for n in here.parent.children if not isinstance(n, str)]
        at = row.index(here)
        chosen = [
            n is here or close_to_best(n) or (inside and n.tag in _PARTS and density(n) < 0.25 and (_prose(n) > 80 or _headed(n))) for n in row
        ]
        first, last = chosen.index(True), len(row) - 1 - chosen[::-1].index(True)
        for i in range(len(row) - 1, -1, -1):
            unlinked = sizes[row[i]][0] > 0 and density(row[i]) < 0.25
            if unlinked and row[i].tag in _BETWEEN and first < i and (i < last or inside):
                chosen[i] = True
            elif unlinked and row[i].tag in _HEADINGS and i + 1 < len(row) and chosen[i + 1]:
                chosen[i] = True  # a heading goes with what it heads
        kept = [n for n, c in zip(row[:at], chosen) if c] + kept + [n for n, c in zip(row[at + 1 :], chosen[at + 1 :]) if c]
        here = here.parent
    return kept


def _headed(node: Node) -> bool:
    """A header or group that holds a main heading."""
    return node.tag in ("header", "hgroup") and any(not isinstance(c, str) and c.tag in ("h1", "h2") for c in node.children)


def blocks(nodes: list[Node]) -> list[str]:
    """The text of each block in page order, with single spaces."""
    out: list[str] = []
    line: list[str] = []

    def end_block() -> None:
        text = " ".join(entities.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    for node in nodes:
        stack: list[Node | str | None] = [node]
        while stack:
            here = stack.pop()
            if here is None:
                end_block()
            elif isinstance(here, str):
                line.append(here)
            elif here.tag in _BLOCK:
                end_block()
                stack.append(None)
                stack.extend(reversed(here.children))
            else:
                if here.tag in ("br", "wbr", "img"):
                    line.append(" " if here.tag == "br" else "")
                stack.extend(reversed(here.children))
        end_block()
    return out


def main_text(page: str | None) -> str:
    """Blocks of the main content joined by line ends; empty for null, empty or textless pages."""
    if not page:
        return ""
    return "\n".join(blocks(main_nodes(parse(page))))


def extract_main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, ``text`` and ``n_chars`` (its code points) of every whole page.

    One row a page, repeated pages and ids included; null, empty and textless pages have an empty
    text. Further columns of ``pages`` are left out, whatever their names.
    """
    rows = pages.select(*[F.col(c) for c in keep], text_of(html).alias("_html"))
    schema = rows.drop("_html").withColumn("text", F.lit("")).withColumn("n_chars", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [main_text(p) for p in part.column(len(keep)).to_pylist()]
                columns = [part.column(i) for i in range(len(keep))]
                counts = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), counts], names=[*keep, "text", "n_chars"])

    return rows.mapInArrow(run, schema)
