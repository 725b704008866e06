"""Main text of web pages by tag-path ratios.

Each text run of a page belongs to a root-to-leaf path of tags with their classes and ids. Per path, the length of the text and
its punctuation are summed, over links and all; the two ratios of a path are text per run and punctuation per run. Ratios
are smoothed over neighbouring paths of one parent in page order and fused by their product with a third factor, the evidence of the path's own elements: none for
boilerplate (menus, headers, footers, notices, adverts, forms, comments, by tag, role or name). Paths over a share of the page's mean count as
content, and their nodes are the text. Only short blocks that no path carries, such as titles and list items, are then taken from the container of the
chosen nodes, where they stand among these.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
#: Elements by what they are in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math object canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body br button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
NEVER = frozenset("nav header footer aside form button select option script style noscript template iframe svg math object canvas audio video head menu dialog fieldset textarea search".split())
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
#: Elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|promoted|nav|navbar|navigation|menu\w*|breadcrumbs?|header|masthead|topbar|toolbar|footer|foot|copyright|sidebar|side|aside|rail|widgets?|cookies?|consent|gdpr|notice\w*|newsletter|subscribe\w*|signup|login|popup|modal|overlay|toast|alert|comments?|commentlist|discussion|replies|reply|disqus|respond|social|share|sharing|related|recommend\w*|more-?stories|pagination|pager|tags?|tagcloud|skip-?link|legal|disclaimer|paywall)(?=$|[\s_-])",
    re.I,
)
#: Names that say what a page or container has, not what it is.
LAYOUT = re.compile(r"(?:^|(?<=\s))(?:with|has|no|without|show|hide|single|layout|is)[-_]\S+", re.I)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s"'>]+))?""")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
SPACE = re.compile(r"\s+")
#: A path is content if its fused ratio is at least this share of the page's mean.
SHARE = 0.25
#: Articles are the containers if they hold at least this share of the content text.
NEARLY = 0.9
SECTIONS = frozenset(["article", "main", "section", "div", "body", ""])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are made for text, and those that are judged as one.
TEXTUAL = HEADINGS | frozenset("p li dt dd td th caption figcaption blockquote pre code q summary".split())
LISTS = frozenset("ul ol dl table".split())
TITLES = re.compile(r"(?:^|[\s_-])(?:title|subtitle|headline|heading|subheading)(?=$|[\s_-])", re.I)


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(source)} if source.strip("/ \t\n\r") else {}


class Node:
    __slots__ = ("tag", "path", "parent", "never", "text")

    def __init__(self, tag: str, name: str, parent: Node | None, never: bool):
        self.tag, self.parent, self.never = tag, parent, never
        # elements of one name may be boilerplate here and not there
        self.path = (f"{parent.path}/{name}" if parent else name) + "!" * (never and not (parent and parent.never))
        self.text = 0


def parse(html: str) -> tuple[list[tuple[Node, str, int]], list[Node]]:
    """Text runs (node, text, block number) in page order, and all nodes."""
    root = Node("", "", None, False)
    stack, nodes, out = [root], [root], []
    block, at, length = 0, 0, len(html)
    while at < length:
        m = TOKEN.search(html, at)
        end = m.start() if m else length
        if end > at:
            out.append((stack[-1], html[at:end], block))
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                continue
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                block += 1
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
            continue
        if tag in BLOCK:
            block += 1
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in CLOSES and tag != "p":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES[tag]:
                    del stack[k:]
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table", "select", "menu", "dir"):
                    break
        if tag in VOID:
            continue
        own = attributes(m[3])
        label = f"{own.get('class', '')} {own.get('id', '')}".strip()
        never = stack[-1].never or tag in NEVER or own.get("role", "").lower() in ROLES or "hidden" in own or own.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", ""), re.I))
        if not never and label and tag not in ("html", "body", "article", "main"):
            never = bool(NAMES.search(LAYOUT.sub(" ", label)))
        if own.get("itemprop", "").lower() == "comment":
            never = True
        node = Node(tag, f"{tag}.{label}" if label else tag, stack[-1], never)
        nodes.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(html, at)
            at = close.end() if close else length
            block += tag in BLOCK
            continue
        if not m[0].endswith("/>"):
            stack.append(node)
    return out, nodes


def content_paths(found: list[tuple[Node, str, int]]) -> set[str]:
    """Paths whose smoothed and fused ratios are high enough."""
    order: dict[str, list[float]] = {}
    chosen: dict[str, float] = {}
    for node, text, _ in found:
        size = len(text.strip())
        if not size:
            continue
        if node.never:
            chosen[node.path] = 0.0  # no evidence for it, whatever its ratios
            continue
        s = order.setdefault(node.path, [0.0, 0.0, 0.0])
        s[0] += size
        s[1] += len(PUNCTUATION.findall(text))
        s[2] += 1
    paths = list(order)
    text = [order[p][0] / order[p][2] for p in paths]
    marks = [1 + order[p][1] / order[p][2] for p in paths]

    parents = [p.rpartition("/")[0] for p in paths]

    def smooth(x: list[float]) -> list[float]:
        near = lambda i, j: x[j] if 0 <= j < len(x) and parents[i] == parents[j] else x[i]
        return [(2 * x[i] + near(i, i - 1) + near(i, i + 1)) / 4 for i in range(len(x))]

    chosen |= {p: a * b for p, a, b in zip(paths, smooth(text), smooth(marks), strict=True)}
    mean = sum(chosen.values()) / max(1, len(paths))
    return {p for p, f in chosen.items() if f >= SHARE * mean} if paths else set()


def extract(html: str) -> str:
    """The page's main text: blocks in page order, joined by one space."""
    found, _ = parse(html)
    chosen = content_paths(found)
    # link text says nothing of where the content is, unless there is no other
    for plain in (True, False):
        weight: dict[Node, int] = {}
        total = 0
        for node, text, _ in found:
            if node.path in chosen and not (plain and any(n.tag == "a" for n in above(node))):
                n = len(text.strip())
                total += n
                for up in above(node) if n else ():
                    weight[up] = weight.get(up, 0) + n
        if total:
            break
    if not total:
        return ""
    parts = [n for n in weight if n.tag in ("article", "main") and not any(x.tag in ("article", "main") for x in above(n.parent))]
    if sum(weight[n] for n in parts) < NEARLY * total:
        holders = [n for n in weight if weight[n] == total and (n.tag in SECTIONS or n.tag == "td")]
        deepest = max(holders, key=lambda n: n.path.count("/"))
        # the title may stand beside it: up to the first container, short of the body, that has one
        titled = {up for node, text, _ in found if not node.never and text.strip() and any(n.tag == "h1" for n in above(node)) for up in above(node)}
        parts = [next((n for n in above(deepest) if n in titled and n.tag not in ("body", "html", "")), deepest)]
    roots = set(parts)
    runs = [(k, node, text, block) for k, (node, text, block) in enumerate(found) if (node.path in chosen or not node.never) and any(n in roots for n in above(node))]
    chars: dict[Node, int] = {}
    links: dict[Node, int] = {}
    places = []
    for k, node, text, _ in runs:
        own = []
        for n in above(node):
            own.append(n)
            if n in roots:
                break
        lists = [n for n in own[:-1] if n.tag in LISTS]
        unit = lists[-1] if lists else next((n for n in own if n.tag in BLOCK), own[-1])
        size = len(text.strip())
        chars[unit] = chars.get(unit, 0) + size
        links[unit] = links.get(unit, 0) + (size if any(n.tag == "a" for n in own) else 0)
        places.append((own, unit))
        if node.path in chosen and size:
            last = k
    first = next(k for k, node, text, _ in runs if text.strip() and (node.path in chosen or any(n.tag == "h1" for n in above(node))))
    blocks: dict[int, list[str]] = {}
    for (k, node, text, block), (own, unit) in zip(runs, places, strict=True):
        if node.path in chosen or not text.strip() or among(own, unit, chosen, weight, first < k < last, 2 * links[unit] > chars[unit]):
            blocks.setdefault(block, []).append(text)
    out = (SPACE.sub(" ", unescape("".join(b))).strip() for b in blocks.values())
    return " ".join(b for b in out if b)


def above(node: Node | None) -> Iterator[Node]:
    """The node and those that hold it."""
    while node is not None:
        yield node
        node = node.parent


def among(own: list[Node], unit: Node, chosen: set[str], weight: dict[Node, int], between: bool, linked: bool) -> bool:
    """Whether text of no content path goes with the content; own leads from its node to the container."""
    block = next((n for n in own if n.tag in BLOCK), own[-1])
    if block.path in chosen:
        return True
    if any(n.tag == "h1" or TITLES.search(n.path[n.path.rfind("/") :].partition(".")[2]) for n in own[:-1]):
        return True
    heading = any(n.tag in HEADINGS for n in own[:-1])
    if linked and not heading:
        return False
    section = next((n for n in own if n.tag in SECTIONS), own[-1])
    return (block is own[-1] or any(n.tag in TEXTUAL for n in own[:-1])) and (between or section in weight)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for each row of pages (page_id, url, html).

    A null or empty page has the empty text; markup that is cut off is read as far as it goes. Rows that repeat are
    read each by itself, and other columns are not read. An empty table gives no rows. There is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches, "html"):
            texts = [extract(h or "") for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
