"""The main text of web pages by tag-path ratios.

A page is cut into tags and text runs, and every run becomes a node with its path of block elements from the root.
For each path, text length outside links and punctuation are added up and divided by the path's nodes; along the page, each node's
path ratios are smoothed with its neighbours', averaged by path again and fused by their product.  Paths over a
threshold hold content.  The element that holds the content (an article, the main element, or else the
deepest container with most of it) gives the article's nodes.  Regions that say what they are (navigation, headers, footers, sidebars,
notices, adverts, forms, comments, hidden parts: by element, role or class) weigh nothing and are left out.

A page is handled alone, by one task, in memory in proportion to its length.  A null or empty page has no text; broken
markup is read as far as it goes; repeated pages give equal rows; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.session import ship

#: Share of the best path's score from which a path holds content; share of the content that a container must hold to be entered.
THRESHOLD, MOST = 0.1, 0.8
#: Weights of a node's neighbours at distance 0, 1 and 2 in the smoothing (a Gaussian of deviation 1).
SMOOTHING = (0.399, 0.242, 0.054)
#: Elements open at once, beyond which further ones are read as if they had no tags.
DEEPEST = 512
#: Share of link text from which a node outside content paths is a list of links.
LINKS = 0.5

_NAME = r"[a-zA-Z][^\s/>]*"
#: A tag has at most 256 quoted parts and parts between them, so that a tag which never ends costs no more than that.
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)({_NAME})((?:[^<>\"']++|\"[^\"]{{0,4096}}\"|'[^']{{0,4096}}'|[\"']){{0,256}}+)>|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PUNCTUATION = re.compile("[,.;:!?、。，；：！？]")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base basefont br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript noframes iframe template xmp svg math canvas object audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body center div html main section table tbody td tr".split())
LEAVES_P_OPEN = frozenset("option optgroup legend caption tbody thead tfoot tr td th html head body".split())
#: What an opening tag closes, if it is open inside the elements named second.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

OFF_ELEMENTS = frozenset("head nav header footer aside form fieldset button select option menu dialog search".split())
OFF_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
OFF_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices notification notifications "
    "alert alerts popup modal overlay sidebar sidenav aside menu nav navbar navigation navi breadcrumb breadcrumbs header masthead topbar footer comment comments commentlist disqus reply replies respond "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login search toolbar pagination pager widget widgets copyright disclaimer".split()
)
CONTENT_WORDS = frozenset("article content post entry story main text body page".split())
#: First words of classes that tell what a page has, not what an element is.
ABOUT = frozenset("with has have no not is without hide show js can".split())
#: Elements that a class can make a header; elsewhere the word means a heading, or the head of a table.
HEADERS = frozenset("div section header span".split())
BY_CLASS_NEVER = frozenset("html body main article".split())


@dataclass(slots=True)
class Element:
    name: str
    label: str
    key: int
    off: bool = False
    header: bool = False
    main: int = 0
    inside: bool = False
    link: bool = False


@dataclass(slots=True)
class Node:
    path: tuple[str, ...]
    holders: tuple[int, ...]
    text: str
    linked: int
    score: float = 0.0


@dataclass(slots=True)
class Page:
    nodes: list[Node] = field(default_factory=list)
    elements: dict[int, Element] = field(default_factory=dict)


def _off_class(token: str, name: str) -> bool:
    words = [w.lower() for w in _WORDS.findall(token)]
    if not words or words[0] in ABOUT or words[-1] == "header" and name not in HEADERS:
        return False
    return words[-1] in OFF_WORDS or words[0] in OFF_WORDS and not CONTENT_WORDS.intersection(words)


def _element(name: str, raw: str, key: int, above: Element | None) -> Element:
    inside = above is not None and (above.inside or above.main > 0)
    off, header, main = name in OFF_ELEMENTS, name == "header" and inside, 2 if name == "article" else 1 if name == "main" else 0
    label, link = name, False
    if raw and not raw.isspace():
        given = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(raw)}
        classes = given.get("class", "").split()
        label, link = ".".join([name, *classes]), name == "a" and "href" in given
        role = given.get("role", "").lower()
        tokens = [] if name in BY_CLASS_NEVER else [t for t in (*classes, given.get("id", "")) if t and _off_class(t, name)]
        header = header or bool(tokens) and inside and all(_WORDS.findall(t)[-1].lower() == "header" for t in tokens)
        hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", ""), re.I)
        off = off or bool(tokens) or role in OFF_ROLES or bool(hidden)
        if role == "main" or given.get("itemprop", "").lower() == "articlebody":
            main = max(main, 2 if role != "main" else 1)
    held = above is not None and above.off and not (above.header and name in HEADINGS)
    return Element(name, label, key, off or held, header or bool(above and above.header and above.off), 0 if off or held else main, inside, link or bool(above and above.link))


def parse(text: str) -> Page:
    """The page's text runs, without those of regions that are left out."""
    page, stack, made = Page(), [], 0
    run: list[str] = []
    linked = 0
    at = 0
    block_depth: list[int] = []

    def flush() -> None:
        nonlocal linked
        if run:
            body = " ".join(html.unescape("".join(run)).split())
            if body:
                blocks = [stack[k] for k in block_depth]
                page.nodes.append(Node(tuple(e.label for e in blocks), tuple(e.key for e in blocks), body, linked))
            run.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        del stack[depth:]
        while block_depth and block_depth[-1] >= depth:
            block_depth.pop()

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not (stack and stack[-1].off):
            run.append(piece)
            if stack and stack[-1].link:
                linked += len(piece.strip())

    while at < len(text):
        m = _TOKEN.search(text, at)
        if m is None:
            add(text[at:])
            break
        add(text[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCKS:
                flush()
            lowest = block_depth[-1] if block_depth and name not in BLOCKS else 0
            for depth in range(len(stack) - 1, lowest - 1, -1):
                if stack[depth].name == name:
                    pop_to(depth)
                    break
            continue
        if name in RAW:
            closing = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(text, at)
            end = text.find(">", closing.end()) if closing else -1
            at = len(text) if end < 0 else end + 1
            if name not in ("script", "style"):
                add(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name != "wbr":
                add(" ")
            continue
        if name == "a" and stack and stack[-1].name == "a":
            pop_to(len(stack) - 1)
        if name in BLOCKS:
            flush()
            if name not in LEAVES_P_OPEN:
                for k in range(len(block_depth) - 1, -1, -1):
                    if stack[block_depth[k]].name == "p":
                        pop_to(block_depth[k])
                        break
                    if stack[block_depth[k]].name in ("td", "th", "table"):
                        break
            closes, within = CLOSES.get(name, ((), ()))
            for k in range(len(block_depth) - 1, -1, -1):
                if stack[block_depth[k]].name in closes:
                    pop_to(block_depth[k])
                    break
                if stack[block_depth[k]].name in within:
                    break
        if len(stack) >= DEEPEST:
            continue
        if name in BLOCKS:
            block_depth.append(len(stack))
        made += 1
        element = _element(name, m[3], made, stack[-1] if stack else None)
        stack.append(element)
        if name in BLOCKS:
            page.elements[made] = element
    flush()
    return page


def score(nodes: list[Node]) -> dict[tuple[str, ...], float]:
    """Fused ratios by path: text outside links a node, and punctuation a node, each smoothed along the page."""
    if not nodes:
        return {}

    def ratios(values: list[float]) -> dict[tuple[str, ...], float]:
        total, n = defaultdict(float), defaultdict(int)
        for node, v in zip(nodes, values, strict=True):
            total[node.path] += v
            n[node.path] += 1
        return {p: total[p] / n[p] for p in total}

    def smoothed(of: dict[tuple[str, ...], float]) -> list[float]:
        along = [of[node.path] for node in nodes]
        out = []
        for k in range(len(along)):
            near = [(SMOOTHING[abs(d)], along[k + d]) for d in range(-2, 3) if 0 <= k + d < len(along)]
            out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        return out

    length = ratios(smoothed(ratios([max(0, len(n.text) - n.linked) for n in nodes])))
    marks = ratios(smoothed(ratios([len(_PUNCTUATION.findall(n.text)) if n.linked < len(n.text) else 0 for n in nodes])))
    return {p: length[p] * (1 + marks[p]) for p in length}


def _holder(page: Page, mass: dict[int, float], total: float) -> tuple[int | None, bool]:
    """The element that holds the article, and whether the page marks it as such."""
    for kind in (2, 1):
        marked = [(m, -k) for k, m in mass.items() if page.elements[k].main == kind and m > 0]
        if marked:
            return -max(marked)[1], True
    inside = [(k, m) for k, m in mass.items() if m >= MOST * total and page.elements[k].name in CONTAINERS]
    return (max(inside)[0] if inside else None), False


def article(text: str | None) -> list[str]:
    """The blocks of the page's article, in page order."""
    page = parse(text or "")
    paths = score(page.nodes)
    least = THRESHOLD * max(paths.values(), default=0)
    chosen = {p for p, s in paths.items() if s > 0 and s >= least}
    mass: dict[int, float] = defaultdict(float)
    total = 0.0
    for node in page.nodes:
        if node.path in chosen:
            weight = max(0, len(node.text) - node.linked)
            total += weight
            for key in node.holders:
                mass[key] += weight
    holder, marked = _holder(page, mass, total)
    inside = [n for n in page.nodes if holder is None or holder in n.holders]
    return [n.text for n in inside if marked or n.path in chosen or n.linked < LINKS * len(n.text)]


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = ["\n".join(article(h.as_py())) for h in batch["html"]]
        lengths = [len(t) for t in texts]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(lengths, pa.int64())], schema=_SCHEMA)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (blocks joined by a line feed; empty if none), n_chars (code points) for every page."""
    ship(pages.sparkSession)
    own = pages.selectExpr("CAST(page_id AS bigint) AS page_id", "url", "html")
    return own.mapInArrow(_extracted, "page_id bigint, url string, text string, n_chars bigint")
