"""Main text of web pages by tag-path ratios.

A page's text is cut into blocks, each with the path of tags from the root to it. For every path the text
length and the punctuation of its blocks are added up; per block of the path they give two ratios, which
are fused into one (less the share of text in links), smoothed along the page, and held against a threshold
from their spread. Paths above it are content; a block counts as content if its path does, or if it stands in
the same container as one (headings, short paragraphs).

Names only weigh: inside an article element the ratio counts more; inside navigation, footers, forms and what is named like
an advert, a notice, a sidebar or readers' comments it counts less, and such a block has to pass by itself, whatever its container. A
name of which only a part says so doesn't weigh on an element that holds most of the page's text, and no class does on an article.
What a browser doesn't show as text (scripts, styles, controls, hidden elements) is left out beforehand.

Paths are numbers, each made of its parent's and a label, so that a page's memory follows its length however deep it is.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movewatch.llm.common import free_name, in_slices

# fixed values of HTML: elements by their role
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("html body td th tr thead tbody tfoot caption option button legend".split())
#: An opening tag ends open elements of these names, up to the nearest of the second group.
ENDS = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"),
    "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "thead": ("thead tbody tfoot tr td th", "table"), "tbody": ("thead tbody tfoot tr td th", "table"),
    "tfoot": ("thead tbody tfoot tr td th", "table"),
}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
#: Elements whose content is no text of the page.
DROPPED = frozenset(
    "head script style noscript template iframe object svg math canvas audio video button select option input "
    "textarea noembed noframes xmp".split()
)
ARTICLE = frozenset("article main".split())
#: Elements that hold blocks; the empty name is the page itself.
HOLDERS = frozenset(["", "html", "body", "div", "article", "main", "section", "td", "center", "header"])
ASIDE = frozenset("nav aside footer form fieldset label menu dialog legend".split())
COMMENTS = re.compile(r"comments?|commentlist|respond|replies|disqus", re.I)
NOISE = re.compile(
    r"ads?|adverts?|advertis\w*|banner|promo\w*|sponsor\w*|side-?bar|menu|nav|navbar|navigation|footer|masthead|topbar|"
    r"cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|subscri\w*|newsletter|signup|sign-up|login|share|sharing|social|"
    r"related|recommend\w*|breadcrumbs?|widget|pagination|pager|search|toolbar|"
    r"skip|copyright|legal|disclaimer|outbrain|taboola",
    re.I,
)
HEADING = re.compile(r"site-?header|page-?header|header|head", re.I)
LAYOUT = re.compile(r"(?:has|with|without|no|is|not)[-_]", re.I)
NOISE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
UNFINISHED = re.compile(r"<(?:[a-zA-Z/][^>]*)?\Z")
PUNCTUATION = re.compile(r"[.,;:!?、。，！？…]")

#: Share of the ratios' spread, and of the greatest ratio, below which a path is not content; and the lowest ratio of content.
SPREAD, GREATEST, FLOOR = 0.5, 0.25, 0.5
#: What names make of a path's ratio: in an article; in what is beside it by its element, role or whole name; by part of a name.
IN_ARTICLE, BESIDE, NAMED = 4.0, 0.05, 0.1
#: The least a block counts that is all links, and the share of a page's text from which part of a name doesn't weigh.
ALL_LINKS, MOST = 0.05, 0.5


@dataclass(slots=True)
class Element:
    name: str
    path: int
    box: int  # place in the stack of the block it is in, itself included
    holder: int  # and of the container
    dropped: bool
    article: bool
    linked: bool
    beside: bool
    named: int  # number of the innermost element around that part of a name weighs on, 0 for none


@dataclass(slots=True)
class Block:
    path: int
    container: int
    article: bool
    beside: bool
    named: int
    text: list[str] = field(default_factory=list)
    linked: int = 0
    weight: float = 1.0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def _label(name: str, attributes: dict[str, str]) -> str:
    return ".".join([name, *attributes.get("class", "").split()[:2]]) + (f"#{attributes['id']}" if "id" in attributes else "")


def _hidden(attributes: dict[str, str]) -> bool:
    return (
        "hidden" in attributes
        or attributes.get("aria-hidden") == "true"
        or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")) is not None
    )


def _beside(name: str, attributes: dict[str, str], in_article: bool) -> tuple[bool, bool]:
    """Whether an element is beside the article by its kind or whole name, and whether part of a name says so."""
    if name in ARTICLE or name in ("html", "body"):
        return False, False
    whole = name in ASIDE or (name == "header" and not in_article) or attributes.get("role", "").lower() in NOISE_ROLE
    if not attributes:
        return whole, False
    # "with-sidebar" and the like name a page's layout, not the part itself
    names = [n for n in f"{attributes.get('class', '')} {attributes.get('id', '')}".split() if not LAYOUT.match(n)]
    parts = [part for n in names for part in re.split("[-_]", n)]
    whole = whole or any(NOISE.fullmatch(n) for n in names) or any(COMMENTS.fullmatch(x) for x in parts)
    part = any(NOISE.fullmatch(x) for x in parts) or (not in_article and name != "header" and any(HEADING.fullmatch(n) for n in names))
    return whole, part


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, without empty ones and what is never shown, weighed by the names around them."""
    out: list[Block] = []
    stack = [Element("", 0, 0, 0, False, False, False, False, 0)]
    paths: dict[tuple[int, str], int] = {}
    around = [0]  # of each element that part of a name weighs on, the next such one around it
    opened: Counter[str] = Counter()
    current: Block | None = None
    at, length = 0, len(page)

    def text(raw: str) -> None:
        nonlocal current
        top = stack[-1]
        if top.dropped or not raw:
            return
        decoded = html.unescape(raw) if "&" in raw else raw
        if current is None:
            if not decoded.strip():
                return
            current = Block(stack[top.box].path, stack[top.holder].path, top.article, top.beside, top.named)
            out.append(current)
        current.text.append(decoded)
        if top.linked:
            current.linked += len(decoded.strip())

    def pop_to(depth: int) -> None:
        nonlocal current
        for e in stack[depth:]:
            opened[e.name] -= 1
            if e.name in BLOCK:
                current = None
        del stack[depth:]

    while at < length:
        found = page.find("<", at)
        if found < 0:
            text(page[at:])
            break
        token = TOKEN.match(page, found)
        if token is None:
            if UNFINISHED.match(page, found):  # cut off within a tag
                text(page[at:found])
                break
            text(page[at : found + 1])
            at = found + 1
            continue
        text(page[at:found])
        at = token.end()
        closing, name, rest = token[1] or token[4], (token[2] or token[5] or "").lower(), token[3] or token[6] or ""
        if not name:
            continue
        if closing:
            if opened[name]:
                pop_to(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            elif name in BLOCK:
                current = None
            continue
        attributes = _attributes(rest) if rest else {}
        if name in VOID:
            if name == "br":
                text(" ")
            elif name == "hr":
                current = None
            continue
        if name in CLOSES_P and stack[stack[-1].box].name == "p":
            pop_to(stack[-1].box)
        if name in ENDS and any(opened[n] for n in ENDS[name][0]):
            ended, bound = ENDS[name]
            depth = len(stack)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in bound:
                    break
                if stack[i].name in ended:
                    depth = i
            pop_to(depth)
        if name in RAW:
            if name in BLOCK:
                current = None
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            at = end.start() if end else length
            close = page.find(">", at)
            at = close + 1 if end and close >= 0 else length
            continue
        top, depth = stack[-1], len(stack)
        if name in BLOCK:
            current = None
        label = _label(name, attributes) if attributes else name
        article = top.article or name in ARTICLE or attributes.get("role") == "main" or attributes.get("itemprop") == "articleBody"
        whole, part = _beside(name, attributes, article)
        if part and not whole:
            around.append(top.named)
        stack.append(Element(
            name,
            paths.setdefault((top.path, label), len(paths) + 1),
            depth if name in BLOCK else top.box,
            depth if name in HOLDERS else top.holder,
            top.dropped or name in DROPPED or _hidden(attributes),
            article,
            top.linked or name == "a",
            top.beside or whole,
            len(around) - 1 if part and not whole else top.named,
        ))
        opened[name] += 1
    for block in out:
        block.text = [" ".join("".join(block.text).split())]
    out = [b for b in out if b.text[0]]
    _weigh(out, around)
    return out


def _weigh(found: list[Block], around: list[int]) -> None:
    """Set what the names around each block make of its ratio."""
    held = [0] * len(around)
    for b in found:
        held[b.named] += len(b.text[0])
    for i in range(len(around) - 1, 0, -1):  # an element comes before those inside it
        held[around[i]] += held[i]
    weighs = [False] * len(around)
    for i in range(1, len(around)):
        weighs[i] = weighs[around[i]] or held[i] <= MOST * held[0]
    for b in found:
        b.weight = (IN_ARTICLE if b.article else 1.0) * (BESIDE if b.beside else NAMED if weighs[b.named] else 1.0)


def ratios(found: list[Block]) -> np.ndarray:
    """The fused ratio of every block's path, smoothed along the page, then weighed by links and names: a neighbour doesn't lift an advert."""
    path = np.unique([b.path for b in found], return_inverse=True)[1]
    count = np.bincount(path)
    length, marks, linked, weight = (
        np.bincount(path, v)
        for v in zip(*[(len(b.text[0]), len(PUNCTUATION.findall(b.text[0])), min(b.linked, len(b.text[0])), b.weight) for b in found])
    )
    fused = np.sqrt(length / count * (1 + marks / count))
    kernel = np.exp(-0.5 * np.arange(-1, 2) ** 2)
    smooth = np.convolve(np.pad(fused[path], 1, mode="edge"), kernel / kernel.sum(), mode="valid")
    return smooth * (np.maximum(1 - linked / length, ALL_LINKS) * weight / count)[path]


def chosen(found: list[Block], ratio: np.ndarray) -> np.ndarray:
    """Which blocks are content, given their ratios."""
    # a path is judged by the mean of its blocks, so that smoothing doesn't cut it in two
    path = np.unique([b.path for b in found], return_inverse=True)[1]
    level = np.bincount(path, ratio) / np.bincount(path)
    top = level.max()
    cut = max(GREATEST * top, min(SPREAD * float(np.std(ratio)), 0.5 * top), FLOOR)
    content = level[path] >= cut
    homes = {b.container for b, c in zip(found, content) if c}
    light = np.array([b.weight < 1.0 for b in found])
    return content | (~light & np.array([b.container in homes for b in found]))


def main_text(page: str | None) -> str:
    """The page's content blocks joined by an empty line; empty for null, empty or textless pages."""
    found = blocks(page or "")
    if not found:
        return ""
    return "\n\n".join(b.text[0] for b, c in zip(found, chosen(found, ratios(found))) if c)


def extract(df: DataFrame, markup: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, ``text`` and ``n_chars`` (code points) of every row of ``df``.

    Null and empty markup give an empty text. Markup cut off within a tag loses only that tag; elements left
    open end with the page.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*batch.schema.names[1:], "text", "n_chars"],
            )

    narrow = df.select(F.col(markup).alias(free_name(df, "_markup")), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[1:])
    return narrow.mapInArrow(in_slices(run), f"{schema}, text string, n_chars long")
